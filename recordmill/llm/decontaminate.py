"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An item of L characters occurs in a text if some part of the text lies within k = floor(L * ``edits``) edits of it. Such
a part shares at least L - q + 1 - k*q of the item's q-grams with it, on at most k + 1 neighbouring diagonals, so one of
the overlapping bands of 2(k + 1) diagonals holds them all. Bands that reach the bound are verified by a banded
alignment of the whole item with free ends in the text.

Case is ignored and each white-space character counts as a space; positions are code points of the text. Items shorter
than ``shortest`` characters say too little for edits, so they are found only as they are and between word ends; blank
ones never. Null texts and items count as empty; items without an id are searched for and reported with a null id.
Occurrences are of whole items: a part of an item is no leak. Every row of a repeated id is searched; extra columns are
ignored. The benchmark is indexed in blocks of bounded size, each against all documents; the index of one block is what
is sent to the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

Q = 8
MULTIPLIER = 0x9E3779B97F4A7C15
#: White space other than the blank.
SPACES = (9, 10, 11, 12, 13, 0x85, 0xA0, 0x2028, 0x2029)
TABLE_BITS = 22


def codes(text: str | None) -> np.ndarray:
    """Code points in lower case, each white-space character a blank; one for each of the text's."""
    text = text or ""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    for x in SPACES:
        c[c == x] = 32
    return c


def grams(c: np.ndarray) -> np.ndarray:
    """64-bit hashes of the Q-grams, by doubling."""
    if len(c) < Q:
        return np.empty(0, np.uint64)
    h, n, m = c.astype(np.uint64) + np.uint64(1), 1, MULTIPLIER
    while n < Q:
        h = h[:-n] * np.uint64(m) + h[n:]
        n, m = 2 * n, m * m % (1 << 64)
    h = h ^ (h >> np.uint64(29))
    return h * np.uint64(MULTIPLIER)


def plain(c: np.ndarray) -> str:
    return c.tobytes().decode("utf-32-le", "surrogatepass")


def whole_words(finder: ahocorasick.Automaton, text: str) -> list[tuple[int | None, int, int, int]]:
    """(item_id, start, end, 0) of the finder's items between word ends; overlapping ones of an item count once."""
    out, ends = [], {}
    for last, (item, ids) in finder.iter(text):
        start, end = last + 1 - len(item), last + 1
        outside = (start == 0 or not (text[start - 1].isalnum() and item[0].isalnum())) and (end == len(text) or not (text[end].isalnum() and item[-1].isalnum()))
        if outside and start >= ends.get(item, 0):
            ends[item] = end
            out += [(i, start, end, 0) for i in ids]
    return out


def finder(index: Index) -> ahocorasick.Automaton | None:
    if not index.short:
        return None
    a = ahocorasick.Automaton()
    for item, ids in index.short.items():
        a.add_word(item, (item, ids))
    a.make_automaton()
    return a


@dataclass
class Index:
    ids: list[int | None]
    items: list[np.ndarray]
    budget: np.ndarray
    bound: np.ndarray  # indexed grams that an occurrence shares at least
    hashes: np.ndarray  # sorted distinct
    starts: np.ndarray  # of each hash's postings, one more at the end
    which: np.ndarray
    where: np.ndarray
    table: np.ndarray  # which top bits occur
    short: dict[str, list[int | None]] = field(default_factory=dict)  # items that must occur as they are


def build(rows: list[tuple[int, str]], edits: float, shortest: int) -> Index:
    coded = [(i, codes(t)) for i, t in rows]
    kept = [(i, c) for i, c in coded if len(c) >= max(shortest, Q)]
    short: dict[str, list[int | None]] = {}
    for i, c in coded:
        if len(c) < max(shortest, Q) and (t := plain(c).strip()):
            short.setdefault(t, []).append(i)
    items = [t for _, t in kept]
    length = np.array([len(t) for t in items], np.int64)
    budget = (length * edits).astype(np.int64)
    parts = [grams(t) for t in items]
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    bound = np.maximum(1, length - Q + 1 - budget * Q)
    # An item's commonest grams may stay out of the index if its bound falls by as many: two thirds of it at most.
    times = np.unique(flat, return_inverse=True, return_counts=True)
    often = times[2][times[1]] if len(flat) else np.empty(0, np.int64)
    keep, at = np.ones(len(flat), bool), 0
    for i, p in enumerate(parts):
        own = often[at : at + len(p)]
        out = np.argsort(-own, kind="stable")[: 2 * bound[i] // 3]
        out = out[own[out] > 1]
        keep[at + out] = False
        bound[i] -= len(out)
        at += len(p)
    which = np.repeat(np.arange(len(items)), [len(p) for p in parts]).astype(np.int32)
    where = np.concatenate([np.arange(len(p)) for p in parts]).astype(np.int32) if parts else np.empty(0, np.int32)
    flat, which, where = flat[keep], which[keep], where[keep]
    order = np.argsort(flat, kind="stable")
    hashes, starts = np.unique(flat[order], return_index=True)
    table = np.zeros(1 << TABLE_BITS, bool)
    table[hashes >> np.uint64(64 - TABLE_BITS)] = True
    return Index([i for i, _ in kept], items, budget, bound, hashes, np.append(starts, len(flat)), which[order], where[order], table, short)


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best part of ``text`` for ``item`` on diagonals low..high; the earliest end among ties."""
    n, width = len(item), high - low + 1
    big = len(item) + len(text) + 1
    diagonal = np.arange(low, high + 1)
    ok = (diagonal >= 0) & (diagonal <= len(text))
    cost, start = np.where(ok, 0, big), diagonal.copy()
    step = np.arange(width)
    for i in range(n):
        at = diagonal + i
        inside = (at >= 0) & (at < len(text))
        match = np.zeros(width, bool)
        match[inside] = text[at[inside]] == item[i]
        new, origin = cost + ~match, start
        new = np.where(inside, new, big)
        up = np.append(cost[1:], big) + 1  # the item's character has no counterpart
        take = up < new
        new, origin = np.where(take, up, new), np.where(take, np.append(start[1:], 0), origin)
        new = np.where((at + 1 >= 0) & (at + 1 <= len(text)), new, big)
        # A text character without counterpart moves one diagonal to the right.
        least = np.minimum.accumulate(new - step)
        from_ = np.maximum.accumulate(np.where(new - step == least, step, 0))
        cost, start = least + step, origin[from_]
        cost = np.where((at + 1 >= 0) & (at + 1 <= len(text)), cost, big)
        if cost.min() > budget:
            return None
    best = int(cost.argmin())
    return int(cost[best]), int(start[best]), int(diagonal[best] + n)


def search(index: Index, text: str | None, exact: ahocorasick.Automaton | None = None) -> list[tuple[int | None, int, int, int]]:
    """(item_id, start, end, edits) of the occurrences in one text; overlapping ones of an item count once."""
    c = codes(text)
    short = whole_words(exact, plain(c)) if exact is not None else []
    return sorted(short + _long(index, c), key=lambda x: (x[0] is None, x[0] or 0, *x[1:]))


def _long(index: Index, c: np.ndarray) -> list[tuple[int | None, int, int, int]]:
    h = grams(c)
    if not len(h) or not len(index.hashes):
        return []
    at = np.flatnonzero(index.table[h >> np.uint64(64 - TABLE_BITS)])
    place = np.minimum(np.searchsorted(index.hashes, h[at]), len(index.hashes) - 1)
    hit = index.hashes[place] == h[at]
    at, place = at[hit], place[hit]
    if not len(at):
        return []
    counts = index.starts[place + 1] - index.starts[place]
    total = int(counts.sum())
    post = np.repeat(index.starts[place] - (np.cumsum(counts) - counts), counts) + np.arange(total)
    item = index.which[post].astype(np.int64)
    diagonal = np.repeat(at, counts) - index.where[post]
    width = index.budget[item] + 1
    longest = max(map(len, index.items))
    band = (diagonal + 2 * longest) // width
    spread = np.int64(4 * longest + len(c) + 4)
    cells, held = np.unique(item * spread + band, return_counts=True)
    # A band is a cell and the next one; a region's diagonals lie within one of the two bands that begin around them.
    keys = np.unique(np.concatenate([cells, cells - 1]))
    count = lambda k: np.where(cells[(x := np.minimum(np.searchsorted(cells, k), len(cells) - 1))] == k, held[x], 0)
    n = count(keys) + count(keys + 1)
    found: dict[int, list[tuple[int, int, int]]] = {}
    last = -2
    for k in keys[n >= index.bound[keys // spread]].tolist():
        if k == last + 1:  # two bands in a row are verified together: occurrences that near overlap
            last = -2
            continue
        last = k
        i, b = divmod(k, int(spread))
        w, budget, wanted = int(index.budget[i]) + 1, int(index.budget[i]), index.items[i]
        low = b * w - 2 * longest - budget
        high = low + 3 * w - 1 + 2 * budget
        part = c[max(0, low) : max(0, high + len(wanted))]
        same = part.tobytes().find(wanted.tobytes())
        if same >= 0 and same % 4 == 0:
            got = (0, max(0, low) + same // 4, max(0, low) + same // 4 + len(wanted))
        else:
            got = align(wanted, c, low, high, budget)
        if got:
            found.setdefault(i, []).append(got)
    out = []
    for i, spans in found.items():
        chosen: list[tuple[int, int, int]] = []
        for edits, start, end in sorted(set(spans)):
            if all(end <= s or start >= e for _, s, e in chosen):
                chosen.append((edits, start, end))
        out += [(index.ids[i], start, end, edits) for edits, start, end in chosen]
    return out


def _search_udf(index: Index):
    shared = index

    @F.pandas_udf("array<struct<item_id:long,start:int,end:int,edits:int>>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        exact = finder(shared)
        for t in texts:
            yield pd.Series([[{"item_id": i, "start": s, "end": e, "edits": d} for i, s, e, d in search(shared, x, exact)] for x in t], dtype=object)

    return run


def blocks(benchmark: DataFrame, edits: float, shortest: int, block_chars: int) -> Iterator[Index]:
    """Indexes of the benchmark, each over about ``block_chars`` characters."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-total // block_chars))
    for b in range(count):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b).orderBy("item_id", "text").collect()
        yield build([(r["item_id"], r["text"]) for r in some], edits, shortest)


def find_leaks(docs: DataFrame, benchmark: DataFrame, edits: float = 0.08, shortest: int = 24, block_chars: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, start, end, edits) of every occurrence of a benchmark item in a document."""
    found = []
    for index in blocks(benchmark, edits, shortest, block_chars):
        hits = docs.select("doc_id", F.explode(_search_udf(index)(F.col("text").cast("string"))).alias("x"))
        found.append(staged(hits.select("doc_id", "x.*"), "leaks"))
    return reduce(DataFrame.unionByName, found)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, edits: float = 0.08, shortest: int = 24, block_chars: int = 2_000_000) -> DataFrame:
    """Stage: the documents without an occurrence; columns as in ``docs``."""
    for index in blocks(benchmark, edits, shortest, block_chars):
        docs = docs.where(F.size(_search_udf(index)(F.coalesce(F.col("text").cast("string"), F.lit("")))) == 0)
    return docs
