"""Suffix-array dedup: every byte covered by a ``SPAN``-byte string that also starts earlier is removed.

Suffixes travel as runs. Each ``SPAN``-byte window is filed under its least ``GRAM``-byte gram by a fixed hash, and
neighbouring windows with the same least gram form one run, so equal windows always meet under one gram and the runs
hold a few bytes for each window instead of ``SPAN``. Grams that occur in one run only can't hold a repeat and go first.
The rest are range-partitioned by the gram's leading bytes with sampled splitters (Spark's range partitioner), a digest
of the run splitting hot grams over neighbouring buckets. Runs that a sample finds very often are first reduced to one
occurrence each, by partial aggregation, so that copies without number never meet in one bucket. A bucket drops repeated runs, sorts the suffixes of the others
by multikey quicksort, eight bytes at a time on the still equal parts, and keeps the first of each equal group. Where a
leading key may go on in the next bucket, the bucket's first occurrences are compared across the boundary.

Order is by doc_id (nulls last, by a hash of their texts), then position; strings are judged on the input. Null text
counts as empty. Rows that share an id count as one document at equal positions, and so do rows without id that share
their text. Matches never cross documents. Other columns are ignored. An empty table gives no rows.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .near_dedup import BASE, mix

SPAN, GRAM = 100, 24
WIDTH = SPAN - GRAM + 1  # grams of a window
SLICE = 1 << 19  # windows that are looked at together
BUCKET_BYTES = 8 << 20
#: One run in so many is looked at to find hot runs, and how often one must be seen to count as hot.
LOOK, HOT = 16, 16
LAST = (1 << 63) - 1
_B = [pow(int(BASE), 1 << i, 1 << 64) for i in range(5)]


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hashes of all GRAM-byte strings: by doubling to 8 and 16, then 16 + 8."""
    h = b.astype(np.uint64) + np.uint64(1)
    parts = {1: h}
    for i, n in enumerate((1, 2, 4, 8)):
        h = h[:-n] * np.uint64(_B[i]) + h[n:]
        parts[2 * n] = h
    eight = parts[8]
    return mix(parts[16][: len(b) - GRAM + 1] * np.uint64(_B[3]) + eight[16 : 16 + len(b) - GRAM + 1])


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours, from running minima of blocks in both directions."""
    n = len(h) - w + 1
    full = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(h)] = h
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def runs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram, start and number of windows of each run; the number is negative if the gram occurs in the run again."""
    grams, starts, counts = [], [], []
    b = np.frombuffer(data, np.uint8)
    for at in range(0, max(0, len(b) - SPAN + 1), SLICE):
        h = gram_hashes(b[at : at + SLICE + SPAN - 1])
        least = sliding_min(h, WIDTH)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        grams.append(least[first])
        starts.append(first + at)
        n = np.diff(np.append(first, len(least)))
        near = np.arange(WIDTH)
        left = first + (h[first[:, None] + near] == least[first][:, None]).argmax(axis=1)
        right = first + n + WIDTH - 2 - (h[(first + n + WIDTH - 2)[:, None] - near] == least[first][:, None]).argmax(axis=1)
        counts.append(np.where(left == right, n, -n))
    if not grams:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(grams), np.concatenate(starts), np.concatenate(counts)


def _runs(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for t in texts:
        rows = []
        for text in t:
            data = (text or "").encode("utf-8")
            g, s, c = runs(data)
            rows.append((len(data), hashlib.sha256(data).hexdigest(), g.view(np.int64), s.astype(np.int32), c.astype(np.int32)))
        yield pd.DataFrame(rows, columns=["n_bytes", "sha", "grams", "starts", "counts"])


def _carriers(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The bytes of the chosen runs, and the leading eight bytes of their gram as an ordered integer."""
    for t, chosen in texts:
        rows = []
        for text, which in zip(t, chosen, strict=True):
            data = (text or "").encode("utf-8")
            found = []
            for x in which:
                s, n = x["s"], x["n"]
                found.append((s, n < 0, data[s : s + abs(n) + SPAN - 1]))
            leads = _leads([p for _, _, p in found], np.array([x["g"] for x in which], np.int64).view(np.uint64))
            rows.append([{"lead": k, "at": s, "again": a, "run": p} for (s, a, p), k in zip(found, leads, strict=True) if k is not None])
        yield pd.Series(rows, dtype=object)


def _leads(pieces: list[bytes], grams: np.ndarray) -> list[int | None]:
    """Ordered leading bytes of each piece's gram; None where the piece hasn't it (another text of a repeated id)."""
    if not pieces:
        return []
    sizes = np.array([len(p) for p in pieces])
    flat = np.frombuffer(b"".join(pieces) + b"\0" * SPAN, np.uint8)
    h = gram_hashes(flat)
    starts = np.cumsum(sizes) - sizes
    out: list[int | None] = []
    for a in range(0, len(pieces), 4096):
        s = starts[a : a + 4096]
        same = h[np.minimum(s[:, None] + np.arange(WIDTH), len(h) - 1)] == grams[a : a + 4096, None]
        off = same.argmax(axis=1)
        ok = same[np.arange(len(s)), off] & (sizes[a : a + 4096] >= SPAN)
        lead = np.zeros(len(s), np.uint64)
        for i in range(8):
            lead = lead << np.uint64(8) | flat[s + off + i].astype(np.uint64)
        ordered = (lead ^ np.uint64(1 << 63)).view(np.int64).tolist()
        out += [x if y else None for x, y in zip(ordered, ok.tolist(), strict=True)]
    return out


def multikey_groups(buffer: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indexes into ``at``, group numbers) of the SPAN-byte strings at ``at`` that another string of their ``group`` equals.

    A multikey quicksort over 8-byte symbols: each round orders the still equal strings by their next symbol and drops
    those that nothing equals any more.
    """
    wide = np.zeros(len(buffer), np.uint64)
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)]).astype(np.uint64)
    for i in range(8):
        wide = wide << np.uint64(8) | padded[i : i + len(buffer)]
    active = np.arange(len(at))
    group = group.copy()
    for depth in range(0, SPAN, 8):
        step = min(depth, SPAN - 8)  # the last symbol overlaps the one before
        key = wide[at[active] + step]
        order = np.lexsort((key, group))
        active, group, key = active[order], group[order], key[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])]) if len(group) else np.empty(0, bool)
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1 if len(group) else new
        active, group = active[many], group[many]
        if not len(active):
            break
    return active, group


def _spans(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that start at (doc, pos) as joined spans."""
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + SPAN)])) if len(doc) else np.empty(0, np.int64)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], pos[first], (pos[last] + SPAN if len(doc) else pos)


def sort_bucket(lead: np.ndarray, doc: np.ndarray, pos: np.ndarray, again: np.ndarray, pieces: list[bytes]) -> tuple[tuple, tuple]:
    """One bucket: spans (doc, start, end) of repeats, and first windows (digest, doc, pos) under the bucket's outer keys."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    order = np.lexsort((pos, doc))
    known: dict[bytes, int] = {}
    own, gone = [], []
    for i in order.tolist():
        (gone if known.setdefault(pieces[i], i) != i else own).append(i)
    gone_, own_ = np.array(gone, np.int64), np.array(own, np.int64)
    whole = (doc[gone_], pos[gone_], pos[gone_] + sizes[gone_])
    _, number = np.unique(lead[own_], return_inverse=True)
    outer = (lead[own_] == lead.min()) | (lead[own_] == lead.max())
    busy = (np.bincount(number)[number] > 1) | again[own_]
    use = own_[busy | outer]
    buffer = np.frombuffer(b"".join(pieces[i] for i in use), np.uint8)
    counts = sizes[use] - SPAN + 1
    base = np.cumsum(sizes[use]) - sizes[use]
    rep = np.repeat(np.arange(len(use)), counts)
    inner = np.arange(len(rep)) - np.repeat(np.cumsum(counts) - counts, counts)
    at, d, p = base[rep] + inner, doc[use][rep], pos[use][rep] + inner
    active, group = multikey_groups(buffer, at, number[busy | outer][rep])
    by = np.lexsort((p[active], d[active], group))
    active, group = active[by], group[by]
    lost = active[1:][group[1:] == group[:-1]]
    # The same place can come twice, from rows that share an id.
    head = active[np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), np.arange(len(group)), 0))][1:][group[1:] == group[:-1]] if len(active) else lost
    lost = lost[(d[lost] != d[head]) | (p[lost] != p[head])]
    spans = _spans(d[lost], p[lost])
    first = np.ones(len(at), bool)
    first[lost] = False
    edge = np.flatnonzero(first & outer[busy | outer][rep])
    data = buffer.tobytes()
    digests = [hashlib.blake2b(data[a : a + SPAN], digest_size=16).digest() for a in at[edge].tolist()]
    # A repeated run at the very place of its first occurrence is the same string, not a repeat.
    kept = np.array([known[pieces[i]] for i in gone], np.int64)
    differ = (doc[gone_] != doc[kept]) | (pos[gone_] != pos[kept]) if len(gone) else np.empty(0, bool)
    return tuple(np.concatenate([x[differ], y]) for x, y in zip(whole, spans, strict=True)), (digests, d[edge], p[edge])


def _bucket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    b = pd.concat(parts, ignore_index=True)
    (d, s, e), (digest, ed, ep) = sort_bucket(b["lead"].to_numpy(), b["id"].to_numpy(), b["at"].to_numpy(np.int64), b["again"].to_numpy(bool), [bytes(x) for x in b["run"]])
    yield pd.DataFrame({"id": d, "s": s, "e": e, "digest": pd.Series([None] * len(d), dtype=object)})
    yield pd.DataFrame({"id": ed, "s": ep, "e": ep + SPAN, "digest": pd.Series(digest, dtype=object)})


def repeated_spans(rows: DataFrame, own: DataFrame) -> DataFrame:
    """(id, s, e) of what goes, from the runs of each row."""
    spark = rows.sparkSession
    flat = rows.select("id", F.explode(F.arrays_zip("grams", "starts", "counts")).alias("x")).select("id", F.col("x.grams").alias("g"), F.col("x.starts").alias("s"), F.col("x.counts").alias("n"))
    shared = flat.groupBy("g").agg(F.sum(F.when(F.col("n") < 0, 2).otherwise(1)).alias("k")).where("k > 1").select("g")
    open_ = flat.join(shared, "g").groupBy("id").agg(F.collect_list(F.struct("g", "s", "n")).alias("chosen"))
    carried = own.join(open_, "id").select("id", F.explode(F.pandas_udf(_carriers, "array<struct<lead:long,at:int,again:boolean,run:binary>>")("text", "chosen")).alias("x")).select("id", "x.*")
    carried = staged(carried, "suffix-runs")
    size = carried.agg(F.sum(F.length("run")).alias("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    seen = carried.where(F.pmod(F.xxhash64("id", "at"), F.lit(LOOK)) == 0).groupBy(F.xxhash64("run").alias("h")).agg(F.count("*").alias("n"))
    hot = staged(seen.where(F.col("n") >= HOT).select("h"), "suffix-hot")  # at most one in LOOK * HOT of the runs; its size decides whether it is broadcast
    marked = carried.join(hot, F.xxhash64("run") == hot["h"], "left")
    often = staged(marked.where("h is not null").drop("h"), "suffix-often")
    firsts = staged(often.groupBy("run").agg(F.min(F.struct("id", "at")).alias("first"), F.first("lead").alias("lead"), F.first("again").alias("again")), "suffix-firsts")
    copies = often.join(firsts.select("run", "first"), "run").where(F.struct("id", "at") != F.col("first")).select("id", F.col("at").cast("long").alias("s"), (F.col("at") + F.length("run")).cast("long").alias("e"))
    once = firsts.select("first.id", "lead", "first.at", "again", "run")
    carried = marked.where("h is null").select(once.columns).unionByName(once)
    dealt = carried.withColumn("part", F.xxhash64("run")).repartitionByRange(parts, "lead", "part").select("lead", "id", "at", "again", "run")
    found = staged(dealt.mapInPandas(_bucket, "id long, s long, e long, digest binary"), "suffix-found")
    inner = found.where("digest is null").select("id", "s", "e")
    edge = found.where("digest is not null")
    first = edge.groupBy("digest").agg(F.min(F.struct("id", "s")).alias("first"), F.count("*").alias("k")).where("k > 1").select("digest", "first")
    across = edge.join(first, "digest").where(F.struct("id", "s") != F.col("first")).select("id", "s", "e")
    return inner.unionByName(across).unionByName(copies)


def _cut(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for t, gone in texts:
        rows = []
        for text, spans in zip(t, gone, strict=True):
            data = (text or "").encode("utf-8")
            out, removed, count, at = [], 0, 0, 0
            for s, e in sorted((x["s"], min(x["e"], len(data))) for x in spans):
                if e <= at and count:
                    continue
                if s > at or not count:
                    count += 1
                    out.append(data[at:s])
                    at = s
                removed += e - at
                at = e
            kept = b"".join([*out, data[at:]])
            rows.append((removed, count, hashlib.sha256(kept).hexdigest(), kept))
        yield pd.DataFrame(rows, columns=["n_removed", "n_spans", "sha", "kept"])


def dedup_suffixes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, where bytes go, ``kept`` of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    late = F.lit(LAST) - F.pmod(F.xxhash64(text), F.lit(1 << 61))  # rows without id come last
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), late).alias("id"), "doc_id", text.alias("text"))
    rows = staged(own.select("id", "doc_id", F.pandas_udf(_runs, "n_bytes long, sha string, grams array<long>, starts array<int>, counts array<int>")("text").alias("r")).select("id", "doc_id", "r.*"), "suffix-rows")
    spans = repeated_spans(rows, own.select("id", "text")).groupBy("id").agg(F.collect_list(F.struct("s", "e")).alias("gone"))
    spans = staged(spans, "suffix-spans")
    cut = own.join(spans, "id").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.pandas_udf(_cut, "n_removed long, n_spans long, sha string, kept binary")("text", "gone").alias("r")).select("doc_id", "n_bytes", "r.*")
    whole = rows.join(spans.select("id"), "id", "left_anti").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "sha", F.lit(None).cast("binary").alias("kept"))
    return cut.unionByName(whole).withColumnRenamed("sha", "kept_sha256")


def suffix_digest(docs: DataFrame) -> DataFrame:
    """op4: what goes from each row and the digest of what is left."""
    return dedup_suffixes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
