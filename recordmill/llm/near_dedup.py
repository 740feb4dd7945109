"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

Words are the ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case; a document's set holds its distinct word
shingles (four words unless said otherwise), or its whole word sequence if it has fewer. Equal sets are one node, found
by a 128-bit digest. The band keys of ``BINS`` bins, ``ROWS`` to a band, choose candidates: at a Jaccard similarity of
0.8 a pair is missed with probability (1 - 0.8**4)**32, about 5e-8. Links are confirmed on the full sets.

Null, empty and blank texts have no shingles, are linked with nothing and keep themselves. A null id never names a
component unless its component has no other id. Repeated rows get equal results. Other columns are ignored.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import classes

BINS, ROWS = 128, 4
#: 64-bit words of a set's parity bitmap.
MARKS = 16
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values: the splitmix64 finaliser
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Texts are hashed together up to so many bytes.
CHUNK = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


#: For an empty bin, the bins to borrow from in turn: one random sequence for each bin.
TRIES = np.random.default_rng(11).integers(0, BINS, (BINS, 4096))


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, held, words = at, 0, []
        while end < len(texts) and (held == 0 or held < CHUNK):
            words.append(texts[end].encode("utf-8", "surrogatepass").lower().split())
            held += len(texts[end]) + 1
            end += 1
        flat = np.empty(sum(map(len, words)), object)
        flat[:] = [w for ws in words for w in ws]
        h = pd.util.hash_array(flat, categorize=False) if len(flat) else np.empty(0, np.uint64)
        start = 0
        for ws in words:
            one = h[start : start + len(ws)]
            start += len(ws)
            n = min(size, len(one))
            acc = np.full(max(0, len(one) - n + 1) if n else 0, np.uint64(n), np.uint64)
            for i in range(n):
                acc = mix(acc * BASE + one[i : i + len(acc)])
            out.append(np.unique(acc))
        at = end
    return out


def signature(h: np.ndarray) -> np.ndarray:
    """One minimum for each bin of the hash range; empty bins borrow along TRIES."""
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(57)
    first = np.searchsorted(h, edges)
    value = h[np.minimum(first, len(h) - 1)]
    filled = (first < len(h)) & ((value >> np.uint64(57)) == np.arange(BINS, dtype=np.uint64))
    out, missing = value.copy(), np.flatnonzero(~filled)
    for t in range(TRIES.shape[1]):
        if not len(missing):
            break
        from_ = TRIES[missing, t]
        ok = filled[from_]
        out[missing[ok]] = value[from_[ok]]
        missing = missing[~ok]
    out[missing] = h[0]
    return out


def band_keys(h: np.ndarray) -> np.ndarray:
    sig = signature(h).reshape(-1, ROWS)
    key = np.arange(len(sig), dtype=np.uint64) + np.uint64(1)
    for r in range(ROWS):
        key = mix(key * BASE + sig[:, r])
    return key.view(np.int64)


def parities(h: np.ndarray) -> np.ndarray:
    """A bitmap in which each element flips one bit: two sets differ in no fewer elements than their bitmaps in bits."""
    odd = np.bincount((h & np.uint64(64 * MARKS - 1)).astype(np.int64), minlength=64 * MARKS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _sketch(size: int):
    @F.pandas_udf("n long, node binary, bands array<long>, marks array<long>")
    def sketch(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            sets = shingle_sets(list(t.fillna("")), size)
            yield pd.DataFrame({"n": [len(h) for h in sets], "node": [hashlib.md5(h.tobytes()).digest() if len(h) else None for h in sets], "bands": [band_keys(h) if len(h) else np.empty(0, np.int64) for h in sets], "marks": [parities(h) for h in sets]})

    return sketch


def _hashes(size: int):
    @F.pandas_udf("node binary, hashes array<long>")
    def hashes(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            sets = shingle_sets(list(t.fillna("")), size)
            yield pd.DataFrame({"node": [hashlib.md5(h.tobytes()).digest() if len(h) else None for h in sets], "hashes": [h.view(np.int64) for h in sets]})

    return hashes


def near_duplicates(docs: DataFrame, shingle: int = 4, percent: int = 80, text: Column | None = None, row: Column | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``; with ``row``, by which rows of one id differ, also that and ``only``, whether it is the row of its component that stays."""
    key = [] if row is None else [row.alias("row")]
    own = docs.select("doc_id", (F.col("text") if text is None else text).cast("string").alias("text"), *key)
    key = [] if row is None else ["row"]
    rows = staged(own.select("doc_id", *key, _sketch(shingle)("text").alias("s")).select("doc_id", *key, "s.*"), "near-sketch")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.min("n").alias("size"), F.min("marks").alias("marks"), *[F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("head") for _ in key])
    nodes = staged(nodes, "near-nodes")
    # One row's bands for each node: rows of one node have equal bands, so the row of the smallest id serves.
    banded = rows.select("doc_id", "node", "bands").join(nodes, (rows["node"] == nodes["node"]) & rows["doc_id"].eqNullSafe(nodes["first"]))
    buckets = banded.select(rows["node"], F.explode("bands").alias("bucket")).distinct()

    def possible(x: str, y: str) -> Column:
        sx, sy = F.col(f"{x}size"), F.col(f"{y}size")
        differ = sum((F.bit_count(F.col(f"{x}marks")[i].bitwiseXOR(F.col(f"{y}marks")[i])) for i in range(MARKS)), F.lit(0))
        return (F.least(sx, sy) * 100 >= F.greatest(sx, sy) * percent) & (differ * (100 + percent) <= (sx + sy) * (100 - percent))

    def similar(pairs: DataFrame) -> DataFrame:
        pairs = staged(pairs, "near-pairs")
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        ids = wanted.join(nodes, "node").select(F.col("first").alias("doc_id")).distinct()
        # Staged, so that only these texts are hashed again.
        texts = staged(own.join(ids, own["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select("text"), "near-texts")
        sets = texts.select(_hashes(shingle)("text").alias("h")).select("h.*").where("node is not null")
        sets = staged(sets.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes")), "near-sets")
        a, b = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
        both = pairs.join(b, "b").join(a, "a").withColumn("i", F.size(F.array_intersect("ha", "hb")))
        return both.where(F.col("i") * 100 >= (F.size("ha") + F.size("hb") - F.col("i")) * percent).select("a", "b")

    labels = classes(buckets, nodes.select("node", "size", "marks"), possible, similar, "near")
    of_node = nodes.join(labels.withColumnRenamed("v", "node"), "node", "left").select("node", "first", *["head" for _ in key], F.coalesce("c", "node").alias("c"))
    smallest = of_node.groupBy("c").agg(F.min("first").alias("component"), *[F.min("head").alias("stays") for _ in key])
    of_node = of_node.join(smallest, "c").select("node", "component", *["stays" for _ in key])
    out = rows.select("doc_id", *key, "n", "node").join(of_node, "node", "left")
    component = F.coalesce("component", "doc_id")
    only = [(F.col("node").isNull() | (F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("row") == F.col("stays.row")))).alias("only") for _ in key]
    return out.select("doc_id", *key, *only, F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Stage: one document of each group of near copies, and one of repeated rows; columns as in ``docs``."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    gone = near_duplicates(docs, shingle, percent, row=digest).where(~F.col("only"))
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).distinct()
    left = docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (digest == gone["__row"]), "left_anti")
    return left.dropDuplicates(["doc_id", "text"])
