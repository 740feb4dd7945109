"""Hard negatives from inverted lists: exact top lists of inner products, pruned by Cauchy-Schwarz bounds.

Rows are quantised vectors with a label; some are anchors. K-means splits all rows into lists; of each list the centroid
c and the radius r, the largest distance of a member, are stored. For an anchor q no member's score exceeds
q*c + |q|*r nor falls below q*c - |q|*r. Lists are visited by falling upper bound, in rounds of 4, 16, 64, ... lists: a
round leaves out the lists whose bound is strictly below the anchor's kth score so far (equal ones may hold a tie with a
smaller id), and for negatives the lists that lie outside every window of the anchor. What a round finds is merged with
what was found before, so the result is that of comparing with every row.

The centroids are fitted on ``SAMPLE`` rows at most (a hash of the id chooses them); every row is in a list. Lists are cut
into blocks of about ``BLOCK`` rows and the anchors that visit one into chunks of about ``CHUNK``, so a list that a third
of all rows fall into is dealt to many tasks, and each task holds one block and one chunk. Rows go through shuffles of
Spark only; the driver holds the centroids, radii and sizes of at most ``LISTS`` lists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, staged

SAMPLE, LISTS, BLOCK, CHUNK = 20_000, 1024, 4096, 16_384
#: Components beyond this size are set to it, so that scores of up to 32,767 components fit in 64 bits.
LARGEST = 1 << 24
NO_SCORE = -(1 << 62)


def quantised(vectors: DataFrame, id_: Column, vector: Column, label: Column, anchor: Column, scale: int = 256) -> DataFrame:
    """(id, label, q, anchor): components floor(scale * x), vectors filled up with zeros to the longest one's length.

    Rows with a null id, label or vector or a null or non-finite component take no part. Repeated rows count once.
    """
    numbers = F.transform(vector, lambda x: x.cast("double"))
    rows = vectors.select(id_.cast("long").alias("id"), label.cast("long").alias("label"), numbers.alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    held = lambda x: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), x * scale))
    rows = rows.where("id is not null and label is not null and v is not null").where(sound)
    rows = staged(rows.select("id", "label", F.transform("v", lambda x: F.floor(held(x)).cast("int")).alias("q"), "anchor").distinct(), "negatives-rows")
    longest = rows.agg(F.max(F.size("q"))).head()[0] or 0
    return rows.withColumn("q", F.concat("q", F.expr(f"array_repeat(0, {max(1, longest)} - size(q))"))).withColumn("a", F.xxhash64("id", "label", "q"))


def centroids(rows: DataFrame, count: int, lists: int, sample: int = SAMPLE, rounds: int = 8) -> np.ndarray:
    """K-means by Lloyd's rounds over a sample of ``sample`` rows, or twice as many if one id has most of them."""
    share = min(1.0, sample / max(1, count))
    chosen = rows.where(F.pmod(F.xxhash64("id", "a"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * sample)
    x = matrix(chosen.select("q").toArrow()).astype(float)
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)].copy() if len(x) else np.zeros((1, 1))
    for _ in range(rounds if len(x) else 0):
        near = nearest(x, c)[0]
        sums, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def matrix(table: pa.Table) -> np.ndarray:
    flat = table["q"].combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([x.flatten() for x in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 1), np.int32)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row, and the distance to it."""
    which, far = np.empty(len(x), np.int64), np.empty(len(x))
    for i in range(0, len(x), 4096):
        part = x[i : i + 4096]
        which[i : i + 4096] = best = ((c * c).sum(1) - 2 * part @ c.T).argmin(1)
        far[i : i + 4096] = np.sqrt(((part - c[best]) ** 2).sum(1))
    return which, far


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products; doubles hold them where they stay under 2**53, and are much faster."""
    top = float(max(1, np.abs(q).max(initial=0))) * float(max(1, np.abs(x).max(initial=0))) * max(1, q.shape[1])
    if top < 2.0**53:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def best(score: np.ndarray, open_: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the first ``k`` open entries of each row, by falling score, ties by smaller id."""
    held = np.where(open_, score, NO_SCORE)
    if held.shape[1] > k:
        least = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]
        open_ = open_ & (held >= least[:, None])
    r, c = np.nonzero(open_)
    order = np.lexsort((ids[c], -score[r, c], r))
    r, c = r[order], c[order]
    starts = np.searchsorted(r, np.arange(len(score)))
    first = np.arange(len(r)) - starts[r] < k
    return r[first], c[first]


class Lists:
    """All rows in lists, and what the driver knows of them: centroids, radii and the number of blocks of each."""

    def __init__(self, rows: DataFrame, lists: int | None = None):
        count = rows.count()
        wanted = lists or int(min(LISTS, max(1, np.sqrt(count) / 2)))
        self.spark, c = rows.sparkSession, centroids(rows, count, wanted)
        shared = self.spark.sparkContext.broadcast(c)

        def assign(batches):
            for b in batches:
                t = pa.Table.from_batches([b])
                which, far = nearest(matrix(t).astype(float), shared.value) if t.num_rows else (np.zeros(0, int), np.zeros(0))
                yield from t.append_column("list", pa.array(which, pa.int32())).append_column("far", pa.array(far, pa.float64())).to_batches()

        own = rows.select("id", "label", "q", "anchor", "a")
        self.rows = staged(own.mapInArrow(assign, "id long, label long, q array<int>, anchor boolean, a long, list int, far double"), "negatives-lists")
        known = self.rows.groupBy("list").agg(F.max("far").alias("r"), F.count("*").alias("n")).collect()  # at most LISTS
        self.centroids, self.radius, self.blocks = c, np.full(len(c), -1.0), np.ones(len(c), int)
        for x in known:
            self.radius[x["list"]], self.blocks[x["list"]] = x["r"], -(-x["n"] // BLOCK)
        self.anchors = self.rows.where("anchor").select("a", "id", "label", "q")
        self.chunks = max(1, -(-self.anchors.count() // CHUNK))

    def visits(self, anchors: DataFrame, lo: int, hi: int, loosely: bool) -> DataFrame:
        """A row for each block of the lists of rank ``lo`` to ``hi`` of each anchor that may still hold something.

        ``floors`` and ``ceilings`` of an anchor bound the scores that it still looks for. With ``loosely`` ranks count
        all lists; else only those that meet one of the windows, whose lower ends are ``lows``.
        """
        shared, chunks = self.spark.sparkContext.broadcast((self.centroids, self.radius, self.blocks)), self.chunks

        def emit(batches):
            c, r, blocks = shared.value
            norm_c = np.sqrt((c * c).sum(1))
            for b in batches:
                t = pa.Table.from_batches([b])
                q = matrix(t).astype(float)
                windows = [t[n].to_pylist() for n in ("lows", "floors", "ceilings")]
                for i in range(t.num_rows):
                    size = np.sqrt((q[i] * q[i]).sum())
                    slack = 1e-9 * size * (norm_c + r) + 1e-6  # of the bounds' own rounding
                    mid = c @ q[i]
                    up, down = mid + size * r + slack, mid - size * r - slack
                    lows, floors, ceilings = (np.array(w[i], float)[:, None] for w in windows)
                    below = (down <= ceilings) & (r >= 0)
                    ranked = (r >= 0) if loosely else (below & (up >= lows)).any(0)
                    order = np.argsort(-up, kind="stable")
                    order = order[ranked[order]][lo:hi]
                    order = order[(below & (up >= floors)).any(0)[order]]
                    if len(order):
                        lists = np.repeat(order, blocks[order])
                        block = np.concatenate([np.arange(blocks[x]) for x in order])
                        one = t.slice(i, 1).select(["a", "id", "label", "q", "floors", "ceilings"])
                        out = one.take(pa.array(np.zeros(len(lists), int)))
                        chunk = np.full(len(lists), t["a"][i].as_py() % chunks)
                        for name, x in (("list", lists), ("block", block), ("chunk", chunk)):
                            out = out.append_column(name, pa.array(x, pa.int32()))
                        yield from out.combine_chunks().to_batches()

        return anchors.select("a", "id", "label", "q", "lows", "floors", "ceilings").mapInArrow(emit, "a long, id long, label long, q array<int>, floors array<long>, ceilings array<long>, list int, block int, chunk int")

    def search(self, visits: DataFrame, k: int, same: bool) -> DataFrame:
        """(a, w, nid, score): the first ``k`` rows of each visited block for each window, of the anchor's label or of others."""

        def look(left: pa.Table, right: pa.Table) -> pa.Table:
            out = [[], [], [], []]
            q, x = matrix(left), matrix(right)
            ids, labels = right["id"].to_numpy(), right["label"].to_numpy()
            a, own, of = left["a"].to_numpy(), left["id"].to_numpy(), left["label"].to_numpy()
            floors, ceilings = left["floors"].to_pylist(), left["ceilings"].to_pylist()
            for i in range(0, len(q) if len(x) else 0, 256):
                s = scores(q[i : i + 256], x)
                alike = of[i : i + 256, None] == labels[None]
                fit = alike & (own[i : i + 256, None] != ids[None]) if same else ~alike
                most = max(map(len, floors[i : i + 256]))
                for w in range(most):
                    lo = np.array([f[w] if w < len(f) else -NO_SCORE for f in floors[i : i + 256]])
                    up = np.array([f[w] if w < len(f) else NO_SCORE for f in ceilings[i : i + 256]])
                    r, c = best(s, fit & (s >= lo[:, None]) & (s <= up[:, None]), ids, k)
                    for to, what in zip(out, (a[i + r], np.full(len(r), w), ids[c], s[r, c]), strict=True):
                        to.append(what)
            flat = [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]
            return pa.table({"a": pa.array(flat[0], pa.int64()), "w": pa.array(flat[1], pa.int32()), "nid": pa.array(flat[2], pa.int64()), "score": pa.array(flat[3], pa.int64())})

        spread = self.spark.createDataFrame([(i, int(n)) for i, n in enumerate(self.blocks)], "list int, n int")
        rows = self.rows.join(F.broadcast(spread), "list").select("id", "label", "q", "list", F.pmod(F.col("a"), F.col("n")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(self.chunks - 1))).alias("chunk"))
        by = ("list", "block", "chunk")
        return visits.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(look, "a long, w int, nid long, score long")

    def rounds(self):
        lo, n = 0, 4
        while lo < len(self.centroids):
            yield lo, lo + n
            lo, n = lo + n, 4 * n

    def first(self, anchors: DataFrame, k: int, same: bool, name: str) -> DataFrame:
        """(a, w, rank, nid, score): the first ``k`` rows of every window of the anchors (a, id, label, q, lows, ceilings)."""
        place = W.partitionBy("a", "w").orderBy(F.desc("score"), "nid")
        found, last = None, None
        for lo, hi in self.rounds():
            now = anchors.withColumn("floors", F.col("lows"))
            if found is not None:
                # kth scores by window, as many as the anchor has windows
                kth = found.where(F.col("rank") == k).groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))
                higher = F.transform("lows", lambda x, i: F.greatest(x, F.coalesce(F.element_at("kth", i), x)))
                now = anchors.join(kth, "a", "left").withColumn("floors", F.when(F.col("kth").isNull(), F.col("lows")).otherwise(higher))
            new = self.search(self.visits(now, lo, hi, same), k, same)
            both = new if found is None else new.unionByName(found.select("a", "w", "nid", "score"))
            last, found = found, staged(both.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k), f"negatives-{name}")
            if last is not None:
                discard(last)
        return found


def mine(rows: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, lists: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows made by ``quantised``.

    An anchor's positives are its first ``positives`` rows of the same label under other ids; a positive's negatives are
    the first ``negatives`` rows of other labels whose score is ``low`` to ``high`` percent of its own. No positive with
    a negative score has any. Higher scores come first, ties by smaller id. An id that stands on several rows counts with
    each. No anchors, or an empty table: no rows.
    """
    index = Lists(rows, lists)
    if not len(index.anchors.take(1)):
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    whole = lambda c: F.array(F.lit(c).cast("long"))
    open_ = index.anchors.withColumn("lows", whole(NO_SCORE + 1)).withColumn("ceilings", whole(-NO_SCORE))
    near = index.first(open_, positives, True, "positives").where("score >= 0")
    window = W.partitionBy("a").orderBy("rank")
    near = staged(near.select("a", (F.row_number().over(window) - 1).alias("w"), F.col("nid").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-windows")
    ends = F.transform(F.sort_array(F.collect_list(F.struct("w", "positive_score"))), lambda x: x["positive_score"])  # at most ``positives``
    share = lambda percent, up: F.expr(f"transform(ends, x -> {percent} * (x div 100) + ({percent} * (x % 100) + {99 * up}) div 100)")
    windows = near.groupBy("a").agg(ends.alias("ends")).select("a", share(low, True).alias("lows"), share(high, False).alias("ceilings"))
    asked = staged(index.anchors.join(windows, "a"), "negatives-asked")
    got = index.first(asked, negatives, False, "found")
    return got.join(near, ["a", "w"]).join(asked.select("a", F.col("id").alias("anchor_id")), "a").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("nid").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine_digest(vectors: DataFrame) -> DataFrame:
    """op11: hard negatives of ``embeddings`` for the anchors whose vec_id is divisible by 100."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(quantised(vectors, F.col("vec_id"), F.col("embedding"), label, F.col("vec_id") % 100 == 0))


def oracle() -> str:
    """DuckDB's form: every anchor against every row."""
    return """with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: floor(256 * x::double)) q from embeddings
   where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select a.vec_id anchor_id, b.vec_id other_id, a.label = b.label same, list_inner_product(a.q, b.q)::bigint score from r a join r b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
 p as (select anchor_id, other_id positive_id, score positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5),
 n as (select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, other_id)::int rank, other_id negative_id, positive_score, score negative_score
   from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
 select * from n where rank <= 10"""
