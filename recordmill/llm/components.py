"""Connected components, and exact classes from bucketed candidates, without collecting edges or groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(v, c) for every node that isn't the smallest of its component; ``edges`` has columns a and b.

    Each round points every node at its smallest neighbour, jumps pointers to the roots and contracts the edges, so the
    rounds grow with the logarithm of the longest path. All steps are joins and minima; no group is gathered.
    """
    ends = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    left = staged(edges.where("a <> b").select(*ends(F.col("a"), F.col("b"))).distinct(), f"{name}-edges")
    labels = left.select(F.col("b").alias("v"), F.col("a").alias("c")).limit(0)
    while not left.isEmpty():
        point = staged(left.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("c")), f"{name}-point")
        while True:
            up = point.select(F.col("v").alias("c"), F.col("c").alias("up"))
            jumped = staged(point.select("v", "c").join(up, "c", "left").select("v", F.coalesce("up", "c").alias("c"), F.col("up").isNotNull().alias("moved")), f"{name}-jump")
            discard(point)
            point = jumped
            if jumped.where("moved").isEmpty():
                break
        new = point.select(F.col("v").alias("c"), F.col("c").alias("up"))
        old, labels = labels, staged(labels.join(new, "c", "left").select("v", F.coalesce("up", "c").alias("c")).unionByName(point.select("v", "c")), f"{name}-labels")
        pa, pb = point.select(F.col("v").alias("a"), F.col("c").alias("ra")), point.select(F.col("v").alias("b"), F.col("c").alias("rb"))
        joined = left.join(pa, "a", "left").join(pb, "b", "left")
        moved = joined.select(*ends(F.coalesce("ra", "a"), F.coalesce("rb", "b"))).where("a <> b").distinct()
        last, left = left, staged(moved, f"{name}-edges")
        discard(old, last, point)
    return labels


def classes(buckets: DataFrame, facts: DataFrame, possible: Callable[[str, str], Column], similar: Callable[[DataFrame], DataFrame], name: str, exact: bool = True) -> DataFrame:
    """(v, c) of the components that verified links between members of one bucket form.

    ``buckets``: distinct (bucket, node). ``facts``: node and what ``possible`` needs; ``possible(x, y)`` is a necessary
    condition of a link on the columns with these prefixes. ``similar`` takes distinct pairs (a, b) and returns the
    linked ones. First each bucket's hub, the node that shares most buckets, is compared with its other members, a star:
    a hub near the middle of its group links most of it. Where members of a bucket then still lie in several components,
    every member outside the bucket's largest component is held against all members of other components, so that no
    link that could join two components is missed; ``possible`` is asked inside that join, before any pair is formed. Unless ``exact``, only one more star is
    drawn in such a bucket, around a member outside its largest component, so that pairs never outnumber the buckets' rows.
    """
    facts_of = lambda side: facts.select(F.col("node").alias(side), *[F.col(c).alias(side + c) for c in facts.columns if c != "node"])
    full = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = staged(buckets.join(full, "bucket"), f"{name}-shared")
    score = shared.groupBy("node").agg(F.sum("n").alias("score"))
    hubs = shared.join(score, "node").groupBy("bucket").agg(F.max_by("node", F.struct("score", "node")).alias("hub"))
    ends = (F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
    # A pair meets in many buckets, and it is compared once.
    stars = staged(shared.join(hubs, "bucket").where("hub <> node").select(*ends).distinct(), f"{name}-stars")
    linked = staged(similar(stars.join(facts_of("a"), "a").join(facts_of("b"), "b").where(possible("a", "b")).select("a", "b")), f"{name}-linked")
    labels = components(linked, name)
    named = shared.select("bucket", "node").join(labels.withColumnRenamed("v", "node"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    parts = named.groupBy("bucket", "c").agg(F.count("*").alias("k"))
    mixed = parts.groupBy("bucket").agg(F.count("*").alias("cs"), F.max_by("c", F.struct("k", "c")).alias("most")).where("cs > 1").select("bucket", "most")
    open_ = staged(named.join(mixed, "bucket").join(facts, "node"), f"{name}-open")
    own = [c for c in open_.columns if c not in ("bucket", "most")]
    if not exact:
        second = open_.where("c <> most").groupBy("bucket").agg(F.max_by(F.struct(F.col("node").alias("hub"), F.col("c").alias("own")), F.xxhash64("node")).alias("x")).select("bucket", "x.*")
        others = open_.join(second, "bucket").where("own <> c")
        drawn = others.select(*ends).distinct().join(stars, ["a", "b"], "left_anti")
        more = staged(similar(drawn.join(facts_of("a"), "a").join(facts_of("b"), "b").where(possible("a", "b")).select("a", "b")), f"{name}-more")
        return labels if more.isEmpty() else components(linked.unionByName(more), name)
    x = open_.where("c <> most").select("bucket", *[F.col(c).alias("a" if c == "node" else f"a{c}") for c in own])
    y = open_.select("bucket", (F.col("c") == F.col("most")).alias("main"), *[F.col(c).alias("b" if c == "node" else f"b{c}") for c in own])
    # Two members outside the largest component would meet twice.
    crossed = x.join(y, (x["bucket"] == y["bucket"]) & (F.col("ac") != F.col("bc")) & (F.col("main") | (F.col("a") < F.col("b"))) & possible("a", "b"))
    rest = staged(crossed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(stars, ["a", "b"], "left_anti"), f"{name}-rest")
    if rest.isEmpty():
        return labels
    more = staged(similar(rest), f"{name}-more")
    return labels if more.isEmpty() else components(linked.unionByName(more), name)
