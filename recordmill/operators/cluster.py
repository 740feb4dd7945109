"""Clusters of matched pairs: connected components, cliques, golden ids and the crosswalk."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in ``spark.checkpoint.dir``; a folder of our own only where none is set (local tests)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="recordmill-"))
    return df.checkpoint()


def components(pairs: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(id, component) of every id in ``pairs`` (l, r); a component is named by its smallest id.

    Large-star and small-star steps in turn: both hang neighbours on the smallest id in sight, by one partial
    aggregation and one join, so no neighbour list is ever gathered; a hub's rows are split by the skew join.
    """
    now, before = cut(pairs.select("l", "r").where("l <> r").distinct()), None
    for _ in range(most_rounds):
        both = now.union(now.select("r", "l"))
        least = both.groupBy("l").agg(F.min("r").alias("m")).select("l", F.least("l", "m").alias("m"))
        large = both.join(least, "l").where("r > l").select(F.col("r").alias("l"), F.col("m").alias("r"))
        down = large.where("l <> r").select(F.greatest("l", "r").alias("l"), F.least("l", "r").alias("r")).distinct()
        least = down.groupBy("l").agg(F.min("r").alias("m"))
        small = down.join(least, "l").select(F.col("r").alias("l"), F.col("m").alias("r")).union(least.select("l", F.col("m").alias("r")))
        now = cut(small.where("l <> r").distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("l", "r").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("l").alias("id"), F.col("r").alias("component")).union(now.select("r", "r").distinct())


def clusters(records: DataFrame, id_col: str, pairs: DataFrame, strict: bool = False) -> DataFrame:
    """(id, cluster) of every record. ``strict`` breaks up a component of over two members unless all of its pairs match."""
    found = components(pairs)
    if strict:
        sizes = found.groupBy("component").agg(F.count("*").alias("n"))
        links = pairs.select(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r")).where("l <> r").distinct()
        links = links.join(found, links["l"] == found["id"]).groupBy("component").agg(F.count("*").alias("links"))
        whole = sizes.join(links, "component").where((F.col("n") <= 2) | (F.col("links") * 2 == F.col("n") * (F.col("n") - 1)))
        found = found.join(whole.select("component"), "component", "left_semi").select("id", "component")
    own = records.select(F.col(id_col).alias("id"))
    return own.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))


def running(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` up to each row in ``order``, without drawing all rows into one task.

    Rows are sorted by ranges and checkpointed; of the partitions only the sums are added up before.
    """
    ranged = cut(df.orderBy(*order)).select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__i"))
    sums = ranged.groupBy("__p").agg(F.sum(value).alias("__n"))  # one row for each partition
    starts = sums.select("__p", (F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).alias("__start"))
    own = F.sum(value).over(W.partitionBy("__p").orderBy("__i").rowsBetween(W.unboundedPreceding, W.currentRow))
    return ranged.withColumn("__own", own).join(F.broadcast(starts), "__p").withColumn(name, F.col("__start") + F.col("__own")).drop("__p", "__i", "__own", "__start")


def sequenced(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``, its place from 1 in ``order``, without drawing all rows into one task.

    Rows are sorted by ranges and checkpointed; only the counts of the partitions are summed up.
    """
    ranged = cut(df.orderBy(*order)).select("*", F.spark_partition_id().alias("__p"), (F.monotonically_increasing_id() % (1 << 33)).alias("__i"))
    counts = ranged.groupBy("__p").agg(F.count("*").alias("__n"))  # one row for each partition
    starts = counts.select("__p", (F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).alias("__start"))
    return ranged.join(F.broadcast(starts), "__p").withColumn(name, F.col("__start") + F.col("__i") + 1).drop("__p", "__i", "__start")


def golden_ids(members: DataFrame, prefix: str = "MDM") -> DataFrame:
    """(cluster, member_count, golden_id) from (id, cluster): numbered by size, largest first, then by first member."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("member_count"), F.min("id").alias("first"))
    placed = sequenced(sizes, [F.desc("member_count"), F.asc("first")], "place")
    return placed.select("cluster", "member_count", F.format_string(f"{prefix}-%06d", "place").alias("golden_id"))


def crosswalk(members: DataFrame, golden: DataFrame) -> DataFrame:
    """One row for each member: its id and golden id."""
    return members.join(golden, "cluster").select("id", "golden_id")


def statistics(members: DataFrame) -> DataFrame:
    """Records, golden records, merged clusters, duplicates removed, the largest cluster and whether it is suspect."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"))
    out = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count("*").alias("golden"), F.count_if(F.col("n") > 1).alias("merged"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    removed = (F.col("records") - F.col("golden")).alias("duplicates_removed")
    return out.select("*", removed, (F.col("largest") > F.greatest(F.lit(10.0), F.col("records") * 0.05)).alias("over_merge_suspected"))
