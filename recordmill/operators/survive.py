"""Survivorship: the value of each field of a golden record, where it came from, and the golden records themselves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import clusters, crosswalk, cut, golden_ids

STRATEGIES = ("most_recent", "source_priority", "most_frequent", "longest", "most_complete", "max", "min", "sum", "manual")


@dataclass(frozen=True)
class Keep:
    """A field: ``raw`` is the column that survives, ``std`` the standardised one that decides."""

    raw: str
    std: str
    strategy: str = "most_complete"


def trust(system: Column, priority: list[str]) -> Column:
    """Rank of a source, best first; those not listed come last."""
    ranks = F.when(F.lit(False), 0)
    for i, name in enumerate(priority):
        ranks = ranks.when(system == name, i)
    return ranks.otherwise(len(priority))


def survivors(members: DataFrame, fields: list[Keep], rank: Column, updated: Column) -> DataFrame:
    """Per ``cluster`` of ``members`` (id, cluster and more) and field a struct of value, source and conflict; member_count, conflicts, needs_steward.

    A candidate has a standardised value. Ties and missing times or numbers fall back to trust: rank, recency, id.
    ``sum`` has no source and manual fields have neither. All but the most frequent value come from one aggregation
    with partial sums; frequencies are counted beforehand by (cluster, value), so no group is gathered.
    """
    rows = members.withColumn("__order", F.struct(rank.alias("r"), F.coalesce(-F.unix_millis(updated), F.lit(1 << 62)).alias("t"), F.col("id").alias("i"))).withColumn("__t", F.unix_millis(updated))
    aggs: list[Column] = [F.count("*").alias("member_count")]
    frequent = [f for f in fields if f.strategy == "most_frequent"]
    for f in fields:
        has, number = F.col(f.std).isNotNull(), F.expr(f"try_cast(`{f.std}` as double)")
        number = F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)
        one = F.struct(F.col(f.raw).cast("string").alias("value"), F.col("id").cast("string").alias("source"))
        by_trust = F.min_by(one, F.when(has, F.col("__order")))
        firsts = {"most_recent": -F.col("__t"), "longest": -F.length(F.col(f.std).cast("string")), "max": -number, "min": number}
        if f.strategy in firsts:
            # Among equals the first record wins, whatever its trust.
            best = F.min_by(one, F.when(has & firsts[f.strategy].isNotNull(), F.struct(firsts[f.strategy].alias("x"), F.col("id").alias("i"))))
            picked = F.coalesce(best, by_trust)
        elif f.strategy == "sum":
            picked = F.struct(F.sum(number).cast("string").alias("value"), F.lit(None).cast("string").alias("source"))
        elif f.strategy == "manual":
            picked = F.struct(F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("source"))
        else:
            picked = by_trust
        aggs += [picked.alias(f"__p_{f.raw}"), (F.min(f.std) != F.max(f.std)).alias(f"__c_{f.raw}"), F.count(f.std).alias(f"__n_{f.raw}")]
    out = rows.groupBy("cluster").agg(*aggs)
    for f in frequent:
        one = F.struct(F.col(f.raw).cast("string").alias("value"), F.col("id").cast("string").alias("source"))
        counted = rows.where(F.col(f.std).isNotNull()).groupBy("cluster", f.std).agg(F.count("*").alias("n"), F.min("__order").alias("o"), F.min_by(one, "__order").alias("p"))
        best = counted.groupBy("cluster").agg(F.min_by("p", F.struct((-F.col("n")).alias("n"), "o")).alias(f"__f_{f.raw}"))
        out = out.join(best, "cluster", "left").withColumn(f"__p_{f.raw}", F.col(f"__f_{f.raw}"))
    picked = [F.struct(F.col(f"__p_{f.raw}.value").alias("value"), F.col(f"__p_{f.raw}.source").alias("source"), F.coalesce(f"__c_{f.raw}", F.lit(False)).alias("conflict")).alias(f.raw) for f in fields]
    conflicts = sum((F.coalesce(F.col(f"__c_{f.raw}"), F.lit(False)).cast("int") for f in fields), F.lit(0))
    steward = sum((F.col(f"__n_{f.raw}") for f in fields if f.strategy == "manual"), F.lit(0)) > 0
    return out.select("cluster", "member_count", *picked, conflicts.alias("conflicts"), steward.alias("needs_steward"))


def master(records: DataFrame, matches: DataFrame, fields: list[Keep], rank: Column, updated: Column, strict: bool = False, prefix: str = "MDM") -> tuple[DataFrame, DataFrame]:
    """Golden records and the crosswalk of ``records`` (id and more), given the pairs (l, r) that match; singletons included."""
    of = cut(clusters(records, "id", matches, strict))
    ids = golden_ids(of, prefix)
    golden = survivors(records.join(of, "id"), fields, rank, updated).join(ids.select("cluster", "golden_id"), "cluster")
    return golden.drop("cluster"), crosswalk(of, ids)
