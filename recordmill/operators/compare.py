"""Two runs of a rule side by side: metrics, outcomes, findings, samples and the verdict; and the same for every rule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordmill.functions.convert import direction, half_up
from recordmill.operators import exceptions as ex
from recordmill.operators.reconcile import OUTCOMES

# Metrics of a run, and which way is better.
METRICS = {"records_a": "none", "records_b": "none", "keys_compared": "none", "matched": "up", "exception_count": "down"}
SEVERITIES = ("high", "medium", "low")


def percent(before: Column, delta: Column) -> Column:
    """Change in percent with one decimal; null if there was nothing or it can't be told."""
    return F.when(before != 0, half_up(delta / before * 100, 1))


def metric_deltas(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """``pairs`` (earlier, later: run ids) with a row for each metric: before, after, delta, percent and direction. A metric without value is null.

    Whole runs meet by sorted joins, and only pairs are unfolded by metric.
    """
    def held(side: str) -> DataFrame:
        # Compressed files look small to the planner, so it would broadcast all runs.
        return runs.select(F.col("run").alias(side), F.struct(*[F.col(m).cast("double").alias(m) for m in METRICS]).alias(f"of_{side}")).hint("merge")

    met = pairs.select("earlier", "later").join(held("later"), "later").join(held("earlier"), "earlier")
    each = [F.struct(F.lit(m).alias("metric"), F.lit(b).alias("better"), F.col(f"of_earlier.{m}").alias("before"), F.col(f"of_later.{m}").alias("after")) for m, b in METRICS.items()]
    both = met.select("earlier", "later", F.explode(F.array(*each)).alias("x")).select("earlier", "later", "x.*")
    delta = F.col("after") - F.col("before")
    return both.select("earlier", "later", "metric", "before", "after", delta.alias("delta"), percent(F.col("before"), delta).alias("percent"), direction(delta, F.col("better")).alias("direction"))


def outcome_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(place, outcome, before, after, delta) of the outcomes that either run has; unknown ones come last."""
    rows = before.select("outcome", F.lit(1).alias("b"), F.lit(0).alias("a")).union(after.select("outcome", F.lit(0), F.lit(1)))
    counts = rows.groupBy("outcome").agg(F.sum("b").alias("before"), F.sum("a").alias("after"))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, OUTCOMES)), F.col("outcome")), F.lit(0).cast("long")), F.lit(len(OUTCOMES) + 1).cast("long"))
    return counts.select(place.alias("place"), "outcome", "before", "after", (F.col("after") - F.col("before")).alias("delta"))


def sampled(rows: DataFrame, group: str, order: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """Exact totals of each group, and its first ``most`` rows; the rank limit is met in each task before the shuffle."""
    totals = rows.groupBy(group).agg(F.count("*").alias("total"))
    ranked = rows.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    return totals, ranked.where(F.col("place") <= most)


@dataclass(frozen=True)
class Comparison:
    earlier: object
    later: object
    swapped: bool
    version_changed: bool
    metrics: DataFrame
    outcomes: DataFrame
    changes: DataFrame
    totals: DataFrame
    sample: DataFrame
    verdict: DataFrame
    missing_detail: list


def compare_runs(runs: DataFrame, findings: DataFrame, first: object, second: object, most: int = 100) -> Comparison:
    """Runs ``first`` and ``second`` in the order of their start. ValueError ``same_run``, ``unknown_run`` or ``other_rule`` where they can't be compared.

    ``runs`` has run, rule, version, started and the metrics; ``findings`` run, fingerprint, outcome and severity.
    ``missing_detail`` names runs that count exceptions but hold no findings: their items can't be trusted.
    """
    if first == second:
        raise ValueError("same_run")
    rows = {r["run"]: r for r in runs.where(F.col("run").isin(first, second)).collect()}  # two rows
    if len(rows) < 2:
        raise ValueError("unknown_run")
    if rows[first]["rule"] != rows[second]["rule"]:
        raise ValueError("other_rule")
    earlier, later = (first, second) if rows[first]["started"] <= rows[second]["started"] else (second, first)
    before, after = findings.where(F.col("run") == F.lit(earlier)), findings.where(F.col("run") == F.lit(later))
    changes = ex.diff(before, after)
    totals, sample = sampled(changes, "change", ["fingerprint"], most)
    pair = runs.sparkSession.createDataFrame([(earlier, later)], ["earlier", "later"])
    bare = [r for r, f in ((earlier, before), (later, after)) if (rows[r]["exception_count"] or 0) > 0 and f.isEmpty()]
    return Comparison(earlier, later, earlier != first, rows[earlier]["version"] != rows[later]["version"], metric_deltas(pair, runs.where(F.col("run").isin(first, second))), outcome_deltas(before, after), changes, totals, sample, ex.verdict(changes), bare)


def latest_pairs(runs: DataFrame) -> DataFrame:
    """(rule, later, earlier, run_count) from the completed ``runs`` (run, rule, status, started); earlier is null for a single run."""
    newest = W.partitionBy("rule").orderBy(F.desc("started"), F.desc("run"))
    done = runs.where("status = 'completed'")
    ranked = done.select("rule", F.col("run").alias("later"), F.row_number().over(newest).alias("n"), F.lead("run").over(newest).alias("earlier"), F.count("*").over(W.partitionBy("rule")).alias("run_count"))
    return ranked.where("n = 1").drop("n")


def across_rules(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per rule with completed runs: its newest pair, exceptions, severities of the newest run, what changed and the verdict.

    Rules of a single run have no comparison. One join of the pairs' findings serves all rules.
    """
    pairs = latest_pairs(runs)
    counts = runs.select(F.col("run").alias("later"), F.coalesce(F.col("exception_count"), F.lit(0)).alias("exceptions"), F.col("version").alias("v"))
    versions = runs.select(F.col("run").alias("earlier"), F.col("version").alias("w"))
    sides = pairs.select("rule", F.explode(F.array(F.struct(F.col("later").alias("run"), F.lit(True).alias("new")), F.struct(F.col("earlier").alias("run"), F.lit(False).alias("new")))).alias("x")).select("rule", "x.*").where("run is not null")
    order = F.col("position") if "position" in findings.columns else F.struct("outcome", "severity")
    found = findings.drop("rule").join(sides, "run")
    firsts = found.groupBy("rule", "fingerprint").agg(
        F.min_by("outcome", F.when(F.col("new"), order)).alias("after"),
        F.min_by("outcome", F.when(~F.col("new"), order)).alias("before"),
    )
    severity = F.when(F.col("severity").isin(*SEVERITIES), F.col("severity")).otherwise("medium")
    mix = found.where("new").groupBy("rule").agg(*[F.count_if(severity == s).alias(s) for s in SEVERITIES])
    moved = firsts.groupBy("rule").agg(
        F.count_if(F.col("before").isNull()).alias("introduced"),
        F.count_if(F.col("after").isNull()).alias("resolved"),
        F.count_if(F.col("before") == F.col("after")).alias("persisting"),
        F.count_if(F.col("before") != F.col("after")).alias("changed"),
    )
    rows = pairs.join(counts, "later").join(versions, "earlier", "left").join(mix, "rule", "left").join(moved, "rule", "left").fillna(0, [*SEVERITIES, "introduced", "resolved", "persisting", "changed"])
    comparable = F.col("earlier").isNotNull()
    shown = [F.when(comparable, F.col(c)).alias(c) for c in ("introduced", "resolved", "persisting", "changed")]
    return rows.select("rule", "later", "earlier", "run_count", "exceptions", *SEVERITIES, comparable.alias("comparable"), F.when(comparable, F.col("v") != F.col("w")).alias("version_changed"), *shown, F.when(comparable, ex.said()).alias("verdict"))
