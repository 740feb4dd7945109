"""Weighted scores of candidate pairs, and the decision that follows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Feature:
    """One compared field. ``missing`` says what a null on either side does: skip its weight, neutral (0.5) or disagree (0)."""

    name: str
    similarity: Callable[[Column, Column], Column]
    weight: float = 1.0
    missing: str = "skip"
    required: bool = False
    least: float = 1.0  # a required or blocking field below this rejects the pair
    blocker: bool = False  # must not disagree, but may be missing


#: A field's part in a score: its similarity (three decimals, null if skipped), weight, and the policy for a missing value.
PART = "struct<field:string,score:double,weight:double,skipped:boolean,policy:string>"


def explain_pairs(pairs: DataFrame, records: DataFrame, id_col: str, features: list[Feature], match: float = 0.9, review: float = 0.75) -> DataFrame:
    """``pairs`` (l, r) with ``score`` (three decimals), ``decision``, ``rejected_by`` (field and code), ``compared`` (fields) and ``contributions``.

    The decision is match, review, distinct or rejected; the unrounded score meets the thresholds. A weight of zero or
    less counts as one. A pair without any usable field scores 0. A required field that is missing or a required or
    blocking one below its least similarity rejects; the first such field is named. Pairs whose records aren't found
    are dropped.
    """
    side = lambda name: records.select(F.col(id_col).alias(name), F.struct(*[f.name for f in features]).alias(f"__{name}"))
    both = pairs.join(side("l"), "l").join(side("r"), "r")
    measured, points, weights, rejects, parts = [], [], [], [], []
    for i, f in enumerate(features):
        a, b = F.col(f"__l.{f.name}"), F.col(f"__r.{f.name}")
        w, gone = float(f.weight) if f.weight > 0 else 1.0, a.isNull() | b.isNull()
        measured += [gone.alias(f"__g{i}"), F.when(gone, 0.5 if f.missing == "neutral" else 0.0).otherwise(f.similarity(a, b).cast("double")).alias(f"__s{i}")]
        s, gone = F.col(f"__s{i}"), F.col(f"__g{i}")
        points.append(s * w)
        skip = gone if f.missing == "skip" else F.lit(False)
        weights.append(F.when(skip, 0.0).otherwise(w))
        code = F.when(gone & F.lit(f.required), "missing").when(~gone & (s < f.least) & F.lit(f.required), "disagrees").when(~gone & (s < f.least) & F.lit(f.blocker), "conflicts")
        rejects.append(F.when(code.isNotNull(), F.struct(F.lit(f.name).alias("field"), code.alias("code"))))
        shown = F.when(~skip, F.floor(s * 1000 + 0.5) / 1000)
        parts.append(F.struct(F.lit(f.name).alias("field"), shown.alias("score"), F.lit(w).alias("weight"), skip.alias("skipped"), F.when(gone, F.lit(f.missing)).alias("policy")))
    both = both.select("l", "r", *measured)
    used = reduce(lambda x, y: x + y, weights)
    both = both.withColumn("__score", F.when(used > 0, reduce(lambda x, y: x + y, points) / used).otherwise(0.0)).withColumn("rejected_by", F.coalesce(*rejects))
    decision = F.when(F.col("rejected_by").isNotNull(), "rejected").when(F.col("__score") >= match, "match").when(F.col("__score") >= review, "review").otherwise("distinct")
    both = both.withColumn("contributions", F.array(*parts))
    compared = F.size(F.filter("contributions", lambda x: ~x["skipped"]))
    return both.select("l", "r", (F.floor(F.col("__score") * 1000 + 0.5) / 1000).alias("score"), decision.alias("decision"), "rejected_by", compared.alias("compared"), "contributions")


def score_pairs(pairs: DataFrame, records: DataFrame, id_col: str, features: list[Feature], match: float = 0.9, review: float = 0.75) -> DataFrame:
    """``pairs`` (l, r) with ``score`` and ``decision`` of ``explain_pairs``."""
    return explain_pairs(pairs, records, id_col, features, match, review).select("l", "r", "score", "decision")


def contributions(explained: DataFrame) -> DataFrame:
    """(l, r, field, score, weight, skipped, policy): one row per pair and field."""
    return explained.select("l", "r", F.explode("contributions").alias("c")).select("l", "r", "c.*")
