"""Two-source reconciliation: a full outer match on a business key with typed comparison."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.functions import convert
from recordmill.functions.text import normalise_key, trim

OUTCOMES = ("match", "value_mismatch", "missing_from_a", "missing_from_b", "duplicate", "invalid_key")
# The severity of each outcome before the rule's priority.
SEVERITY = {"match": "none", "missing_from_a": "high", "missing_from_b": "high", "value_mismatch": "medium", "duplicate": "medium", "invalid_key": "low"}


@dataclass(frozen=True)
class Compare:
    """One compared value; ``a`` and ``b`` are SQL expressions over their side (a constant is a literal)."""

    label: str
    a: str
    b: str
    kind: str = "string"  # or number, date
    tolerance: float = 0.0
    percent: bool = False
    trim: bool = True
    fold_case: bool = True


@dataclass(frozen=True)
class Rule:
    key_a: str
    key_b: str
    fields: tuple[Compare, ...] = field(default_factory=tuple)
    duplicates: str = "exception"  # or ignore, first
    blank_keys: str = "exception"  # or ignore
    priority: str = "medium"
    fold_case: bool = True
    order: str = "1"  # expression that says which row of a key is first


#: One unequal field: text of both values, B - A (of dates in days), and why values can't be compared.
DETAIL = "struct<field:string,value_a:string,value_b:string,difference:double,reason:string>"


def _prepared(c: Column, kind, compare: Compare) -> Column:
    """A value in the form that is compared, and its text."""
    text = convert.as_text(c, kind)
    shown = F.nullif(text, F.lit(""))
    if compare.kind == "number":
        ready = convert.number(c, kind)
    elif compare.kind == "date":
        ready = convert.time(c, kind)
    else:
        ready = F.coalesce(trim(text) if compare.trim else text, F.lit(""))
        ready = F.lower(ready) if compare.fold_case else ready
    return F.struct(ready.alias("x"), shown.alias("t"))


def judged(c: Compare, a: Column, b: Column) -> Column:
    """Struct of ``equal``, ``difference`` and ``reason`` for two prepared values.

    Both missing is equal. A number or date that is missing or unreadable on one side is unequal, with a reason. Text is
    compared without outer white space and case, unless the field says otherwise; missing text is empty text.
    """
    none, no_reason = F.lit(None).cast("double"), F.lit(None).cast("string")
    if c.kind == "number":
        d = (b["x"] - a["x"]).cast("double")
        same = F.abs(d) <= (F.abs(a["x"]).cast("double") * c.tolerance / 100 if c.percent else F.lit(float(c.tolerance)))
    elif c.kind == "date":
        d = F.floor((F.unix_millis(b["x"]) - F.unix_millis(a["x"])) / 86_400_000 + 0.5).cast("double")
        same = F.abs(d) <= c.tolerance
    else:
        return F.struct((a["x"] == b["x"]).alias("equal"), none.alias("difference"), no_reason.alias("reason"))
    both = a["t"].isNull() & b["t"].isNull()
    bad = a["x"].isNull() | b["x"].isNull()
    reason = F.when(~both & bad, f"not_a_{c.kind}")
    return F.struct(F.when(both, True).when(bad, False).otherwise(same).alias("equal"), F.when(~both, d).alias("difference"), reason.alias("reason"))


def _side(df: DataFrame, key: str, rule: Rule, side: str) -> DataFrame:
    exprs = [F.expr(getattr(c, side)) for c in rule.fields]
    kinds = [f.dataType for f in df.select(*[e.alias(f"v{i}") for i, e in enumerate(exprs)]).schema] if exprs else []
    values = [_prepared(e, kind, c).alias(f"v{i}") for i, (e, kind, c) in enumerate(zip(exprs, kinds, rule.fields, strict=True))]
    raw = F.expr(key).cast("string")
    return df.select(normalise_key(raw, rule.fold_case).alias("k"), trim(raw).alias("shown"), F.expr(rule.order).alias("o"), *values)


def _grouped(side: DataFrame, name: str, width: int) -> DataFrame:
    first = F.min_by(F.struct("shown", *[f"v{i}" for i in range(width)]), F.struct("o", "shown"))
    # A number leads the sort: texts that begin alike are slow to compare.
    return side.where("k <> ''").groupBy(F.xxhash64("k").alias("h"), "k").agg(F.count("*").alias(f"n_{name}"), first.alias(name))


def severity(outcome: Column, priority: str) -> Column:
    base = F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), outcome)
    if priority == "high":
        return F.when(base == "medium", "high").otherwise(base)
    return F.when(base == "high", "medium").otherwise(base) if priority == "low" else base


def reconcile(a: DataFrame, b: DataFrame, rule: Rule) -> DataFrame:
    """One row per key and blank-key row: business_key, outcome, side, count_a, count_b, differences, details, values_a, values_b, severity.

    ``differences`` names the unequal fields and ``details`` says how they differ; ``values_a`` and ``values_b`` hold the
    compared values by label where a side is there and something is wrong. Each side is aggregated to one row per key
    before the join, so neither duplicates nor a hot key multiply rows.
    """
    left, right = _side(a, rule.key_a, rule, "a"), _side(b, rule.key_b, rule, "b")
    width = len(rule.fields)
    both = _grouped(left, "a", width).join(_grouped(right, "b", width), ["h", "k"], "full_outer")
    n_a, n_b = F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0))
    results = [judged(c, F.col(f"a.v{i}"), F.col(f"b.v{i}")) for i, c in enumerate(rule.fields)]
    both = both.select("*", *[r.alias(f"r{i}") for i, r in enumerate(results)])
    unequal = [F.when(~F.col(f"r{i}.equal"), F.struct(F.lit(c.label).alias("field"), F.col(f"a.v{i}.t").alias("value_a"), F.col(f"b.v{i}.t").alias("value_b"), F.col(f"r{i}.difference").alias("difference"), F.col(f"r{i}.reason").alias("reason"))) for i, c in enumerate(rule.fields)]
    details = F.array_compact(F.array(*unequal)) if unequal else F.expr(f"cast(array() as array<{DETAIL}>)")
    both = both.withColumn("details", details)
    twice = F.lit(False) if rule.duplicates == "first" else (n_a > 1) | (n_b > 1)
    outcome = F.when(twice, F.lit(None if rule.duplicates == "ignore" else "duplicate")).when(n_a == 0, "missing_from_a").when(n_b == 0, "missing_from_b")
    outcome = outcome.when(F.size("details") > 0, "value_mismatch").otherwise("match")
    wrong = F.col("outcome").isin("value_mismatch", "missing_from_a", "missing_from_b")

    def values(side: str) -> Column:
        pairs = [x for i, c in enumerate(rule.fields) for x in (F.lit(c.label), F.col(f"{side}.v{i}.t"))]
        made = F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")
        return F.when(wrong & F.col(f"n_{side}").isNotNull(), made).alias(f"values_{side}")

    found = both.withColumn("outcome", outcome)
    mismatch = F.col("outcome") == "value_mismatch"
    found = found.select(
        F.coalesce("a.shown", "b.shown").alias("business_key"), "outcome", F.lit("").alias("side"), n_a.alias("count_a"), n_b.alias("count_b"),
        F.when(mismatch, F.col("details.field")).alias("differences"), F.when(mismatch, F.col("details")).alias("details"), values("a"), values("b"),
    )
    if rule.blank_keys != "ignore":
        for name, side in (("a", left), ("b", right)):
            blank = side.where("k = ''").select(F.lit("(missing key)").alias("business_key"), F.lit("invalid_key").alias("outcome"), F.lit(name).alias("side"))
            found = found.unionByName(blank, allowMissingColumns=True)
    return found.withColumn("severity", severity(F.col("outcome"), rule.priority))


def differences(found: DataFrame) -> DataFrame:
    """(business_key, field, value_a, value_b, difference, reason) of every unequal field."""
    return found.where("details is not null").select("business_key", F.explode("details").alias("d")).select("business_key", "d.*")


def outcome_counts(found: DataFrame) -> DataFrame:
    """All six outcomes, zeros included, in one pass."""
    counts = found.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])
    return counts.unpivot([], list(OUTCOMES), "outcome", "total")


def summary(found: DataFrame) -> DataFrame:
    exceptions = F.count_if(F.col("outcome") != "match")
    return found.agg(
        F.coalesce(F.sum("count_a"), F.lit(0)).cast("long").alias("keyed_a"),
        F.coalesce(F.sum("count_b"), F.lit(0)).cast("long").alias("keyed_b"),
        F.count("count_a").alias("keys_compared"),
        F.count_if(F.col("outcome") == "match").alias("matched"),
        exceptions.alias("exceptions"),
        (exceptions == 0).alias("passed"),
    )


def fingerprint(rule_id: str, found: DataFrame) -> DataFrame:
    key = F.lower("business_key")
    return found.where("outcome <> 'match'").withColumn("fingerprint", F.concat_ws("|", F.lit(rule_id), "outcome", key, "side"))
