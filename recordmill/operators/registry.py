"""Rules and models: legacy shapes, validation, query plans, versions, and keyed tables that change by snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordmill.operators.reconcile import Compare, Rule
from recordmill.sources.datasets import Selection, expression_problem

# Fixed values.
OPERANDS = ("field", "expression", "constant")
STATUSES = ("draft", "active", "retired")
KEY = "recon_key"


def operand(given: dict | None, legacy: str | None = None) -> dict:
    """An operand; rules from before there were expressions and constants name a column."""
    if given and given.get("kind") in OPERANDS:
        return {"kind": given["kind"], "value": "" if given.get("value") is None else given["value"]}
    return {"kind": "field", "value": legacy or ""}


def compare_field(given: dict, index: int) -> dict:
    a, b = operand(given.get("a"), given.get("fieldA")), operand(given.get("b"), given.get("fieldB"))
    return {
        "label": given.get("label") or a["value"] or b["value"] or f"Value {index + 1}",
        "a": a,
        "b": b,
        "type": given.get("type") or "string",
        "tolerance": given.get("tolerance") or None,
        "fold_case": given.get("caseInsensitive") is not False,
        "trim": given.get("trim") is not False,
    }


def field_problems(fields: list[dict]) -> list[tuple[int, str, str]]:
    """(position from 1, side, code) of all that is wrong with a rule's fields: missing, a code of ``expression_problem``, or both_constant."""
    out = []
    for i, given in enumerate(fields or []):
        f = compare_field(given, i)
        for side in ("a", "b"):
            kind, value = f[side]["kind"], str(f[side]["value"]).strip()
            if not value and kind != "constant":
                out.append((i + 1, side, "missing"))
            elif kind == "expression" and (code := expression_problem(value)):
                out.append((i + 1, side, code))
        if f["a"]["kind"] == f["b"]["kind"] == "constant":
            out.append((i + 1, "", "both_constant"))
    return out


def rule_problems(rule: dict) -> list[str]:
    """Codes of what keeps a rule from being saved or activated: the first missing part, else every problem of its fields."""
    needs = (("name",), ("source_a", "source_b"), ("dataset_a", "dataset_b"), ("key_a", "key_b"), ("fields",))
    for parts in needs:
        if not all(rule.get(p) for p in parts):
            return [f"missing:{'+'.join(parts)}"]
    return [f"field:{i}{side}:{code}" for i, side, code in field_problems(rule["fields"])]


def model_problems(model: dict) -> list[str]:
    """Codes of all that is wrong with a model."""
    config = model.get("config") or {}
    fields = config.get("fields") or []
    out = [f"missing:{p}" for p in ("name", "source", "dataset") if not model.get(p)]
    if not fields:
        out.append("missing:fields")
    out += [f"field:{i}:no_column" for i, f in enumerate(fields, 1) if not f.get("column")]

    def number(x) -> float | None:
        try:
            return float(x)
        except (TypeError, ValueError):
            return None

    if fields and not any((number(f.get("weight")) or 0) > 0 for f in fields):
        out.append("no_weight")
    match, review = number(config.get("match")), number(config.get("review"))
    if match is not None and review is not None and review > match:
        out.append("review_above_match")
    if model.get("destination_table") and not model.get("destination"):
        out.append("missing:destination")
    return out


def plan_rule(rule: dict) -> tuple[list[Selection], list[Selection], Rule]:
    """What each side reads, under aliases, and the rule over these aliases. Constants are never read."""
    sides = {"a": [Selection(rule.get("key_a") or rule.get("key"), KEY)], "b": [Selection(rule.get("key_b") or rule.get("key"), KEY)]}
    compares = []
    for i, given in enumerate(rule.get("fields") or []):
        f = compare_field(given, i)
        over = {}
        for side, chosen in sides.items():
            kind, value = f[side]["kind"], f[side]["value"]
            if kind == "constant":
                over[side] = "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
            else:
                over[side] = f"recon_c{i}{side}"
                chosen.append(Selection(str(value), over[side], "expression" if kind == "expression" else "field"))
        limit = f["tolerance"] or {}
        compares.append(Compare(f["label"], over["a"], over["b"], f["type"], float(limit.get("value") or 0), limit.get("type") == "percent", f["trim"], f["fold_case"]))
    plan = Rule(KEY, KEY, tuple(compares), rule.get("duplicates") or "exception", rule.get("blank_keys") or "exception", rule.get("priority") or "medium")
    return sides["a"], sides["b"], plan


def columns_for(config: dict) -> list[str]:
    """The columns that a model reads: its fields', then id, system and time, each once."""
    names = [f.get("column") for f in config.get("fields") or []] + [config.get(k) for k in ("id_column", "system_column", "updated_column")]
    return list(dict.fromkeys(n for n in names if n))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with ``rows`` in place of those of the same keys: what saving a run's totals or progress, an item's details or a decision comes to."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows.dropDuplicates(keys), allowMissingColumns=True)


def revise(table: DataFrame, changes: DataFrame, key: str, definition: list[str]) -> tuple[DataFrame, DataFrame]:
    """A table of rules or models (key, version, status, owner, ``definition`` columns) after ``changes``, and the version rows to append.

    A change has the key, the columns it sets (null leaves a value as it is), note and actor. A changed definition
    raises the version; a change of status or owner keeps it. Each change of an existing row gives one version row with a
    snapshot. New keys start as drafts of version 1.
    """
    sets = [c for c in changes.columns if c not in (key, "note", "actor")]
    ask = changes.select(key, F.struct(*sets, "note", "actor").alias("ask"))
    both = table.withColumn("known", F.lit(True)).join(ask, key, "full_outer")
    new = F.col("known").isNull()
    edited = F.lit(False)
    for c in definition:
        if c in sets:
            edited = edited | F.col(f"ask.{c}").isNotNull()
    value = {c: F.coalesce(F.col(f"ask.{c}"), F.col(c)) if c in sets else F.col(c) for c in table.columns if c != key}
    value["version"] = F.when(new, 1).otherwise(F.col("version") + edited.cast("int"))
    value["status"] = F.when(new, "draft").otherwise(value["status"])
    made = F.when(new, "created").when(edited, "updated")
    if "status" in sets:
        made = made.when(F.col("ask.status").isNotNull(), F.concat(F.lit("status: "), F.col("ask.status")))
    if "owner" in sets:
        made = made.when(F.col("ask.owner").isNotNull(), F.concat(F.lit("owner: "), F.col("ask.owner")))
    note = F.coalesce(F.col("ask.note"), made)
    rows = both.select(key, *[value[c].alias(c) for c in table.columns if c != key], F.col("ask").isNotNull().alias("asked"), note.alias("note"), F.col("ask.actor").alias("actor"))
    after = rows.select(*table.columns)
    versions = rows.where("asked").select(key, "version", F.to_json(F.struct(*table.columns)).alias("snapshot"), "note", "actor")
    return after, versions


def in_order(table: DataFrame) -> DataFrame:
    """Active rules, then drafts, then the rest; by name."""
    return table.orderBy(status_place(F.col("status")), "name")


def status_place(status: Column) -> Column:
    return F.when(status == "active", 0).when(status == "draft", 1).otherwise(2)


def save_partition(df: DataFrame, path: str, by: str = "run") -> None:
    """Write the rows of some runs in place of what these runs held before; other runs stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def delete_runs(tables: dict[str, DataFrame], gone: DataFrame, key: str = "run") -> dict[str, DataFrame]:
    """Every table without the rows of the runs that are ``gone``, children before their runs in the order given."""
    ids = gone.select(key).distinct()
    return {name: t.join(ids, key, "left_anti") for name, t in tables.items()}


def retained(runs: DataFrame, keep: int) -> DataFrame:
    """The runs beyond the newest ``keep`` of each rule."""
    place = F.row_number().over(W.partitionBy("rule").orderBy(F.desc("started"), F.desc("run")))
    return runs.select("run", place.alias("place")).where(F.col("place") > keep).select("run")


def latest_completed(runs: DataFrame, by: str) -> DataFrame:
    """The newest completed run of each group, such as a principal's."""
    done = runs.where("status = 'completed'")
    return done.groupBy(by).agg(F.max_by("run", F.struct("started", "run")).alias("run"))


def comparable(runs: DataFrame, run: int) -> DataFrame:
    """Completed runs of the tenant of ``run``, newest first, without itself."""
    tenant = runs.where(F.col("run") == run).select("tenant")
    return runs.where((F.col("status") == "completed") & (F.col("run") != run)).join(tenant, "tenant", "left_semi").orderBy(F.desc("started"), F.desc("run"))


def stored_or_computed(stored: DataFrame, computed: DataFrame, key: str = "run") -> DataFrame:
    """Stored totals where a run has them, else those computed now, with ``backfilled``."""
    have = stored.withColumn("backfilled", F.lit(False))
    return have.unionByName(computed.join(stored.select(key), key, "left_anti").withColumn("backfilled", F.lit(True)))


def model_state(runs: DataFrame, state: DataFrame) -> DataFrame:
    """(run, state): ``not_indexed`` where no state row tells, else ``empty`` or ``indexed``."""
    said = F.when(F.col("workspaces").isNull(), "not_indexed").when(F.col("workspaces") == 0, "empty").otherwise("indexed")
    return runs.select("run").join(state.select("run", "workspaces"), "run", "left").select("run", said.alias("state"))
