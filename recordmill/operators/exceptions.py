"""The exception ledger and the comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The statuses that each status may change to.
TRANSITIONS = {
    "open": ("acknowledged", "investigating", "resolved", "accepted"),
    "acknowledged": ("investigating", "resolved", "accepted", "open"),
    "investigating": ("resolved", "accepted", "open"),
    "resolved": ("open",),
    "accepted": ("open",),
}
CLOSED = ("resolved", "accepted")
SNAPSHOT = "fingerprint string, outcome string, severity string, status string, first_run int, last_run int, occurrence_count int"


def _led(findings: DataFrame, columns: list[str], order: Column | None = None) -> DataFrame:
    """``firsts`` with ``__lead``, a number that leads sorts and joins: fingerprints begin alike, which is slow to compare."""
    if order is None:
        order = F.col("position") if "position" in findings.columns else F.struct(*columns)
    return findings.groupBy(F.xxhash64("fingerprint").alias("__lead"), "fingerprint").agg(F.min_by(F.struct(*columns), order).alias("x")).select("__lead", "fingerprint", "x.*")


def firsts(findings: DataFrame, columns: list[str], order: Column | None = None) -> DataFrame:
    """The first finding of each fingerprint: by ``order``, the findings' column ``position`` or, without either, by outcome and severity."""
    return _led(findings, columns, order).drop("__lead")


def fold(ledger: DataFrame, findings: DataFrame, run: int, order: Column | None = None) -> DataFrame:
    """The ledger after a run: new findings open, known ones are counted once, closed ones that come back are open again.

    Of several findings of one fingerprint the first counts (see ``firsts``). Columns of the ledger beyond those of
    ``SNAPSHOT`` are kept.
    """
    batch = _led(findings, ["outcome", "severity"], order).withColumnsRenamed({"outcome": "new_outcome", "severity": "new_severity"})
    seen = F.col("new_outcome").isNotNull()
    status = F.when(F.col("status").isNull(), "open").when(seen & F.col("status").isin(*CLOSED), "open").otherwise(F.col("status"))
    led = ledger.withColumn("__lead", F.xxhash64("fingerprint"))
    return led.join(batch, ["__lead", "fingerprint"], "full_outer").select(
        "fingerprint",
        F.coalesce("new_outcome", "outcome").alias("outcome"),
        F.coalesce("new_severity", "severity").alias("severity"),
        status.alias("status"),
        F.coalesce("first_run", F.lit(run)).alias("first_run"),
        F.when(seen, run).otherwise(F.col("last_run")).alias("last_run"),
        (F.coalesce("occurrence_count", F.lit(0)) + seen.cast("int")).alias("occurrence_count"),
        *[c for c in ledger.columns if c not in StructType.fromDDL(SNAPSHOT).names],
    )


def fold_events(ledger: DataFrame, findings: DataFrame, run: int) -> DataFrame:
    """(fingerprint, run, is_new, action, from_status) of every finding of a run: identified, reopened or seen."""
    seen = findings.select("fingerprint").distinct().join(ledger.select("fingerprint", "status"), "fingerprint", "left")
    action = F.when(F.col("status").isNull(), "identified").when(F.col("status").isin(*CLOSED), "reopened").otherwise("seen")
    return seen.select("fingerprint", F.lit(run).alias("run"), F.col("status").isNull().alias("is_new"), action.alias("action"), F.col("status").alias("from_status"))


def judge(ledger: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (fingerprint, to_status and more) with ``status``, and ``problem``: a code that says why one can't be met, or null.

    ``unknown``: no such exception. ``barred:A>B``: status A may not become B. ``reason_missing``: closing needs a reason,
    if ``requests`` has that column. A request for the present status or for none is no move.
    """
    both = requests.join(ledger.select("fingerprint", "status"), "fingerprint", "left")
    moves = F.create_map(*[x for a, bs in TRANSITIONS.items() for x in (F.lit(a), F.array(*map(F.lit, bs)))])
    move = F.col("to_status").isNotNull() & (F.col("to_status") != F.col("status"))
    barred = move & ~F.coalesce(F.array_contains(moves[F.col("status")], F.col("to_status")), F.lit(False))
    problem = F.when(F.col("status").isNull(), "unknown").when(barred, F.format_string("barred:%s>%s", "status", "to_status"))
    if "reason" in requests.columns:
        problem = problem.when(move & F.col("to_status").isin(*CLOSED) & (F.trim(F.coalesce("reason", F.lit(""))) == ""), "reason_missing")
    return both.withColumn("problem", problem)


def change(ledger: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ledger after ``requests``, the events, and the requests that were skipped with their problem.

    ``ledger`` has owner and reason besides the columns of ``SNAPSHOT``; ``requests`` has one row for each fingerprint:
    owner, severity, to_status, comment and reason, null where nothing is asked for (an empty owner clears it). Only
    what differs changes; each difference is an event, and a comment is one of its own unless the status moves.
    """
    judged = judge(ledger, requests)
    asked = judged.where("problem is null").select("fingerprint", F.struct("owner", "severity", "to_status", "comment", "reason").alias("ask"))
    both = ledger.join(asked, "fingerprint", "left")
    owner = F.nullif(F.col("ask.owner"), F.lit(""))
    assigned = F.col("ask.owner").isNotNull() & ~owner.eqNullSafe(F.col("owner"))
    graded = F.coalesce(F.col("ask.severity") != F.col("severity"), F.lit(False))
    moved = F.coalesce(F.col("ask.to_status") != F.col("status"), F.lit(False))

    def event(when, action, was, now):
        return F.when(when, F.struct(F.lit(action).alias("action"), was.cast("string").alias("was"), now.cast("string").alias("now")))

    no = F.lit(None)
    events = F.array_compact(
        F.array(
            event(assigned, "assigned", F.col("owner"), owner),
            event(graded, "severity-change", F.col("severity"), F.col("ask.severity")),
            event(moved, "status-change", F.col("status"), F.col("ask.to_status")),
            event(~moved & F.col("ask.comment").isNotNull(), "comment", no, F.col("ask.comment")),
        )
    )
    new = {
        "owner": F.when(assigned, owner).otherwise(F.col("owner")),
        "severity": F.when(graded, F.col("ask.severity")).otherwise(F.col("severity")),
        "status": F.when(moved, F.col("ask.to_status")).otherwise(F.col("status")),
        "reason": F.when(moved, F.coalesce("ask.reason", "reason")).otherwise(F.col("reason")),
    }
    after = both.select(*[new.get(c, F.col(c)).alias(c) for c in ledger.columns])
    log = both.where("ask is not null").select("fingerprint", F.explode(events).alias("e")).select("fingerprint", "e.*")
    return after, log, judged.where("problem is not null")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings of two runs side by side: introduced, resolved, persisting, or changed where the outcome differs."""
    first = lambda df, name: _led(df, ["outcome"]).withColumnRenamed("outcome", name)
    both = first(before, "before").join(first(after, "after"), ["__lead", "fingerprint"], "full_outer").drop("__lead")
    change = F.when(F.col("before").isNull(), "introduced").when(F.col("after").isNull(), "resolved").when(F.col("before") == F.col("after"), "persisting").otherwise("changed")
    return both.withColumn("change", change)


def said() -> Column:
    """The verdict on columns introduced, resolved, persisting and changed."""
    none = F.col("changed") == 0
    out = F.when((F.col("introduced") == 0) & (F.col("resolved") == 0) & none, F.when(F.col("persisting") > 0, "unchanged").otherwise("clean"))
    return out.when((F.col("introduced") > 0) & (F.col("resolved") == 0), "worse").when((F.col("resolved") > 0) & (F.col("introduced") == 0), "better").otherwise("churn")


def verdict(changes: DataFrame) -> DataFrame:
    n = {x: F.count_if(F.col("change") == x) for x in ("introduced", "resolved", "persisting", "changed")}
    c = changes.agg(*[v.alias(k) for k, v in n.items()])
    return c.withColumn("net_change", F.col("introduced") - F.col("resolved")).withColumn("verdict", said())
