"""Reading the exception ledger: one filter for lists, counts and bulk actions, lookups, and the dashboard's panels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.functions.convert import COLLATION
from recordmill.operators.cluster import sequenced

from recordmill.operators.exceptions import CLOSED

#: Columns of a listing; values and differences stay unread.
LISTED = ("id", "rule", "rule_name", "area", "business_key", "outcome", "severity", "status", "owner", "occurrences", "first_seen", "last_seen", "last_run")
# Most and usual rows of a listing and of a bulk action.
LIST_MOST, LIST_USUAL, ACTION_MOST, ACTION_USUAL = 2000, 500, 20_000, 5000


@dataclass(frozen=True)
class Filter:
    """Equalities that hold together; what is None isn't asked. ``open_only`` leaves out closed exceptions."""

    status: str | None = None
    severity: str | None = None
    outcome: str | None = None
    rule: int | None = None
    owner: str | None = None
    run: int | None = None
    open_only: bool = False

    def column(self) -> Column:
        out = F.lit(True)
        for name, value in (("status", self.status), ("severity", self.severity), ("outcome", self.outcome), ("rule", self.rule), ("owner", self.owner), ("last_run", self.run)):
            if value not in (None, ""):
                out = out & (F.col(name) == value)
        return out & ~F.col("status").isin(*CLOSED) if self.open_only else out

    def narrow(self) -> bool:
        """Whether it names a rule, run, status, severity or outcome; a bulk action on all there is isn't meant."""
        return any(x not in (None, "") for x in (self.rule, self.run, self.status, self.severity, self.outcome))


def read_filter(asked: dict) -> Filter:
    """A filter from request values: open exceptions only, unless a status or ``all`` is asked for."""
    whole = asked.get("all") in (True, "1", "true")
    text = {k: asked.get(k) or None for k in ("status", "severity", "outcome", "owner")}
    ids = {k: int(asked[k]) if str(asked.get(k) or "").strip().lstrip("-").isdigit() else None for k in ("rule", "run")}
    return Filter(**text, **ids, open_only=not text["status"] and not whole)


def clamp(asked: int | None, usual: int, most: int) -> int:
    return max(1, min(most, asked or usual))


def by_severity() -> list[Column]:
    return [F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2), F.desc("last_seen"), F.asc("id")]


def listing(ledger: DataFrame, wanted: Filter, limit: int | None = None) -> DataFrame:
    """The page that a filter shows: most severe first, then last seen, then id."""
    rows = ledger.where(wanted.column()).select(*[c for c in LISTED if c in ledger.columns])
    return rows.orderBy(*by_severity()).limit(clamp(limit, LIST_USUAL, LIST_MOST))


def count(ledger: DataFrame, wanted: Filter) -> DataFrame:
    return ledger.where(wanted.column()).agg(F.count("*").alias("total"))


def for_action(ledger: DataFrame, wanted: Filter, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What a bulk action on a filter touches, by id up to a bound, and one row that says whether more were left (``truncated``)."""
    if not wanted.narrow():
        raise ValueError("filter_too_wide")
    cap = clamp(most, ACTION_USUAL, ACTION_MOST)
    rows = ledger.where(wanted.column())
    return rows.orderBy("id").limit(cap), rows.limit(cap + 1).agg((F.count("*") > cap).alias("truncated"))


def by_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows that a table of ids names, and those of several runs likewise; no id is written into a statement."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def has_findings(findings: DataFrame, run: int) -> bool:
    return not findings.where(F.col("run") == run).isEmpty()


def missing_detail(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Runs that count exceptions but hold no findings."""
    return runs.where("exception_count > 0").join(findings.select("run").distinct(), "run", "left_anti")


def with_status(findings: DataFrame, ledger: DataFrame) -> DataFrame:
    """Findings with the status and owner of their exception."""
    return findings.join(ledger.select("fingerprint", "status", "owner"), "fingerprint")


def with_run(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """Findings with their run's rule name, null where the run is gone."""
    return findings.join(runs.select("run", "rule_name"), "run", "left")


def run_detail(ledger: DataFrame, run: int, limit: int | None = None) -> DataFrame:
    """Exceptions that were last seen in a run."""
    return listing(ledger, Filter(run=run), limit)


def by_business_key(rows: DataFrame, order: list[str] = ["id"]) -> DataFrame:  # noqa: B006
    """``rows`` with ``place`` by business key as people sort it, ties by ``order``."""
    return sequenced(rows, [F.collate(F.col("business_key").cast("string"), COLLATION).asc(), *[F.asc(c) for c in order]], "place")


def placed(findings: DataFrame) -> DataFrame:
    """``findings`` with ``place``, their number from 1 in all runs by run and fingerprint, in files of whole ranges of it.

    Written as it is, a page of a run is a range of places, which few files and row groups hold.
    """
    return sequenced(findings, [F.asc("run"), F.asc("fingerprint"), F.asc("outcome"), F.asc("severity")], "place")


def offsets(rows: DataFrame) -> DataFrame:
    """(run, start, n): the place of each run's first finding and how many it has, from ``placed`` rows."""
    return rows.groupBy("run").agg(F.min("place").alias("start"), F.count("*").alias("n"))


def page(rows: DataFrame, run: int, number: int = 0, size: int = LIST_USUAL) -> DataFrame:
    """Page ``number`` from 0 of a run's findings: one range of places, which the scan is asked for."""
    start = offsets(rows.where(F.col("run") == run)).head()
    first = (start["start"] if start else 0) + max(0, number) * size
    return rows.where((F.col("run") == run) & (F.col("place") >= first) & (F.col("place") < first + size))


def findings_of(rows: DataFrame) -> DataFrame:
    """(run, n, first): how many findings each run has and its first fingerprint, from ``placed`` rows; ``page`` shows them."""
    starts = offsets(rows)
    return starts.join(rows.select(F.col("place").alias("start"), F.col("fingerprint").alias("first")), "start").select("run", "n", "first")


def counts(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("total"))


def ageing(ledger: DataFrame, today: Column) -> DataFrame:
    """Open exceptions seen first within 7 days, 8 to 30 days and longer ago."""
    days = F.datediff(today, F.col("first_seen").cast("date"))
    opened = ledger.where(~F.col("status").isin(*CLOSED)).select(days.alias("days"))
    return opened.agg(F.count_if(F.col("days") <= 7).alias("week"), F.count_if(F.col("days").between(8, 30)).alias("month"), F.count_if(F.col("days") > 30).alias("older"))


def owners(rows: DataFrame) -> DataFrame:
    """Totals by owner as it is written; none is ``(unassigned)``."""
    return counts(rows, "owner").select(F.coalesce("owner", F.lit("(unassigned)")).alias("owner"), "total")


def headline(rows: DataFrame) -> DataFrame:
    """One row: how many exceptions are open, and how many there are."""
    return rows.agg(F.count_if(~F.col("status").isin(*CLOSED)).alias("open"), F.count("*").alias("total"))


def top_rules(rows: DataFrame, most: int = 20) -> DataFrame:
    """The rules with most open exceptions, ties by rule."""
    open_ = rows.where(~F.col("status").isin(*CLOSED))
    top = open_.groupBy("rule", "rule_name", "area").agg(F.count("*").alias("open_count"), F.max("occurrences").alias("worst_recurrence"), F.max("last_seen").alias("last_seen"))
    return top.orderBy(F.desc("open_count"), "rule").limit(most)


def panels(rules: DataFrame, ledger: DataFrame, runs: DataFrame, findings: DataFrame, today: Column, run: int | None = None) -> dict[str, DataFrame]:
    """The nine panels, of the standing ledger or, with ``run``, of what that run found; rules, recent runs and ageing are the same for both.

    In a run's panel of rules ``worst_recurrence`` is 1 if anything found was new.
    """
    open_ = ledger.where(~F.col("status").isin(*CLOSED))
    shared = {"rules": counts(rules, "status"), "recent_runs": runs.orderBy(F.desc("started"), F.desc("run")).limit(15), "ageing": ageing(ledger, today)}
    if run is None:
        return shared | {"status": counts(ledger, "status"), "outcome": counts(open_, "outcome"), "severity": counts(open_, "severity"), "top_rules": top_rules(ledger), "owners": owners(open_), "run": runs.limit(0)}
    found = findings.where(F.col("run") == run)
    known = with_status(found, ledger)
    top = with_run(found, runs).groupBy("rule").agg(F.max("rule_name").alias("rule_name"), F.lit(None).cast("string").alias("area"), F.count("*").alias("open_count"), F.max(F.col("is_new").cast("int")).alias("worst_recurrence"), F.max("recorded").alias("last_seen"))
    return shared | {"status": counts(known, "status"), "outcome": counts(found, "outcome"), "severity": counts(found, "severity"), "top_rules": top.orderBy(F.desc("open_count"), "rule").limit(20), "owners": owners(known), "run": runs.where(F.col("run") == run)}
