"""Reconciliation of two order sets that differ by fixed rules, its ledger and its runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordmill.operators import exceptions as ex
from recordmill.operators.cluster import cut
from recordmill.operators.reconcile import Compare, Rule, differences, fingerprint, outcome_counts, reconcile, summary
from recordmill.operators.registry import plan_rule
from recordmill.sources.datasets import project

TOTAL = Compare("total", "cents", "cents", "number")
STATUS = Compare("status", "status", "status")
DATE = Compare("date", "day", "day", "date")


def _sides(spark, sf_dir, shift: int = 0):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    base = orders.selectExpr("o_orderkey k", "cast(round(o_totalprice * 100) as bigint) cents", "o_orderstatus status", "o_orderdate day")
    a = base.where(f"k % 97 <> {1 + shift}").selectExpr("concat('ORD-', k) key", "cents", "status", "day", "k")
    b = base.where(f"k % 89 <> {2 + shift}").selectExpr(
        f"case when k % 307 = 8 then '   ' else concat('  ord-', k, ' ') end key",
        f"case when k % 41 = {4 + shift} then cents * 102 div 100 when k % 31 = {3 + shift} then cents + 1 else cents end cents",
        "case when k % 7 = 0 then lower(status) else status end status",
        f"case when k % 53 = {5 + shift} then day + interval 2 days else day end day",
        "k",
        f"case when k % 211 = {6 + shift} then 2 else 1 end times",
    )
    return a, b.select("*", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "col")


def _sql(shift: int = 0, total="abs(b.cents - a.cents) <= 0", status=None, date=None, duplicates="exception", extra="") -> str:
    conditions = {"total": total, "status": status, "date": date}
    diffs = ", ".join(f"case when not ({c}) then '{n}' end" for n, c in conditions.items() if c)
    twice = "" if duplicates == "first" else "when coalesce(a.n,0) > 1 or coalesce(b.n,0) > 1 then " + ("null" if duplicates == "ignore" else "'duplicate'")
    return f"""with base as (select o_orderkey k, cast(round(o_totalprice * 100) as bigint) cents, o_orderstatus status, o_orderdate as day from orders),
    a0 as (select 'ord-' || k as key, 'ORD-' || k as shown, cents, status, day from base where k % 97 <> {1 + shift}),
    b1 as (select case when k % 307 = 8 then '' else 'ord-' || k end as key, case when k % 41 = {4 + shift} then cents * 102 // 100 when k % 31 = {3 + shift} then cents + 1 else cents end cents,
      case when k % 7 = 0 then lower(status) else status end status, case when k % 53 = {5 + shift} then day + interval 2 days else day end as day, case when k % 211 = {6 + shift} then 2 else 1 end times from base where k % 89 <> {2 + shift}),
    b0 as (select key, cents, status, day, unnest(range(times)) r from b1),
    a as (select key, count(*) n, min(shown) shown, min(cents) cents, min(status) status, min(day) as day from a0 group by key),
    b as (select key, count(*) n, min(cents) cents, min(status) status, min(day) as day from b0 where key <> '' group by key),
    j as (select coalesce(a.shown, b.key) business_key, coalesce(a.n, 0) count_a, coalesce(b.n, 0) count_b, list_filter([{diffs}], lambda x: x is not null) diffs,
      case {twice} when a.n is null then 'missing_from_a' when b.n is null then 'missing_from_b' when len(list_filter([{diffs}], lambda x: x is not null)) > 0 then 'value_mismatch' else 'match' end outcome
      from a full join b on a.key = b.key),
    found as (select business_key, outcome, '' side, count_a, count_b, case when outcome = 'value_mismatch' then diffs end differences from j
      union all select '(missing key)', 'invalid_key', 'b', null, null, null from b0 where key = ''){extra} """


STATUS_SQL, DATE_SQL = "lower(trim(a.status)) = lower(trim(b.status))", "abs(floor(epoch(b.day - a.day) / 86400 + 0.5)) <= 0"
ALL_SQL = {"status": STATUS_SQL, "date": DATE_SQL}
ALL = (TOTAL, STATUS, DATE)
COUNTS = "select o.outcome, count(f.outcome) total from (values ('match'),('value_mismatch'),('missing_from_a'),('missing_from_b'),('duplicate'),('invalid_key')) o(outcome) left join found f using (outcome) group by o.outcome"
PRINT = "'orders|' || outcome || '|' || lower(business_key) || '|' || side"
SEV = "case when outcome in ('duplicate','value_mismatch') then 'medium' when outcome = 'invalid_key' then 'low' else 'high' end"


def _found(spark, sf_dir, fields=(TOTAL,), shift=0, **options):
    a, b = _sides(spark, sf_dir, shift)
    return reconcile(a, b, Rule("key", "key", fields, order="cents", **options))


def _counts(fields=(TOTAL,), **options):
    return lambda spark, sf_dir: outcome_counts(_found(spark, sf_dir, fields, **options))


def _run(spark, sf_dir, shift):
    return fingerprint("orders", _found(spark, sf_dir, ALL, shift)).select("fingerprint", "outcome", "severity")


def _ledger(spark, sf_dir):
    ledger = spark.createDataFrame([], ex.SNAPSHOT)
    for run in (1, 2, 3):
        ledger = cut(ex.fold(ledger, _run(spark, sf_dir, run - 1), run))
    return ledger


def _runs_sql(*runs: int) -> str:
    parts = [f"r{r} as (select distinct {PRINT} fingerprint, outcome, {SEV} severity from ({_sql(r - 1, **ALL_SQL)} select * from found where outcome <> 'match'))" for r in runs]
    return "with " + ", ".join(parts)


LEDGER_SQL = _runs_sql(1, 2, 3) + ", u as (select 1 run, * from r1 union all select 2, * from r2 union all select 3, * from r3), l as (select fingerprint, min(outcome) outcome, min(severity) severity, 'open' status, min(run) first_run, max(run) last_run, count(*) occurrence_count from u group by fingerprint)"
DIFF_SQL = _runs_sql(1, 2) + ", d as (select fingerprint, a.outcome as before, b.outcome as after, case when a.outcome is null then 'introduced' when b.outcome is null then 'resolved' when a.outcome = b.outcome then 'persisting' else 'changed' end as change from r1 a full join r2 b using (fingerprint))"


def _closed(spark, sf_dir):
    """The ledger after the first run, its duplicates resolved."""
    ledger = ex.fold(spark.createDataFrame([], ex.SNAPSHOT), _run(spark, sf_dir, 0), 1)
    return ledger.withColumn("status", F.when(F.col("outcome") == "duplicate", "resolved").otherwise(F.col("status")))


def _events(spark, sf_dir):
    return ex.fold_events(_closed(spark, sf_dir), _run(spark, sf_dir, 1), 2)


def _text_sides(spark, sf_dir):
    """The same sides with amounts and days as text, some of which can't be read."""
    a, b = _sides(spark, sf_dir)
    a = a.selectExpr("key", "cents", "k", "format_number(cast(cents as decimal(20,2)) / 100, 2) amount", "date_format(day, 'yyyy-MM-dd') day")
    b = b.selectExpr("key", "cents", "k", "case when k % 19 = 0 then 'n/a' when k % 2 = 0 then concat(' ', cast(cents as decimal(20,2)) / 100) else format_number(cast(cents as decimal(20,2)) / 100, 2) end amount", "case when k % 17 = 0 then 'soon' when k % 2 = 0 then date_format(day, 'M/d/yyyy') else date_format(day, 'd MMM yyyy') end day")
    return a, b


def _text(spark, sf_dir, *fields):
    found = reconcile(*_text_sides(spark, sf_dir), Rule("key", "key", fields, order="cents"))
    reason = F.coalesce(F.get(F.col("details.reason"), F.lit(0)), F.lit(""))
    return found.groupBy("outcome", reason.alias("reason")).agg(F.count("*").alias("total"))


def _text_sql(condition: str, bad: str, reason: str) -> str:
    return _sql(total=condition) + f"select outcome, case when outcome = 'value_mismatch' and cast(substr(business_key, 5) as bigint) % {bad} = 0 then '{reason}' else '' end reason, count(*) total from found group by all"


def _differences(spark, sf_dir):
    rows = differences(_found(spark, sf_dir, (TOTAL, DATE)))
    shown = [F.when(F.col("field") == "total", F.col(c)).alias(c) for c in ("value_a", "value_b")]
    return rows.select("business_key", "field", *shown, "difference", "reason")


def _values(spark, sf_dir):
    wrong = _found(spark, sf_dir).where("outcome in ('value_mismatch', 'missing_from_a', 'missing_from_b')")
    return wrong.select("business_key", "outcome", F.col("values_a")["total"].alias("total_a"), F.col("values_b")["total"].alias("total_b"))


def _planned(spark, sf_dir):
    """A stored rule, planned: a legacy field, an expression with a constant, and a tolerance in percent."""
    rule = {"key_a": "key", "key_b": "key", "duplicates": "first", "fields": [{"fieldA": "status", "fieldB": "status"}, {"label": "closed", "a": {"kind": "expression", "value": "case when status = 'F' then 'F' else 'x' end"}, "b": {"kind": "constant", "value": "F"}}, {"fieldA": "cents", "fieldB": "cents", "type": "number", "tolerance": {"type": "percent", "value": 3}}]}
    chosen_a, chosen_b, plan = plan_rule(rule)
    a, b = _sides(spark, sf_dir)
    return outcome_counts(reconcile(project(a, chosen_a), project(b, chosen_b), plan))


def _judged(spark, sf_dir):
    ledger = _closed(spark, sf_dir)
    wanted = F.when(F.col("outcome") == "duplicate", "investigating").when(F.col("outcome") == "missing_from_a", "open").otherwise("resolved")
    requests = ledger.select("fingerprint", wanted.alias("to_status"), F.when(F.col("outcome") == "missing_from_b", "").otherwise("fixed").alias("reason"))
    return ex.judge(ledger, requests)


def _diff(spark, sf_dir):
    return ex.diff(_run(spark, sf_dir, 0), _run(spark, sf_dir, 1))


def _verdict(spark, sf_dir):
    return ex.verdict(_diff(spark, sf_dir))


def _delta(spark, sf_dir):
    runs = _run(spark, sf_dir, 0).withColumn("run", F.lit(1)).unionByName(_run(spark, sf_dir, 1).withColumn("run", F.lit(2))).distinct()
    return runs.groupBy("outcome").agg(F.count_if(F.col("run") == 1).alias("before"), F.count_if(F.col("run") == 2).alias("after")).withColumn("delta", F.col("after") - F.col("before"))


PLANS = {
    "recon_text_numbers": (lambda s, d: _text(s, d, Compare("amount", "amount", "amount", "number")), _text_sql("cast(substr(b.key, 5) as bigint) % 19 <> 0 and a.cents = b.cents", "19", "not_a_number")),
    "recon_text_dates": (lambda s, d: _text(s, d, Compare("day", "day", "day", "date")), _text_sql("cast(substr(b.key, 5) as bigint) % 17 <> 0 and abs(floor(epoch(b.day - a.day) / 86400 + 0.5)) <= 0", "17", "not_a_date")),
    "recon_differences": (_differences, _sql() + "select a.shown business_key, 'total' field, a.cents::varchar value_a, b.cents::varchar value_b, (b.cents - a.cents)::double difference, null::varchar reason from a join b on a.key = b.key where a.n = 1 and b.n = 1 and a.cents <> b.cents union all select a.shown, 'date', null, null, floor(epoch(b.day - a.day) / 86400 + 0.5), null from a join b on a.key = b.key where a.n = 1 and b.n = 1 and floor(epoch(b.day - a.day) / 86400 + 0.5) <> 0"),
    "recon_values": (_values, _sql() + "select coalesce(a.shown, b.key) business_key, case when a.n is null then 'missing_from_a' when b.n is null then 'missing_from_b' else 'value_mismatch' end outcome, a.cents::varchar total_a, b.cents::varchar total_b from a full join b on a.key = b.key where coalesce(a.n, 0) <= 1 and coalesce(b.n, 0) <= 1 and (a.n is null or b.n is null or a.cents <> b.cents)"),
    "recon_case_sensitive": (_counts((Compare("status", "status", "status", fold_case=False),)), _sql(total="a.status = b.status") + COUNTS),
    "recon_planned_rule": (_planned, _sql(total="a.status = 'F' and abs(b.cents - a.cents) <= abs(a.cents) * 3.0 / 100", duplicates="first") + COUNTS),
    "recon_outcomes": (_counts(ALL), _sql(**ALL_SQL) + COUNTS),
    "recon_summary": (lambda s, d: summary(_found(s, d, ALL)), _sql(**ALL_SQL) + "select cast(sum(count_a) as bigint) keyed_a, cast(sum(count_b) as bigint) keyed_b, count(count_a) keys_compared, count(*) filter (outcome = 'match') matched, count(*) filter (outcome <> 'match') exceptions, count(*) filter (outcome <> 'match') = 0 passed from found"),
    "recon_value_mismatch_fields": (lambda s, d: _found(s, d, ALL).select(F.explode("differences").alias("field")).groupBy("field").agg(F.count("*").alias("total")), _sql(**ALL_SQL) + "select field, count(*) total from (select unnest(differences) field from found) group by field"),
    "recon_duplicates": (lambda s, d: _found(s, d).where("outcome = 'duplicate'").select("business_key", "count_a", "count_b"), _sql() + "select business_key, count_a, count_b from found where outcome = 'duplicate'"),
    "recon_duplicates_first": (_counts(duplicates="first"), _sql(duplicates="first") + COUNTS),
    "recon_duplicates_ignored": (_counts(duplicates="ignore"), _sql(duplicates="ignore") + COUNTS),
    "recon_invalid_keys": (lambda s, d: _found(s, d).where("outcome = 'invalid_key'").groupBy("side").agg(F.count("*").alias("total")), _sql() + "select side, count(*) total from found where outcome = 'invalid_key' group by side"),
    "recon_tolerance_abs": (_counts((Compare("total", "cents", "cents", "number", 1),)), _sql(total="abs(b.cents - a.cents) <= 1") + COUNTS),
    "recon_tolerance_pct": (_counts((Compare("total", "cents", "cents", "number", 3, True),)), _sql(total="abs(b.cents - a.cents) <= abs(a.cents) * 3.0 / 100") + COUNTS),
    "recon_date_tolerance": (_counts((Compare("date", "day", "day", "date", 2),)), _sql(total="abs(floor(epoch(b.day - a.day) / 86400 + 0.5)) <= 2") + COUNTS),
    "recon_constant_operand": (_counts((Compare("status", "status", "'F'"),)), _sql(total="lower(a.status) = 'f'") + COUNTS),
    "recon_expression_operand": (_counts((Compare("status", "upper(status)", "upper(status)"),)), _sql(total="upper(a.status) = upper(b.status)") + COUNTS),
    "recon_severity_priority": (lambda s, d: _found(s, d, priority="high").where("outcome <> 'match'").groupBy("outcome", "severity").agg(F.count("*").alias("total")), _sql() + "select outcome, case when outcome = 'invalid_key' then 'low' else 'high' end severity, count(*) total from found where outcome <> 'match' group by outcome"),
    "exception_fold": (_ledger, LEDGER_SQL + " select * from l"),
    "exception_status_counts": (lambda s, d: _ledger(s, d).groupBy("status", "outcome").agg(F.count("*").alias("total")), LEDGER_SQL + " select status, outcome, count(*) total from l group by all"),
    "fold_events": (_events, _runs_sql(1, 2) + " select fingerprint, 2 run, r1.fingerprint is null is_new, case when r1.fingerprint is null then 'identified' when r1.outcome = 'duplicate' then 'reopened' else 'seen' end action, case when r1.outcome = 'duplicate' then 'resolved' when r1.outcome is not null then 'open' end from_status from r2 left join r1 using (fingerprint)"),
    "bulk_eligibility": (_judged, _runs_sql(1) + " , q as (select fingerprint, case outcome when 'duplicate' then 'investigating' when 'missing_from_a' then 'open' else 'resolved' end to_status, case when outcome = 'missing_from_b' then '' else 'fixed' end reason, case when outcome = 'duplicate' then 'resolved' else 'open' end status from r1) select fingerprint, to_status, reason, status, case when status = 'resolved' then 'barred:resolved>investigating' when to_status = 'resolved' and reason = '' then 'reason_missing' end problem from q"),
    "severity_mix": (lambda s, d: _ledger(s, d).groupBy("severity").agg(F.count("*").alias("total")), LEDGER_SQL + " select severity, count(*) total from l group by all"),
    "exception_recurrence": (lambda s, d: _ledger(s, d).groupBy("occurrence_count").agg(F.count("*").alias("total")), LEDGER_SQL + " select occurrence_count, count(*) total from l group by all"),
    "run_diff_findings": (lambda s, d: _diff(s, d).groupBy("change").agg(F.count("*").alias("total")), DIFF_SQL + " select change, count(*) total from d group by change"),
    "run_outcome_delta": (_delta, _runs_sql(1, 2) + " select outcome, count(*) filter (run = 1) as before, count(*) filter (run = 2) as after, count(*) filter (run = 2) - count(*) filter (run = 1) delta from (select 1 run, * from r1 union all select 2, * from r2) group by outcome"),
    "run_verdicts": (_verdict, DIFF_SQL + " , c as (select count(*) filter (change='introduced') introduced, count(*) filter (change='resolved') resolved, count(*) filter (change='persisting') persisting, count(*) filter (change='changed') changed from d) select *, introduced - resolved net_change, case when introduced + resolved + changed = 0 then case when persisting > 0 then 'unchanged' else 'clean' end when introduced > 0 and resolved = 0 then 'worse' when resolved > 0 and introduced = 0 then 'better' else 'churn' end verdict from c"),
}
