"""Runs compared, the ledger read by filters and panels, rules versioned: orders as runs or exceptions, line items as findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordmill.operators import compare, ledger, registry

from .records import _read

RUNS = """select o_orderkey run, o_custkey rule, concat('rule ', o_custkey) rule_name, o_custkey % 4 tenant, o_orderkey % 2 as version, case o_orderstatus when 'P' then 'failed' else 'completed' end status, o_orderdate started,
 o_orderkey % 100 records_a, o_custkey % 100 records_b, cast(round(o_totalprice) as bigint) keys_compared, case when o_orderkey % 13 = 0 then null else o_orderkey % 17 end matched, o_orderkey % 7 exception_count from {orders}"""
FINDINGS = """select l_orderkey run, concat('f', l_partkey % 9) fingerprint, case l_linenumber % 3 when 0 then 'value_mismatch' when 1 then 'duplicate' else 'missing_from_a' end outcome,
 case l_suppkey % 4 when 0 then 'high' when 1 then 'medium' when 2 then 'low' else 'odd' end severity, l_linenumber * 1000000 + l_suppkey as position, l_partkey % 5 = 0 is_new, l_shipdate recorded, l_orderkey % 50 rule from {lineitem} where l_orderkey % 3 <> 0"""
LEDGER = """select o_orderkey id, o_custkey rule, concat('rule ', o_custkey) rule_name, o_orderkey % 3 area, concat('K', o_orderkey) business_key, case o_orderkey % 4 when 0 then 'duplicate' when 1 then 'value_mismatch' when 2 then 'missing_from_a' else 'invalid_key' end outcome,
 case o_orderkey % 3 when 0 then 'high' when 1 then 'medium' else 'low' end severity, case o_orderstatus when 'F' then 'resolved' when 'O' then 'open' else 'investigating' end status, case when o_orderkey % 5 <> 0 then o_orderpriority end as owner,
 o_orderkey % 9 occurrences, o_orderdate first_seen, o_orderdate last_seen, o_custkey % 50 last_run, concat('e', o_orderkey) fingerprint from {orders}"""
PRINTS = "select concat('f', k) fingerprint, case when k % 3 = 0 then 'resolved' else 'open' end status, case when k % 2 = 0 then concat('o', k) end as owner from (select distinct o_orderkey % 9 k from {orders}) t"


def _table(text):
    """The same text for Spark and, by ``_sql``, for the oracle."""
    names = [n for n in ("orders", "lineitem", "supplier", "customer", "nation", "part", "events") if "{" + n + "}" in text]
    return lambda s, d: s.sql(text, **{n: _read(s, d, n) for n in names})


def _sql(**tables):
    parts = []
    for name, text in tables.items():
        for n in ("orders", "lineitem", "supplier", "customer", "nation", "part", "events"):
            text = text.replace("{" + n + "}", n)
        parts.append(f"{name} as ({text})")
    return "with " + ", ".join(parts)


runs, findings, exceptions, prints = map(_table, (RUNS, FINDINGS, LEDGER, PRINTS))
PAIRS = _sql(runs=RUNS, findings=FINDINGS) + ", ranked as (select *, row_number() over w n, lead(run) over w earlier, lead(version) over w v0, count(*) over (partition by rule) run_count from runs where status = 'completed' window w as (partition by rule order by started desc, run desc)), pairs as (select rule, run later, earlier, run_count, version <> v0 version_changed, coalesce(exception_count, 0) exceptions from ranked where n = 1) "


def _deltas(s, d):
    r = runs(s, d)
    return compare.metric_deltas(compare.latest_pairs(r).where("earlier is not null"), r)


DELTAS = PAIRS + ", m as (select run, unnest(['records_a','records_b','keys_compared','matched','exception_count']) metric, unnest(['none','none','none','up','down']) better, unnest([records_a, records_b, keys_compared, matched, exception_count]::double[]) v from runs), j as (select p.earlier, p.later, a.metric, a.better, b.v before_, a.v after_ from pairs p join m a on a.run = p.later join m b on b.run = p.earlier and b.metric = a.metric) select earlier, later, metric, before_ as before, after_ as after, after_ - before_ delta, case when before_ <> 0 then floor((after_ - before_) / before_ * 100 * 10 + 0.5) / 10 end percent, case when after_ - before_ is null or after_ = before_ then 'unchanged' when better = 'none' then 'changed' when (better = 'up') = (after_ > before_) then 'improved' else 'worsened' end direction from j"
ACROSS = PAIRS + """, x as (select p.rule, f.fingerprint, arg_min(f.outcome, f.position) filter (f.run = p.later) a, arg_min(f.outcome, f.position) filter (f.run = p.earlier) b from pairs p join findings f on f.run = p.later or f.run = p.earlier group by all),
 m as (select rule, count(*) filter (b is null) introduced, count(*) filter (a is null) resolved, count(*) filter (a = b) persisting, count(*) filter (a <> b) changed from x group by 1),
 v as (select p.rule, count(*) filter (severity = 'high') high, count(*) filter (severity = 'low') low, count(*) filter (severity not in ('high', 'low')) medium from pairs p join findings f on f.run = p.later group by 1)
 select p.rule, later, earlier, run_count, exceptions, coalesce(high, 0) high, coalesce(medium, 0) medium, coalesce(low, 0) low, earlier is not null comparable, version_changed, case when earlier is not null then coalesce(introduced, 0) end introduced, case when earlier is not null then coalesce(resolved, 0) end resolved,
 case when earlier is not null then coalesce(persisting, 0) end persisting, case when earlier is not null then coalesce(changed, 0) end changed, case when earlier is not null then case when coalesce(introduced + resolved + changed, 0) = 0 then case when coalesce(persisting, 0) > 0 then 'unchanged' else 'clean' end when introduced > 0 and resolved = 0 then 'worse' when resolved > 0 and introduced = 0 then 'better' else 'churn' end end verdict
 from pairs p left join m using (rule) left join v using (rule)"""


def _page(s, d):
    """The second page, of three rows, of the run with most findings."""
    rows = ledger.placed(findings(s, d))
    most = ledger.offsets(rows).orderBy(F.desc("n"), "run").head()
    return ledger.page(rows, most["run"], 1, 3).select("fingerprint", "outcome", "severity")


def _by_key(s, d):
    """Business keys in capitals, with accents or neither."""
    key = F.concat(F.element_at(F.array(*map(F.lit, ("Öl", "ol", "OL", "Ab", "ab", "Äb"))), (F.col("id") % 6 + 1).cast("int")), F.col("id").cast("string"))
    return ledger.by_business_key(exceptions(s, d).withColumn("business_key", key)).select("id", "place")


def _outcomes(s, d):
    f = findings(s, d)
    return compare.outcome_deltas(f.where("run % 2 = 0"), f.where("run % 2 = 1 and outcome <> 'duplicate'"))


def _sample(s, d):
    totals, sample = compare.sampled(findings(s, d).select("outcome", "run", "position").distinct(), "outcome", ["run", "position"], 5)
    return sample.join(totals, "outcome").select("outcome", "place", "run", "total")


def _action(s, d):
    rows, cut = ledger.for_action(exceptions(s, d), ledger.Filter(severity="high", open_only=True), 200)
    return rows.select("id", "rule", "status").crossJoin(F.broadcast(cut))  # one row


def _ids(s, d):
    return _read(s, d, "customer").selectExpr("c_custkey * 2 id", "c_custkey * 2 run")


def _panel(name):
    """A panel of run 40; runs are numbered modulo 50 here, so that it has findings."""

    def run(s, d):
        held = prints(s, d).withColumn("first_seen", F.lit(None).cast("date"))
        known = runs(s, d).withColumn("run", F.expr("run % 50")).dropDuplicates(["run"])
        out = ledger.panels(registry_table(s, d), held, known, findings(s, d).withColumn("run", F.expr("run % 50")), F.lit("1998-08-31").cast("date"), 40)[name]
        return out.drop("rule_name", "area", "last_seen") if name == "top_rules" else out

    return run


RULES = "select s_suppkey id, s_name as name, cast(null as string) as owner, case when s_suppkey % 3 = 0 then 'active' when s_suppkey % 3 = 1 then 'draft' else 'retired' end status, 1 as version, concat('ds', s_suppkey % 7) dataset from {supplier}"
CHANGES = "select s_suppkey id, case when s_suppkey % 4 = 0 then concat(s_name, '!') end as name, case when s_suppkey % 6 = 0 then 'retired' end status, case when s_suppkey % 10 = 0 then 'ann' end as owner, cast(null as string) dataset, cast(null as string) note, 'bob' actor from {supplier} where s_suppkey % 2 = 0 union all select -1, 'fresh', 'active', null, 'ds0', 'first', 'bob'"
registry_table, changes = _table(RULES), _table(CHANGES)
REVISED = _sql(r=RULES.replace("as string", "as varchar"), c=CHANGES.replace("as string", "as varchar")) + ", j as (select coalesce(r.id, c.id) id, coalesce(c.name, r.name) as name, coalesce(c.owner, r.owner) as owner, case when r.id is null then 'draft' else coalesce(c.status, r.status) end status, case when r.id is null then 1 else r.version + (c.name is not null or c.dataset is not null)::int end as version, coalesce(c.dataset, r.dataset) dataset, c.id is not null asked, c.note, c.name cn, c.status cs, c.owner co, r.id rid from r full join c on r.id = c.id) "


def _revised(s, d, part):
    return registry.revise(registry_table(s, d), changes(s, d), "id", ["name", "dataset"])[part]


def _cascade(s, d):
    tables = {"findings": findings(s, d).select("run"), "runs": runs(s, d).select("run")}
    left = registry.delete_runs(tables, registry.retained(runs(s, d), 3))
    return left["findings"].agg(F.count("*").alias("n")).withColumn("what", F.lit("findings")).unionByName(left["runs"].agg(F.count("*").alias("n")).withColumn("what", F.lit("runs")))


def _upserted(s, d):
    old = _read(s, d, "customer").selectExpr("c_custkey k", "c_name value")
    new = _read(s, d, "orders").selectExpr("o_custkey k", "'new' value").distinct()
    return registry.upsert(old, new, ["k"])


def _totals(s, d):
    computed = runs(s, d).selectExpr("run", "exception_count total")
    return registry.stored_or_computed(computed.where("run % 2 = 0").withColumn("total", F.lit(0).cast("long")), computed.withColumn("total", F.col("total").cast("long")))


def _state(s, d):
    state = _read(s, d, "orders").where("o_orderkey % 3 <> 0").selectExpr("o_orderkey run", "o_orderkey % 2 workspaces")
    return registry.model_state(runs(s, d), state)


L = _sql(l=LEDGER)
OPEN = "status not in ('resolved', 'accepted')"
FOUND = _sql(f=FINDINGS, p=PRINTS, r=RUNS) + ", g as (select run % 50 run, fingerprint, outcome, severity, is_new, rule from f where run % 50 = 40) "
PLANS = {
    "latest_run_pairs": (lambda s, d: compare.latest_pairs(runs(s, d)), PAIRS + "select rule, later, earlier, run_count from pairs"),
    "run_metric_delta": (_deltas, DELTAS),
    "compare_across_rules": (lambda s, d: compare.across_rules(runs(s, d), findings(s, d)), ACROSS),
    "diff_outcomes": (_outcomes, _sql(f=FINDINGS) + ", x as (select outcome, count(*) filter (run % 2 = 0) b, count(*) filter (run % 2 = 1 and outcome <> 'duplicate') a from f group by 1) select case outcome when 'value_mismatch' then 2 when 'missing_from_a' then 3 when 'duplicate' then 5 end as place, outcome, b as before, a as after, a - b delta from x"),
    "sample_caps": (_sample, _sql(f=FINDINGS) + ", g as (select distinct outcome, run, position from f) select outcome, n as place, run, total from (select *, row_number() over (partition by outcome order by run, position) n, count(*) over (partition by outcome) total from g) where n <= 5"),
    "filter_listing": (lambda s, d: ledger.listing(exceptions(s, d), ledger.read_filter({"severity": "medium"}), 100).select("id", "severity", "status"), L + f" select id, severity, status from l where severity = 'medium' and {OPEN} order by last_seen desc, id limit 100"),
    "filter_count": (lambda s, d: ledger.count(exceptions(s, d), ledger.read_filter({"all": "1", "rule": "7", "outcome": ""})), L + " select count(*) total from l where rule = 7"),
    "filter_action": (_action, L + f", x as (select id, rule, status from l where severity = 'high' and {OPEN}) select *, (select count(*) > 200 from x) truncated from x order by id limit 200"),
    "exceptions_by_ids": (lambda s, d: ledger.by_ids(exceptions(s, d), _ids(s, d)).select("id", "status"), L + " select id, status from l where id in (select c_custkey * 2 from customer)"),
    "findings_for_runs": (lambda s, d: ledger.by_ids(findings(s, d), _ids(s, d), "run").groupBy("run").agg(F.count("*").alias("findings")), _sql(f=FINDINGS) + " select run, count(*) findings from f where run in (select c_custkey * 2 from customer) group by 1"),
    "findings_status_join": (lambda s, d: ledger.with_status(findings(s, d), prints(s, d)).groupBy("status", "owner").agg(F.count("*").alias("total")), _sql(f=FINDINGS, p=PRINTS) + " select p.status, p.owner, count(*) total from f join p using (fingerprint) group by all"),
    "findings_run_left_join": (lambda s, d: ledger.with_run(findings(s, d), runs(s, d).where("run % 5 <> 0")).groupBy("rule_name").agg(F.count("*").alias("total")), _sql(f=FINDINGS, r=RUNS) + " select r.rule_name, count(*) total from f left join (select * from r where run % 5 <> 0) r using (run) group by 1"),
    "missing_detail_notice": (lambda s, d: ledger.missing_detail(runs(s, d), findings(s, d)).select("run"), _sql(f=FINDINGS, r=RUNS) + " select run from r where exception_count > 0 and run not in (select run from f)"),
    "run_detail": (lambda s, d: ledger.run_detail(exceptions(s, d), 7).select("id", "status"), L + " select id, status from l where last_run = 7 order by case severity when 'high' then 0 when 'medium' then 1 else 2 end, last_seen desc, id limit 500"),
    "findings_by_run": (lambda s, d: ledger.findings_of(ledger.placed(findings(s, d))), _sql(f=FINDINGS) + " select run, count(*) n, min(fingerprint) as first from f group by 1"),
    "findings_page": (_page, _sql(f=FINDINGS) + ", r as (select max(run) run from f group by f.run order by count(*) desc, f.run limit 1) select fingerprint, outcome, severity from f where run = (select run from r) order by fingerprint, outcome, severity limit 3 offset 3"),
    "exceptions_sort": (_by_key, _sql(l=LEDGER) + ", k as (select *, ['Öl', 'ol', 'OL', 'Ab', 'ab', 'Äb'][(id % 6 + 1)::int] || id as named from l) select id, row_number() over (order by lower(strip_accents(named)), id) place from k"),
    "panel_outcome": (lambda s, d: ledger.panels(registry_table(s, d), exceptions(s, d), runs(s, d), findings(s, d), F.lit("1998-08-31").cast("date"))["outcome"], L + f" select outcome, count(*) total from l where {OPEN} group by 1"),
    "panel_severity": (lambda s, d: ledger.panels(registry_table(s, d), exceptions(s, d), runs(s, d), findings(s, d), F.lit("1998-08-31").cast("date"))["severity"], L + f" select severity, count(*) total from l where {OPEN} group by 1"),
    "panel_rules": (lambda s, d: ledger.counts(registry_table(s, d), "status"), _sql(r=RULES.replace("as string", "as varchar")) + " select status, count(*) total from r group by 1"),
    "panel_run_status": (_panel("status"), FOUND + "select p.status, count(*) total from g join p using (fingerprint) group by 1"),
    "panel_run_outcome": (_panel("outcome"), FOUND + "select outcome, count(*) total from g group by 1"),
    "panel_run_severity": (_panel("severity"), FOUND + "select severity, count(*) total from g group by 1"),
    "panel_run_rules": (_panel("top_rules"), FOUND + "select rule, count(*) open_count, max(is_new::int) worst_recurrence from g group by 1 order by 2 desc, 1 limit 20"),
    "panel_run_owners": (_panel("owners"), FOUND + "select coalesce(p.owner, '(unassigned)') as owner, count(*) total from g join p using (fingerprint) group by p.owner"),
    "rule_revisions": (lambda s, d: _revised(s, d, 0), REVISED + "select id, name, owner, status, version, dataset from j"),
    "rule_versions": (lambda s, d: _revised(s, d, 1).select("id", "version", "note", "actor"), REVISED + "select id, version, coalesce(note, case when rid is null then 'created' when cn is not null then 'updated' when cs is not null then 'status: ' || cs when co is not null then 'owner: ' || co end) note, 'bob' actor from j where asked"),
    "rule_listing": (lambda s, d: registry.in_order(registry_table(s, d)).select("id", "name", registry.status_place(F.col("status")).alias("place")), _sql(r=RULES.replace("as string", "as varchar")) + " select id, name, case status when 'active' then 0 when 'draft' then 1 else 2 end place from r"),
    "keyed_upsert": (_upserted, "select c_custkey k, case when c_custkey in (select o_custkey from orders) then 'new' else c_name end as value from customer union select o_custkey, 'new' from orders"),
    "delete_cascade": (_cascade, _sql(f=FINDINGS, r=RUNS) + ", k as (select run from (select run, row_number() over (partition by rule order by started desc, run desc) n from r) where n <= 3) select 'findings' what, count(*) n from f where run in (select run from k) or run not in (select run from r) union all select 'runs', count(*) from k"),
    "latest_completed": (lambda s, d: registry.latest_completed(runs(s, d), "tenant"), _sql(r=RUNS) + " select tenant, run from (select *, row_number() over (partition by tenant order by started desc, run desc) n from r where status = 'completed') where n = 1"),
    "comparable_runs": (lambda s, d: registry.comparable(runs(s, d), 1).select("run", "tenant"), _sql(r=RUNS) + " select run, tenant from r where status = 'completed' and run <> 1 and tenant = (select tenant from r where run = 1)"),
    "stored_totals": (_totals, _sql(r=RUNS) + " select run, case when run % 2 = 0 then 0 else exception_count end::bigint total, run % 2 <> 0 backfilled from r"),
    "run_model_state": (_state, _sql(r=RUNS) + " select run, case when run % 3 = 0 then 'not_indexed' when run % 2 = 0 then 'empty' else 'indexed' end state from r"),
}
