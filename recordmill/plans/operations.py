"""Triage, snapshots, lineage, schedules, progress and live windows over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordmill.functions import convert
from recordmill.operators import cluster, estate, timing
from recordmill.streaming import live

from .records import _read

NOW = "timestamp'1998-08-02 00:00:00'"


def _workspaces(s, d):
    return _read(s, d, "supplier").selectExpr("s_suppkey ws", "case when s_suppkey % 3 = 0 then 'cap-1' when s_suppkey % 3 = 1 then '00000000-0000-0000-0000-000000000000' end capacity_id")


def _items(s, d):
    """Line items as items of their supplier; one supplier in ten has none."""
    kind = "element_at(array('Report','Lakehouse','Dashboard','Dataset','Dataflow Gen2','Other'), cast(l_linenumber % 6 + 1 as int))"
    return _read(s, d, "lineitem").where("l_suppkey % 10 <> 0 and (l_suppkey % 4 <> 0 or l_linenumber % 6 <> 1)").selectExpr("l_suppkey ws", f"{kind} type", "cast(l_shipdate as timestamp) updated", "concat('U', l_orderkey % 2000) creator")


def _users(s, d):
    """Customers as users of suppliers 1 to 40, by their number; some suppliers have no admin, only an app, or one."""
    return _read(s, d, "customer").selectExpr("cast(c_custkey % 40 + 1 as bigint) ws", "concat('u', c_custkey) email", "c_name name", "case when c_custkey div 40 < c_custkey % 3 then 'ADMIN' else 'Member' end role", "case when c_custkey % 4 = 0 then 'App' end kind")


TRIAGE = """with w as (select s_suppkey ws, s_suppkey % 3 = 0 has from supplier),
 i as (select l_suppkey ws, l_linenumber % 6 t, l_shipdate::timestamp updated, 'u' || (l_orderkey % 2000) who from lineitem where l_suppkey % 10 <> 0 and (l_suppkey % 4 <> 0 or l_linenumber % 6 <> 1)),
 u as (select c_custkey % 40 + 1 ws, 'u' || c_custkey who, c_custkey // 40 < c_custkey % 3 adm, c_custkey % 4 <> 0 person from customer),
 ua as (select ws, count(*) users, count(*) filter (adm) admins, count(*) filter (adm and person) people from u group by 1),
 ia as (select ws, count(*) items, max(updated) latest, count(*) filter (t = 1) bound, count(*) filter (who not in (select who from u)) orphans from i group by 1),
 j as (select ws, has, coalesce(users,0) users, coalesce(admins,0) admins, coalesce(people,0) people, coalesce(items,0) items, latest, coalesce(bound,0) bound, coalesce(orphans,0) orphans from w left join ua using (ws) left join ia using (ws)),
 f as (select ws, list_filter([case when users > 0 and admins = 0 then 'ownerless' end, case when users > 0 and admins > 0 and people = 0 then 'orphanedAdmin' end, case when users > 0 and people = 1 then 'singleAdmin' end,
  case when items > 0 and floor(epoch(timestamp '1998-08-02' - latest) / 86400) >= 90 then 'staleContent' end, case when orphans > 0 then 'orphanedContent' end, case when bound > 0 and not has then 'capacityRisk' end,
  case when users >= 50 then 'overShared' end, case when users > 0 and items = 0 then 'emptyWorkspace' end], lambda x: x is not null) found from j),
 k as (select unnest(['ownerless','orphanedAdmin','singleAdmin','staleContent','orphanedContent','capacityRisk','overShared','emptyWorkspace']) finding, unnest([100,80,50,40,35,30,20,15]) weight),
 x as (select ws, unnest(found) finding from f) """


def _triaged(s, d):
    return estate.triage(_workspaces(s, d), _items(s, d), _users(s, d), F.expr(NOW))


def _worklist(s, d):
    named = _read(s, d, "supplier").selectExpr("s_suppkey ws", "s_name name")
    return estate.worklist(_triaged(s, d), named, _items(s, d)).select("ws", "name", "score", "items", "place")


def _details(s, d):
    found = estate.triage_details(_triaged(s, d), _workspaces(s, d), _items(s, d), _users(s, d), F.expr(NOW))
    return found.withColumn("names", F.array_join("names", ","))


def _cells(s, d):
    cells = _read(s, d, "part").selectExpr("p_partkey k", "case p_partkey % 5 when 0 then concat(p_size, ' mm') when 1 then concat('-', p_size, '.5') when 2 then upper(p_name) when 3 then concat('é', p_name) end v")
    return cluster.sequenced(cells, [*convert.cell_order(F.col("v")), F.asc("k")], "place").select("k", "place")


def _snapshots(s, d):
    orders = _read(s, d, "orders")
    before = orders.where("o_orderkey % 11 <> 0").selectExpr("o_orderkey", "o_orderstatus state", "case when o_orderkey % 5 = 0 then null else o_orderpriority end label")
    after = orders.where("o_orderkey % 13 <> 0").selectExpr("o_orderkey", "case when o_orderkey % 7 = 0 then lower(o_orderstatus) else o_orderstatus end state", "case when o_orderkey % 5 = 0 then '' else o_orderpriority end label")
    return before, after


def _diff(s, d):
    return estate.snapshot_diff(*_snapshots(s, d), "o_orderkey", ["state", "label"]).select("o_orderkey", "change", F.array_join("fields", ",").alias("fields"))


def _metrics(s, d):
    def of(df):
        return df.agg(F.count("*").alias("orders"), F.count_if(F.col("state") == "f").alias("folded"), F.count("label").alias("labels"))

    return estate.metric_changes(*map(of, _snapshots(s, d)))


def _lineage(s, d):
    models = _read(s, d, "customer").selectExpr("concat('c', c_custkey) id", "c_name name")
    upstream = _read(s, d, "customer").selectExpr("concat('c', c_custkey) id", "concat('n', c_nationkey) source", "'dataflow' source_kind")
    orders = _read(s, d, "orders")
    reports = orders.selectExpr("concat('o', o_orderkey) id", "concat('c', o_custkey) model")
    tiles = _read(s, d, "lineitem").selectExpr("concat('o', l_orderkey) id", "concat('p', l_partkey) model")
    index = models.selectExpr("id", "'model' kind", "name").union(_read(s, d, "nation").selectExpr("concat('n', n_nationkey)", "'dataflow'", "n_name"))
    return estate.lineage(models, upstream, reports, tiles, index)


def _schedules(s, d):
    return _read(s, d, "customer").selectExpr("c_custkey id", "element_at(array('hourly','daily','weekdays','weekly'), cast(c_custkey % 4 + 1 as int)) kind", "c_custkey % 24 hour", "c_custkey % 60 minute", "element_at(array('Sunday','Monday','Tuesday','Wednesday','Thursday','Friday','Saturday'), cast(c_custkey % 7 + 1 as int)) day", "'Asia/Kolkata' zone")


def _slots(s, d):
    return timing.due_slots(_schedules(s, d), F.expr("timestamp'2024-01-17 10:40:30'"))


def _pending(s, d):
    ran = _read(s, d, "customer").where("c_custkey % 3 = 0").selectExpr("c_custkey id", "timestamp'2024-01-17 09:00:00' executed_at")
    return timing.pending_slots(_slots(s, d), ran).select("id", "slot")


SLOTS = """with x as (select c_custkey id, c_custkey % 4 t, c_custkey % 24 h, c_custkey % 60 m, c_custkey % 7 w, b, timestamp '2024-01-17 10:40:00' - to_minutes(b::int) due, timestamp '2024-01-17 16:10:00' - to_minutes(b::int) loc from customer, range(0, 241) r(b)),
 z as (select id, strftime(max(loc), '%Y-%m-%dT%H:%M') slot, max(due) due_at, min(b) minutes_late from x where minute(loc) = m and (t = 0 or (hour(loc) = h and (t = 1 or (t = 2 and dayofweek(loc) between 1 and 5) or (t = 3 and dayofweek(loc) = w)))) group by id) """


def _progress(s, d):
    phases = _read(s, d, "orders").selectExpr("o_custkey run", "element_at(array('running','completed','failed'), cast(o_custkey % 3 + 1 as int)) status", "1 + o_orderkey % 5 weight", "case o_orderstatus when 'F' then 'done' when 'O' then 'active' else 'pending' end state", "o_orderkey % 10 done", "case o_orderkey % 7 when 0 then null when 1 then 0 else 8 end total")
    return timing.progress(phases)


def _liveness(s, d):
    runs = _read(s, d, "events").groupBy(F.col("user_id").alias("run")).agg(F.max("ts").alias("updated"), F.min("ts").alias("started")).selectExpr("*", "case when run % 5 = 0 then 'completed' else 'running' end status", "cast(null as timestamp) throttled_until")
    return timing.liveness(runs, F.expr("timestamp'2024-01-31 00:00:00'"), 3600 * 6, 3600 * 24)


PLANS = {
    "triage": (lambda s, d: _triaged(s, d).select("ws", F.array_join("findings", ",").alias("findings"), "score"), TRIAGE + "select ws, array_to_string(found, ',') findings, coalesce(cast((select sum(weight) from x join k using (finding) where x.ws = f.ws) as bigint), 0) score from f"),
    "triage_worklist": (_worklist, TRIAGE + ", y as (select ws, coalesce(sum(weight), 0)::bigint score from f left join x using (ws) left join k using (finding) group by 1) select ws, s_name as name, score, items, row_number() over (order by score desc, items desc, s_name, ws) place from y join j using (ws) join supplier on s_suppkey = ws"),
    "triage_details": (_details, TRIAGE + """, a as (select ws, list(who order by person desc, who) who, count(*) n from (select u.ws, u.who, coalesce(u.person, false) person from u where adm) group by 1),
 o as (select ws, who, count(*) n from i where who not in (select who from u) group by all), t as (select ws, list(upper(who) || ' (' || n || ')' order by n desc, who)[:3] top, count(*) creators from o group by 1)
 select x.ws, finding, weight, case when finding in ('overShared', 'emptyWorkspace') then users when finding = 'capacityRisk' then bound when finding = 'orphanedContent' then orphans end as count,
 case when finding = 'staleContent' then floor(epoch(timestamp '1998-08-02' - latest) / 86400)::bigint end as days, case when finding = 'staleContent' then latest::date end as since,
 array_to_string(case finding when 'orphanedContent' then top when 'singleAdmin' then a.who[:1] when 'orphanedAdmin' then a.who[:20] end, ',') as names,
 case finding when 'orphanedContent' then creators > 3 when 'orphanedAdmin' then a.n > 20 else false end as more from x join k using (finding) join j using (ws) left join a using (ws) left join t using (ws)"""),
    "table_sort": (_cells, """with c as (select p_partkey k, case p_partkey % 5 when 0 then p_size || ' mm' when 1 then '-' || p_size || '.5' when 2 then upper(p_name) when 3 then 'é' || p_name end v from part),
 o as (select k, v, try_cast(regexp_extract(v, '^-?[0-9.]+') as double) n from c) select k, row_number() over (order by case when v is null then 2 when n is not null then 0 else 1 end, n, lower(strip_accents(v)), k) place from o"""),
    "triage_counts": (lambda s, d: estate.finding_counts(_triaged(s, d)), TRIAGE + "select finding, weight, count(x.ws) total from k left join x using (finding) group by all"),
    "orphaned_content": (lambda s, d: estate.orphaned_items(_items(s, d), _users(s, d)).groupBy("ws").agg(F.count("*").alias("orphans")), TRIAGE + "select ws, orphans from ia where orphans > 0"),
    "item_families": (lambda s, d: _items(s, d).groupBy("ws", estate.family(F.col("type")).alias("family")).agg(F.count("*").alias("items")), TRIAGE + "select ws, (['report','lakehouse','dashboard','model','dataflow','other'])[t + 1] family, count(*) items from i group by all"),
    "licences": (lambda s, d: _read(s, d, "part").selectExpr("p_partkey", "element_at(array('F64','FREE','PPU','P1','EM2','a4','','x'), cast(p_partkey % 8 + 1 as int)) sku").groupBy(estate.licence(F.col("sku")).alias("licence")).agg(F.count("*").alias("total")), "select (['Fabric','Pro','Premium Per User','Premium','Premium','Premium','Pro','Pro'])[p_partkey % 8 + 1] licence, count(*) total from part group by 1"),
    "user_360": (lambda s, d: estate.access_overview(_users(s, d).withColumnRenamed("email", "principal"), _items(s, d)), TRIAGE + "select coalesce(a.who, b.who) principal, coalesce(grants, 0) grants, coalesce(grants, 0) workspaces, coalesce(created, 0) created from (select who, count(*) grants from u group by 1) a full join (select who, count(*) created from i group by 1) b on a.who = b.who"),
    "snapshot_diff": (_diff, "with o as (select *, o_orderkey % 11 <> 0 b, o_orderkey % 13 <> 0 a, o_orderkey % 7 = 0 as c from orders) select o_orderkey, case when not b then 'added' when not a then 'removed' when c then 'changed' else 'same' end as change, case when a and b and c then 'state' else '' end fields from o where a or b"),
    "metric_changes": (_metrics, "with n as (select count(*) filter (o_orderkey % 11 <> 0) ob, count(*) filter (o_orderkey % 13 <> 0) oa, count(*) filter (o_orderkey % 13 <> 0 and o_orderkey % 7 = 0 and o_orderstatus = 'F') fa, count(*) filter (o_orderkey % 11 <> 0 and o_orderkey % 5 <> 0) lb, count(*) filter (o_orderkey % 13 <> 0) la from orders), m as (select 'orders' metric, ob::double b, oa::double a from n union all select 'folded', 0, fa from n union all select 'labels', lb, la from n) select metric, b as before, a as after, a - b delta, case when a = 0 and b = 0 then 0 when b <> 0 then floor((a - b) / b * 1000 + 0.5) / 10 end percent from m"),
    "lineage_edges": (_lineage, "select 'n' || c_nationkey as source, 'dataflow' source_kind, n_name source_name, 'c' || c_custkey target, 'model' target_kind, c_name target_name from customer join nation on n_nationkey = c_nationkey union all select 'c' || o_custkey, 'model', coalesce(c_name, 'c' || o_custkey), 'o' || o_orderkey, 'report', 'o' || o_orderkey from orders left join customer on c_custkey = o_custkey union all select distinct 'p' || l_partkey, 'model', 'p' || l_partkey, 'o' || l_orderkey, 'dashboard', 'o' || l_orderkey from lineitem"),
    "due_slots": (_slots, SLOTS + "select * from z"),
    "pending_slots": (_pending, SLOTS + "select id, slot from z where id % 3 <> 0 or due_at > timestamp '2024-01-17 09:00:00'"),
    "progress": (_progress, "with p as (select o_custkey run, o_custkey % 3 st, 1 + o_orderkey % 5 w, o_orderstatus s, o_orderkey % 10 d, case o_orderkey % 7 when 0 then null when 1 then 0 else 8 end t from orders), q as (select run, st, sum(w * case when s = 'F' then 1.0 when s <> 'O' then 0.0 when t is null then 0.5 when t = 0 then 1.0 else least(1.0, d / 8.0) end::double) / sum(w) f, coalesce(sum(case when t is not null then case when s = 'F' then t else least(d, t) end end), 0) done, coalesce(sum(t), 0) total from p group by all) select run, (['running','completed','failed'])[st + 1] status, case when st = 1 then 100 when st = 0 then least(99, floor(f * 100 + 0.5)) else floor(f * 100 + 0.5) end::bigint percent, done::bigint done, total::bigint total, greatest(0, total - done)::bigint remaining from q"),
    "liveness": (_liveness, "with e as (select user_id run, cast(epoch(timestamp '2024-01-31') as bigint) - cast(floor(epoch(max(ts))) as bigint) q from events group by 1) select run, q quiet_seconds, case when run % 5 = 0 then 'terminal' when q >= 86400 then 'interrupted' when q >= 21600 then 'stalled' else 'live' end state from e"),
    "rate_limit": (lambda s, d: live.hits(_read(s, d, "events"), "user_id", "ts", 3600, 1), "select user_id, to_timestamp(epoch(ts)::bigint // 3600 * 3600)::timestamp as start, count(*) hits, count(*) > 1 limited from (select user_id, date_trunc('second', ts) ts from events) group by 1, 2"),
    "heartbeat_sessions": (lambda s, d: live.sessions(_read(s, d, "events"), "user_id", "ts", 86400), "with g as (select user_id, ts, case when ts >= lag(ts) over w + interval 1 day or lag(ts) over w is null then 1 else 0 end as n from events window w as (partition by user_id order by ts)), h as (select user_id, ts, sum(n) over (partition by user_id order by ts) k from g) select user_id, min(ts)::timestamp started, count(*) beats from h group by user_id, k"),
}
