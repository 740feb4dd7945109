"""A mastering model over customers in three systems, as one call; schedules, attempts and windows beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordmill.functions import convert, text as tx
from recordmill.operators import build, cluster, master, timing
from recordmill.operators.score import contributions, explain_pairs
from recordmill.streaming import live

from .records import SYSTEMS, _blocked, _read, _systems

FIELDS = (
    build.Field("name", "name", (), tx.edit_similarity, 2),
    build.Field("segment", "segment", ("lower",), strategy="most_frequent"),
    build.Field("balance", "balance", ()),
    build.Field("digits", "digits", (), required=True),
)
MODEL = build.Model(FIELDS, "id", "sys", blocks=(build.Block("digits"),), priority=("CRM", "ERP"))
#: Scored pairs, clusters of at most three records by two hops, and golden records.
BUILT = SYSTEMS + """, p as (select a.id l, b.id r, 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name))::double n, (lower(a.segment) = lower(b.segment))::int::double g, (a.balance = b.balance)::int::double h from s a join s b on a.digits = b.digits and a.id < b.id),
 q as (select *, (n * 2 + g + coalesce(h, 0) + 1) / (case when h is null then 4 else 5 end) x from p),
 d as (select *, floor(x * 1000 + 0.5) / 1000 score, case when x >= 0.9 then 'match' when x >= 0.75 then 'review' else 'distinct' end decision from q),
 e as (select l a, r b from d where decision = 'match' union select r, l from d where decision = 'match' union select id, id from s),
 e2 as (select x.a, y.b from e x join e y on x.b = y.a), m as (select a id, min(b) as cluster from e2 group by 1),
 f as (select s.*, left(s.id, 3) sys, m.cluster, count(*) over (partition by m.cluster, lower(segment)) times from s join m using (id)),
 z as (select cluster, count(*) n, arg_min(name, trust) as name, arg_min(segment, (-times) * 10 + trust) segment, arg_min(balance, trust) filter (balance is not null) balance, (count(distinct name) > 1)::int + (count(distinct lower(segment)) > 1)::int + (count(distinct balance) > 1)::int conflicts, string_agg(distinct sys, ', ' order by sys) systems from f group by 1),
 g as (select *, 'MDM-' || lpad(row_number() over (order by n desc, cluster)::varchar, 6, '0') golden_id from z) """


def _built(s, d):
    return build.build_master(_systems(s, d), MODEL)


def _explained(s, d):
    records = build.records_of(_systems(s, d), MODEL)
    features = [build.Feature(f"std_{f.name}", f.compare, f.weight, f.missing, f.required, f.least, f.blocker) for f in FIELDS]
    return explain_pairs(master.block_pairs(_blocked(s, d)), records, "id", features)


def _capped(s, d):
    keyed = _read(s, d, "customer").withColumn("segment", F.concat_ws("-", "c_nationkey", "c_mktsegment"))
    blocked = master.blocks(keyed, "c_custkey", [master.block_keys("segment", "exact")])
    pairs, cost = master.candidates(blocked, 500, 7)
    return pairs.agg(F.min("l").alias("least"), F.max(F.struct("l", "r")).alias("last")).select("least", "last.l", "last.r").crossJoin(cost)  # one row


def _hot(s, d):
    """All customers in one block, since all names begin alike: the first hundred pairs are those of the first customer."""
    blocked = master.blocks(_read(s, d, "customer"), "c_custkey", [master.block_keys("c_name", "prefix", 1)])
    return master.candidates(blocked, 100)[0]


def _grams(s, d):
    """Part names that share any three letters: pairs that meet in many blocks."""
    names = _read(s, d, "part").select("p_name").distinct()
    return master.block_pairs(master.blocks(names, "p_name", [master.block_keys("p_name", "ngram", 3), master.block_keys("p_name", "prefix", 1)]), 16)


CAPPED = "with p as (select distinct a.c_custkey l, b.c_custkey r from customer a join customer b on a.c_nationkey = b.c_nationkey and a.c_mktsegment = b.c_mktsegment and a.c_custkey < b.c_custkey), k as (select * from p order by l, r limit 500), z as (select count(*) n from customer group by c_nationkey, c_mktsegment) select (select min(l) from k) least, (select l from k order by l desc, r desc limit 1) l, (select r from k order by l desc, r desc limit 1) r, (select count(*) from k) candidate_pairs, (select count(*) >= 500 from k) truncated, (select count(*) from z) blocks_examined, (select max(n) from z) largest_block"


def _decided(s, d):
    review = _built(s, d).review
    wanted = review.select("l", "r", F.when(F.substring("l", -1, 1) == "1", "match").when(F.substring("l", -1, 1) == "2", "not_match").otherwise("nonsense").alias("review"))
    return build.review_listing(build.decide(review, wanted), "pending", 100).select("l", "r", "score")


def _blockers(s, d):
    """Rejections: segments must not conflict, balances must agree."""
    features = [build.Feature("segment", lambda a, b: (a == b).cast("double"), blocker=True), build.Feature("balance", lambda a, b: (a == b).cast("double"), required=True)]
    found = explain_pairs(master.block_pairs(_blocked(s, d)), _systems(s, d), "id", features)
    return found.groupBy("decision", F.col("rejected_by.field").alias("field"), F.col("rejected_by.code").alias("code")).agg(F.count("*").alias("total"))


def _strictly(s, d):
    return cluster.statistics(cluster.clusters(_systems(s, d), "id", master.block_pairs(_blocked(s, d)), strict=True)).select("records", "golden", "largest")


def _overview(s, d):
    models = _read(s, d, "nation").selectExpr("n_nationkey model", "case when n_nationkey % 2 = 0 then 'active' else 'draft' end status")
    runs = _read(s, d, "orders").selectExpr("o_orderkey % 20 model", "case when o_orderstatus = 'P' then 'failed' else 'completed' end status", "o_custkey golden_records", "o_orderkey % 77 duplicates_removed")
    review = _read(s, d, "customer").selectExpr("c_nationkey model", "case when c_custkey % 3 = 0 then 'match' else 'pending' end review")
    return build.overview(models, runs, review)


def _latest_totals(s, d):
    stats = _read(s, d, "orders").selectExpr("cast(o_custkey as bigint) golden_records", "cast(o_orderkey % 77 as bigint) duplicates_removed")
    return build.totals(stats)


ZONED = "element_at(array('CET (Warsaw)', 'et', 'Asia/Kolkata (IST)', 'No/Where', 'odd', 'Pacific/Auckland'), cast(c_custkey % 6 + 1 as int)) zone"
DAYS = "element_at(array('Sunday','Monday','Tuesday','Wednesday','Thursday','Friday','Saturday'), cast(c_custkey % 7 + 1 as int)) day"


def _schedules(s, d):
    kind = "element_at(array('hourly','daily','weekdays','weekly'), cast(c_custkey % 4 + 1 as int)) kind"
    return _read(s, d, "customer").selectExpr("c_custkey id", kind, "cast(c_custkey % 24 as int) hour", "cast(c_custkey % 60 as int) minute", DAYS, ZONED)


#: The same instant, 2024-01-20 22:10 UTC, a Saturday, on each zone's clock; the oracle knows the offsets of that day's zones.
NOW = "timestamp'2024-01-20 22:10:00'"
UTC = """with c as (select c_custkey id, c_custkey % 4 t, c_custkey % 24 h, c_custkey % 60 m, c_custkey % 7 w, c_custkey % 6 z from customer),
 o as (select *, ([60, -300, 330, 0, 0, 780])[z + 1] off, (['Europe/Warsaw', 'America/New_York', 'Asia/Kolkata', 'No/Where', 'UTC', 'Pacific/Auckland'])[z + 1] as zone from c),
 l as (select *, date_trunc('day', timestamp '2024-01-20 22:10:00' + to_minutes(off)) today from o),
 k as (select *, today + to_days((case when t = 3 then (w - dayofweek(today) + 7) % 7 when t = 2 and dayofweek(today) in (0, 6) then (1 - dayofweek(today) + 7) % 7 else 0 end)::int) + to_minutes((h * 60 + m)::int) - to_minutes(off) at_ from l) """
UTC_OUT = "zone, case when t > 0 then hour(at_)::int end utc_hour, minute(at_)::int utc_minute, dayname(at_) utc_day"


def _utc(s, d):
    return timing.utc_schedule(_schedules(s, d), F.expr(NOW)).select("id", "zone", "utc_hour", "utc_minute", "utc_day")


def _filled(s, d):
    stored = _schedules(s, d).selectExpr("*", "case when id % 3 = 0 then 5 end utc_hour", "case when id % 5 = 0 then 7 end utc_minute", "cast(null as string) utc_day")
    return timing.fill_utc(stored, F.expr(NOW)).select("id", "zone", "utc_hour", "utc_minute", "utc_day")


def _labels(s, d):
    return timing.utc_schedule(_schedules(s, d), F.expr(NOW)).select("id", timing.schedule_label().alias("label"))


def _clock(s, d):
    tz = timing.zone(F.col("zone"))
    local = timing.local_time(F.expr(NOW), tz)
    return _schedules(s, d).select("id", F.date_format(local, "yyyy-MM-dd HH:mm").alias("local"), (F.dayofweek(local) - 1).alias("dow"))


def _capacity_match(s, d):
    schedules = _read(s, d, "customer").selectExpr("c_custkey id", "upper(concat('Cap ', c_nationkey)) capacity_name")
    return timing.schedules_of(schedules, _read(s, d, "nation").selectExpr("n_nationkey id", "concat('Cap ', n_nationkey) name")).select("id", "capacity_id")


def _history(s, d):
    rows = _read(s, d, "orders").selectExpr("o_orderkey id", "o_orderpriority name", "cast(o_orderdate as timestamp) executed_at")
    return timing.history(rows, "1-URGENT", F.expr("timestamp'1998-08-02 00:00:00'"), 400).select("id")


def _executions(s, d):
    rows = _read(s, d, "orders").selectExpr("o_custkey id", "case when o_orderkey % 2 = 0 then 'success' when o_orderkey % 3 = 0 then 'skipped' else 'failed' end status", "cast(o_orderdate as date) executed_at")
    return timing.last_executions(rows).selectExpr("id", "cast(succeeded_at as string) succeeded_at", "cast(skipped_at as string) skipped_at")


def _first_hits(s, d):
    return live.first_hit_windows(_read(s, d, "events").withColumn("second", F.date_trunc("second", "ts")), "user_id", "second", 86400, 2)


FIRST = "with recursive e as (select user_id, date_trunc('second', ts)::timestamp t from events where user_id is not null and ts is not null), w(user_id, start) as (select user_id, min(t) from e group by 1 union all select w.user_id, (select min(t) from e where e.user_id = w.user_id and t >= w.start + interval 1 day) from w where exists (select 1 from e where e.user_id = w.user_id and t >= w.start + interval 1 day)) select w.user_id, w.start, count(*) hits, count(*) > 2 limited from w join e on e.user_id = w.user_id and t >= start and t < start + interval 1 day group by 1, 2"


def _tries(s, d):
    rows = _read(s, d, "orders").selectExpr("o_custkey slot", "o_orderdate ts", "o_orderkey id")
    return live.attempts(rows, "slot", "ts").select("id", "attempt", "allowed")


def _counters(s, d):
    rows = _read(s, d, "lineitem").selectExpr("l_orderkey run", "element_at(array('request','retry','throttled','failure','other'), cast(l_linenumber % 5 + 1 as int)) kind")
    return live.run_counters(rows)


def _codes(s, d):
    text = F.concat(F.element_at(F.array(*map(F.lit, ("API error (", "status: ", "Code=", "nothing "))), (F.col("p_partkey") % 4 + 1).cast("int")), (F.col("p_partkey") % 700).cast("string"), F.lit(")"))
    return _read(s, d, "part").select("p_partkey", convert.status_code(text).alias("code"))


def _numbers(s, d):
    text = F.element_at(F.array(F.concat(F.lit(" "), F.format_number("p_retailprice", 2)), F.lit("12x"), F.lit("  "), F.lit(""), F.lit("0x1F"), F.lit("-1e3"), F.lit("Infinity"), F.lit("5d")), (F.col("p_partkey") % 8 + 1).cast("int"))
    return _read(s, d, "part").select("p_partkey", convert.to_number(text).alias("number"), convert.to_count(text).alias("count"))


def _times(s, d):
    o = F.col("o_orderdate").cast("timestamp")
    text = F.element_at(F.array(F.date_format(o, "yyyy-MM-dd"), F.date_format(o, "M/d/yyyy"), F.date_format(o, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(o, "MMM d, yyyy"), F.lit("2024-02-30"), F.lit("tomorrow")), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return _read(s, d, "orders").select("o_orderkey", F.date_format(convert.to_time(text), "yyyy-MM-dd").alias("day"))


def _urls(s, d):
    return _read(s, d, "pages").select("page_id", convert.url_path(F.col("url")).alias("path"))


def _stages(s, d):
    order = F.when(F.col("p_partkey") % 5 != 4, F.col("p_partkey") % 5)
    return _read(s, d, "part").select("p_partkey", convert.stage_name(order).alias("stage"), convert.size_label(F.col("p_partkey") * F.col("p_partkey") * 37).alias("size"))


def _waits(s, d):
    p = _read(s, d, "part").selectExpr("p_partkey", "element_at(array(408, 429, 500, 404), cast(p_partkey % 4 + 1 as int)) status", "p_partkey % 3 attempt", "case when p_partkey % 7 = 0 then p_partkey % 90 end retry_after")
    return p.select("p_partkey", convert.retry_delay(F.col("status"), F.col("attempt"), F.col("retry_after")).alias("delay"))


def _json(s, d):
    text = F.when(F.col("p_partkey") % 3 == 0, "[broken").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("[1,"), F.col("p_partkey").cast("string"), F.lit("]")))
    return _read(s, d, "part").select("p_partkey", F.size(convert.json_or(text, "array<bigint>", F.expr("cast(array() as array<bigint>)"))).alias("n"))


PLANS = {
    "mdm_stats15": (lambda s, d: _built(s, d).stats, BUILT + "select (select count(*) from s) raw_records, count(*) golden_records, count(*) filter (n > 1) merged_clusters, coalesce(sum(n) filter (n > 1), 0)::bigint records_merged, (select count(*) from s) - count(*) duplicates_removed, (select count(*) from d) pairs_compared, (select count(*) from d) candidate_pairs, (select count(distinct digits) from s) blocks_examined, (select max(k) from (select count(*) k from s group by digits)) largest_block, (select count(*) >= 500000 from d) pairs_truncated, (select count(*) from d where decision = 'review') review_pairs, sum(conflicts)::bigint conflicted_fields, 0 steward_required, max(n) largest_cluster, max(n) > greatest(10, (select count(*) from s) * 0.05) over_merge_suspected from g"),
    "golden_published": (lambda s, d: build.published(_built(s, d).golden, ["name", "segment"]), BUILT + "select golden_id, name, segment, systems source_systems, n source_record_count from g"),
    "crosswalk_systems": (lambda s, d: _built(s, d).crosswalk, BUILT + "select golden_id, f.id source_record_id, f.sys source_system from f join g using (cluster)"),
    "golden_listing": (lambda s, d: build.golden_listing(_built(s, d).golden, 50).select("golden_id", "member_count"), BUILT + "select golden_id, n member_count from g order by n desc, golden_id limit 50"),
    "review_pairs": (lambda s, d: _built(s, d).review.select("l", "r", "score", "review"), BUILT + "select l, r, score, 'pending' review from d where decision = 'review'"),
    "review_decisions": (_decided, BUILT + "select l, r, score from d where decision = 'review' and right(l, 1) not in ('1', '2') order by score desc, l, r limit 100"),
    "contributions": (lambda s, d: contributions(_explained(s, d)).select("l", "r", "field", "score", "weight", "skipped", "policy"), BUILT + "select l, r, 'std_name' field, floor(n * 1000 + 0.5) / 1000 score, 2.0::double weight, false skipped, null::varchar policy from d union all select l, r, 'std_segment', g, 1, false, null from d union all select l, r, 'std_balance', h, 1, h is null, case when h is null then 'skip' end from d union all select l, r, 'std_digits', 1, 1, false, null from d"),
    "score_blockers": (_blockers, SYSTEMS + ", p as (select a.segment = b.segment g, a.balance = b.balance h from s a join s b on a.digits = b.digits and a.id < b.id) select case when not g or h is null or not h then 'rejected' else 'match' end decision, case when not g then 'segment' when h is null or not h then 'balance' end field, case when not g then 'conflicts' when h is null then 'missing' when not h then 'disagrees' end code, count(*) total from p group by all"),
    "candidate_cap": (_capped, CAPPED),
    "candidate_cap_hot": (_hot, "select c_custkey l, c_custkey + n r from (select min(c_custkey) c_custkey from customer), (select unnest(range(1, 101)) n)"),
    "block_pairs_ngrams": (_grams, "with n as (select distinct p_name from part), g as (select p_name, unnest(list_concat([left(p_name, 1)], list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, i, 3)))) g from n) select distinct a.p_name l, b.p_name r from g a join g b on a.g = b.g and a.p_name < b.p_name"),
    "block_pairs_chunked": (lambda s, d: master.block_pairs(_blocked(s, d), 2), SYSTEMS + "select a.id l, b.id r from s a join s b on a.digits = b.digits and a.id < b.id"),
    "comparisons_avoided": (lambda s, d: master.comparisons(_systems(s, d)), SYSTEMS + "select count(*) records, count(*) * (count(*) - 1) // 2 exhaustive from s"),
    "strict_statistics": (_strictly, SYSTEMS + "select count(*) records, count(distinct digits) golden, max(n)::bigint largest from (select *, count(*) over (partition by digits) n from s)"),
    "mdm_overview_models": (_overview, "with r as (select o_orderkey % 20 model, count(*) runs, max(o_custkey) golden_records, max(o_orderkey % 77) duplicates_removed from orders where o_orderstatus <> 'P' group by 1), v as (select c_nationkey model, count(*) pending from customer where c_custkey % 3 <> 0 group by 1) select n_nationkey model, case when n_nationkey % 2 = 0 then 'active' else 'draft' end status, coalesce(runs, 0) runs, golden_records, duplicates_removed, coalesce(pending, 0) pending from nation left join r on r.model = n_nationkey left join v on v.model = n_nationkey"),
    "mdm_totals": (_latest_totals, "select sum(o_custkey)::bigint golden_records, sum(o_orderkey % 77)::bigint duplicates_removed from orders"),
    "schedule_utc": (_utc, UTC + f"select id, {UTC_OUT} from k"),
    "schedule_utc_fill": (_filled, UTC + f", u as (select id, {UTC_OUT} from k) select id, zone, case when id % 3 = 0 then 5 else utc_hour end utc_hour, case when id % 5 = 0 then 7 else utc_minute end utc_minute, utc_day from u"),
    "schedule_label": (_labels, UTC + f", u as (select id, t, {UTC_OUT} from k) select id, case when t = 0 then 'hourly at minute ' || lpad(utc_minute::varchar, 2, '0') || ' UTC' else lpad(utc_hour::varchar, 2, '0') || ':' || lpad(utc_minute::varchar, 2, '0') || ' UTC (' || utc_day || ')' end as label from u"),
    "time_in_timezone": (_clock, UTC + "select id, strftime(timestamp '2024-01-20 22:10:00' + to_minutes(off), '%Y-%m-%d %H:%M') as local, dayofweek(timestamp '2024-01-20 22:10:00' + to_minutes(off))::int dow from l"),
    "capacity_detail_match": (_capacity_match, "select c_custkey id, c_nationkey capacity_id from customer join nation on n_nationkey = c_nationkey"),
    "schedule_history": (_history, "select o_orderkey id from orders where o_orderpriority = '1-URGENT' and o_orderdate::timestamp >= timestamp '1998-08-02' - interval 400 day order by o_orderdate desc, o_orderkey limit 50"),
    "last_execution": (_executions, "select o_custkey id, (max(o_orderdate::date) filter (o_orderkey % 2 = 0))::varchar succeeded_at, (max(o_orderdate::date) filter (o_orderkey % 2 <> 0 and o_orderkey % 3 = 0))::varchar skipped_at from orders group by 1"),
    "rate_limit_first_hit": (_first_hits, FIRST),
    "rate_limit_hot_key": (lambda s, d: live.first_hit_windows(_read(s, d, "events").withColumn("second", F.date_trunc("second", "ts")), "user_id", "second", 86400, 2, 1), FIRST),
    "retry_cap": (_tries, "select o_orderkey id, row_number() over w attempt, row_number() over w <= 3 allowed from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)"),
    "newest_events": (lambda s, d: live.newest_events(_read(s, d, "events").select("user_id", "ts", "event_id"), "user_id", "ts", 3).select("user_id", "event_id", "place"), "select user_id, event_id, n as place from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id) n from events) where n <= 3"),
    "run_counters": (_counters, "select l_orderkey run, count(*) filter (l_linenumber % 5 = 0) requests, count(*) filter (l_linenumber % 5 = 1) retries, count(*) filter (l_linenumber % 5 = 2) throttled, count(*) filter (l_linenumber % 5 = 3) failures from lineitem group by 1"),
    "extract_status": (_codes, "select p_partkey, case when p_partkey % 4 <> 3 and p_partkey % 700 between 100 and 599 then (p_partkey % 700)::int end code from part"),
    "to_number": (_numbers, "with x as (select p_partkey, (p_partkey % 8)::int r, round(p_retailprice, 2) p from part) select p_partkey, case r when 0 then p when 2 then 0 when 4 then 31 when 5 then -1000 end::double as number, coalesce(case r when 0 then case when p < 1000 then p end when 2 then 0 when 4 then 31 when 5 then -1000 end, 0)::double as count from x"),
    "to_date_value": (_times, "select o_orderkey, case when o_orderkey % 6 < 4 then strftime(o_orderdate, '%Y-%m-%d') end as day from orders"),
    "describe_url": (_urls, "select page_id, case when regexp_matches(url, '^[a-z]+://[^/?#]+') then case when regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' then '/' else regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) end else url end path from pages"),
    "stage_names": (_stages, "with x as (select p_partkey, p_partkey::bigint * p_partkey * 37 b from part) select p_partkey, (['Development', 'Test', 'Production', 'Stage 4', 'Stage'])[p_partkey % 5 + 1] stage, case when b < 1024 then b || ' B' when b < 1048576 then printf('%.1f', floor(b / 1024.0::double * 10 + 0.5) / 10) || ' KB' when b < 1073741824 then printf('%.1f', floor(b / 1048576.0::double * 10 + 0.5) / 10) || ' MB' when b < 1099511627776 then printf('%.1f', floor(b / 1073741824.0::double * 10 + 0.5) / 10) || ' GB' else printf('%.1f', floor(b / 1099511627776.0::double * 10 + 0.5) / 10) || ' TB' end as size from x"),
    "retry_delay": (_waits, "select p_partkey, case when p_partkey % 4 <> 3 then case when p_partkey % 7 = 0 and p_partkey % 90 > 0 then least(p_partkey % 90 * 1000, 60000) else 1000 * (1 << (p_partkey % 3)::int) end end::bigint delay from part"),
    "parse_json": (_json, "select p_partkey, case when p_partkey % 3 = 1 then 2 else 0 end::int n from part"),
}
