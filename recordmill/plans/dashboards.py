"""Dashboard panels, storage breakdowns, settings and overviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordmill.operators import estate, ledger, scan
from recordmill.operators import exceptions as ex
from recordmill.operators.survive import Keep, survivors

from .records import SYSTEMS, _read, _systems


def _exceptions(s, d):
    """Orders as exceptions: rule without name and area, status, owner, day seen, occurrences."""
    return _read(s, d, "orders").selectExpr("o_orderkey id", "o_custkey rule", "case o_orderstatus when 'F' then 'resolved' when 'O' then 'open' else 'investigating' end status", "case when o_orderkey % 5 = 0 then null else o_orderpriority end owner", "cast(o_orderdate as date) first_seen", "cast(o_orderdate as date) last_seen", "o_orderkey % 9 occurrences", "cast(null as string) rule_name", "cast(null as string) area")


def _open(s, d):
    return _exceptions(s, d).where(~F.col("status").isin(*ex.CLOSED))


def top_rules(s, d):
    return ledger.top_rules(_exceptions(s, d)).select("rule", "open_count", "worst_recurrence", F.col("last_seen").cast("string").alias("last_seen"))


def recent_runs(s, d):
    """The fifteen newest runs."""
    return _exceptions(s, d).orderBy(F.desc("first_seen"), "id").limit(15).select("id", F.col("first_seen").cast("string").alias("started"))


def overview(s, d):
    """Per model, independent maxima over its runs."""
    runs = _read(s, d, "lineitem").selectExpr("l_partkey % 50 model", "l_orderkey golden", "l_suppkey duplicates")
    return runs.groupBy("model").agg(F.count("*").alias("runs"), F.max("golden").alias("golden"), F.max("duplicates").alias("duplicates"))


def folders(s, d):
    """Paths rolled up to their first two segments, then to the first."""
    paths = _read(s, d, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"), F.lit(False).alias("is_directory"), F.length("html").alias("length"))
    return estate.area_groups(estate.folder_sizes(paths))


def settings(s, d):
    """Parts as settings, their type's first word as the run."""
    groups = f"cast(null as {scan.GROUPS})"
    named = "array(named_struct('graphId', cast(p_partkey as string), 'name', p_name))"
    p = _read(s, d, "part").selectExpr("split(p_type, ' ')[0] run", "p_partkey % 3 = 0 enabled", "p_partkey % 4 = 0 delegateToWorkspace", "cast(null as boolean) delegateToCapacity", "false delegateToDomain", f"case when p_partkey % 10 > 4 then {named} end enabledSecurityGroups", f"{groups} excludedSecurityGroups")
    names = {"run": "grp", "settings": "total", "settings_enabled": "enabled", "settings_disabled": "disabled", "settings_delegated": "delegated", "settings_group_scoped": "group_scoped"}
    return scan.settings_summary(p).withColumnsRenamed(names)


def strategies(s, d):
    rows = _systems(s, d).withColumn("cluster", F.col("digits")).withColumn("cents", F.expr("cast(round(balance * 100) as bigint)")).withColumn("upper", F.upper("segment"))
    fields = [Keep("segment", "segment", "most_frequent"), Keep("upper", "upper", "longest"), Keep("name", "name", "source_priority"), Keep("cents", "cents", "max"), Keep("sys", "sys", "manual")]
    out = survivors(rows, fields, F.col("trust"), F.lit(None).cast("timestamp"))
    return out.select("cluster", "member_count", F.col("segment.value").alias("segment"), F.col("segment.source").alias("segment_from"), F.col("name.value").alias("name"), F.col("cents.value").alias("cents"), "conflicts", "needs_steward")


EXC = "with x as (select o_orderkey id, o_custkey rule, case o_orderstatus when 'F' then 'resolved' when 'O' then 'open' else 'investigating' end status, case when o_orderkey % 5 <> 0 then o_orderpriority end as owner, o_orderdate::date first_seen, o_orderkey % 9 occurrences from orders), o as (select * from x where status <> 'resolved') "

PLANS = {
    "dashboard_status": (lambda s, d: ledger.counts(_exceptions(s, d), "status"), EXC + "select status, count(*) total from x group by 1"),
    "dashboard_owners": (lambda s, d: ledger.owners(_open(s, d)), EXC + "select coalesce(owner, '(unassigned)') as owner, count(*) total from o group by o.owner"),
    "dashboard_top_rules": (top_rules, EXC + "select rule, count(*) open_count, max(occurrences) worst_recurrence, max(first_seen)::varchar last_seen from o group by 1 order by 2 desc, 1 limit 20"),
    "recent_runs": (recent_runs, EXC + "select id, first_seen::varchar started from x order by first_seen desc, id limit 15"),
    "open_headline": (lambda s, d: ledger.headline(_exceptions(s, d)), EXC + "select count(*) filter (status <> 'resolved') as open, count(*) total from x"),
    "mdm_overview": (overview, "select l_partkey % 50 model, count(*) runs, max(l_orderkey) golden, max(l_suppkey) duplicates from lineitem group by 1"),
    "folder_rollup": (folders, "with f as (select list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: x <> '') p, length(html) size from pages), g as (select p[1] area, array_to_string(p[1:2], '/') folder, count(*) files, sum(size) size from f group by all) select area, count(*) folders, sum(files)::bigint files, sum(size)::bigint size, max(size)::bigint largest from g group by 1"),
    "settings_summary": (settings, "select string_split(p_type, ' ')[1] grp, count(*) total, count(*) filter (p_partkey % 3 = 0) enabled, count(*) filter (p_partkey % 3 <> 0) disabled, count(*) filter (p_partkey % 4 = 0) delegated, count(*) filter (p_partkey % 10 > 4) group_scoped from part group by 1"),
    "survivor_strategies": (strategies, SYSTEMS + ", f as (select *, count(segment) over (partition by digits, segment) n from s) select digits as cluster, count(*) member_count, arg_min(segment, (-n) * 10 + trust) segment, arg_min(id, (-n) * 10 + trust) segment_from, arg_min(name, trust) as name, max(cast(round(balance * 100) as bigint))::varchar cents, (count(distinct segment) > 1)::int + (count(distinct name) > 1)::int + (count(distinct cast(round(balance * 100) as bigint)) > 1)::int + (count(distinct upper(segment)) > 1)::int + (count(distinct left(id, 3)) > 1)::int conflicts, true needs_steward from f group by digits"),
}
