"""Clusters, golden ids and crosswalks of customers that are chained in fours, every third group by all of its pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordmill.functions import text as tx
from recordmill.operators import cluster, master

from .records import PAIRS, _pairs, _read


def _links(s, d):
    keys = _read(s, d, "customer").select(F.col("c_custkey").alias("l"))
    last = keys.agg(F.max("l").alias("last"))
    steps = F.when(F.expr("l div 4 % 3 = 0"), F.expr("sequence(1, 3)")).otherwise(F.expr("sequence(1, 1)"))
    pairs = keys.select("l", F.explode(steps).alias("step")).where("l % 4 + step < 4").select("l", (F.col("l") + F.col("step")).alias("r"))
    return pairs.join(F.broadcast(last), F.col("r") <= F.col("last")).select("l", "r")  # last is one row


def _members(s, d, strict=False):
    return cluster.clusters(_read(s, d, "customer"), "c_custkey", _links(s, d), strict)


def _crosswalk(s, d):
    members = cluster.cut(_members(s, d))
    return cluster.crosswalk(members, cluster.golden_ids(members))


FOURS = "with c as (select c_custkey id, min(c_custkey) over (partition by c_custkey // 4) as cluster, count(*) over (partition by c_custkey // 4) n from customer) "
GOLDEN = FOURS + ", g as (select cluster, n member_count, 'MDM-' || lpad(row_number() over (order by n desc, cluster)::varchar, 6, '0') golden_id from (select distinct cluster, n from c)) "


def _address(s, d):
    return _read(s, d, "part").select("p_partkey", tx.expand_abbreviations(F.concat(F.lit("12 N. "), "p_name", F.lit(" St. Ltd"))).alias("value"))


def _cost(s, d):
    keyed = _read(s, d, "customer").withColumn("segment", F.concat_ws("-", "c_nationkey", "c_mktsegment"))
    return master.block_cost(master.blocks(keyed, "c_custkey", [master.block_keys("segment", "exact")]))


PLANS = {
    "clusters": (_members, FOURS + "select id, cluster from c"),
    "clusters_strict": (lambda s, d: _members(s, d, True), FOURS + "select id, case when n <= 2 or (id // 4) % 3 = 0 then cluster else id end as cluster from c"),
    "golden_ids": (lambda s, d: cluster.golden_ids(_members(s, d)), GOLDEN + "select * from g"),
    "crosswalk": (_crosswalk, GOLDEN + "select id, golden_id from c join g using (cluster)"),
    "mdm_stats": (lambda s, d: cluster.statistics(_members(s, d)), FOURS + ", z as (select cluster, count(*) n from c group by 1) select cast(sum(n) as bigint) records, count(*) golden, count(*) filter (n > 1) merged, max(n) largest, cast(sum(n) as bigint) - count(*) duplicates_removed, max(n) > greatest(10.0, sum(n) * 0.05) over_merge_suspected from z"),
    "block_cost": (_cost, "select cast(sum(n * (n - 1) // 2) as bigint) pairs from (select count(*) n from customer group by c_nationkey, c_mktsegment)"),
    "std_expand_abbreviations": (_address, "select p_partkey, '12 north ' || p_name || ' street limited' as value from part"),
    "std_strip_diacritics": (lambda s, d: _read(s, d, "documents").select("doc_id", tx.strip_diacritics(F.col("text")).alias("value")), "select doc_id, strip_accents(text) as value from documents"),
    "jaro_winkler": (_pairs(tx.jaro_winkler), None),
    "numeric_similarity": (lambda s, d: _read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(tx.numeric_similarity(F.col("l_quantity"), F.col("l_quantity") + F.col("l_linenumber"), 1, 0.05), 6).alias("score")), "with x as (select l_orderkey, l_linenumber, l_linenumber::double d, greatest(1.0, 0.05 * greatest(abs(l_quantity), abs(l_quantity + l_linenumber)))::double a from lineitem) select l_orderkey, l_linenumber, round(case when d <= a then 1 else greatest(0, 1 - (d - a) / (4 * a)) end::double, 6) score from x"),
    "date_similarity": (lambda s, d: _read(s, d, "lineitem").select(tx.date_similarity(F.col("l_shipdate").cast("timestamp"), F.lit("1995-06-17 12:00:00").cast("timestamp"), 30.5).alias("score")).groupBy("score").agg(F.count("*").alias("total")), "select case when abs(epoch(l_shipdate::timestamp - timestamp '1995-06-17 12:00:00')) <= 30.5 * 86400 then 1.0 else 0.0 end::double score, count(*) total from lineitem group by 1"),
}
