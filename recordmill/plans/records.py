"""Standardising, similarity and mastering of customer and part records."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordmill.functions import text as tx
from recordmill.operators import master, simjoin
from recordmill.operators.survive import Keep, survivors


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _customers(column):
    return lambda s, d: _read(s, d, "customer").select("c_custkey", column().alias("value"))


def _name():
    return F.col("c_name")


def _pairs(similarity):
    def run(spark, sf_dir):
        names = _read(spark, sf_dir, "part").select("p_name").distinct()
        l, r = names.select(F.col("p_name").alias("l")), names.select(F.col("p_name").alias("r"))  # noqa: E741
        # Names are a small vocabulary of adjectives and nouns, 64 at every scale, so each is held against each.
        pairs = l.join(r, F.col("l") < F.col("r"))
        return pairs.select("l", "r", F.round(similarity(F.col("l"), F.col("r")), 6).alias("score"))

    return run


PAIRS = "with n as (select distinct p_name from part), p as (select a.p_name l, b.p_name r from n a join n b on a.p_name < b.p_name) "


def _systems(spark, sf_dir):
    c = _read(spark, sf_dir, "customer")
    crm = c.selectExpr("concat('CRM-', c_custkey) id", "'CRM' sys", "c_custkey k", "c_name name", "c_mktsegment segment", "c_acctbal balance", "1 trust")
    erp = c.where("c_custkey % 3 = 0").selectExpr("concat('ERP-', c_custkey) id", "'ERP' sys", "c_custkey k", "concat(upper(replace(c_name, '#', ' ')), ' LTD.') name", "c_mktsegment segment", "c_acctbal balance", "2 trust")
    old = c.where("c_custkey % 5 = 0").selectExpr("concat('OLD-', c_custkey) id", "'OLD' sys", "c_custkey k", "concat(substring(c_name, 1, 3), substring(c_name, 5)) name", "lower(c_mktsegment) segment", "cast(null as double) balance", "3 trust")
    return crm.unionByName(erp).unionByName(old).withColumn("digits", tx.digits(F.col("name")))


SYSTEMS = """with s0 as (select 'CRM-' || c_custkey id, c_custkey k, c_name as name, c_mktsegment segment, c_acctbal balance, 1 trust from customer
 union all select 'ERP-' || c_custkey, c_custkey, upper(replace(c_name, '#', ' ')) || ' LTD.', c_mktsegment, c_acctbal, 2 from customer where c_custkey % 3 = 0
 union all select 'OLD-' || c_custkey, c_custkey, substring(c_name, 1, 3) || substring(c_name, 5), lower(c_mktsegment), null, 3 from customer where c_custkey % 5 = 0),
 s as (select *, regexp_replace(name, '[^0-9]', '', 'g') digits from s0) """


def _blocked(s, d):
    return master.blocks(_systems(s, d), "id", [master.block_keys("digits", "exact")])


def _golden(s, d):
    rows = _systems(s, d).withColumn("cluster", F.col("digits")).withColumn("trusted", F.col("segment")).withColumn("frequent", F.col("segment"))
    out = survivors(rows, [Keep("trusted", "trusted", "source_priority"), Keep("frequent", "frequent", "most_frequent")], F.col("trust"), F.lit(None).cast("timestamp"))
    values = rows.groupBy("cluster").agg(F.count_distinct("segment").alias("segment_values"))
    return out.join(values, "cluster").select(F.col("cluster").alias("digits"), "member_count", F.col("trusted.value").alias("segment_trusted"), F.col("frequent.value").alias("segment_frequent"), "segment_values")


#: Soundex by letters, classes and runs, as DuckDB has no such function.
SOUNDEX = "with n as (select distinct p_name from part), x as (select p_name, regexp_replace(lower(p_name), '[^a-z]', '', 'g') x from n), y as (select p_name, x, upper(left(x, 1)) f, case when left(x, 1) in ('h', 'w') then 'a' else left(x, 1) end || replace(replace(substr(x, 2), 'h', ''), 'w', '') s from x), z as (select p_name, x, f, translate(s, 'abcdefghijklmnopqrstuvwxyz', '01230120022455012623010202') t from y), r as (select p_name, x, f, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '0+', '0', 'g'), '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g') t from z) select p_name, case when x = '' then '' else rpad(left(f || replace(substr(t, 2), '0', ''), 4), 4, '0') end code from r"


PLANS = {
    "std_upper_strip": (_customers(lambda: tx.standardise(_name(), ["strip_punctuation", "upper"])), "select c_custkey, nullif(trim(regexp_replace(upper(trim(regexp_replace(regexp_replace(c_name, '[.,;:!\"''`()\\[\\]{}/|_*&%$#~^=-]', ' ', 'g'), '\\s+', ' ', 'g'))), '^$', '')), '') as value from customer"),
    "std_digits": (_customers(lambda: tx.digits(_name())), "select c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') as value from customer"),
    "std_alnum": (_customers(lambda: tx.alphanumeric(_name())), "select c_custkey, regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g') as value from customer"),
    "std_sort_tokens": (lambda s, d: _read(s, d, "part").select("p_partkey", tx.sort_tokens(F.col("p_name")).alias("value")), "select p_partkey, array_to_string(list_sort(list_filter(string_split(p_name, ' '), lambda x: x <> '')), ' ') as value from part"),
    "prefix_keys": (lambda s, d: _read(s, d, "part").groupBy(F.substring("p_name", 1, 4).alias("prefix")).agg(F.count("*").alias("total")), "select left(p_name, 4) prefix, count(*) total from part group by 1"),
    "ngram_keys": (lambda s, d: _read(s, d, "part").select(F.explode(tx.ngrams(F.col("p_name"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("total")), "select gram, count(*) total from (select unnest(list_distinct([substr(p_name, i, 3) for i in range(1, length(p_name) - 1)])) gram from part) group by gram"),
    "soundex_codes": (lambda s, d: _read(s, d, "part").select("p_name").distinct().select("p_name", tx.soundex(F.col("p_name")).alias("code")), SOUNDEX),
    "edit_similarity": (_pairs(tx.edit_similarity), PAIRS + "select l, r, round(1 - levenshtein(l, r) / greatest(length(l), length(r))::double, 6) score from p"),
    "token_jaccard": (_pairs(tx.token_jaccard), PAIRS + "select l, r, round(len(list_intersect(string_split(l,' '), string_split(r,' '))) / len(list_distinct(list_concat(string_split(l,' '), string_split(r,' '))))::double, 6) score from p"),
    "jaccard_join": (lambda s, d: simjoin.jaccard_join(_read(s, d, "part").select(F.col("p_name").alias("id"), simjoin.token_sets(F.col("p_name")).alias("tokens")).distinct(), 1 / 3).select("l", "r", F.round("score", 6).alias("score")), PAIRS + "select * from (select l, r, round(len(list_intersect(string_split(l,' '), string_split(r,' '))) / len(list_distinct(list_concat(string_split(l,' '), string_split(r,' '))))::double, 6) score from p) where score >= 0.333333"),
    "edit_join": (lambda s, d: simjoin.edit_join(_read(s, d, "part").select(F.col("p_name").alias("id"), F.col("p_name").alias("text")).distinct(), 0.6).select("l", "r", F.round("score", 6).alias("score")), PAIRS + "select * from (select l, r, round(1 - levenshtein(l, r) / greatest(length(l), length(r))::double, 6) score from p) where score >= 0.6"),
    "block_pairs": (lambda s, d: master.block_pairs(_blocked(s, d)), SYSTEMS + "select a.id l, b.id r from s a join s b on a.digits = b.digits and a.id < b.id"),
    "block_stats": (lambda s, d: master.block_stats(_blocked(s, d)), SYSTEMS + "select count(*) blocks, max(n) largest_block from (select count(*) n from s group by digits)"),
    "golden_records": (_golden, SYSTEMS + ", f as (select *, count(segment) over (partition by digits, segment) n from s) select digits, count(*) member_count, arg_min(segment, trust) segment_trusted, arg_min(segment, (-n) * 10 + trust) segment_frequent, count(distinct segment) segment_values from f group by digits"),
}
