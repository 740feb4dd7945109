"""Scored pairs, rankings, top lists and dashboards."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordmill.functions import text as tx
from recordmill.operators import estate, ledger, master
from recordmill.operators.score import Feature, score_pairs

from .records import SYSTEMS, _blocked, _read, _systems


def _same(a, b):
    return (a == b).cast("double")


FEATURES = [Feature("name", tx.edit_similarity, 2), Feature("segment", _same, required=True, least=0.0), Feature("balance", _same)]
SCORED = SYSTEMS + """, p as (select a.id l, b.id r, 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name))::double n, (a.segment = b.segment)::int::double g,
 (a.balance = b.balance)::int::double h from s a join s b on a.digits = b.digits and a.id < b.id),
 q as (select l, r, (n * 2 + g + coalesce(h, 0)) / (case when h is null then 3 else 4 end) score from p),
 d as (select l, r, round(score, 3) score, case when score >= 0.9 then 'match' when score >= 0.75 then 'review' else 'distinct' end decision from q) """


def _scored(s, d):
    return score_pairs(master.block_pairs(_blocked(s, d)), _systems(s, d), "id", FEATURES)


def _runs(s, d):
    """Orders as runs of a customer's rule."""
    return _read(s, d, "orders").selectExpr("o_custkey rule", "o_orderkey run", "o_orderdate started", "cast(round(o_totalprice) as bigint) exceptions")


def latest_pairs(s, d):
    newest = W.partitionBy("rule").orderBy(F.desc("started"), F.desc("run"))
    ranked = _runs(s, d).select("rule", "run", "exceptions", F.row_number().over(newest).alias("n"), F.lead("run").over(newest).alias("before"), F.lead("exceptions").over(newest).alias("was"), F.count("*").over(W.partitionBy("rule")).alias("runs"))
    return ranked.where("n = 1 and before is not null").select("rule", "run", "before", "runs", (F.col("exceptions") - F.col("was")).alias("delta"))


def top3(s, d):
    return estate.top_creators(_read(s, d, "orders").select(F.col("o_orderpriority").alias("ws"), F.col("o_custkey").alias("creator")))


def ageing(s, d):
    rows = _read(s, d, "orders").selectExpr("case when o_orderstatus = 'F' then 'resolved' else 'open' end status", "o_orderdate first_seen")
    return ledger.ageing(rows, F.lit("1998-08-31").cast("date"))


def owners(s, d):
    a, b = _read(s, d, "customer").select(F.lower("c_mktsegment")), _read(s, d, "orders").select(F.lower("o_orderpriority"))
    return estate.distinct_texts(a, b).withColumnRenamed("value", "owner")


def listing(s, d):
    """Orders as exceptions: the page of 500 that a filter without conditions shows, most severe and newest first."""
    severity = F.when(F.col("o_orderstatus") == "P", "high").when(F.col("o_orderstatus") == "O", "medium").otherwise("low")
    rows = _read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), severity.alias("severity"), F.col("o_orderdate").alias("last_seen"))
    return ledger.listing(rows, ledger.Filter(), 500).select(F.col("id").alias("o_orderkey"), F.col("status").alias("o_orderstatus"))


def orphans(s, d):
    known = _read(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return _read(s, d, "customer").join(known, "c_custkey", "left_anti").select("c_custkey", "c_name")


def shares(s, d):
    return estate.shares(_read(s, d, "customer"), "c_mktsegment")


PLANS = {
    "score_pairs": (_scored, SCORED + "select * from d"),
    "pair_decisions": (lambda s, d: _scored(s, d).groupBy("decision").agg(F.count("*").alias("total")), SCORED + "select decision, count(*) total from d group by decision"),
    "latest_pairs": (latest_pairs, "with r as (select o_custkey rule, o_orderkey run, cast(round(o_totalprice) as bigint) e, row_number() over w n, lead(o_orderkey) over w before, lead(cast(round(o_totalprice) as bigint)) over w was, count(*) over (partition by o_custkey) runs from orders window w as (partition by o_custkey order by o_orderdate desc, o_orderkey desc)) select rule, run, before, runs, e - was delta from r where n = 1 and before is not null"),
    "top3_creators": (top3, "select * from (select o_orderpriority ws, o_custkey creator, count(*) items, row_number() over (partition by o_orderpriority order by count(*) desc, o_custkey) as rank from orders group by 1, 2) where rank <= 3"),
    "ageing_buckets": (ageing, "with o as (select date_diff('day', o_orderdate::date, date '1998-08-31') as days from orders where o_orderstatus <> 'F') select count(*) filter (days <= 7) as week, count(*) filter (days between 8 and 30) as month, count(*) filter (days > 30) as older from o"),
    "list_owners": (owners, "select lower(c_mktsegment) as owner from customer where trim(c_mktsegment) <> '' union select lower(o_orderpriority) from orders where trim(o_orderpriority) <> ''"),
    "list_exceptions": (listing, "select o_orderkey, o_orderstatus from orders order by case o_orderstatus when 'P' then 0 when 'O' then 1 else 2 end, o_orderdate desc, o_orderkey limit 500"),
    "orphan_anti": (orphans, "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)"),
    "segment_shares": (shares, "select c_mktsegment, count(*) total, cast(floor(count(*) * 100.0::double / sum(count(*)) over () + 0.5) as bigint) percent from customer group by 1"),
}
