"""What is kept by key: changes of the ledger, stored scans, cached details, schemas of databases."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from recordmill.operators import exceptions, scan
from recordmill.sources import datasets
from recordmill.sources.keyed import KeyedTable, Step
from recordmill.sources.scan_store import ScanStore

from .comparing import _sql, _table
from .records import _read
from .scans import SQL as SCANS
from .scans import documents


def _folder(s) -> str:
    """A fresh folder in the cluster's shared one; one of our own only where none is set (local tests)."""
    return f"{(s.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='recordmill-')).rstrip('/')}/recordmill-{uuid.uuid4().hex}"


HELD = """select concat('e', o_orderkey) fingerprint, 'duplicate' outcome, case o_orderkey % 3 when 0 then 'high' when 1 then 'medium' else 'low' end severity, case o_orderstatus when 'F' then 'resolved' when 'O' then 'open' else 'investigating' end status,
 1 first_run, 1 last_run, 1 occurrence_count, case when o_orderkey % 5 <> 0 then o_orderpriority end as owner, cast(null as varchar(9)) reason from {orders}"""
ASKS = """select concat('e', o_orderkey) fingerprint, case o_orderkey % 4 when 1 then 'ann' when 2 then '' end as owner, case when o_orderkey % 6 = 1 then 'high' end severity, case o_orderkey % 3 when 0 then 'accepted' when 1 then 'open' end to_status,
 case when o_orderkey % 10 = 3 then 'seen' end as comment, case when o_orderkey % 12 <> 0 then 'known' end reason from {orders} where o_orderkey % 2 = 1 or o_orderkey % 12 = 0"""
held, asks = _table(HELD), _table(ASKS)
JUDGED = _sql(l=HELD, a=ASKS) + """, j as (select l.*, a.owner ask_owner, a.severity ask_severity, to_status, comment, a.reason ask_reason, a.fingerprint is not null asked, coalesce(to_status <> status, false) moving from l left join a using (fingerprint)),
 p as (select *, case when asked and moving and not (to_status = 'open' or (to_status = 'accepted' and status <> 'resolved')) then 'barred:' || status || '>' || to_status when asked and moving and to_status = 'accepted' and coalesce(trim(ask_reason), '') = '' then 'reason_missing' end problem from j),
 k as (select *, asked and problem is null ok from p),
 c as (select *, ok and ask_owner is not null and nullif(ask_owner, '') is distinct from owner assigned, coalesce(ok and ask_severity <> severity, false) graded, ok and moving moved from k) """


def _changed(part):
    return lambda s, d: exceptions.change(held(s, d), asks(s, d))[part]


def _scan_marked(s, d):
    """Both scans stored by workspace, one workspace marked in both, and the states that are read back."""
    store = ScanStore(s, _folder(s), 16)
    store.save(*documents(s, d))
    store.mark_deleted("W8", "2024-01-01")
    return scan.workspaces(store.load()).groupBy("run", "state").agg(F.count("*").alias("n"))


def _details_cache(s, d):
    """Customers cached by key, then those of one in seven put anew, in a form that the first ones are brought to as they are read."""
    folder, keys, base = _folder(s), ["c_custkey"], "c_custkey bigint, name string, balance double"
    c = _read(s, d, "customer")
    KeyedTable(s, folder, keys, base, 16).upsert(c.selectExpr("c_custkey", "c_name name", "c_acctbal balance"))
    step = Step(1, "segment", f"{base}, segment string", lambda df: df.withColumn("segment", F.lit("unknown")))
    new = KeyedTable(s, folder, keys, base, 16, steps=(step,))
    new.upsert(c.where("c_custkey % 7 = 0").selectExpr("c_custkey", "upper(c_name) name", "c_acctbal * 2 balance", "c_mktsegment segment"))
    return new.read().select("c_custkey", "name", F.round("balance", 2).alias("balance"), "segment")


def _shaped(s, d):
    rows = _read(s, d, "part").selectExpr("concat('s', p_size % 3) table_schema", "concat('t', p_partkey % 40) table_name", "case when p_partkey % 40 < 30 then 'BASE TABLE' else 'VIEW' end table_type", "concat('c', p_partkey) column_name",
        "case p_partkey % 4 when 0 then 'nvarchar' when 1 then 'decimal' when 2 then 'int' else 'char' end data_type", "case p_partkey % 4 when 0 then -1 when 3 then 5 end length", "case when p_partkey % 4 = 1 then 10 end precision", "case when p_partkey % 4 = 1 then 2 end scale", "case when p_partkey % 2 = 0 then 'YES' else 'no' end is_nullable", "cast(p_partkey as int) position")
    shaped = datasets.shape_schema(rows)
    return shaped.select("name", "kind", F.size("fields").alias("fields"), F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit(" "), f["data_type"], F.when(f["nullable"], "?").otherwise(""))), ",").alias("text"))


PLANS = {
    "ledger_changed": (lambda s, d: _changed(0)(s, d).select("fingerprint", "owner", "severity", "status", "reason"), JUDGED + "select fingerprint, case when assigned then nullif(ask_owner, '') else owner end as owner, case when graded then ask_severity else severity end severity, case when moved then to_status else status end status, case when moved then coalesce(ask_reason, reason) else reason end reason from c"),
    "ledger_events": (_changed(1), JUDGED + "select fingerprint, 'assigned' as action, owner as was, nullif(ask_owner, '') as now from c where assigned union all select fingerprint, 'severity-change', severity, ask_severity from c where graded union all select fingerprint, 'status-change', status, to_status from c where moved union all select fingerprint, 'comment', null, comment from c where ok and not moved and comment is not null"),
    "ledger_refused": (lambda s, d: _changed(2)(s, d).select("fingerprint", "problem"), JUDGED + "select fingerprint, problem from p where problem is not null"),
    "scan_marked": (_scan_marked, SCANS + "select run, case when ws = 'W8' then 'Deleted' else state end state, count(*) n from w group by all"),
    "details_cache": (_details_cache, "select c_custkey, case when c_custkey % 7 = 0 then upper(c_name) else c_name end as name, round(case when c_custkey % 7 = 0 then c_acctbal * 2 else c_acctbal end, 2)::double balance, case when c_custkey % 7 = 0 then c_mktsegment else 'unknown' end segment from customer"),
    "shape_schema": (_shaped, """with r as (select 's' || (p_size % 3) || '.t' || (p_partkey % 40) as name, case when p_partkey % 40 < 30 then 'Table' else 'View' end kind, p_partkey k, 'c' || p_partkey || ' ' || case p_partkey % 4 when 0 then 'nvarchar(max)' when 1 then 'decimal(10,2)' when 2 then 'int' else 'char(5)' end || case when p_partkey % 2 = 0 then '?' else '' end one from part)
 select name, kind, count(*)::int fields, string_agg(one, ',' order by k) as text from r group by all"""),
}
