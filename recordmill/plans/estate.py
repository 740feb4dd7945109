"""Estate analytics: nations as workspaces, parts as items, customers as users."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordmill.operators import estate, timing


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _items(s, d):
    return _read(s, d, "part").selectExpr("p_partkey % 25 ws", "p_type type", "p_size size")


def item_counts(s, d):
    ws = _read(s, d, "nation").selectExpr("n_nationkey ws", "n_name name")
    counts = _items(s, d).groupBy("ws", "type").agg(F.count("*").alias("items"), F.sum("size").alias("storage"))
    return counts.join(F.broadcast(ws), "ws").select("name", "type", "items", "storage")  # nations: 25 rows


def user_access(s, d):
    users = _read(s, d, "customer").selectExpr("c_nationkey ws", "case when c_custkey % 4 = 0 then 'Admin' else 'Member' end role")
    ws = _read(s, d, "nation").selectExpr("n_nationkey ws", "n_name name")
    counts = users.groupBy("ws").agg(F.count_if(F.col("role") == "Admin").alias("admins"), F.count("*").alias("users"))
    joined = ws.join(counts, "ws", "left").fillna(0, ["admins", "users"])
    finding = F.when(F.col("admins") == 0, "ownerless").when(F.col("admins") == 1, "singleAdmin").when(F.col("users") >= 50, "overShared")
    return joined.select("name", "admins", "users", finding.alias("finding"))


def rate_window(s, d):
    events = _read(s, d, "events")
    return events.groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("hits")).where("hits > 2")


def interrupted(s, d):
    last = _read(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    quiet = F.unix_timestamp(F.lit("2024-01-31 00:00:00").cast("timestamp")) - F.unix_timestamp("last_ts")
    return last.select("user_id", quiet.alias("quiet_seconds")).where("quiet_seconds >= 86400")


def storage_rollup(s, d):
    path = F.regexp_replace("url", "^[a-z]+://[^/]*/?", "")
    paths = _read(s, d, "pages").select(path.alias("path"), F.lit(False).alias("is_directory"), F.length("html").alias("length"))
    return estate.folder_sizes(paths).groupBy("area").agg(F.sum("files").alias("files"), F.sum("size").alias("size"))


def interrupted_join(s, d):
    events = _read(s, d, "events")
    runs = events.groupBy(F.col("user_id").alias("run")).agg(F.min("ts").alias("started")).selectExpr("*", "case when run % 4 = 0 then 'completed' when run % 4 = 1 then 'cancelling' else 'running' end status")
    beats = events.where("user_id % 3 = 0").groupBy(F.col("user_id").alias("run")).agg(F.max("ts").alias("updated"))
    return timing.interrupted(runs, beats, F.expr("timestamp'2024-01-31 00:00:00'"), 86400)


PLANS = {
    "item_counts_by_type": (item_counts, "select n_name as name, p_type as type, count(*) items, cast(sum(p_size) as bigint) storage from part join nation on n_nationkey = p_partkey % 25 group by all"),
    "triage_access": (user_access, "with c as (select c_nationkey ws, count(*) filter (c_custkey % 4 = 0) admins, count(*) users from customer group by 1) select n_name as name, coalesce(admins,0) admins, coalesce(users,0) users, case when coalesce(admins,0) = 0 then 'ownerless' when admins = 1 then 'singleAdmin' when users >= 50 then 'overShared' end finding from nation left join c on ws = n_nationkey"),
    "rate_window": (rate_window, "select user_id, date_trunc('day', ts)::timestamp as day, count(*) hits from events group by all having count(*) > 2"),
    "interrupted_runs": (interrupted, "select user_id, cast(epoch(timestamp '2024-01-31') as bigint) - cast(floor(epoch(max(ts))) as bigint) quiet_seconds from events group by 1 having quiet_seconds >= 86400"),
    "interrupted_left_join": (interrupted_join, "with e as (select user_id run, cast(epoch(timestamp '2024-01-31') as bigint) - cast(floor(epoch(case when user_id % 3 = 0 then max(ts) else min(ts) end)) as bigint) quiet_seconds from events where user_id % 4 <> 0 group by 1) select * from e where quiet_seconds >= 86400"),
    "storage_rollup": (storage_rollup, "select coalesce(list_filter(string_split(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '/'), lambda x: x <> '')[1], '') area, count(*) files, cast(sum(length(html)) as bigint) as size from pages group by 1"),
}
