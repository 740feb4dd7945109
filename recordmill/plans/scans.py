"""Two scans of an estate as stored documents, a row for each workspace: nations as workspaces, parts as items, customers as users, suppliers as settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordmill.operators import scan

from .comparing import _sql, _table
from .records import _read

RUN = "(select 1 run union all select 2 run) r"
ZERO = "00000000-0000-0000-0000-000000000000"
WORKSPACES = f"""select run, n_nationkey n, concat('W', n_nationkey) ws, n_name as name, case when run = 2 and n_nationkey = 6 then 'Suspended' when n_nationkey % 7 = 3 then 'Deleted' when n_nationkey % 5 = 0 then null else 'Active' end state,
 case when run = 2 and n_nationkey = 9 then 'CAP-0' when n_nationkey % 3 = 0 then concat('CAP-', n_nationkey % 2) when n_nationkey % 3 = 1 then '{ZERO}' end capacity_id, case when n_nationkey % 4 = 0 then n_nationkey * 1000 else 0 end storage, n_nationkey files
 from {RUN} cross join {{nation}} where not (run = 1 and n_nationkey = 0) and not (run = 2 and n_nationkey = 24)"""
ITEMS = f"""select run, concat('W', p_partkey % 25) ws, concat('P', p_partkey) item, p_name as name, case p_partkey % 9 when 0 then 'Report' when 1 then 'SemanticModel' when 2 then 'Dashboard' when 3 then 'Dataflow Gen2' when 4 then 'Lakehouse' when 5 then 'Notebook' when 6 then 'DataPipeline' when 7 then 'Warehouse' else 'Eventhouse' end type,
 case when p_partkey % 6 <> 0 then concat('u', p_partkey % 40) end creator from {RUN} cross join {{part}} where (run = 1 and p_partkey % 11 <> 0 and p_partkey % 25 <> 0) or (run = 2 and p_partkey % 13 <> 0 and p_partkey % 25 <> 24)"""
USERS = f"""select run, concat('W', c_nationkey) ws, case when c_custkey % 9 <> 0 then concat('u', c_custkey) end email, c_name as name, case when run = 2 and c_custkey % 7 = 0 then 'Viewer' when c_custkey % 4 = 0 then 'Admin' else 'Member' end role
 from {RUN} cross join {{customer}} where (run = 1 and c_nationkey <> 0) or (run = 2 and c_custkey % 17 <> 0 and c_nationkey <> 24)"""
SETTINGS = f"""select run, s_suppkey k, concat('S', s_suppkey) name, case when s_suppkey % 5 <> 0 then s_name end title, case when s_suppkey % 7 <> 0 then concat('G', s_suppkey % 4) end grp, (s_suppkey % 3 = 0) <> (run = 2 and s_suppkey % 8 = 0) as on_, s_suppkey % 6 = 0 delegated, s_suppkey % 2 = 0 or (run = 2 and s_suppkey % 9 = 0) scoped
 from {RUN} cross join {{supplier}} where not (run = 1 and s_suppkey % 10 = 1) and not (run = 2 and s_suppkey % 10 = 2)"""
W, I, U, S = map(_table, (WORKSPACES, ITEMS, USERS, SETTINGS))  # noqa: E741
SQL = _sql(w=WORKSPACES, i=ITEMS, u=USERS, s=SETTINGS)
FAMILY = "case type when 'Report' then 'report' when 'SemanticModel' then 'model' when 'Dashboard' then 'dashboard' when 'Dataflow Gen2' then 'dataflow' when 'Lakehouse' then 'lakehouse' when 'Notebook' then 'notebook' when 'DataPipeline' then 'pipeline' when 'Warehouse' then 'warehouse' else 'other' end"
LICENCE = ", c as (select 'cap-0' id, 'F64' sku union all select 'cap-1', 'P1'), wl as (select w.*, c.sku, case c.sku when 'F64' then 'Fabric' when 'P1' then 'Premium' else 'Pro' end licence from w left join c on c.id = lower(w.capacity_id)) "


def documents(s, d):
    """Each scan as stored: a JSON text for each workspace and each setting of a run, and whether settings were captured."""
    item = F.struct(F.col("item").alias("id"), "name", "type", F.when(F.col("creator").isNotNull(), F.struct(F.lit(None).cast("string").alias("name"), F.col("creator").alias("upn"))).alias("creator"))
    items = I(s, d).groupBy("run", "ws").agg(F.collect_list(item).alias("items"))  # a workspace's own, which are one document
    users = U(s, d).groupBy("run", "ws").agg(F.collect_list(F.struct("email", "name", "role")).alias("users"))
    ws = W(s, d).join(items, ["run", "ws"], "left").join(users, ["run", "ws"], "left")
    one = F.struct(F.col("ws").alias("id"), "name", "state", F.col("capacity_id").alias("capacityId"), F.col("storage").alias("storageSize"), F.col("files").alias("storageFiles"), "items", "users")
    group = F.expr("array(struct(concat('g', k % 5) as name, cast(null as string) as graphId), struct(cast(null as string) as name, 'h' as graphId))")
    setting = F.struct(F.col("name").alias("settingName"), "title", F.col("grp").alias("tenantSettingGroup"), F.col("on_").alias("enabled"), F.col("delegated").alias("delegateToWorkspace"), F.when(F.col("scoped"), group).alias("enabledSecurityGroups"))
    settings = S(s, d).select("run", F.col("name").alias("setting"), F.to_json(setting).alias("doc"))
    return ws.select("run", "ws", F.to_json(one).alias("doc")), settings, W(s, d).select("run").distinct().withColumn("captured", F.lit(True))


def _docs(s, d):
    return scan.parsed(*documents(s, d))


def _capacities(s):
    return s.createDataFrame([("cap-0", "F64"), ("cap-1", "P1")], "id string, sku string")


def _of(make, run):
    return lambda s, d: make(_docs(s, d)).where(F.col("run") == run).drop("run")


ws1, ws2, items1, items2, users1, users2, settings1, settings2 = (_of(m, r) for m in (scan.workspaces, scan.items, scan.users, scan.settings) for r in (1, 2))


def _summary(s, d):
    docs = _docs(s, d)
    return scan.summary(scan.workspaces(docs), scan.items(docs), scan.users(docs), _capacities(s))


def _totals(s, d):
    docs = _docs(s, d)
    return scan.run_totals(_summary(s, d), scan.items(docs), scan.users(docs), scan.settings(docs), scan.captured(docs))


def _total_diff(s, d):
    t = _totals(s, d)
    return scan.diff_totals(t.where("run = 1").drop("run"), t.where("run = 2").drop("run"))


SUMMARY = SQL + LICENCE + f""", f as (select *, {FAMILY} family from i), a as (select run, count(*) items, {', '.join(f"count(*) filter (family = '{x}') {x}s" for x in scan.FAMILIES)} from f group by 1),
 b as (select run, count(*) workspaces, count(*) filter (coalesce(capacity_id, '{ZERO}') <> '{ZERO}') on_capacity, count(*) filter (coalesce(capacity_id, '{ZERO}') = '{ZERO}') on_shared, sum(storage)::bigint storage, sum(files)::bigint files, count(*) filter (storage > 0) with_storage, count(*) filter (licence = 'Fabric') fabric from wl group by 1),
 who as (select run, lower(coalesce(email, name)) p, 0 made from u union all select run, creator, 1 from i where creator is not null), p as (select run, p, max(made) made from who group by all), q as (select run, count(*) users, sum(made)::bigint creators, count(*) filter (made = 0) explorers from p group by 1),
 z as (select run, count(*) settings, count(*) filter (on_) settings_enabled, count(*) filter (not on_) settings_disabled, count(*) filter (scoped) settings_group_scoped, count(*) filter (delegated) settings_delegated from s group by 1),
 t as (select run, workspaces, items, reports, models, dashboards, dataflows, lakehouses, notebooks, pipelines, warehouses, users, creators, explorers, 2 capacities, on_capacity, on_shared, storage, files, with_storage, settings, settings_enabled, settings_disabled, settings_group_scoped, settings_delegated from a join b using (run) join q using (run) join z using (run)) """
METRICS = ", ".join(f"'{m}'" for m in (*scan.METRICS, *scan.SETTING_METRICS))
VALUES = ", ".join((*scan.METRICS, *scan.SETTING_METRICS))
SCOPE = "case when scoped then 'groups g' || (k % 5) || ', h' else 'everyone' end || case when delegated then '; delegated: workspace' else '' end"
SETTING_DIFF = SQL + f""", x as (select *, coalesce(title, name) as label, coalesce(grp, 'Ungrouped') g, {SCOPE} scope from s), j as (select coalesce(a.name, b.name) as name, coalesce(a.label, b.label) as label, coalesce(a.g, b.g) as g, b.on_ b, a.on_ a, b.scope bs, a.scope as_ from (select * from x where run = 1) b full join (select * from x where run = 2) a using (name))
 select name, label, g as group, 'added' as change, null::varchar was, case when a then 'on' else 'off' end as now from j where b is null union all select name, label, g, 'removed', case when b then 'on' else 'off' end, null from j where a is null
 union all select name, label, g, 'toggled', case when b then 'on' else 'off' end, case when a then 'on' else 'off' end from j where a <> b union all select name, label, g, 'rescoped', bs, as_ from j where bs <> as_"""


def _deleted(s, d):
    states = W(s, d).where("run = 1 and n % 4 = 1").selectExpr("ws", "'Deleted' state", "'2024-01-01' deleted_at", "'ann' deleted_by")
    return scan.overlay_deleted(ws1(s, d).select("ws", "state"), states)


def _checked(s, d):
    recorded = W(s, d).where("run = 1 and n % 4 = 1").selectExpr("ws", "'DELETED' state")
    probed = W(s, d).where("run = 1 and n % 5 <> 0").selectExpr("ws", "n % 5 <> 2 there")
    return scan.check_states(ws1(s, d), recorded, probed)


def _marked(s, d):
    return scan.workspaces(scan.mark_deleted(_docs(s, d), "W8", "2024-01-01")).groupBy("run", "state").agg(F.count("*").alias("n"))


def _sizes(s, d):
    """Line items as paths of parts; some carry no length."""
    paths = _read(s, d, "lineitem").selectExpr("concat('W', l_partkey % 25) ws", "concat('P', l_partkey) item", "case when l_linenumber % 4 <> 0 then cast(l_quantity as bigint) end length")
    return scan.item_storage(paths)


def _storage(s, d):
    return scan.workspace_storage(items1(s, d), _sizes(s, d))


SIZES = SQL + ", z as (select 'W' || (l_partkey % 25) ws, 'P' || l_partkey item, sum(l_quantity::bigint)::bigint as size, count(*) files from lineitem where l_linenumber % 4 <> 0 group by 1, 2), y as (select i.ws, coalesce(sum(size), 0)::bigint as size, coalesce(sum(files), 0)::bigint files, count(*) filter (size > 0) with_data, count(*) filter (size is null) unread from i left join z using (ws, item) where run = 1 and lower(type) in ('lakehouse', 'warehouse', 'semanticmodel', 'notebook', 'datapipeline') group by 1) "


def _recalculated(s, d):
    one = s.createDataFrame([("W3", 5, 1, 1, 0)], "ws string, size bigint, files bigint, with_data bigint, unread bigint")
    return scan.recalculated(_storage(s, d), one)[1]


def _pipelines(s, d):
    stages = F.expr("transform(sequence(0, 3), o -> struct(case when o < 3 then o end as order, case when (k + o) % 4 <> 0 then concat('w', k * 4 + o) end as workspaceId))")
    return _read(s, d, "region").selectExpr("concat('pipe', r_regionkey) id", "r_name name", "r_regionkey k").withColumn("stages", stages)


def _access(s, d):
    users = F.expr("transform(sequence(0, 2), o -> struct(concat('App', (k + o) % 4) as identifier, case when o = 1 then 'App' else 'User' end as principalType, case when o = 0 then 'Admin' else 'Member' end as accessRight))")
    known = _pipelines(s, d).where("k <> 3").select(F.col("id").alias("pipeline"), users.alias("users"))
    return scan.pipeline_access(_pipelines(s, d), known, "app2")


def _assigned(s, d):
    return scan.with_pipeline(ws1(s, d), scan.pipeline_assignments(_pipelines(s, d))).select("ws", "pipeline_name", "stage")


PIPES = SQL + ", o as (select r_regionkey k, 'pipe' || r_regionkey id, r_name as name, o from region cross join range(0, 4) t(o)), a as (select *, 'w' || (k * 4 + o) ws from o where (k + o) % 4 <> 0) "


def _edges(s, d):
    """Customers as models with upstream flows and models, orders as reports, line items as tiles."""
    c, o = _read(s, d, "customer"), _read(s, d, "orders")
    flow, up = "array(struct(concat('f', c_custkey % 5) as targetDataflowId, case when c_custkey % 2 = 0 then 'other' end as groupId))", "case when c_custkey % 3 = 0 then array(struct(concat('m', c_custkey + 1) as datasetId, concat('W', c_nationkey) as groupId)) end"
    models = c.selectExpr("concat('W', c_nationkey) ws", "concat('m', c_custkey) id", f"{flow} upstreamDataflows", f"{up} upstreamDatasets")
    reports = o.selectExpr("'W1' ws", "concat('r', o_orderkey) id", "case when o_orderkey % 4 <> 0 then concat('m', o_custkey) end datasetId")
    tiles = _read(s, d, "lineitem").groupBy("l_suppkey").agg(F.collect_list(F.struct(F.concat(F.lit("m"), F.col("l_partkey") % 20).alias("datasetId"))).alias("tiles"))
    boards = tiles.selectExpr("'W2' ws", "concat('d', l_suppkey) id", "tiles")
    names = c.selectExpr("concat('m', c_custkey) item", "c_name name", "concat('W', c_nationkey) ws").union(s.sql("select 'f0' item, 'flow' name, 'W9' ws"))
    return scan.lineage_edges(models, reports, boards, names)


EDGES = """with n as (select 'm' || c_custkey item, c_name as name, 'W' || c_nationkey ws from customer union all select 'f0', 'flow', 'W9'),
 e as (select 'f' || (c_custkey % 5) as source, 'Dataflow' source_kind, case when c_custkey % 2 <> 0 then 'W' || c_nationkey end source_ws, 'm' || c_custkey target, 'SemanticModel' target_kind, 'W' || c_nationkey target_ws from customer
 union all select 'm' || (c_custkey + 1), 'SemanticModel', 'W' || c_nationkey, 'm' || c_custkey, 'SemanticModel', 'W' || c_nationkey from customer where c_custkey % 3 = 0
 union all select 'm' || o_custkey, 'SemanticModel', 'W1', 'r' || o_orderkey, 'Report', 'W1' from orders where o_orderkey % 4 <> 0
 union all select distinct 'm' || (l_partkey % 20), 'SemanticModel', 'W2', 'd' || l_suppkey, 'Dashboard', 'W2' from lineitem)
 select e.source, source_kind, coalesce(a.name, e.source) source_name, coalesce(source_ws, a.ws) source_ws, e.target, target_kind, coalesce(b.name, e.target) target_name, coalesce(target_ws, b.ws) target_ws from e left join n a on a.item = e.source left join n b on b.item = e.target"""


def _datasets(s, d):
    sources = _read(s, d, "nation").selectExpr("n_nationkey source", "concat('W', n_nationkey) ws", "'I' item", """case n_nationkey % 3 when 0 then '[{"name":"own","kind":"View","fields":[{"name":"a","dataType":"int","nullable":true}]}]' when 1 then '[]' else '{broken' end schema_json""")
    cache = _read(s, d, "nation").where("n_nationkey % 2 = 0").selectExpr("concat('W', n_nationkey) ws", "'I' item", """'{"sections":[{"key":"x"},{"key":"sqlendpoint","groups":[{"label":"dbo.t","badges":[],"rows":[["c","int","Yes"],["e","text","No"]]}]}]}' payload""")
    return scan.stored_datasets(sources, cache).select("source", "name", "kind", F.size("fields").alias("fields"))


def _sections(s, d):
    found, ws = items1(s, d), ws1(s, d)
    failed = found.where("type = 'Warehouse'").select("item", F.lit("timeout").alias("error"))
    loaded = {"metadata": scan.metadata_section(found, ws), "endpoint": failed, "tiles": scan.tile_section(_tiles(s, d), found.select("item", "name"))}
    return scan.sections(found.where("type in ('Dashboard', 'Warehouse')"), loaded)


def _tiles(s, d):
    return _read(s, d, "part").where("p_partkey % 9 = 2").selectExpr("concat('P', p_partkey) item", "case when p_partkey % 2 = 0 then p_name end title", "'sub' subtitle", "concat('P', p_partkey - 2) report", "case when p_partkey % 4 = 0 then 'gone' end model")


def _refreshes(s, d):
    rows = _read(s, d, "orders").selectExpr("concat('P', o_custkey) item", "o_orderdate started", "concat('s', o_orderkey) status")
    return scan.refresh_section(rows, 2).select("item", "status")


TABLE = "select concat('P', p_partkey) item, case when p_partkey % 2 = 0 then p_name end name, p_size as size, p_partkey % 3 = 0 required from {part}"
PLANS = {
    "shape_workspaces": (lambda s, d: scan.workspaces(_docs(s, d)).select("run", "ws", "name", "state", "capacity_id", "storage", "files", "item_count", "user_count", "users_readable"), SQL + ", a as (select run, ws, count(*) n from i group by all), b as (select run, ws, count(*) n from u group by all) select w.run, w.ws, w.name, w.state, w.capacity_id, w.storage, w.files, coalesce(a.n, 0) item_count, coalesce(b.n, 0) user_count, true users_readable from w left join a using (run, ws) left join b using (run, ws)"),
    "shape_items": (lambda s, d: scan.items(_docs(s, d)).select("run", "ws", "item", "name", "type", "creator_upn"), SQL + "select run, ws, item, name, type, creator creator_upn from i"),
    "shape_users": (lambda s, d: scan.users(_docs(s, d)).select("run", "ws", "email", "name", "role"), SQL + "select run, ws, email, name, role from u"),
    "items_by_type": (lambda s, d: scan.items_of_types(scan.items(_docs(s, d)), scan.workspaces(_docs(s, d)).where("ws <> 'W4'"), ["lakehouse", "Report"]).select("run", "item", "workspace"), SQL + "select i.run, item, w.name workspace from i left join (select * from w where ws <> 'W4') w using (run, ws) where type in ('Lakehouse', 'Report')"),
    "extract_candidates": (lambda s, d: scan.candidates(scan.items(_docs(s, d)), scan.workspaces(_docs(s, d))).select("run", "workspace", "item", "type"), SQL + "select i.run, w.name workspace, item, i.type from i join w using (run, ws) where i.type in ('Lakehouse', 'Warehouse')"),
    "artifact_listing": (lambda s, d: scan.artifacts(scan.items(_docs(s, d)), scan.workspaces(_docs(s, d)), "other").select("run", "workspace", "item", "creator"), SQL + "select i.run, w.name workspace, item, coalesce(creator, '-') creator from i join w using (run, ws) where i.type = 'Eventhouse'"),
    "item_index": (lambda s, d: scan.item_index(items1(s, d).withColumn("run", F.lit(1)), ws1(s, d).withColumn("run", F.lit(1))).select("item", "name", "workspace"), SQL + "select item, i.name, w.name workspace from i join w using (run, ws) where run = 1"),
    "run_listings": (lambda s, d: scan.run_items(scan.items(_docs(s, d)), 2, "W3").select("item", "type"), SQL + "select item, type from i where run = 2 and ws = 'W3'"),
    "run_users": (lambda s, d: scan.run_users(scan.users(_docs(s, d)), 2, "W3").select("name", "role"), SQL + "select name, role from u where run = 2 and ws = 'W3'"),
    "workspaces_for_grant": (lambda s, d: scan.grantable(scan.workspaces(_docs(s, d)), s.createDataFrame([(1, "completed", 1), (2, "completed", 2), (3, "failed", 3)], "run int, status string, started int")), SQL + "select ws, name, coalesce(state, 'Active') state from w where run = 2"),
    "workspace_counts": (lambda s, d: scan.workspace_counts(ws1(s, d).withColumn("run", F.lit(1)), items1(s, d).withColumn("run", F.lit(1))).select("ws", "items", "reports", "dataflows", "warehouses"), SQL + "select w.ws, count(item) items, count(*) filter (i.type = 'Report') reports, count(*) filter (i.type = 'Dataflow Gen2') dataflows, count(*) filter (i.type = 'Warehouse') warehouses from w left join i using (run, ws) where run = 1 group by 1"),
    "capacity_lookup": (lambda s, d: scan.with_capacity(ws1(s, d), _capacities(s)).select("ws", "sku", "licence"), SQL + LICENCE + "select ws, sku, licence from wl where run = 1"),
    "migration_view": (lambda s, d: scan.migration_view(scan.workspaces(_docs(s, d)), scan.items(_docs(s, d)), _capacities(s)).where("run = 2").drop("run"), SQL + LICENCE + ", n as (select run, ws, count(*) items from i group by all) select ws, name, coalesce(state, 'Active') state, coalesce(capacity_id, '') capacity_id, coalesce(sku, '') sku, licence, coalesce(items, 0) items from wl left join n using (run, ws) where run = 2"),
    "scan_summary": (lambda s, d: _summary(s, d).select("run", "workspaces", "items", "models", "users", "on_capacity", "on_shared", "with_storage", F.col("by_licence")["Fabric"].alias("fabric"), "has_full"), SUMMARY + "select run, workspaces, items, models, users, on_capacity, on_shared, with_storage, fabric, true has_full from t join b using (run, workspaces, on_capacity, on_shared, with_storage)"),
    "run_totals": (_totals, SUMMARY + "select *, true settings_captured from t"),
    "diff_totals": (_total_diff, SUMMARY + f", l as (select run, unnest([{METRICS}]) metric, unnest([{VALUES}]::double[]) v from t) select b.metric, b.v as before, a.v as after, a.v - b.v delta, a.v <> b.v changed, case when b.v = 0 and a.v = 0 then 0 when b.v <> 0 then floor((a.v - b.v) / b.v * 100 * 10 + 0.5) / 10 end percent from l b join l a using (metric) where b.run = 1 and a.run = 2"),
    "settings_groups": (lambda s, d: scan.setting_groups(scan.settings(_docs(s, d))), SQL + "select run, coalesce(grp, 'Ungrouped') as name, count(*) total, count(*) filter (on_) enabled from s group by all"),
    "settings_view": (lambda s, d: scan.settings_view(scan.settings(_docs(s, d)), scan.captured(_docs(s, d)), 1)[0].select("settingName", scan.scope_text().alias("scope")), SQL + f"select name settingName, {SCOPE} scope from s where run = 1"),
    "diff_settings": (lambda s, d: scan.diff_settings(settings1(s, d), settings2(s, d)), SETTING_DIFF),
    "security_group_names": (lambda s, d: settings1(s, d).groupBy(F.array_join(scan.group_names(F.col("enabledSecurityGroups")), ",").alias("names")).agg(F.count("*").alias("total")), SQL + "select case when scoped then 'g' || (k % 5) || ',h' else '' end as names, count(*) total from s where run = 1 group by 1"),
    "diff_users": (lambda s, d: scan.diff_users(users1(s, d), users2(s, d)), SQL + ", a as (select ws, lower(coalesce(email, name)) who, max(role) r from u where run = 1 group by all), b as (select ws, lower(coalesce(email, name)) who, max(role) r from u where run = 2 group by all) select ws, who, case when a.r is null then 'added' when b.r is null then 'removed' else 'role_changed' end as change, a.r was, b.r as now from a full join b using (ws, who) where a.r is distinct from b.r and ws in (select ws from a) and ws in (select ws from b)"),
    "diff_run_items": (lambda s, d: scan.diff_items(items1(s, d), items2(s, d)), SQL + "select coalesce(a.ws, b.ws) ws, coalesce(a.item, b.item) item, case when a.item is null then 'added' else 'removed' end as change, coalesce(a.name, b.name) as name, coalesce(a.type, b.type) as type from (select * from i where run = 1) a full join (select * from i where run = 2) b on a.ws = b.ws and a.item = b.item where a.item is null or b.item is null"),
    "diff_workspace_counts": (lambda s, d: scan.diff_counts(ws1(s, d), ws2(s, d), ["item_count", "user_count"]), SQL + ", a as (select run, ws, count(*) n from i group by all), b as (select run, ws, count(*) n from u group by all), c as (select w.run, w.ws, coalesce(a.n, 0) item_count, coalesce(b.n, 0) user_count from w left join a using (run, ws) left join b using (run, ws)), l as (select run, ws, unnest(['item_count', 'user_count']) field, unnest([item_count, user_count]) v from c) select x.ws, x.field, x.v was, y.v as now, y.v - x.v delta from l x join l y using (ws, field) where x.run = 1 and y.run = 2 and x.v <> y.v"),
    "capacity_moves": (lambda s, d: scan.capacity_moves(scan.with_capacity(ws1(s, d), _capacities(s)), scan.with_capacity(ws2(s, d), _capacities(s))), SQL + LICENCE + "select a.ws, coalesce(a.capacity_id, '-') was_capacity_id, coalesce(a.sku, '-') was_sku, a.licence was_licence, coalesce(b.capacity_id, '-') now_capacity_id, coalesce(b.sku, '-') now_sku, b.licence now_licence from wl a join wl b using (ws) where a.run = 1 and b.run = 2 and (a.capacity_id is distinct from b.capacity_id or a.sku is distinct from b.sku)"),
    "deleted_overlay": (_deleted, SQL + "select ws, case when n % 4 = 1 then 'Deleted' else state end state, case when n % 4 = 1 then '2024-01-01' end deleted_at, case when n % 4 = 1 then 'ann' end deleted_by from w where run = 1"),
    "status_check": (_checked, SQL + "select ws, case when n % 4 = 1 then false when n % 5 <> 0 then n % 5 <> 2 end as there, case when n % 4 = 1 then 'recorded' else 'probe' end as source from w where run = 1"),
    "status_counts": (lambda s, d: scan.state_counts(_checked(s, d)), SQL + ", c as (select case when n % 4 = 1 then false when n % 5 <> 0 then n % 5 <> 2 end t from w where run = 1) select count(*) filter (t) active, count(*) filter (not t) deleted, count(*) filter (t is null) as unknown from c"),
    "mark_deleted": (_marked, SQL + "select run, case when ws = 'W8' then 'Deleted' else state end state, count(*) n from w group by all"),
    "item_storage": (lambda s, d: _sizes(s, d), SIZES + "select ws, item, size, files from z"),
    "workspace_storage": (_storage, SIZES + "select * from y"),
    "storage_totals": (lambda s, d: scan.storage_totals(_storage(s, d)), SIZES + "select sum(size)::bigint as size, sum(files)::bigint files, count(*) filter (size > 0) with_data from y"),
    "storage_ranking": (lambda s, d: scan.storage_ranking(_storage(s, d)), SIZES + "select ws, size, files, floor(size * 100.0::double / (select sum(size) from y) + 0.5)::bigint percent from y where size > 0"),
    "storage_recalc": (_recalculated, SIZES + ", n as (select ws, size, files from y where ws <> 'W3' union all select 'W3', 5, 1) select sum(size)::bigint as size, sum(files)::bigint files, count(*) filter (size > 0) with_data from n"),
    "pipeline_lookup": (_assigned, PIPES + "select w.ws, a.name pipeline_name, case when a.ws is not null then case a.o when 0 then 'Development' when 1 then 'Test' when 2 then 'Production' else 'Stage' end end stage from w left join a on a.ws = lower(w.ws) where run = 1"),
    "deployment_assignments": (lambda s, d: scan.pipeline_assignments(_pipelines(s, d)).groupBy("pipeline").agg(F.count("*").alias("workspaces")), PIPES + "select id pipeline, count(*) workspaces from a group by 1"),
    "pipelines_with_access": (_access, PIPES + "select id, name, 3 workspaces, case when k = 3 then 'unknown' when (k + 1) % 4 = 2 then 'granted' else 'none' end access, case when k = 3 then 0 else 1 end admins from o where o = 0"),
    "runs_by_tenant": (lambda s, d: scan.runs_by(_read(s, d, "orders").selectExpr("o_custkey tenant", "o_orderkey run", "o_orderdate started"), "tenant"), "select o_custkey tenant, count(*) runs, max(case when n = 1 then o_orderkey end) newest from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) n from orders) group by 1"),
    "scan_lineage": (_edges, EDGES),
    "stored_datasets": (_datasets, "select n_nationkey as source, case when n_nationkey % 3 = 0 then 'own' else 'dbo.t' end as name, case when n_nationkey % 3 = 0 then 'View' else 'Table' end kind, case when n_nationkey % 3 = 0 then 1 else 2 end fields from nation where n_nationkey % 3 = 0 or n_nationkey % 2 = 0"),
    "item_metadata": (lambda s, d: scan.metadata_section(items1(s, d), ws1(s, d)).where("label in ('type', 'workspace', 'description')"), SQL + "select item, 'type' as label, i.type as value from i where run = 1 union all select item, 'workspace', w.name from i join w using (run, ws) where run = 1 union all select item, 'description', '-' from i where run = 1"),
    "item_tiles": (lambda s, d: scan.tile_section(_tiles(s, d), items1(s, d).select("item", "name")), SQL + ", t as (select p_partkey k, p_name from part where p_partkey % 9 = 2) select 'P' || k item, case when k % 2 = 0 then p_name else 'sub' end title, coalesce(x.name, 'P' || (k - 2)) report, case when k % 4 = 0 then 'gone' else '-' end model from t left join (select * from i where run = 1) x on x.item = 'P' || (k - 2)"),
    "item_refreshes": (_refreshes, "select 'P' || o_custkey item, 's' || o_orderkey status from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, 's' || o_orderkey) n from orders) where n <= 2"),
    "item_tables": (lambda s, d: scan.table_section(_table(TABLE)(s, d), ["name", "size", "required"]), "select 'P' || p_partkey item, case when p_partkey % 2 = 0 then p_name else '-' end as name, p_size::varchar as size, case when p_partkey % 3 = 0 then 'Yes' else 'No' end required from part"),
    "item_sections": (_sections, SQL + "select item, 'metadata' section, 6 as rows, null::varchar warning from i where run = 1 and type in ('Dashboard', 'Warehouse') union all select item, 'endpoint', 0, 'timeout' from i where run = 1 and type = 'Warehouse' union all select item, 'tiles', 1, null from i where run = 1 and type = 'Dashboard'"),
    "detail_cap": (lambda s, d: scan.detailed(items1(s, d), 100).select("ws", "item"), SQL + "select ws, item from i where run = 1 order by ws, item limit 100"),
}
