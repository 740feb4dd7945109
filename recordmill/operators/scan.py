"""Scans of an estate: the stored document, its tables, totals, settings, access, storage, pipelines and what changed between two.

Tables carry ``run``; the document is parsed once and only to rebuild them. Both spellings of a field that documents
use are read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordmill.functions.convert import half_up, share, stage_name
from recordmill.operators.estate import FULL_SKUS, NO_CAPACITY, family, licence, principal
from recordmill.operators.registry import upsert

# Item types that keep data.
STORING = ("lakehouse", "warehouse", "sqldatabase", "semanticmodel", "dataset", "dataflow", "dataflowgen2", "datagen2", "kqldatabase", "notebook", "environment", "eventstream", "datapipeline", "sparkjobdefinition")
#: Families that a workspace is counted by.
FAMILIES = ("report", "model", "dashboard", "dataflow", "lakehouse", "notebook", "pipeline", "warehouse")
DELETED = "Deleted"

ITEM = "struct<id:string,name:string,type:string,state:string,description:string,lastUpdate:string,lastUpdated:string,modifiedDateTime:string,modifiedBy:string,storageSize:bigint,creator:struct<name:string,upn:string,type:string>>"
USER = "struct<identifier:string,graphId:string,principalType:string,displayName:string,name:string,email:string,emailAddress:string,userPrincipalName:string,groupUserAccessRight:string,accessRight:string,role:string>"
WORKSPACE = f"struct<id:string,name:string,displayName:string,type:string,state:string,capacityId:string,capacityName:string,capacitySku:string,licenseType:string,isOnDedicatedCapacity:boolean,pipelineName:string,pipelineStage:string,storageSize:bigint,storageFiles:bigint,usersReadable:boolean,description:string,deletedAt:string,items:array<{ITEM}>,users:array<{USER}>>"
GROUPS = "array<struct<name:string,graphId:string>>"
SETTING = f"struct<settingName:string,title:string,tenantSettingGroup:string,enabled:boolean,delegateToWorkspace:boolean,delegateToCapacity:boolean,delegateToDomain:boolean,enabledSecurityGroups:{GROUPS},excludedSecurityGroups:{GROUPS}>"


@dataclass(frozen=True)
class Scans:
    """``workspaces`` (run, w), ``settings`` (run, s) and ``runs`` (run, captured): a row for each workspace and setting of a run."""

    workspaces: DataFrame
    settings: DataFrame
    runs: DataFrame


def parsed(documents: DataFrame, setting_documents: DataFrame, runs: DataFrame) -> Scans:
    """Stored documents (run, ws, doc), (run, setting, doc) as structs. A broken one keeps its key and nothing else.

    Where ``documents`` also has deleted_at, a workspace with such a time shows as deleted, whatever its document says.
    """
    extra = ["deleted_at"] if "deleted_at" in documents.columns else []
    w = documents.select("run", "ws", *extra, F.from_json("doc", WORKSPACE).alias("w"))
    w = w.withColumn("w", F.coalesce("w", F.from_json(F.lit("{}"), WORKSPACE)).withField("id", F.coalesce("w.id", "ws")))
    if extra:
        w = w.withColumn("w", F.when(F.col("deleted_at").isNull(), F.col("w")).otherwise(F.col("w").withField("state", F.lit(DELETED)).withField("deletedAt", F.col("deleted_at"))))
    w = w.select("run", "w")
    s = setting_documents.select("run", "setting", F.from_json("doc", SETTING).alias("s"))
    s = s.select("run", F.coalesce("s", F.from_json(F.lit("{}"), SETTING)).withField("settingName", F.coalesce("s.settingName", "setting")).alias("s"))
    return Scans(w, s, runs.select("run", "captured"))


def _each(docs: Scans) -> DataFrame:
    return docs.workspaces


def workspaces(docs: Scans) -> DataFrame:
    """One row per run and workspace, with its counts; access is unreadable only where the document says so."""
    w = F.col("w")
    fields = {"ws": w["id"], "name": F.coalesce(w["name"], w["displayName"]), "type": w["type"], "state": w["state"], "capacity_id": w["capacityId"], "capacity_name": w["capacityName"], "sku": w["capacitySku"], "licence": w["licenseType"], "dedicated": w["isOnDedicatedCapacity"], "pipeline": w["pipelineName"], "stage": w["pipelineStage"], "storage": w["storageSize"], "files": w["storageFiles"], "description": w["description"]}
    size = lambda c: F.when(c.isNull(), 0).otherwise(F.size(c))
    return _each(docs).select("run", *[c.alias(n) for n, c in fields.items()], size(w["items"]).alias("item_count"), size(w["users"]).alias("user_count"), F.coalesce(w["usersReadable"], F.lit(True)).alias("users_readable"))


def items(docs: Scans) -> DataFrame:
    i = F.col("i")
    fields = {"item": i["id"], "name": i["name"], "type": i["type"], "state": i["state"], "description": i["description"], "storage": i["storageSize"], "modified_at": F.coalesce(i["lastUpdate"], i["lastUpdated"], i["modifiedDateTime"]), "modified_by": i["modifiedBy"], "creator_name": i["creator"]["name"], "creator_upn": i["creator"]["upn"]}
    return _each(docs).select("run", F.col("w.id").alias("ws"), F.explode("w.items").alias("i")).select("run", "ws", *[c.alias(n) for n, c in fields.items()])


def users(docs: Scans) -> DataFrame:
    u = F.col("u")
    fields = {"principal": F.coalesce(u["identifier"], u["graphId"]), "kind": u["principalType"], "name": F.coalesce(u["displayName"], u["name"]), "email": F.coalesce(u["emailAddress"], u["userPrincipalName"], u["email"]), "role": F.coalesce(u["groupUserAccessRight"], u["accessRight"], u["role"])}
    return _each(docs).select("run", F.col("w.id").alias("ws"), F.explode("w.users").alias("u")).select("run", "ws", *[c.alias(n) for n, c in fields.items()])


def settings(docs: Scans) -> DataFrame:
    """One row per run and setting; a run that captured none has no rows, see ``captured``."""
    return docs.settings.select("run", "s.*")


def captured(docs: Scans) -> DataFrame:
    """(run, captured): whether the run holds settings at all, be it an empty list."""
    return docs.runs


def run_workspaces(ws: DataFrame, run: int) -> DataFrame:
    return ws.where(F.col("run") == run).orderBy("name", "ws")


def run_items(found: DataFrame, run: int, ws: str | None = None) -> DataFrame:
    rows = found.where(F.col("run") == run)
    return (rows.where(F.col("ws") == ws) if ws else rows).orderBy("type", "name", "item")


def run_users(found: DataFrame, run: int, ws: str) -> DataFrame:
    return found.where((F.col("run") == run) & (F.col("ws") == ws)).orderBy("role", "name", "principal")


def items_of_types(found: DataFrame, ws: DataFrame, types: list[str]) -> DataFrame:
    """Items of some types, in any case, with their workspace's name; null where the workspace is gone."""
    names = ws.select("run", "ws", F.col("name").alias("workspace"))
    return found.where(F.lower("type").isin(*[t.lower() for t in types])).join(names, ["run", "ws"], "left")


def candidates(found: DataFrame, ws: DataFrame) -> DataFrame:
    """Lakehouses and warehouses, the sources to choose from, by workspace and name."""
    rows = items_of_types(found, ws, ["lakehouse", "warehouse"])
    return rows.select("run", "ws", "workspace", "item", "name", "type").orderBy(F.coalesce("workspace", F.lit("")), F.coalesce("name", F.lit("")), "item")


def artifacts(found: DataFrame, ws: DataFrame, kind: str = "all") -> DataFrame:
    """Items of a family or, with ``other``, of none; with defaults for what is missing, by workspace and name."""
    rows = found if kind == "all" else found.where(family(F.col("type")) == kind)
    rows = rows.join(ws.select("run", "ws", F.col("name").alias("__ws")), ["run", "ws"], "left")
    out = rows.select("run", "ws", "item", F.coalesce("type", F.lit("-")).alias("type"), F.coalesce("name", F.lit("Unnamed")).alias("name"), F.coalesce("__ws", F.lit("Unnamed Workspace")).alias("workspace"), F.coalesce(F.nullif(F.col("creator_upn"), F.lit("")), "creator_name", F.lit("-")).alias("creator"))
    return out.orderBy("workspace", "name", "item")


def item_index(found: DataFrame, ws: DataFrame) -> DataFrame:
    """(run, item, name, type, ws, workspace): what an id stands for."""
    names = ws.select("run", "ws", F.col("name").alias("workspace"))
    return found.where("item is not null").select("run", "ws", "item", "name", "type").join(names, ["run", "ws"], "left")


def grantable(ws: DataFrame, runs: DataFrame) -> DataFrame:
    """(ws, name, state) of the newest completed run, with defaults."""
    last = runs.where("status = 'completed'").agg(F.max_by("run", F.struct("started", "run")).alias("run"))  # one row
    rows = ws.join(F.broadcast(last), "run", "left_semi")
    return rows.select("ws", F.coalesce("name", F.lit("Unnamed")).alias("name"), F.coalesce("state", F.lit("Active")).alias("state"))


def workspace_counts(ws: DataFrame, found: DataFrame) -> DataFrame:
    """Every workspace with its items in all and by family."""
    by = found.groupBy("run", "ws").agg(F.count("*").alias("items"), *[F.count_if(family(F.col("type")) == f).alias(f"{f}s") for f in FAMILIES])
    return ws.select("run", "ws", "name").join(by, ["run", "ws"], "left").fillna(0, ["items", *[f"{f}s" for f in FAMILIES]])


def with_capacity(ws: DataFrame, capacities: DataFrame) -> DataFrame:
    """``ws`` with the sku of its capacity, whose id is compared in any case, and the licence that follows."""
    skus = capacities.select(F.lower("id").alias("__cap"), F.col("sku").alias("__sku"))
    return ws.join(skus, F.lower("capacity_id") == F.col("__cap"), "left").drop("__cap", "sku", "licence").withColumn("sku", F.col("__sku")).withColumn("licence", licence(F.col("__sku"))).drop("__sku")


def migration_view(ws: DataFrame, found: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per workspace its state, capacity, sku, licence and number of items, with defaults."""
    n = found.groupBy("run", "ws").agg(F.count("*").alias("items"))
    rows = with_capacity(ws, capacities).join(n, ["run", "ws"], "left")
    text = lambda c, d: F.coalesce(c, F.lit(d)).alias(c)
    return rows.select("run", "ws", text("name", "Unnamed"), text("state", "Active"), text("capacity_id", ""), text("sku", ""), "licence", F.coalesce("items", F.lit(0)).alias("items"))


def summary(ws: DataFrame, found: DataFrame, access: DataFrame, capacities: DataFrame) -> DataFrame:
    """One row per run: items by family, users, workspaces on a capacity or shared, and maps by state, licence and sku."""
    i = found.groupBy("run").agg(F.count("*").alias("items"), *[F.count_if(family(F.col("type")) == f).alias(f"{f}s") for f in FAMILIES])
    people = access.select("run", principal(F.coalesce("email", "name")).alias("who")).union(found.select("run", principal(F.coalesce("creator_upn", "creator_name")))).where("who is not null")
    u = people.groupBy("run").agg(F.count_distinct("who").alias("users"))
    full = with_capacity(ws, capacities)
    dedicated = F.coalesce("capacity_id", F.lit("")).isin("", NO_CAPACITY)
    rows = full.select("run", F.coalesce("state", F.lit("Active")).alias("state"), "licence", F.coalesce(F.nullif(F.col("sku"), F.lit("")), F.lit("Shared (Pro)")).alias("sku"), (~dedicated).alias("on"), "storage", "files")

    def mapped(by: str) -> DataFrame:
        n = rows.groupBy("run", by).agg(F.count("*").alias("n"))
        return n.groupBy("run").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(by, "n")))).alias(f"by_{by}"))  # few values

    w = rows.groupBy("run").agg(F.count("*").alias("workspaces"), F.count_if("on").alias("on_capacity"), F.count_if(~F.col("on")).alias("on_shared"), F.coalesce(F.sum("storage"), F.lit(0)).alias("storage"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.count_if(F.col("storage") > 0).alias("with_storage"))
    out = w.join(i, "run", "left").join(u, "run", "left")
    for by in ("state", "licence", "sku"):
        out = out.join(mapped(by), "run", "left")
    caps = capacities.agg(F.count("*").alias("capacities"), F.coalesce(F.bool_or(F.col("sku").isin(*FULL_SKUS)), F.lit(False)).alias("has_full"))
    return out.crossJoin(F.broadcast(caps)).fillna(0, ["items", "users", *[f"{f}s" for f in FAMILIES]])  # caps is one row


# The twenty-four metrics that two runs are compared by; those of settings come last.
METRICS = ("workspaces", "items", "reports", "models", "dashboards", "dataflows", "lakehouses", "notebooks", "pipelines", "warehouses", "users", "creators", "explorers", "capacities", "on_capacity", "on_shared", "storage", "files", "with_storage")
SETTING_METRICS = ("settings", "settings_enabled", "settings_disabled", "settings_group_scoped", "settings_delegated")


def run_totals(summed: DataFrame, found: DataFrame, access: DataFrame, setting_rows: DataFrame, has_settings: DataFrame) -> DataFrame:
    """One row per run: ``METRICS``, ``SETTING_METRICS`` and settings_captured. Creators made an item, explorers only have access."""
    made = found.select("run", principal(F.coalesce(F.nullif(F.col("creator_upn"), F.lit("")), "creator_name")).alias("who"), F.lit(1).alias("made"))
    have = access.select("run", principal(F.coalesce("email", "name")).alias("who"), F.lit(0).alias("made"))
    who = made.union(have).where("who is not null").groupBy("run", "who").agg(F.max("made").alias("made"))
    people = who.groupBy("run").agg(F.sum("made").alias("creators"), F.count_if(F.col("made") == 0).alias("explorers"))
    out = summed.select("run", *[c for c in METRICS if c not in ("creators", "explorers")]).join(people, "run", "left").join(settings_summary(setting_rows), "run", "left").join(has_settings, "run", "left")
    named = out.withColumnRenamed("captured", "settings_captured").fillna(0, ["creators", "explorers", *SETTING_METRICS])
    return named.select("run", *METRICS, *SETTING_METRICS, F.coalesce("settings_captured", F.lit(False)).alias("settings_captured"))


def diff_totals(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, delta, changed, percent) of two runs' totals (one row each).

    Metrics of settings are left out unless both runs captured them. Percent has one decimal, is 0 from 0 to 0 and null
    from 0 to anything else.
    """
    long = lambda t, name: t.select("settings_captured", *[F.col(m).cast("double") for m in (*METRICS, *SETTING_METRICS)]).unpivot(["settings_captured"], [*METRICS, *SETTING_METRICS], "metric", name)
    both = long(before, "before").withColumnRenamed("settings_captured", "c0").join(long(after, "after").withColumnRenamed("settings_captured", "c1"), "metric")
    both = both.where(~F.col("metric").isin(*SETTING_METRICS) | (F.col("c0") & F.col("c1")))
    delta = F.col("after") - F.col("before")
    change = F.when((F.col("before") == 0) & (F.col("after") == 0), 0.0).when(F.col("before") != 0, half_up(delta / F.col("before") * 100, 1))
    return both.select("metric", "before", "after", delta.alias("delta"), (delta != 0).alias("changed"), change.alias("percent"))


def group_names(groups: Column) -> Column:
    """Sorted names of security groups, ids where a group has none."""
    return F.array_sort(F.transform(F.coalesce(groups, F.expr(f"cast(array() as {GROUPS})")), lambda g: F.coalesce(F.nullif(g["name"], F.lit("")), g["graphId"], F.lit(""))))


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def scope_key() -> Column:
    """Canonical text of a setting's scope: equal texts, equal scopes."""
    parts = [group_names(F.col("enabledSecurityGroups")).alias("in"), group_names(F.col("excludedSecurityGroups")).alias("out")]
    return F.to_json(F.struct(*parts, *[_flag(f"delegateTo{x}").alias(x.lower()) for x in ("Workspace", "Capacity", "Domain")]))


def scope_text() -> Column:
    """What a setting applies to, for readers."""
    inside, outside = group_names(F.col("enabledSecurityGroups")), group_names(F.col("excludedSecurityGroups"))
    to = F.array_compact(F.array(*[F.when(_flag(f"delegateTo{x}"), F.lit(x.lower())) for x in ("Workspace", "Capacity", "Domain")]))
    parts = F.array(
        F.when(F.size(inside) > 0, F.concat(F.lit("groups "), F.array_join(inside, ", "))).otherwise("everyone"),
        F.when(F.size(outside) > 0, F.concat(F.lit("without "), F.array_join(outside, ", "))),
        F.when(F.size(to) > 0, F.concat(F.lit("delegated: "), F.array_join(to, ", "))),
    )
    return F.array_join(F.array_compact(parts), "; ")


def _some(name: str) -> Column:
    return F.coalesce(F.size(F.col(name)) > 0, F.lit(False))


def settings_summary(rows: DataFrame) -> DataFrame:
    """Per run: settings, and how many are enabled, disabled, delegated and scoped to groups."""
    on = _flag("enabled")
    delegated = _flag("delegateToWorkspace") | _flag("delegateToCapacity") | _flag("delegateToDomain")
    scoped = _some("enabledSecurityGroups") | _some("excludedSecurityGroups")
    return rows.groupBy("run").agg(F.count("*").alias("settings"), F.count_if(on).alias("settings_enabled"), F.count_if(~on).alias("settings_disabled"), F.count_if(scoped).alias("settings_group_scoped"), F.count_if(delegated).alias("settings_delegated"))


def setting_groups(rows: DataFrame) -> DataFrame:
    """(run, name, total, enabled) of the groups of settings, largest first."""
    name = F.coalesce(F.nullif(F.col("tenantSettingGroup"), F.lit("")), F.lit("Ungrouped"))
    return rows.groupBy("run", name.alias("name")).agg(F.count("*").alias("total"), F.count_if(_flag("enabled")).alias("enabled")).orderBy(F.desc("total"), "name")


def settings_view(rows: DataFrame, has_settings: DataFrame, run: int) -> tuple[DataFrame, bool]:
    """A run's settings by group and title, and whether it captured any; not captured isn't the same as none."""
    known = has_settings.where((F.col("run") == run) & F.col("captured"))
    shown = rows.where(F.col("run") == run).orderBy(F.coalesce("tenantSettingGroup", F.lit("Ungrouped")), F.coalesce(F.nullif(F.col("title"), F.lit("")), "settingName", F.lit("")))
    return shown, not known.isEmpty()


def diff_settings(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, label, group, change, was, now) of settings that were added, removed, toggled or rescoped; one can be both of the last.

    Ask ``captured`` first: a run without captured settings must not be compared. Of a repeated name the last by title counts.
    """
    label = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("settingName"), F.lit("Unnamed setting"))
    group = F.coalesce(F.nullif(F.col("tenantSettingGroup"), F.lit("")), F.lit("Ungrouped"))
    one = F.struct(label.alias("label"), group.alias("group"), _flag("enabled").alias("on"), scope_key().alias("key"), scope_text().alias("scope"))
    last = lambda rows, name: rows.where("settingName <> ''").groupBy(F.col("settingName").alias("name")).agg(F.max_by(one, F.coalesce("title", F.lit(""))).alias(name))
    both = last(before, "b").join(last(after, "a"), "name", "full_outer")
    flag = lambda c: F.when(c, "on").otherwise("off")
    there = F.col("a").isNotNull() & F.col("b").isNotNull()
    event = lambda when, name, was, now: F.when(when, F.struct(F.lit(name).alias("change"), was.alias("was"), now.alias("now")))
    none = F.lit(None).cast("string")
    events = F.array_compact(
        F.array(
            event(F.col("b").isNull(), "added", none, flag(F.col("a.on"))),
            event(F.col("a").isNull(), "removed", flag(F.col("b.on")), none),
            event(there & (F.col("a.on") != F.col("b.on")), "toggled", flag(F.col("b.on")), flag(F.col("a.on"))),
            event(there & (F.col("a.key") != F.col("b.key")), "rescoped", F.col("b.scope"), F.col("a.scope")),
        )
    )
    named = both.select("name", F.coalesce("a.label", "b.label").alias("label"), F.coalesce("a.group", "b.group").alias("group"), F.explode(events).alias("e"))
    return named.select("name", "label", "group", "e.*")


def diff_users(before: DataFrame, after: DataFrame) -> DataFrame:
    """(ws, who, change, was, now) of grants added, removed or changed in workspaces that both runs have; who by email, else name, in any case."""
    who = F.lower(F.coalesce(F.nullif(F.col("email"), F.lit("")), F.col("name"), F.lit("")))
    side = lambda rows, name: rows.select("ws", who.alias("who"), F.coalesce("role", F.lit("")).alias("role")).where("who <> ''").groupBy("ws", "who").agg(F.max("role").alias(name))
    both = side(before, "was").join(side(after, "now"), ["ws", "who"], "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "role_changed")
    shared = before.select("ws").distinct().join(after.select("ws").distinct(), "ws")
    return both.withColumn("change", change).where("change is not null").join(shared, "ws", "left_semi").select("ws", "who", "change", "was", "now")


def diff_items(before: DataFrame, after: DataFrame) -> DataFrame:
    """(ws, item, change, name, type) of items added or removed, those of added and removed workspaces included."""
    side = lambda rows, name: rows.where("item is not null").groupBy("ws", "item").agg(F.min(F.struct(F.coalesce("name", F.lit("Unnamed")).alias("name"), F.coalesce("type", F.lit("-")).alias("type"))).alias(name))
    both = side(before, "b").join(side(after, "a"), ["ws", "item"], "full_outer").where("a is null or b is null")
    one = F.coalesce("a", "b")
    return both.select("ws", "item", F.when(F.col("b").isNull(), "added").otherwise("removed").alias("change"), one["name"].alias("name"), one["type"].alias("type"))


def diff_counts(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    """(ws, field, was, now, delta) of counts that differ in workspaces of both runs."""
    long = lambda rows, name: rows.select("ws", *[F.coalesce(F.col(f), F.lit(0)).cast("long").alias(f) for f in fields]).unpivot(["ws"], fields, "field", name)
    both = long(before, "was").join(long(after, "now"), ["ws", "field"]).where("was <> now")
    return both.select("ws", "field", "was", "now", (F.col("now") - F.col("was")).alias("delta"))


def capacity_moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """Workspaces whose capacity, sku or licence differs; missing ones show as ``-``."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    side = lambda rows, p: rows.select("ws", *[text(c).alias(f"{p}_{c}") for c in ("capacity_id", "sku", "licence")])
    both = side(before, "was").join(side(after, "now"), "ws")
    differ = (F.col("was_capacity_id") != F.col("now_capacity_id")) | (F.col("was_sku") != F.col("now_sku")) | (F.col("was_licence") != F.col("now_licence"))
    shown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-")).alias(c)
    return both.where(differ).select("ws", *[shown(f"{p}_{c}") for p in ("was", "now") for c in ("capacity_id", "sku", "licence")])


def overlay_deleted(rows: DataFrame, states: DataFrame) -> DataFrame:
    """``rows`` (ws, state) with later recorded deletions (ws, state, deleted_at, deleted_by) laid over."""
    known = states.select("ws", F.col("state").alias("__state"), "deleted_at", "deleted_by")
    both = rows.join(known, "ws", "left")
    return both.withColumn("state", F.coalesce("__state", "state")).drop("__state")


def check_states(asked: DataFrame, recorded: DataFrame, probed: DataFrame) -> DataFrame:
    """(ws, there, source): recorded deletions need no probe; the rest is what probing (ws, there) said, null if unknown."""
    gone = recorded.where(F.lower(F.coalesce("state", F.lit(""))) == "deleted").select("ws", F.lit(True).alias("__gone")).distinct()
    both = asked.select("ws").join(gone, "ws", "left").join(probed.select("ws", F.col("there").alias("__there")), "ws", "left")
    return both.select("ws", F.when(F.col("__gone"), False).otherwise(F.col("__there")).alias("there"), F.when(F.col("__gone"), "recorded").otherwise("probe").alias("source"))


def state_counts(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count_if("there").alias("active"), F.count_if(~F.col("there")).alias("deleted"), F.count_if(F.col("there").isNull()).alias("unknown"))


def mark_deleted(docs: Scans, ws: str, at: str) -> Scans:
    """The workspace marked as deleted in every run; its items and users stay, and so does an earlier mark."""
    w = F.col("w")
    hit = (w["id"] == ws) & (F.coalesce(w["state"], F.lit("")) != DELETED)
    marked = F.when(hit, w.withField("state", F.lit(DELETED)).withField("deletedAt", F.lit(at))).otherwise(w)
    return replace(docs, workspaces=docs.workspaces.withColumn("w", marked))


def item_storage(paths: DataFrame) -> DataFrame:
    """(ws, item, size, files) of the paths that carry a length."""
    sized = paths.where(F.col("length").isNotNull())
    return sized.groupBy("ws", "item").agg(F.sum(F.col("length").cast("long")).alias("size"), F.count("*").alias("files"))


def workspace_storage(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """(ws, size, files, with_data, unread) over the items of storing types, in any case; items without a row in ``sizes`` are unread."""
    rows = found.where(F.lower(F.coalesce("type", F.lit(""))).isin(*STORING)).select("ws", "item").join(sizes, ["ws", "item"], "left")
    return rows.groupBy("ws").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.count_if(F.col("size") > 0).alias("with_data"), F.count_if(F.col("size").isNull()).alias("unread"))


def storage_totals(ws: DataFrame) -> DataFrame:
    return ws.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("size"), F.coalesce(F.sum("files"), F.lit(0)).cast("long").alias("files"), F.count_if(F.col("size") > 0).alias("with_data"))


def storage_ranking(ws: DataFrame) -> DataFrame:
    """Workspaces with data, largest first, and their whole percent of it all."""
    total = F.broadcast(ws.agg(F.sum("size").alias("__all")))  # one row
    rows = ws.where("size > 0").crossJoin(total)
    return rows.select("ws", "size", "files", share(F.col("size"), F.col("__all")).alias("percent")).orderBy(F.desc("size"), "ws")


def recalculated(ws: DataFrame, one: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``ws`` with the newly read sizes of some workspaces, and the totals that follow."""
    after = upsert(ws, one, ["ws"])
    return after, storage_totals(after)


def pipeline_assignments(pipelines: DataFrame) -> DataFrame:
    """(ws, pipeline, pipeline_name, stage_order, stage) from ``pipelines`` (id, name, stages); ids in lower case, and of several stages the last pipeline's."""
    flat = pipelines.select("id", "name", F.explode("stages").alias("s")).where(F.col("s.workspaceId").isNotNull())
    rows = flat.select(F.lower("s.workspaceId").alias("ws"), F.col("id").alias("pipeline"), F.col("name").alias("pipeline_name"), F.col("s.order").alias("stage_order"))
    last = rows.groupBy("ws").agg(F.max(F.struct("pipeline", "stage_order", "pipeline_name")).alias("x"))
    return last.select("ws", "x.pipeline", "x.pipeline_name", "x.stage_order", stage_name(F.col("x.stage_order")).alias("stage"))


def with_pipeline(ws: DataFrame, assignments: DataFrame) -> DataFrame:
    a = assignments.select(F.col("ws").alias("__ws"), "pipeline_name", "stage")
    return ws.drop("pipeline_name", "stage").join(a, F.lower("ws") == F.col("__ws"), "left").drop("__ws")


def pipeline_access(pipelines: DataFrame, access: DataFrame, principal_id: str | None) -> DataFrame:
    """(id, name, workspaces, access, admins): granted, none, or unknown where the users of a pipeline (pipeline, users) couldn't be read.

    A principal has access if an app user has its identifier, in any case. Without a principal all is unknown.
    """
    u = F.col("users")
    has = F.exists(u, lambda x: (F.lower(x["identifier"]) == F.lit((principal_id or "").lower())) & (F.lower(F.coalesce(x["principalType"], F.lit(""))) == "app"))
    said = F.when(u.isNull() | F.lit(principal_id is None), "unknown").when(F.coalesce(has, F.lit(False)), "granted").otherwise("none")
    admins = F.size(F.filter(u, lambda x: F.lower(F.coalesce(x["accessRight"], F.lit(""))) == "admin"))
    n = F.size(F.filter("stages", lambda s: s["workspaceId"].isNotNull()))
    both = pipelines.join(access.select(F.col("pipeline").alias("id"), "users"), "id", "left")
    return both.select("id", "name", F.greatest(n, F.lit(0)).alias("workspaces"), said.alias("access"), F.when(u.isNull(), 0).otherwise(admins).alias("admins"))


def runs_by(runs: DataFrame, by: str) -> DataFrame:
    """Runs of each principal or tenant, newest first within; at most a page's worth is shown of each."""
    return runs.groupBy(by).agg(F.count("*").alias("runs"), F.max_by("run", F.struct("started", "run")).alias("newest"))


def lineage_edges(models: DataFrame, reports: DataFrame, dashboards: DataFrame, names: DataFrame) -> DataFrame:
    """Edges of a scan: dataflow to model, model to model, model to report, model to dashboard.

    ``models`` (ws, id, upstreamDataflows, upstreamDatasets), ``reports`` (ws, id, datasetId), ``dashboards`` (ws, id,
    tiles). An upstream item of another workspace keeps its id but has no workspace until ``names`` (item, name, ws)
    tells. A dashboard counts each model once; an end without a name is called by its id.
    """
    here = lambda group: F.when(F.coalesce(group, F.col("ws")) == F.col("ws"), F.col("ws"))
    flow = models.select("ws", "id", F.explode("upstreamDataflows").alias("u")).select(F.col("u.targetDataflowId").alias("source"), F.lit("Dataflow").alias("source_kind"), here(F.col("u.groupId")).alias("source_ws"), F.col("id").alias("target"), F.lit("SemanticModel").alias("target_kind"), F.col("ws").alias("target_ws"))
    up = models.select("ws", "id", F.explode("upstreamDatasets").alias("u")).select(F.col("u.datasetId"), F.lit("SemanticModel"), here(F.col("u.groupId")), "id", F.lit("SemanticModel"), "ws")
    rep = reports.where("datasetId is not null").select("datasetId", F.lit("SemanticModel"), "ws", "id", F.lit("Report"), "ws")
    dash = dashboards.select("ws", "id", F.explode("tiles").alias("t")).where("t.datasetId is not null").select(F.col("t.datasetId"), F.lit("SemanticModel"), "ws", "id", F.lit("Dashboard"), "ws").distinct()
    e = flow.union(up).union(rep).union(dash)
    for end in ("source", "target"):
        known = names.select(F.col("item").alias(end), F.col("name").alias(f"{end}_name"), F.col("ws").alias("__ws"))
        e = e.join(known, end, "left").withColumn(f"{end}_name", F.coalesce(f"{end}_name", end)).withColumn(f"{end}_ws", F.coalesce(f"{end}_ws", "__ws")).drop("__ws")
    return e.select(*[f"{end}{x}" for end in ("source", "target") for x in ("", "_kind", "_name", "_ws")])


# Sections of one item's details: each takes what was read for many items at once.


def metadata_section(found: DataFrame, ws: DataFrame) -> DataFrame:
    """(item, label, value): name, type, workspace, description and ids; ``-`` where there is none."""
    names = ws.select("ws", F.col("name").alias("__ws"))
    rows = found.join(names, "ws", "left")
    pairs = {"name": "name", "type": "type", "workspace": F.coalesce("__ws", "ws"), "description": "description", "item": "item", "workspace_id": "ws"}
    made = F.array(*[F.struct(F.lit(k).alias("label"), F.coalesce(F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit("-")).alias("value")) for k, c in pairs.items()])
    return rows.select("item", F.explode(made).alias("x")).select("item", "x.*")


def tile_section(tiles: DataFrame, names: DataFrame) -> DataFrame:
    """(item, title, report, model): ids give way to names, missing ones to ``-``."""
    for end in ("report", "model"):
        tiles = tiles.join(names.select(F.col("item").alias(end), F.col("name").alias(f"__{end}")), end, "left")
    text = lambda *c: F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in c], F.lit("-"))
    return tiles.select("item", text("title", "subtitle").alias("title"), text("__report", "report").alias("report"), text("__model", "model").alias("model"))


def refresh_section(refreshes: DataFrame, most: int = 10) -> DataFrame:
    """The newest ten refreshes of each item."""
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("started"), "status"))
    return refreshes.withColumn("place", place).where(F.col("place") <= most)


def table_section(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Tables, data sources or parameters as they are shown: ``-`` for what is missing, yes or no for flags."""
    kinds = dict(rows.dtypes)
    shown = [F.when(F.col(c), "Yes").otherwise("No").alias(c) if kinds[c] == "boolean" else F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("-")).alias(c) for c in columns]
    return rows.select("item", *shown)


def schema_section(shaped: DataFrame) -> DataFrame:
    """(item, name, kind, columns): the endpoint's tables with how many columns each has, from ``sources.shape_schema`` per item."""
    return shaped.select("item", "name", "kind", F.size("fields").alias("columns")).orderBy("item", "name")


def sections(found: DataFrame, loaded: dict[str, DataFrame]) -> DataFrame:
    """(item, section, rows, warning): how many rows each section of an item has; a section that failed (item, error) is a warning."""
    parts = None
    for name, df in loaded.items():
        if "error" in df.columns:
            one = df.select("item", F.lit(name).alias("section"), F.lit(0).cast("long").alias("rows"), "error")
        else:
            one = df.groupBy("item").agg(F.count("*").alias("rows")).select("item", F.lit(name).alias("section"), "rows", F.lit(None).cast("string").alias("error"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.join(found.select("item").distinct(), "item", "left_semi").select("item", "section", "rows", F.col("error").alias("warning"))


def detailed(found: DataFrame, most: int = 2000) -> DataFrame:
    """The items whose details are collected: the first ``most`` by workspace and id."""
    return found.orderBy("ws", "item").limit(most)


def stored_datasets(sources: DataFrame, cache: DataFrame) -> DataFrame:
    """(source, name, kind, fields) of the datasets of ``sources`` (source, ws, item, schema_json).

    The stored schema counts; where it is missing, broken or empty, the tables of the item's cached details (ws, item,
    payload) do.
    """
    field = "array<struct<name:string,dataType:string,nullable:boolean>>"
    stored = F.from_json("schema_json", f"array<struct<name:string,kind:string,fields:{field}>>")
    details = "struct<sections:array<struct<key:string,groups:array<struct<label:string,badges:array<struct<text:string>>,rows:array<array<string>>>>>>>"
    both = sources.withColumn("own", stored).join(cache.select("ws", "item", F.from_json("payload", details).alias("details")), ["ws", "item"], "left")
    section = F.get(F.filter("details.sections", lambda s: s["key"] == "sqlendpoint"), F.lit(0))
    row = lambda r: F.struct(F.get(r, F.lit(0)).alias("name"), F.get(r, F.lit(1)).alias("dataType"), (F.get(r, F.lit(2)) == "Yes").alias("nullable"))
    cached = F.transform(section["groups"], lambda g: F.struct(g["label"].alias("name"), F.coalesce(F.get(g["badges"], F.lit(0))["text"], F.lit("Table")).alias("kind"), F.transform(g["rows"], row).alias("fields")))
    chosen = F.when(F.size("own") > 0, F.col("own")).otherwise(cached)
    return both.select("source", F.explode(chosen).alias("d")).select("source", "d.*")
