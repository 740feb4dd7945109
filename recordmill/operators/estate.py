"""Estate analytics: item families, licences, triage, access, and differences between two snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordmill.functions.convert import COLLATION, share
from recordmill.operators.cluster import sequenced

# Item types that only run on a dedicated capacity.
CAPACITY_ONLY = ("lakehouse", "warehouse", "notebook", "datapipeline", "kqldatabase", "kqlqueryset", "eventstream", "eventhouse", "sparkjobdefinition", "environment", "sqldatabase", "dataflowgen2", "mlmodel", "mlexperiment")
# Finding and weight.
WEIGHTS = {"ownerless": 100, "orphanedAdmin": 80, "singleAdmin": 50, "staleContent": 40, "orphanedContent": 35, "capacityRisk": 30, "overShared": 20, "emptyWorkspace": 15}
# Capacity sizes that run everything, and the id that means no capacity.
FULL_SKUS = ("F2", "F4", "F8", "F16", "F32", "F64", "F128", "F256", "F512", "F1024", "F2048", "FT1")
NO_CAPACITY = "00000000-0000-0000-0000-000000000000"


def family(kind: Column) -> Column:
    """The first family that an item's type belongs to."""
    k = F.lower(F.coalesce(kind, F.lit("")))
    return (
        F.when(k.isin("report", "paginatedreport"), "report")
        .when(k.isin("semanticmodel", "dataset"), "model")
        .when(k == "dashboard", "dashboard")
        .when(k.contains("dataflow") | (k == "datagen2"), "dataflow")
        .when(k.isin("lakehouse", "notebook"), k)
        .when(k == "datapipeline", "pipeline")
        .when(k.isin("warehouse", "sqldatabase"), "warehouse")
        .otherwise("other")
    )


def licence(sku: Column) -> Column:
    s = F.upper(F.coalesce(sku, F.lit("")))
    premium = s.startswith("P") | s.startswith("EM") | s.startswith("A")
    return F.when(s.startswith("F") & (s != "FREE"), "Fabric").when(s == "PPU", "Premium Per User").when(premium, "Premium").otherwise("Pro")


def has_full_capacity(capacities: DataFrame) -> DataFrame:
    return capacities.agg(F.coalesce(F.bool_or(F.col("sku").isin(*FULL_SKUS)), F.lit(False)).alias("has_full"))


def principal(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def orphaned_items(items: DataFrame, users: DataFrame) -> DataFrame:
    """Items whose creator holds no access anywhere; none where no principal is known at all."""
    known = users.select(principal(F.col("email")).alias("__who")).union(users.select(principal(F.col("name")))).where("__who is not null").distinct()
    made = items.withColumn("__who", principal(F.col("creator"))).where("__who is not null")
    return made.join(known, "__who", "left_anti").join(F.broadcast(known.limit(1)).select(F.lit(1)), F.lit(True), "left_semi").drop("__who")  # one row


def triage(workspaces: DataFrame, items: DataFrame, users: DataFrame, scanned: Column, stale_days: int = 90, over_shared: int = 50) -> DataFrame:
    """(ws, findings, score) of ``workspaces`` (ws, capacity_id), ``items`` (ws, type, updated, creator) and ``users`` (ws, email, name, role, kind).

    Access findings need users; the first of ownerless, only non-person admins and a single person counts. Findings
    come heaviest first; the score is the sum of their weights.
    """
    admin = F.lower(F.coalesce("role", F.lit(""))) == "admin"
    person = F.lower(F.coalesce("kind", F.lit("user"))).isin("user", "")
    u = users.groupBy("ws").agg(F.count("*").alias("users"), F.count_if(admin).alias("admins"), F.count_if(admin & person).alias("people"))
    i = items.groupBy("ws").agg(F.count("*").alias("items"), F.max("updated").alias("latest"), F.count_if(F.lower("type").isin(*CAPACITY_ONLY)).alias("bound"))
    o = orphaned_items(items, users).groupBy("ws").agg(F.count("*").alias("orphans"))
    all_ = workspaces.select("ws", "capacity_id").join(u, "ws", "left").join(i, "ws", "left").join(o, "ws", "left").fillna(0, ["users", "admins", "people", "items", "bound", "orphans"])
    some, n = F.col("users") > 0, F.col
    age = F.floor((F.unix_timestamp(scanned) - F.unix_timestamp("latest")) / 86400)
    holds = {
        "ownerless": some & (n("admins") == 0),
        "orphanedAdmin": some & (n("admins") > 0) & (n("people") == 0),
        "singleAdmin": some & (n("people") == 1),
        "staleContent": (n("items") > 0) & F.coalesce(age >= stale_days, F.lit(False)),
        "orphanedContent": n("orphans") > 0,
        "capacityRisk": (n("bound") > 0) & F.coalesce("capacity_id", F.lit("")).isin("", NO_CAPACITY),
        "overShared": some & (n("users") >= over_shared),
        "emptyWorkspace": some & (n("items") == 0),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in holds.items()]))
    score = sum((F.when(c, WEIGHTS[k]).otherwise(0) for k, c in holds.items()), F.lit(0))
    return all_.select("ws", found.alias("findings"), score.alias("score"))


#: Names that a finding's details show at most; how many there are in all is a count.
NAMES = 20


def _sample(rows: DataFrame, order: list[Column], name: str, most: int) -> DataFrame:
    """(ws, ``name``): the first ``most`` values of ``rows`` (ws, value) of each workspace, in order."""
    placed = rows.withColumn("__place", F.row_number().over(W.partitionBy("ws").orderBy(*order))).where(F.col("__place") <= most)
    return placed.groupBy("ws").agg(F.transform(F.sort_array(F.collect_list(F.struct("__place", "value"))), lambda x: x["value"]).alias(name))


def triage_details(triaged: DataFrame, workspaces: DataFrame, items: DataFrame, users: DataFrame, scanned: Column) -> DataFrame:
    """(ws, finding, weight, count, days, since, names, more) of each finding of ``triage``, for readers.

    ``names`` holds the admins of singleAdmin and orphanedAdmin (email, else name, in order) and the three creators with
    most items of orphanedContent, as ``name (items)``; ``more`` says whether there are others. ``count`` is the users of
    overShared and emptyWorkspace, the items of capacityRisk and orphanedContent. ``days`` and ``since`` are the age and
    date of staleContent's newest item.
    """
    who = F.coalesce(F.nullif(F.col("email"), F.lit("")), F.nullif(F.col("name"), F.lit("")), F.lit("Unknown"))
    admins = users.where(F.lower(F.coalesce("role", F.lit(""))) == "admin").select("ws", who.alias("value"), F.lower(F.coalesce("kind", F.lit("user"))).isin("user", "").alias("person"))
    named = admins.groupBy("ws").agg(F.count("*").alias("admins"))
    shown = _sample(admins, [F.desc("person"), F.asc("value")], "admin_names", NAMES)
    by = orphaned_items(items, users).groupBy("ws", F.col("creator").alias("value")).agg(F.count("*").alias("n"))
    made = by.groupBy("ws").agg(F.sum("n").alias("orphans"), F.count("*").alias("creators"))
    top = _sample(by.select("ws", F.format_string("%s (%d)", "value", "n").alias("value"), "n"), [F.desc("n"), F.asc("value")], "creator_names", 3)
    u = users.groupBy("ws").agg(F.count("*").alias("users"))
    i = items.groupBy("ws").agg(F.max("updated").alias("latest"), F.count_if(F.lower("type").isin(*CAPACITY_ONLY)).alias("bound"))
    all_ = triaged.select("ws", F.explode("findings").alias("finding"))
    for part in (named, shown, made, top, u, i):
        all_ = all_.join(part, "ws", "left")
    is_ = lambda *keys: F.col("finding").isin(*keys)
    weight = F.create_map(*[x for k, w in WEIGHTS.items() for x in (F.lit(k), F.lit(w))])[F.col("finding")]
    count = F.when(is_("overShared", "emptyWorkspace"), F.col("users")).when(is_("capacityRisk"), F.col("bound")).when(is_("orphanedContent"), F.col("orphans"))
    age = F.floor((F.unix_timestamp(scanned) - F.unix_timestamp("latest")) / 86400)
    names = F.when(is_("orphanedContent"), F.col("creator_names")).when(is_("singleAdmin"), F.slice("admin_names", 1, 1)).when(is_("orphanedAdmin"), F.col("admin_names"))
    more = F.when(is_("orphanedContent"), F.col("creators") > 3).when(is_("orphanedAdmin"), F.col("admins") > NAMES).otherwise(F.lit(False))
    stale = is_("staleContent")
    return all_.select("ws", "finding", weight.alias("weight"), count.alias("count"), F.when(stale, age).alias("days"), F.when(stale, F.to_date("latest")).alias("since"), names.alias("names"), more.alias("more"))


def worklist(triaged: DataFrame, workspaces: DataFrame, items: DataFrame) -> DataFrame:
    """``triaged`` with name, items and ``place``: highest score first, then most items, then name as people sort it, then id."""
    n = items.groupBy("ws").agg(F.count("*").alias("items"))
    named = triaged.join(workspaces.select("ws", F.coalesce("name", F.lit("Unnamed")).alias("name")), "ws", "left").join(n, "ws", "left").fillna(0, ["items"])
    return sequenced(named, [F.desc("score"), F.desc("items"), F.collate("name", COLLATION).asc(), F.asc("ws")], "place")


def finding_counts(triaged: DataFrame) -> DataFrame:
    """Workspaces per finding, those without any included."""
    defs = triaged.sparkSession.createDataFrame(list(WEIGHTS.items()), "finding string, weight int")
    counts = triaged.select(F.explode("findings").alias("finding")).groupBy("finding").agg(F.count("*").alias("total"))
    return defs.join(counts, "finding", "left").select("finding", "weight", F.coalesce("total", F.lit(0)).alias("total"))


def access_overview(grants: DataFrame, items: DataFrame) -> DataFrame:
    """Per principal its distinct grants (ws, role) and the items it created."""
    g = grants.select(principal(F.col("principal")).alias("principal"), "ws", "role").distinct().groupBy("principal").agg(F.count("*").alias("grants"), F.count_distinct("ws").alias("workspaces"))
    i = items.groupBy(principal(F.col("creator")).alias("principal")).agg(F.count("*").alias("created"))
    return g.join(i, "principal", "full_outer").where("principal is not null").fillna(0, ["grants", "workspaces", "created"])


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change, fields): added, removed, changed (with the names of what differs) or same; null and '' are alike."""
    b = before.select(F.col(key), F.struct(*fields).alias("__b"))
    a = after.select(F.col(key), F.struct(*fields).alias("__a"))
    text = lambda side, f: F.coalesce(F.col(f"{side}.{f}").cast("string"), F.lit(""))
    both = F.col("__b").isNotNull() & F.col("__a").isNotNull()
    differ = F.array_compact(F.array(*[F.when(both & (text("__b", f) != text("__a", f)), F.lit(f)) for f in fields]))
    change = F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "removed").when(F.size(differ) > 0, "changed").otherwise("same")
    return b.join(a, key, "full_outer").select(key, change.alias("change"), differ.alias("fields"))


def percent_change(before: Column, after: Column) -> Column:
    """With one decimal; 0 if both are 0, null if only ``before`` is."""
    return F.when((before == 0) & (after == 0), 0.0).when(before != 0, F.floor((after - before) / before * 1000 + 0.5) / 10)


def metric_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, delta, percent) of two one-row frames of equal numeric columns."""
    long = lambda df, name: df.select([F.col(c).cast("double") for c in df.columns]).unpivot([], df.columns, "metric", name)
    both = long(before, "before").join(long(after, "after"), "metric")
    return both.select("*", (F.col("after") - F.col("before")).alias("delta"), percent_change(F.col("before"), F.col("after")).alias("percent"))


def lineage(models: DataFrame, upstream: DataFrame, reports: DataFrame, tiles: DataFrame, index: DataFrame) -> DataFrame:
    """Named edges: upstream (id, source, source_kind) to model, model to report (id, model), model to dashboard (id, model).

    A dashboard counts each model once. ``index`` (id, kind, name) names both ends; an unknown end is called by its id.
    """
    e = upstream.join(models.select("id"), "id", "left_semi").select("source", "source_kind", F.col("id").alias("target"), F.lit("model").alias("target_kind"))
    for rows, kind in ((reports.select("id", "model"), "report"), (tiles.select("id", "model").distinct(), "dashboard")):
        e = e.union(rows.where("model is not null").select("model", F.lit("model"), "id", F.lit(kind)))
    for end in ("source", "target"):
        names = index.select(F.col("id").alias(end), F.col("kind").alias(f"{end}_kind"), F.col("name").alias(f"{end}_name"))
        e = e.join(names, [end, f"{end}_kind"], "left").withColumn(f"{end}_name", F.coalesce(f"{end}_name", end))
    return e.select("source", "source_kind", "source_name", "target", "target_kind", "target_name")


def folder_sizes(paths: DataFrame) -> DataFrame:
    """(area, folder, files, size) of ``paths`` (path, is_directory, length): the first segment, and the first two.

    A directory makes its folder known but adds neither file nor size.
    """
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    file = ~F.coalesce(F.col("is_directory"), F.lit(False))
    rows = paths.select(F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("area"), F.concat_ws("/", F.slice(parts, 1, 2)).alias("folder"), file.alias("file"), F.when(file, F.coalesce(F.col("length").cast("long"), F.lit(0))).alias("size"))
    return rows.groupBy("area", "folder").agg(F.count_if("file").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))


def area_groups(folders: DataFrame) -> DataFrame:
    """(area, folders, files, size, largest) over the folders of each area."""
    area = F.coalesce(F.nullif(F.col("area"), F.lit("")), F.lit("Other"))
    return folders.groupBy(area.alias("area")).agg(F.count("*").alias("folders"), F.sum("files").cast("long").alias("files"), F.sum("size").cast("long").alias("size"), F.max("size").cast("long").alias("largest"))


def by_size(folders: DataFrame) -> DataFrame:
    """Largest folders first, then by name."""
    return folders.orderBy(F.desc("size"), "folder")


def top_creators(items: DataFrame, most: int = 3) -> DataFrame:
    """(ws, creator, items, rank) of the creators with most items in each workspace."""
    counts = items.groupBy("ws", "creator").agg(F.count("*").alias("items"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy("ws").orderBy(F.desc("items"), "creator"))).where(F.col("rank") <= most)


def shares(rows: DataFrame, by: str) -> DataFrame:
    """(``by``, total, percent): whole percent of all rows; the total is one row that goes to each task."""
    counts = rows.groupBy(by).agg(F.count("*").alias("total"))
    whole = F.broadcast(counts.agg(F.sum("total").alias("__all")))
    return counts.crossJoin(whole).select(by, "total", share(F.col("total"), F.col("__all")).alias("percent"))


def distinct_texts(*columns: DataFrame) -> DataFrame:
    """Distinct texts that aren't blank from the first columns of several tables, as for a list of owners."""
    out = None
    for c in columns:
        one = c.toDF("value")
        out = one if out is None else out.union(one)
    return out.where(F.trim("value") != "").distinct()
