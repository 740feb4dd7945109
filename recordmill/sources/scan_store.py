"""Stored scans of an estate: one JSON row for each run and workspace, settings apart, each changed by key.

A scan arrives workspace by workspace and is read the same way, so no row, task or group holds a whole run. Documents of
older runs, which hold all in one text, are cut up once by ``shredded``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.operators import scan

from .keyed import KeyedTable


def shredded(runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(run, ws, doc), (run, setting, doc) and (run, captured) from ``runs`` (run, results: one JSON text for a whole run).

    Elements stay JSON text: they are cut out, not built anew. A broken text has no workspaces and no settings.
    """
    cut = runs.select("run", F.from_json("results", "struct<workspaces:array<string>,tenantSettings:array<string>>").alias("x"))
    ws = cut.select("run", F.explode("x.workspaces").alias("doc")).select("run", F.get_json_object("doc", "$.id").alias("ws"), "doc")
    settings = cut.select("run", F.explode("x.tenantSettings").alias("doc")).select("run", F.get_json_object("doc", "$.settingName").alias("setting"), "doc")
    return ws, settings, cut.select("run", F.col("x.tenantSettings").isNotNull().alias("captured"))


class ScanStore:
    """Scans at ``path``; a workspace's documents of all runs share a bucket."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.workspaces = KeyedTable(spark, f"{path}/workspaces", ["run", "ws"], "run int, ws string, doc string, deleted_at string", buckets, ["ws"])
        self.settings = KeyedTable(spark, f"{path}/settings", ["run", "setting"], "run int, setting string, doc string", buckets)
        self.runs = KeyedTable(spark, f"{path}/runs", ["run"], "run int, captured boolean", 1)

    def save(self, workspaces: DataFrame, settings: DataFrame, runs: DataFrame) -> None:
        """Store documents in place of those of the same keys; a run counts as stored when its row in ``runs`` is."""
        self.workspaces.upsert(workspaces if "deleted_at" in workspaces.columns else workspaces.withColumn("deleted_at", F.lit(None).cast("string")))
        self.settings.upsert(settings)
        self.runs.upsert(runs)

    def load(self, run: int | None = None) -> scan.Scans:
        pick = lambda t: t.read() if run is None else t.read().where(F.col("run") == run)
        return scan.parsed(pick(self.workspaces), pick(self.settings), pick(self.runs))

    def mark_deleted(self, ws: str, at: str) -> dict:
        """Mark a workspace as deleted in every run, unless its document says so; only its bucket is written.

        The mark lies beside the document, which stays as it was stored.
        """
        mine = (F.col("ws") == ws) & F.col("deleted_at").isNull() & (F.coalesce(F.get_json_object("doc", "$.state"), F.lit("")) != scan.DELETED)
        hit = self.workspaces.spark.createDataFrame([(ws,)], "ws string")
        return self.workspaces.merge(hit, lambda old, _: old.withColumn("deleted_at", F.when(mine, F.lit(at)).otherwise(F.col("deleted_at"))))
