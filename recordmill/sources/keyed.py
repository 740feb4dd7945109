"""Tables that are changed by key: copy-on-write by hash buckets, made visible by numbered manifests.

Rows lie in buckets by a hash of some key columns. A change reads and writes only the buckets that hold keys it names;
the files of all others stay as they are. New files become visible by one manifest that says where each bucket lies, and
a manifest is created under a number that must not exist yet, so a reader sees the table before or after a change, a
change that dies leaves the table as it was, and of two changes at a time one fails (``Conflict``) and can be run again.

The driver holds the manifest: a path for each bucket, never rows. Choose ``buckets`` so that one fits a task; a bucket is
one file of each change that touches it.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another change took the number of this one."""


@dataclass(frozen=True)
class Step:
    """A numbered change of a table's schema: ``schema`` is what holds after it, ``apply`` makes it of rows before it.

    ``apply`` may add, drop or rename columns and fill them from the row's others, but not change keys.
    """

    number: int
    name: str
    schema: str
    apply: Callable[[DataFrame], DataFrame]


class KeyedTable:
    """A table at ``path``. ``by`` are the key columns whose hash chooses the bucket, all of ``keys`` unless given.

    ``schema`` is what the table began with, ``steps`` what it went through since, by ascending number. A manifest says
    of each bucket after which step it was written; rows are brought forward as they are read, and a bucket is written in
    the newest form when it is changed next. So a step costs nothing when it is declared, and old and new files read alike.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = 64, by: list[str] | None = None, steps: tuple[Step, ...] = ()):
        self.spark, self.path, self.keys, self.by, self.buckets, self.steps = spark, path.rstrip("/"), keys, by or keys, buckets, steps
        if [s.number for s in steps] != sorted({s.number for s in steps}) or any(s.number < 1 for s in steps):
            raise ValueError("steps need ascending numbers from 1")
        self.schemas = {0: StructType.fromDDL(schema)} | {s.number: StructType.fromDDL(s.schema) for s in steps}
        self.newest = max(self.schemas)
        self.schema = self.schemas[self.newest]
        where = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = where.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._at("manifest")):
            return []
        return sorted(int(f.getPath().getName().split(".")[0]) for f in self._fs.listStatus(self._at("manifest")) if f.getPath().getName().endswith(".json"))

    def _load(self, number: int) -> dict | None:
        """A manifest; None for one whose writer died over it."""
        stream = self._fs.open(self._at(f"manifest/{number:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        except ValueError:
            return None
        finally:
            stream.close()

    def manifest(self, fits: Callable[[dict], bool] = lambda m: True) -> dict:
        """The newest whole manifest that ``fits``; an empty one before the first."""
        for number in reversed(self._numbers()):
            found = self._load(number)
            if found is not None and fits(found):
                return found
        return {"version": 0, "buckets": {}, "steps": {}, "tags": {}}

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("__bucket", F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.by]), F.lit(self.buckets)).cast("int"))

    def read(self, manifest: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a manifest, the newest unless given, in the newest form."""
        manifest = manifest or self.manifest()
        by_step: dict[int, list[str]] = {}
        for b, p in manifest["buckets"].items():
            if buckets is None or int(b) in buckets:
                by_step.setdefault(manifest.get("steps", {}).get(b, 0), []).append(f"{self.path}/{p}")
        if unknown := set(by_step) - set(self.schemas):
            raise ValueError(f"written after steps {sorted(unknown)}, which aren't declared here")
        out = None
        for step, paths in sorted(by_step.items()):
            rows = self.spark.read.schema(self.schemas[step]).parquet(*paths)
            for later in self.steps:
                if later.number > step:
                    rows = later.apply(rows).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schemas[later.number]])
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], self.schema) if out is None else out

    def applied(self) -> list[tuple[int, int]]:
        """(step, buckets) of how many buckets were written after which step."""
        now = self.manifest()
        return sorted(Counter(now.get("steps", {}).get(b, 0) for b in now["buckets"]).items())

    def migrate(self) -> int:
        """Write the buckets that are older than the newest step in its form; says how many. Run again it does nothing."""
        now = self.manifest()
        old = [int(b) for b in now["buckets"] if now.get("steps", {}).get(b, 0) != self.newest]
        if old:
            self._put(now, self.read(now, old), old, None)
        return len(old)

    def find(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys; only their buckets are read."""
        return self.read(buckets=self._touched(self.bucketed(keys.select(*self.keys)))).join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select("__bucket").distinct().collect()]  # no more than there are buckets

    def merge(self, rows: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], tag: tuple[str, int] | None = None) -> dict:
        """Replace the buckets that ``rows`` have keys in by ``how(old rows of these buckets, rows)``; says the new manifest.

        With a ``tag`` (name, number) the change counts once: it is skipped if that name has this number or a later one
        already, as when a stream's batch runs again. ``how`` must keep each row in its bucket.
        """
        now = self.manifest()
        if tag and now["tags"].get(tag[0], -1) >= tag[1]:
            return now
        touched = self._touched(self.bucketed(rows))
        return self._put(now, how(self.read(now, touched), rows) if touched else None, touched, tag)

    def _put(self, now: dict, rows: DataFrame | None, touched: list[int], tag: tuple[str, int] | None) -> dict:
        kept = {b: p for b, p in now["buckets"].items() if int(b) not in touched}
        steps = {b: n for b, n in now.get("steps", {}).items() if b in kept}
        if rows is not None:
            folder = f"data/{uuid.uuid4().hex}"
            new = self.bucketed(rows.select(*self.schema.names))
            new.repartition(min(len(touched), self.buckets), "__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
            for f in self._fs.listStatus(self._at(folder)):
                name = f.getPath().getName()
                if name.startswith("__bucket="):
                    bucket = name.split("=")[1]
                    kept[bucket], steps[bucket] = f"{folder}/{name}", self.newest
        return self._commit(now, kept, steps, tag)

    def _commit(self, now: dict, buckets: dict, steps: dict, tag: tuple[str, int] | None) -> dict:
        number = max([now["version"], *self._numbers()[-1:]]) + 1
        newest = self.manifest()["version"]
        if newest != now["version"]:
            raise Conflict(f"version {newest} appeared after {now['version']} was read")
        made = {"version": number, "buckets": buckets, "steps": steps, "tags": now["tags"] | dict([tag] if tag else [])}
        try:
            out = self._fs.create(self._at(f"manifest/{number:010d}.json"), False)
        except Exception as e:
            raise Conflict(f"version {number} exists") from e
        out.writeBytes(json.dumps(made))
        out.close()
        return made

    def upsert(self, rows: DataFrame, tag: tuple[str, int] | None = None) -> dict:
        """Put ``rows`` in place of those of the same keys, one for each key."""

        def how(old: DataFrame, new: DataFrame) -> DataFrame:
            return old.join(new.select(*self.keys), self.keys, "left_anti").unionByName(new.dropDuplicates(self.keys), allowMissingColumns=True)

        return self.merge(rows, how, tag)

    def delete(self, keys: DataFrame) -> dict:
        return self.merge(keys.select(*self.keys), lambda old, gone: old.join(gone, self.keys, "left_anti"))

    def vacuum(self, keep: int = 2) -> int:
        """Remove manifests but the newest ``keep`` and the data that no manifest left names; says how many folders went."""
        numbers = self._numbers()
        for n in numbers[:-keep]:
            self._fs.delete(self._at(f"manifest/{n:010d}.json"), False)
        named = {p.split("/")[1] + "/" + p.split("/")[2] for n in numbers[-keep:] for p in ((self._load(n) or {}).get("buckets") or {}).values()}
        gone = 0
        for folder in self._fs.listStatus(self._at("data")) if self._fs.exists(self._at("data")) else []:
            for f in self._fs.listStatus(folder.getPath()):
                name = f.getPath().getName()
                if f"{folder.getPath().getName()}/{name}" not in named:
                    self._fs.delete(f.getPath(), True)
                    gone += name.startswith("__bucket=")
        return gone
