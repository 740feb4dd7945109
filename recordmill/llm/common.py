"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Whole texts go to Python in batches of so many rows; the default of 10,000 rows takes hundreds of MB in each worker.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def fresh(taken: list[str], *wanted: str) -> list[str]:
    """The wanted column names, with underscores behind them where ``taken`` has such a name."""
    names, out = {n.lower() for n in taken}, []
    for w in wanted:
        while w.lower() in names:
            w += "_"
        out.append(w)
    return out


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is configured (local tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="recordmill-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return f"file://{_OWN[0]}"


_STAGED: list[str] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage and survives lost executors.

    The table stays until ``discard`` or ``clean`` removes it.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/recordmill/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return adopt(spark.read.schema(df.schema).parquet(path), path)


def adopt(read: DataFrame, path: str) -> DataFrame:
    """``read``, known as a staged table at ``path``, so that ``discard`` and ``clean`` find it."""
    _STAGED.append(path)
    read.staged_at = path
    return read


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _STAGED.remove(path)


def discard(*tables: DataFrame) -> None:
    """Remove staged tables whose dependants are all staged themselves."""
    for t in tables:
        if getattr(t, "staged_at", None) in _STAGED:
            _remove(t.sparkSession, t.staged_at)


def known() -> frozenset[str]:
    """The paths of the tables that this driver has staged and not removed."""
    return frozenset(_STAGED)


def clean(spark: SparkSession, but: frozenset[str] = frozenset()) -> int:
    """Remove every table that this driver has staged, other than those of ``but``, once the results that read them are
    written; says how many."""
    gone = [path for path in _STAGED if path not in but]
    for path in gone:
        _remove(spark, path)
    return len(gone)


def fold(column: str, modulus: int):
    """crc32 of an id written as text, modulo ``modulus``; a null id counts as empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus
