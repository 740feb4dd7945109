"""Landing of paged services: pages are followed on the driver, tried again where that helps, and stored for Spark to read."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# HTTP codes that are tried again, attempts, and the usual longest wait in seconds.
RETRIED = (408, 429, 500, 502, 503, 504)
ATTEMPTS, LONGEST = 3, 60.0


class HttpError(Exception):
    def __init__(self, status: int, retry_after: int | None = None):
        super().__init__(f"status {status}")
        self.status, self.retry_after = status, retry_after


def wait(error: HttpError, attempt: int) -> float | None:
    """Seconds before another attempt (the first is 0), or None: what the service asks for up to a bound, else 1, 2, 4 and so on up to 10."""
    if error.status not in RETRIED:
        return None
    if error.retry_after and error.retry_after > 0:
        return min(float(error.retry_after), LONGEST)
    return min(2.0**attempt, 10.0)


def retried(call: Callable[[], dict], report: Callable[[str, int | None], None] = lambda kind, status: None, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The call's result; reports request, retry, throttled or failure as it goes."""
    for attempt in range(ATTEMPTS):
        try:
            out = call()
            report("request", None)
            return out
        except HttpError as e:
            pause = wait(e, attempt)
            if pause is None or attempt == ATTEMPTS - 1:
                report("failure", e.status)
                raise
            report("throttled" if e.status == 429 else "retry", e.status)
            sleep(pause)
    raise AssertionError("unreachable")


def pages(get: Callable[[str, dict], dict], url: str, params: dict | None = None) -> Iterator[list]:
    """Each page's rows. A page may name the next one by a whole address or by a token for the same address."""
    at, asked = url, dict(params or {})
    while at:
        page = get(at, asked)
        yield page.get("itemEntities") or page.get("value") or []
        if page.get("continuationUri"):
            at, asked = page["continuationUri"], {}
        elif page.get("continuationToken"):
            asked = {**(params or {}), "continuationToken": page["continuationToken"]}
        else:
            at = None


def offset_pages(get: Callable[[str, dict], dict], url: str, size: int = 100, most: int = 50, report: Callable[[str, int], None] = lambda kind, rows: None) -> Iterator[list]:
    """Pages by offset, up to a short one; the service's limit on requests bounds their number, and ``report`` hears of a listing that it cut."""
    for k in range(most + 1):
        rows = get(url, {"$top": size, "$skip": k * size}).get("value") or []
        yield rows
        if len(rows) < size:
            return
    report("cut", (most + 1) * size)


def land(spark: SparkSession, found: Iterator[list], folder: str) -> int:
    """Store pages as JSON lines in a folder that executors can read, one page in memory at a time; says how many rows there were."""
    total = 0
    for rows in found:
        if rows:
            spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").coalesce(1).write.mode("append").text(folder)
        total += len(rows)
    return total


BROKEN = "_broken"


def landed(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """What was landed, with a stated schema, so that nothing is read to find one; and the lines (line) that don't fit it."""
    rows = spark.read.text(folder).select("value", F.from_json("value", f"{schema}, {BROKEN} string", {"columnNameOfCorruptRecord": BROKEN}).alias("r"))
    whole = F.col("r").isNotNull() & F.col(f"r.{BROKEN}").isNull()
    return rows.where(whole).select("r.*").drop(BROKEN), rows.where(~whole & (F.trim("value") != "")).select(F.col("value").alias("line"))
