"""Rate windows, heartbeats, attempts, event buffers, counters and the exception ledger, on tables and on streams.

Operators that keep state of their own come in two forms: a scan of a table that is sorted by key and time, whose state
is one key's, and a state kept by the stream for each key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recordmill.operators import exceptions
from recordmill.operators.cluster import cut
from recordmill.operators.timing import TERMINAL
from recordmill.sources.keyed import KeyedTable


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    return events.withWatermark(ts, late) if events.isStreaming else events


def hits(events: DataFrame, key: str, ts: str, seconds: int = 60, limit: int = 120, late: str = "240 minutes") -> DataFrame:
    """Hits per key in windows of ``seconds``, aligned to the clock, and whether they exceed ``limit``."""
    counts = _timed(events, ts, late).groupBy(F.window(ts, f"{seconds} seconds").alias("w"), key).agg(F.count("*").alias("hits"))
    return counts.select(key, F.col("w.start").alias("start"), "hits", (F.col("hits") > limit).alias("limited"))


def windows_of(times: list[int], start: int | None, count: int, size: int) -> tuple[list[tuple[int, int]], int | None, int]:
    """Windows that are over, and the open one's start and hits, after hits at ``times`` (milliseconds, ascending).

    A window begins with the first hit after the one before is over.
    """
    over = []
    for t in times:
        if start is None or t >= start + size:
            if start is not None:
                over.append((start, count))
            start, count = t, 0
        count += 1
    return over, start, count


#: Hits of a key that one task walks through; a key with more is spread by pointer jumping.
HOT_HITS = 1_000_000


def first_hit_windows(events: DataFrame, key: str, ts: str, seconds: int = 60, limit: int = 120, hot: int = HOT_HITS) -> DataFrame:
    """(key, start, hits, limited) of windows that begin at a key's first hit.

    A task reads its keys in order and holds one window. Keys of more than ``hot`` hits aren't walked through: see
    ``jumped_windows``. Rows without key or time take no part.
    """
    size = seconds * 1000

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, start, count = None, None, 0
        for b in batches:
            out = []
            for k, part in b.groupby("k", sort=False):
                if now is not None and k != now:
                    out.append((now, start, count))
                    start, count = None, 0
                now = k
                over, start, count = windows_of(part["t"].tolist(), start, count, size)
                out += [(k, s, n) for s, n in over]
            yield pd.DataFrame(out, columns=["k", "s", "n"])
        if now is not None:
            yield pd.DataFrame([(now, start, count)], columns=["k", "s", "n"])

    kind = events.schema[key].dataType.simpleString()
    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("k"), F.unix_millis(F.col(ts).cast("timestamp")).alias("t"))
    large = rows.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("k")
    some = bool(large.take(1))
    few = rows.join(large, "k", "left_anti") if some else rows
    found = few.repartition("k").sortWithinPartitions("k", "t").mapInPandas(scan, f"k {kind}, s long, n long")
    if some:
        found = found.unionByName(jumped_windows(rows.join(large, "k", "left_semi"), size))
    return found.select(F.col("k").alias(key), F.timestamp_millis("s").alias("start"), F.col("n").alias("hits"), (F.col("n") > limit).alias("limited"))


def jumped_windows(rows: DataFrame, size: int) -> DataFrame:
    """(k, s, n) of the first-hit windows of ``rows`` (k, t in milliseconds), a key's hits spread over all tasks.

    Each distinct time points at the first one at least ``size`` later, which begins the next window if it begins one
    itself. It lies in the span of ``size`` that holds t + ``size``, or else it is the first time of the key's next span
    that has any; so only spans are looked through, not keys. Which times begin a window follows by doubling: from the
    first 2**i beginnings a jump over 2**i windows finds as many more, and jumps are joined with themselves.
    """
    times = cut(rows.groupBy("k", "t").agg(F.count("*").alias("n")).withColumn("b", F.floor(F.col("t") / size)))
    spans = times.groupBy("k", "b").agg(F.min("t").alias("first"))
    asked = times.select("k", (F.col("b") + 1).alias("b"), (F.col("t") + size).alias("at"), F.col("t").alias("own"), F.lit(None).cast("long").alias("hit"))
    seen = asked.unionByName(times.select("k", "b", F.col("t").alias("at"), F.lit(None).cast("long").alias("own"), F.col("t").alias("hit")))
    within = W.partitionBy("k", "b").orderBy(F.desc("at"), F.col("hit").isNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = seen.withColumn("next", F.min("hit").over(within)).where("own is not null").select("k", "b", "own", "next")
    # Where that span holds nothing late enough, the key's next span begins the answer: a row for each span, not each time.
    missing = found.where("next is null").select("k", "b", "own")
    gaps = missing.select("k", "b", F.lit(None).cast("long").alias("first")).distinct().unionByName(spans)
    ahead = W.partitionBy("k").orderBy(F.desc("b"), F.col("first").isNotNull()).rowsBetween(W.unboundedPreceding, -1)
    following = gaps.withColumn("next", F.min("first").over(ahead)).where("first is null").select("k", "b", "next")
    filled = missing.join(following, ["k", "b"]).select("k", "own", "next")
    jump = cut(found.where("next is not null").select("k", "own", "next").unionByName(filled.where("next is not null")))
    starts = cut(times.groupBy("k").agg(F.min("t").alias("s")))
    while not jump.isEmpty():
        more = starts.join(jump.withColumnRenamed("own", "s"), ["k", "s"]).select("k", F.col("next").alias("s"))
        starts = cut(starts.unionByName(more))
        far = jump.select("k", F.col("own").alias("next"), F.col("next").alias("over"))
        jump = cut(jump.join(far, ["k", "next"]).select("k", "own", F.col("over").alias("next")))
    # A window reaches into its own span and the next one.
    reach = starts.select("k", "s", F.explode(F.array(F.floor(F.col("s") / size), F.floor(F.col("s") / size) + 1)).alias("b"))
    inside = times.join(reach, ["k", "b"]).where((F.col("t") >= F.col("s")) & (F.col("t") < F.col("s") + size))
    return inside.groupBy("k", "s").agg(F.sum("n").alias("n"))


def first_hit_stream(events: DataFrame, key: str, ts: str, seconds: int = 60, limit: int = 120) -> DataFrame:
    """As ``first_hit_windows``, on a stream: each batch gives the windows that it touched. Hits are taken in the order of a batch's times."""
    size = seconds * 1000
    kind = events.schema[key].dataType.simpleString()

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, count = state.get if state.exists else (None, 0)
        times = sorted(t for p in parts for t in p["t"].tolist())
        over, start, count = windows_of(times, start, count, size)
        state.update((start, count))
        rows = [*over, (start, count)]
        yield pd.DataFrame({"k": [k[0]] * len(rows), "s": [s for s, _ in rows], "n": [n for _, n in rows]})

    rows = events.select(F.col(key).alias("k"), F.unix_millis(F.col(ts)).alias("t"))
    found = rows.groupBy("k").applyInPandasWithState(step, f"k {kind}, s long, n long", "start long, hits long", "update", GroupStateTimeout.NoTimeout)
    return found.select(F.col("k").alias(key), F.timestamp_millis("s").alias("start"), F.col("n").alias("hits"), (F.col("n") > limit).alias("limited"))


def attempts(tries: DataFrame, slot: str, ts: str, most: int = 3) -> DataFrame:
    """``tries`` with their number within the slot, and whether they are allowed."""
    n = F.row_number().over(W.partitionBy(slot).orderBy(ts, *[c for c in tries.columns if c not in (slot, ts)]))
    return tries.withColumn("attempt", n).withColumn("allowed", F.col("attempt") <= most)


def attempts_stream(tries: DataFrame, slot: str, most: int = 3) -> DataFrame:
    """(slot, allowed, refused): what each batch of tries may do, counting those of earlier batches."""
    kind = tries.schema[slot].dataType.simpleString()

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        asked = sum(len(p) for p in parts)
        free = max(0, min(asked, most - before))
        state.update((before + free,))
        yield pd.DataFrame({"slot": [k[0]], "allowed": [free], "refused": [asked - free]})

    rows = tries.select(F.col(slot).alias("slot"))
    return rows.groupBy("slot").applyInPandasWithState(step, f"slot {kind}, allowed long, refused long", "used long", "update", GroupStateTimeout.NoTimeout)


def newest_events(events: DataFrame, key: str, ts: str, most: int = 25) -> DataFrame:
    """The last ``most`` events of each key."""
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc(ts), *[c for c in events.columns if c not in (key, ts)]))
    return events.withColumn("place", place).where(F.col("place") <= most)


def buffer_stream(events: DataFrame, key: str, message: str, most: int = 25) -> DataFrame:
    """(key, messages): each key's last ``most`` messages after each batch."""
    kind = events.schema[key].dataType.simpleString()

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for p in parts:
            held = (held + p["m"].tolist())[-most:]
        state.update((held,))
        yield pd.DataFrame({"key": [k[0]], "messages": [held]})

    rows = events.select(F.col(key).alias("key"), F.col(message).cast("string").alias("m"))
    return rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, messages array<string>", "held array<string>", "update", GroupStateTimeout.NoTimeout)


def run_counters(events: DataFrame, key: str = "run", kind: str = "kind") -> DataFrame:
    """(key, requests, retries, throttled, failures) so far; on a stream in complete or update mode."""
    names = {"request": "requests", "retry": "retries", "throttled": "throttled", "failure": "failures"}
    return events.groupBy(key).agg(*[F.count(F.when(F.col(kind) == k, 1)).alias(n) for k, n in names.items()])


def watch_stream(beats: DataFrame, stall: int = 90, stale: int = 900) -> DataFrame:
    """(run, status, quiet_seconds) of runs that beat (run, status): live with each batch, stalled and interrupted by the clock.

    A run is watched until it ends or is interrupted. One that is throttled (status ``throttled``) isn't stalled.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, quiet = state.get
            quiet = stall if quiet < stall < stale else stale
            if quiet >= stale:
                state.remove()
                said = "interrupted"
            else:
                state.update((status, quiet))
                state.setTimeoutDuration((stale - quiet) * 1000)
                said = status if status == "throttled" else "stalled"
            yield pd.DataFrame({"run": [k[0]], "status": [said], "quiet_seconds": [quiet]})
            return
        last = [x for p in parts for x in p["status"].tolist()][-1]
        if last in TERMINAL:
            if state.exists:
                state.remove()
        else:
            state.update((last, 0))
            state.setTimeoutDuration(min(stall, stale) * 1000)
        yield pd.DataFrame({"run": [k[0]], "status": [last if last in TERMINAL or last == "throttled" else "live"], "quiet_seconds": [0]})

    kind = beats.schema["run"].dataType.simpleString()
    rows = beats.select("run", F.col("status").cast("string").alias("status"))
    return rows.groupBy("run").applyInPandasWithState(step, f"run {kind}, status string, quiet_seconds long", "status string, quiet long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def persist_snapshots(progress: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, seconds: float | None = 4.0) -> StreamingQuery:
    """Hand snapshots to ``write`` at most every ``seconds`` seconds; None takes what there is and stops."""
    writer = progress.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def sessions(events: DataFrame, key: str, ts: str, gap: int = 900, late: str = "240 minutes") -> DataFrame:
    """Runs of heartbeats with no gap of ``gap`` seconds; on a stream one is given out when it was interrupted."""
    counts = _timed(events, ts, late).groupBy(F.session_window(ts, f"{gap} seconds").alias("w"), key).agg(F.count("*").alias("beats"))
    return counts.select(key, F.col("w.start").alias("started"), "beats")


def ledger_table(spark, folder: str, buckets: int = 64) -> KeyedTable:
    return KeyedTable(spark, folder, ["fingerprint"], exceptions.SNAPSHOT, buckets)


def fold_stream(findings: DataFrame, folder: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Fold each micro-batch of findings into the ledger; run n + 1 is batch n.

    A batch reads and writes only the buckets that its findings lie in, so its cost follows the batch and not the ledger.
    It becomes visible with its number in one manifest: a batch that runs again after a failure counts once.
    """

    def fold(batch: DataFrame, n: int) -> None:
        ledger_table(batch.sparkSession, folder, buckets).merge(batch, lambda old, new: exceptions.fold(old, new, n + 1), ("batch", n))

    return findings.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ledger(spark, folder: str, n: int | None = None, buckets: int = 64) -> DataFrame:
    """The ledger as it was after ``n`` batches, or as it is."""
    table = ledger_table(spark, folder, buckets)
    return table.read(table.manifest(lambda m: n is None or m["tags"].get("batch", -1) < n))
