import random

from recordmill.functions import text
from recordmill.streaming import live


def streamed(spark, frames, folder, make, mode="update", seconds=60):
    """What ``make`` gives for the frames; a stream that waits for the clock is stopped after ``seconds``."""
    for k, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/in{k}")
    out = []
    stream = spark.readStream.schema(frames[0].schema).parquet(f"{folder}/in*")
    query = make(stream).writeStream.outputMode(mode).foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    query.awaitTermination(seconds)
    query.stop()
    return out


def test_windows_begin_at_the_first_hit(spark, tmp_path):
    assert live.windows_of([0, 5, 60, 61, 200], None, 0, 60) == ([(0, 2), (60, 2)], 200, 1)
    rows = spark.sql("select 'a' k, timestamp'2024-01-01 00:00:07' + make_dt_interval(0, 0, 0, x) ts from values (0), (59), (60), (200) t(x) union all select 'b', timestamp'2024-01-01 00:00:00' union all select null, timestamp'2024-01-01 00:00:00'")
    got = sorted((r.k, r.start.second, r.hits, r.limited) for r in live.first_hit_windows(rows, "k", "ts", 60, 1).collect())
    assert got == [("a", 7, 1, False), ("a", 7, 2, True), ("a", 27, 1, False), ("b", 0, 1, False)]
    found = streamed(spark, [rows.where("k is not null")], str(tmp_path), lambda s: live.first_hit_stream(s, "k", "ts", 60, 1))
    assert sorted((r.k, r.hits) for r in found) == [("a", 1), ("a", 1), ("a", 2), ("b", 1)]


def test_attempts_and_buffers_of_streams(spark, tmp_path):
    rows = spark.sql("select id % 2 slot, id from range(9)")
    found = streamed(spark, [rows], f"{tmp_path}/a", lambda s: live.attempts_stream(s, "slot"))
    assert sorted((r.slot, r.allowed, r.refused) for r in found) == [(0, 3, 2), (1, 3, 1)]
    found = streamed(spark, [rows.repartition(1)], f"{tmp_path}/b", lambda s: live.buffer_stream(s, "slot", "id", 2))
    assert sorted((r.key, len(r.messages)) for r in found) == [(0, 2), (1, 2)]


def test_ended_runs_are_not_watched(spark, tmp_path):
    rows = spark.sql("select 1 run, 'completed' status union all select 2, 'running' union all select 3, 'throttled'")
    found = streamed(spark, [rows], str(tmp_path), live.watch_stream, seconds=25)
    assert {(1, "completed"), (2, "live"), (3, "throttled")} <= {(r.run, r.status) for r in found}


def test_snapshots_are_handed_over(spark, tmp_path):
    spark.sql("select 1 run, 'request' kind").write.parquet(f"{tmp_path}/in")
    stream, seen = spark.readStream.schema("run int, kind string").parquet(f"{tmp_path}/in"), []
    query = live.persist_snapshots(live.run_counters(stream), lambda df, n: seen.extend(df.collect()), f"{tmp_path}/check", None)
    query.awaitTermination()
    assert [(r.run, r.requests, r.failures) for r in seen] == [(1, 1, 0)]


def plain_jaro_winkler(a, b):
    """By marks on both sides, position by position."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    in_a, in_b = [False] * len(a), [False] * len(b)
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not in_b[j] and b[j] == x:
                in_a[i] = in_b[j] = True
                break
    m = sum(in_a)
    if not m:
        return 0.0
    left, right = [x for x, t in zip(a, in_a) if t], [x for x, t in zip(b, in_b) if t]
    jaro = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(left, right)) / 2) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def test_jaro_winkler_equals_plain_marks(spark):
    draw = random.Random(2)
    words = ["".join(draw.choices("abcde", k=draw.randint(0, 9))) for _ in range(400)]
    names = {r[0] for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_name").collect()}
    pairs = [(draw.choice(words), draw.choice(words)) for _ in range(2000)] + [(a, b) for a in names for b in names]
    for a, b in pairs:
        assert abs(text._jaro_winkler(a, b) - plain_jaro_winkler(a, b)) < 1e-12, (a, b)
