"""Similarity joins and first-hit windows against brute force; orders and pages."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from recordmill.functions import convert
from recordmill.operators import estate, ledger, simjoin
from recordmill.operators.cluster import sequenced
from recordmill.streaming import live


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("least", [0.34, 0.5, 0.8, 1.0])
def test_jaccard_join(spark, least):
    draw = random.Random(4)
    words = [f"w{int(draw.paretovariate(0.8)) % 30}" for _ in range(400)]
    sets = [(i, sorted(set(draw.choices(words, k=draw.randrange(0, 9))))) for i in range(90)] + [(100, []), (101, []), (None, ["w1"]), (102, None)]
    expected = sorted((a, b) for (a, x), (b, y) in itertools.combinations([s for s in sets if None not in s], 2) if (len(set(x) & set(y)) >= least * len(set(x) | set(y)) - 1e-9))
    got = simjoin.jaccard_join(spark.createDataFrame(sets, "id long, tokens array<string>"), least)
    assert sorted((r.l, r.r) for r in got.collect()) == expected
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)


@pytest.mark.parametrize("least", [0.5, 0.7, 0.8, 0.9, 1.0])
def test_edit_join(spark, least):
    draw = random.Random(6)
    base = ["".join(draw.choices("abc", k=draw.randrange(0, 14))) for _ in range(25)] + ["abcdefghijklmnopqrst", "", ""]
    texts = list(base)
    for t in base * 3:
        t = list(t)
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(t) + 1)
            draw.choice([lambda: t.insert(at, draw.choice("abcü")), lambda: t[at : at + 1].clear() or t.__delitem__(slice(at, at + 1)), lambda: t.__setitem__(slice(at, at + 1), ["x"])])()
        texts.append("".join(t))
    rows = list(enumerate(texts)) + [(None, "abc"), (999, None)]
    expected = sorted((i, j) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if (1 - levenshtein(a, b) / max(len(a), len(b)) if a or b else 1) >= least - 1e-9)
    got = simjoin.edit_join(spark.createDataFrame(rows, "id long, text string").repartition(3), least)
    assert sorted((r.l, r.r) for r in got.collect()) == expected
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)


def test_windows_by_jumps(spark):
    draw = random.Random(2)
    hits = [(k, draw.randrange(0, 4000) * (1 if k == "hot" else 37)) for k in ("hot", "rare", "x") for _ in range({"hot": 900, "rare": 40, "x": 3}[k])]
    hits += [("hot", 1_000_000), ("hot", 1_000_009), ("hot", 1_000_010), ("one", 5), ("one", 5)]
    rows = spark.createDataFrame(hits, "k string, t long")
    expected = []
    for k in {k for k, _ in hits}:
        over, start, n = live.windows_of(sorted(t for x, t in hits if x == k), None, 0, 10)
        expected += [(k, s, c) for s, c in [*over, (start, n)]]
    assert sorted(map(tuple, live.jumped_windows(rows, 10).collect())) == sorted(expected)
    events = rows.select("k", F.timestamp_millis("t").alias("ts")).unionByName(spark.sql("select null k, timestamp'2024-01-01' ts union all select 'x', null"))
    few, jumped = (sorted(map(tuple, live.first_hit_windows(events, "k", "ts", 10, 2, hot).collect())) for hot in (10_000, 100))
    assert few == jumped and len(few) < len(hits)


def test_cells_in_order(spark):
    cells = ["10", "9.5 kg", "-3", "Zebra", "éclair", "Eclair2", None, "apple", "1e2", ".5", "", " 7 "]
    rows = spark.createDataFrame([(c,) for c in cells], "c string")
    up = [r.c for r in sequenced(rows, [*convert.cell_order(F.col("c")), F.asc("c")], "p").orderBy("p").collect()]
    assert up == ["-3", ".5", " 7 ", "9.5 kg", "10", "1e2", "", "apple", "éclair", "Eclair2", "Zebra", None]
    down = [r.c for r in rows.orderBy(*convert.cell_order(F.col("c"), False)).collect()]
    assert down[1:4] == ["Zebra", "Eclair2", "éclair"] and down[-1] == "-3"


def test_pages_of_findings(spark, tmp_path):
    rows = [(r, f"f{i:03d}", "duplicate", "low") for r in (1, 2, 3) for i in range(25 * r)]
    placed = ledger.placed(spark.createDataFrame(rows, "run int, fingerprint string, outcome string, severity string").repartition(5))
    placed.write.parquet(f"{tmp_path}/f")
    stored = spark.read.parquet(f"{tmp_path}/f")
    got = ledger.page(stored, 2, 1, 20)
    assert sorted(r.fingerprint for r in got.collect()) == [f"f{i:03d}" for i in range(20, 40)] and "GreaterThanOrEqual(place" in plan_of(got)
    assert ledger.page(stored, 2, 9, 20).count() == 0 and ledger.page(stored, 77).count() == 0
    assert {(r.run, r.n, r["first"]) for r in ledger.findings_of(stored).collect()} == {(1, 25, "f000"), (2, 50, "f000"), (3, 75, "f000")}


def test_details_of_findings(spark):
    ws = spark.createDataFrame([(1, "b", None), (2, "a", "cap"), (3, None, None)], "ws int, name string, capacity_id string")
    items = spark.sql("select 1 ws, 'Report' type, timestamp'2024-01-01' updated, x creator from values ('p'), ('p'), ('q'), ('r'), ('s'), ('s') t(x)")
    users = spark.createDataFrame([(1, "ann@x", "Ann", "Admin", None), (2, None, "robot", "admin", "App"), (2, "app@x", "", "admin", "App"), (3, "cy", "", "Member", "User")], "ws int, email string, name string, role string, kind string")
    now = F.lit("2024-06-01").cast("timestamp")
    triaged = estate.triage(ws, items, users, now)
    got = {(r.ws, r.finding): (r["count"], r.days, r.names, r.more) for r in estate.triage_details(triaged, ws, items, users, now).collect()}
    assert got[1, "orphanedContent"] == (6, None, ["p (2)", "s (2)", "q (1)"], True) and got[1, "singleAdmin"] == (None, None, ["ann@x"], False)
    assert got[2, "orphanedAdmin"] == (None, None, ["app@x", "robot"], False) and got[1, "staleContent"][1] == 152 and got[2, "emptyWorkspace"][0] == 2
    assert [r.name for r in estate.worklist(triaged, ws, items).orderBy("place").collect()][-1] == "a"
