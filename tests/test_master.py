"""Candidate pairs: blocks of tiles, caps that end the work early, pairs that meet in many blocks."""

import dataclasses
import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from recordmill.operators import build, master


def by_hand(rows):
    keys = {}
    for i, b in rows:
        if i is not None and b is not None:
            keys.setdefault(i, set()).add(b)
    return sorted((a, b) for a, b in itertools.combinations(sorted(keys), 2) if keys[a] & keys[b])


@pytest.mark.parametrize(("seed", "chunk"), [(1, 1), (2, 3), (3, 256)])
def test_pairs_of_many_blocks(spark, seed, chunk):
    draw = random.Random(seed)
    rows = [(draw.randrange(60), draw.choice("abcdefgh") if draw.random() < 0.7 else "hot") for _ in range(160)] + [(None, "hot"), (3, None)]
    blocked = spark.createDataFrame(rows, "id long, block string").repartition(3)
    expected = by_hand(rows)
    assert sorted(map(tuple, master.block_pairs(blocked, chunk).collect())) == expected
    for most in (7, len(expected), len(expected) + 1)[seed - 1 :]:
        kept, told = master.candidates(blocked, most, chunk)
        assert sorted(map(tuple, kept.collect())) == expected[:most]
        known = {(i, b) for i, b in rows if i is not None and b is not None}
        assert told.head().asDict() == {"candidate_pairs": min(most, len(expected)), "truncated": most <= len(expected), "blocks_examined": len({b for _, b in known}), "largest_block": max(sum(x == b for _, x in known) for _, b in known)}


def test_no_pairs(spark):
    blocked = spark.createDataFrame([(1, "a"), (2, "b")], "id long, block string")
    assert master.block_pairs(blocked).count() == 0
    kept, told = master.candidates(blocked.limit(0))
    assert kept.count() == 0 and tuple(told.head()) == (0, False, 0, 0)


def test_pairs_are_never_shuffled(spark):
    """No distinct over pairs: the last shuffle of the plan carries tiles."""
    blocked = spark.range(100).selectExpr("id", "explode(array(id % 3, id % 5)) block")
    plan = master.block_pairs(blocked, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [l" not in plan and "Distinct" not in plan


def test_tile_numbers(spark):
    made = master.tile_pairs(spark.createDataFrame([("a", 1), ("b", 150)], "block string, k int"))
    assert sorted(map(tuple, made.collect())) == [("a", 0, 0)] + sorted(("b", x, y) for y in range(150) for x in range(y + 1))
    big = 3_000_000_000
    at = spark.range(1).selectExpr(f"{big}L * ({big}L + 1) div 2 - 1 as m").selectExpr("m", "cast(floor((sqrt(8.0D * m + 1) - 1) / 2) as long) as y0").head()
    assert abs(at["y0"] - (big - 1)) <= 1


def test_a_block_of_a_million_under_a_cap(spark):
    blocked = spark.range(1_000_000).select("id", F.lit("all").alias("block"))
    began = time.time()
    kept, told = master.candidates(blocked, 500_000)
    assert kept.agg(F.count("*"), F.min("l"), F.max("l"), F.min("r"), F.max("r")).head()[:] == (500_000, 0, 0, 1, 500_000)
    assert told.head()["truncated"] and time.time() - began < 120


def test_a_model_compares_the_pairs_beyond_its_cap(spark):
    """Three records in each of four blocks, a cap of five pairs: all twelve are compared and merged, unless the model is capped."""
    rows = spark.range(12).selectExpr("id", "concat('name ', id div 3) name")
    fields = (build.Field("name", "name"),)
    model = build.Model(fields, "id", blocks=(build.Block("name"),), most_pairs=5)
    stats = build.build_master(rows, model).stats.head()
    assert (stats["pairs_compared"], stats["candidate_pairs"], stats["golden_records"], stats["pairs_truncated"]) == (12, 12, 4, True)
    stats = build.build_master(rows, dataclasses.replace(model, capped=True)).stats.head()
    assert (stats["pairs_compared"], stats["pairs_truncated"]) == (5, True)
