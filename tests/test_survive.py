from pyspark.sql import functions as F

from recordmill.operators.survive import STRATEGIES, Keep, master, survivors, trust

ROWS = [("c-1", "CRM", "2026-08-10", "Jonathan Smith", None, 5000), ("s-1", "SAP", "2026-01-05", "J Smith", "0200000", 3000), ("l-1", "Legacy", "2026-08-20", "Jonathan Smith", "0200000", 4000)]
SCHEMA = "id string, sys string, updated string, name string, phone string, credit int"


def test_strategies(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA).withColumn("cluster", F.lit(1))
    rank, updated = trust(F.col("sys"), ["SAP", "CRM"]), F.to_timestamp("updated")

    def got(field, strategy):
        r = survivors(rows, [Keep(field, field, strategy)], rank, updated).first()
        return r[field].value, r[field].source, r.conflicts, r.needs_steward

    assert got("name", "source_priority") == got("name", "most_complete") == ("J Smith", "s-1", 1, False)
    assert got("name", "most_recent") == ("Jonathan Smith", "l-1", 1, False)
    assert got("name", "most_frequent") == ("Jonathan Smith", "c-1", 1, False)
    assert got("name", "longest") == ("Jonathan Smith", "c-1", 1, False)
    assert got("phone", "source_priority") == ("0200000", "s-1", 0, False)
    assert [got("credit", x)[0] for x in ("max", "min", "sum")] == ["5000", "3000", "12000.0"]
    assert got("name", "max") == got("name", "source_priority")
    assert got("name", "manual") == (None, None, 1, True)
    empty = rows.withColumn("name", F.lit(None).cast("string"))
    for strategy in STRATEGIES:
        r = survivors(empty, [Keep("name", "name", strategy)], rank, updated).first()
        assert (r["name"].value, r.conflicts, r.needs_steward) == (None, 0, False)


def test_master(spark):
    rows = spark.createDataFrame([*ROWS, ("x", "CRM", None, "Other", None, None)], SCHEMA)
    pairs = spark.createDataFrame([("c-1", "s-1"), ("s-1", "l-1")], "l string, r string")
    fields = [Keep("name", "name", "longest"), Keep("phone", "phone")]
    golden, cross = master(rows, pairs, fields, trust(F.col("sys"), ["SAP"]), F.to_timestamp("updated"))
    assert sorted((r.golden_id, r.member_count, r["name"].value) for r in golden.collect()) == [("MDM-000001", 3, "Jonathan Smith"), ("MDM-000002", 1, "Other")]
    assert {r.id: r.golden_id for r in cross.collect()} == {"c-1": "MDM-000001", "s-1": "MDM-000001", "l-1": "MDM-000001", "x": "MDM-000002"}
    golden, _ = master(rows, pairs, fields, trust(F.col("sys"), ["SAP"]), F.to_timestamp("updated"), strict=True)
    assert golden.count() == 4
