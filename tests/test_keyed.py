"""Keyed tables, stored scans, the ledger on a stream, and a database (Derby, which Spark brings along)."""

import os

import pytest
from pyspark.sql import functions as F

from recordmill.functions import convert
from recordmill.operators import build, exceptions, scan
from recordmill.sources import datasets as ds
from recordmill.sources import landing
from recordmill.sources.keyed import Conflict, KeyedTable, Step
from recordmill.sources.scan_store import ScanStore, shredded
from recordmill.streaming import live


def files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def rows_of(table):
    return sorted(map(tuple, table.read().collect()))


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ["k"], "k long, v string", 16)
    assert table.read().count() == 0
    table.upsert(spark.range(1000).selectExpr("id k", "'a' v"))
    before = files(tmp_path)
    table.upsert(spark.sql("select 7L k, 'b' v union all select 2000L, 'c'"))
    new = files(tmp_path) - before
    assert before <= files(tmp_path) and 1 <= len(new) <= 2 and table.read().count() == 1001
    assert table.find(spark.sql("select 7L k")).collect()[0].v == "b"
    assert table.read(table.manifest(lambda m: m["version"] == 1)).where("v <> 'a'").count() == 0
    table.delete(spark.sql("select 7L k union all select 5555L"))
    assert table.read().where("k = 7").count() == 0 and table.read().count() == 1000
    assert table.vacuum(1) > 0 and table.read().count() == 1000


def test_a_change_that_dies_changes_nothing(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ["k"], "k long, v string", 4)
    table.upsert(spark.sql("select 1L k, 'a' v"))

    def dies(old, new):
        return new.withColumn("v", F.raise_error(F.lit("lost")))

    with pytest.raises(Exception, match="lost"):
        table.merge(spark.sql("select 1L k, 'b' v"), dies)
    assert rows_of(table) == [(1, "a")]
    with open(f"{tmp_path}/t/manifest/0000000002.json", "w") as out:  # a writer that died over its manifest
        out.write('{"version": 2, "buck')
    assert rows_of(table) == [(1, "a")]
    table.upsert(spark.sql("select 2L k, 'b' v"))
    assert rows_of(table) == [(1, "a"), (2, "b")] and table.manifest()["version"] == 3
    old = table.manifest(lambda m: m["version"] == 1)
    with pytest.raises(Conflict):
        table._commit(old, {}, {}, None)


def test_schema_steps(spark, tmp_path):
    steps = (
        Step(1, "add w", "k long, v string, w int", lambda df: df.withColumn("w", F.length("v"))),
        Step(2, "rename v", "k long, name string, w int", lambda df: df.withColumnRenamed("v", "name")),
    )
    made = lambda n: KeyedTable(spark, f"{tmp_path}/t", ["k"], "k long, v string", 8, steps=steps[:n])
    made(0).upsert(spark.range(100).selectExpr("id k", "concat('v', id) v"))
    made(1).upsert(spark.sql("select 7L k, 'new' v, 70 w"))
    new = made(2)
    assert new.read().columns == ["k", "name", "w"] and new.read().count() == 100
    assert sorted(map(tuple, new.find(spark.sql("select 7L k union all select 11L")).collect())) == [(7, "new", 70), (11, "v11", 3)]
    assert [n for n, _ in new.applied()] == [0, 1]
    before = rows_of(new)
    assert new.migrate() == 8 and new.migrate() == 0 and [n for n, _ in new.applied()] == [2]
    assert rows_of(new) == before
    with pytest.raises(ValueError):
        made(1).read()
    with pytest.raises(ValueError):
        KeyedTable(spark, f"{tmp_path}/t", ["k"], "k long", steps=steps[::-1])


def test_decisions_are_kept_by_pair(spark, tmp_path):
    table = build.review_table(spark, f"{tmp_path}/r", 16)
    build.save_review(table, 3, spark.range(200).selectExpr("cast(id as string) l", "cast(id + 1 as string) r", "0.8D score", "'pending' review"))
    before = files(tmp_path)
    build.decide_stored(table, 3, spark.sql("select '5' l, '6' r, 'match' review union all select '9', '10', 'nonsense' union all select '0', '7', 'match'"))
    assert len(files(tmp_path) - before) <= 2 and table.read().count() == 200
    assert [(r.l, r.review) for r in table.read().where("review <> 'pending'").collect()] == [("5", "match")]


def test_a_batch_counts_once_and_costs_its_buckets(spark, tmp_path):
    table = live.ledger_table(spark, f"{tmp_path}/l", 32)
    fold = lambda n: lambda old, new: exceptions.fold(old, new, n)
    table.merge(spark.range(500).selectExpr("cast(id as string) fingerprint", "'duplicate' outcome", "'medium' severity"), fold(1), ("batch", 0))
    before, small = files(tmp_path), spark.sql("select '3' fingerprint, 'duplicate' outcome, 'high' severity")
    for _ in range(2):  # the batch runs again
        table.merge(small, fold(2), ("batch", 1))
    assert len(files(tmp_path) - before) == 1 and table.read().count() == 500
    assert tuple(table.read().where("fingerprint = '3'").select("severity", "occurrence_count", "last_run").head()) == ("high", 2, 2)


def test_scans_by_workspace(spark, tmp_path):
    whole = '{"workspaces": [{"id": "a", "name": "A", "odd": {"x": 1}, "items": [{"id": "i", "type": "Report"}], "users": []}, {"id": "b", "state": "Deleted"}], "tenantSettings": [{"settingName": "s", "enabled": true}]}'
    runs = spark.createDataFrame([(1, whole), (2, whole.replace('"A"', '"A2"')), (3, "broken"), (4, '{"workspaces": []}'), (5, None)], "run int, results string")
    store = ScanStore(spark, f"{tmp_path}/s", 8)
    store.save(*shredded(runs))
    store.workspaces.upsert(spark.createDataFrame([(2, "c", "{broken", None)], "run int, ws string, doc string, deleted_at string"))
    docs = store.load()
    assert sorted((r.run, r.ws, r["name"], r.state) for r in scan.workspaces(docs).collect()) == [(1, "a", "A", None), (1, "b", None, "Deleted"), (2, "a", "A2", None), (2, "b", None, "Deleted"), (2, "c", None, None)]
    assert {(r.run, r.captured) for r in scan.captured(docs).collect()} == {(1, True), (2, True), (3, False), (4, False), (5, False)}
    assert scan.items(docs).count() == 2 and scan.settings(store.load(1)).head().settingName == "s"
    before = files(tmp_path)
    store.mark_deleted("a", "2024-05-01")
    assert len(files(tmp_path) - before) == 1  # the bucket of a, which holds its documents of both runs
    marked = scan.workspaces(store.load()).where("ws = 'a'").select("run", "state", "item_count").collect()
    assert sorted(map(tuple, marked)) == [(1, "Deleted", 1), (2, "Deleted", 1)]
    assert store.workspaces.read().where("ws = 'a' and doc like '%odd%'").count() == 2
    store.mark_deleted("a", "2025-01-01")
    assert {r.deleted_at for r in store.workspaces.read().where("ws = 'a'").collect()} == {"2024-05-01"}


def test_broken_lines_are_kept(spark, tmp_path):
    told = []
    pages = landing.offset_pages(lambda url, p: {"value": [{"a": 1}] * 2}, "u", 2, 3, lambda *x: told.append(x))
    assert landing.land(spark, pages, f"{tmp_path}/p") == 8 and told == [("cut", 8)]
    spark.createDataFrame([('{"a": "x"',), ("",), ('{"a": 5}',)], "value string").write.mode("append").text(f"{tmp_path}/p")
    rows, broken = landing.landed(spark, f"{tmp_path}/p", "a int")
    assert (rows.count(), rows.columns, [r.line for r in broken.collect()]) == (9, ["a"], ['{"a": "x"'])


def test_codes_in_messages(spark):
    texts = {"failed (404) status 500": 404, "status: 503 (404)": 503, "CODE=200": 200, "code 99": None, "(999)": None, "status 1234": None, "x": None, None: None, "postcode 123": None}
    frame = spark.createDataFrame([(k,) for k in texts], "t string")
    assert {r.t: r.c for r in frame.select("t", convert.status_code(F.col("t")).alias("c")).collect()} == texts


@pytest.fixture
def derby(tmp_path):
    return ds.Source("d", "jdbc", f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})


def test_a_database(spark, derby):
    rows = spark.range(1000).selectExpr("id", "id % 10 grp", "concat('n', id) name")
    ds.write(rows, derby, "T 1", "replace")
    ds.write(rows.where("id < 5"), derby, "T 1")
    ds.write(rows.limit(0), derby, "T 1")
    got = ds.read_rows(spark, derby, "T 1", [ds.Selection("id"), ds.Selection("grp + 1", "g", "expression")], split=ds.Split("id", "0", "1000", 4)).where("id < 3")
    assert got.count() == 6 and got.rdd.getNumPartitions() == 4
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(id,3)" in plan and "name" not in plan
    assert ds.probe(spark, derby, "T 1") and [r.name for r in ds.schema(spark, derby, ["T 1"]).collect()] == ["id", "grp", "name"]
    assert ds.table_exists(spark, derby, "T 1") and not ds.table_exists(spark, derby, "T2")
    assert ds.create_table(spark, derby, "T2", ["a b", "c"]) and not ds.create_table(spark, derby, "T2", ["a b", "c"])
    ds.write(spark.sql("select 'x' `a b`, 'y' c"), derby, "T2", text_only=True)
    out = ds.run_statements(spark, ["insert into \"T2\" values ('p', 'q')", 'select * from "T2"'], derby)
    assert sorted(map(tuple, out[0].collect())) == [("p", "q"), ("x", "y")]
    with pytest.raises(Exception):  # the first of the two is taken back
        ds.run_statements(spark, ['delete from "T2"', "nonsense"], derby)
    assert ds.read(spark, derby, "T2").count() == 2
    with pytest.raises(PermissionError):
        ds.run_statements(spark, ["x"], ds.Source("r", "jdbc", derby.base, derby.options, False))


def test_publishing_is_all_or_nothing(spark, derby, monkeypatch):
    rows = spark.range(300).selectExpr("id", "concat('v', id) v")
    assert ds.publish_staged(rows, derby, "P") == 300
    execute = ds._execute
    monkeypatch.setattr(ds, "_execute", lambda c, s: execute(c, s if not s.startswith("INSERT") else "nonsense"))
    with pytest.raises(Exception):
        ds.publish_staged(rows.limit(7), derby, "P")
    monkeypatch.undo()
    assert ds.read(spark, derby, "P").count() == 300
    for _ in range(2):
        assert ds.publish_staged(rows.limit(7), derby, "P") == 7
    assert ds.read(spark, derby, "P").count() == 7 and not ds.table_exists(spark, derby, "P_staged")


def test_master_data_into_a_database(spark, derby):
    frame = spark.createDataFrame([("1", "Acme"), ("2", "ACME"), ("3", "Globex")], "id string, name string")
    model = build.Model((build.Field("name", "name", ("upper",)),), "id")
    out = build.build_master(frame, model)
    for _ in range(2):
        build.publish(out, model, derby, "golden", "links")
    assert ds.read(spark, derby, "golden").count() == 2 and ds.read(spark, derby, "links").count() == 3
