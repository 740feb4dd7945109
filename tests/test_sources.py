import pytest

from recordmill.operators import exceptions as ex
from recordmill.sources import datasets as ds
from recordmill.streaming import live


def test_expressions():
    assert ds.expression_problem("ROUND(upper(x), 2)") is None
    for bad in ("", " ", "a;b", "a--b", "a/*b", "DROP x", "xp_cmd(1)", "(a", "a)(", "x" * 1001):
        assert ds.expression_problem(bad)
    assert ds.expression_problem("updated_at") is None
    assert ds.quote("a b.c") == "`a b`.`c`"
    with pytest.raises(ValueError):
        ds.quote("a`b")


def test_projection_reads_only_what_it_names(spark, tmp_path):
    source = ds.Source("t", "parquet", str(tmp_path))
    rows = spark.range(10).selectExpr("id", "id * 2 twice", "'x' other")
    ds.write(rows, source, "n", "replace")
    ds.write(rows, source, "n")
    ds.write(rows.limit(0), source, "n")
    got = ds.read_rows(spark, source, "n", [ds.Selection("id", "k"), ds.Selection("twice + 1", "odd", "expression")], 15)
    assert got.columns == ["k", "odd"] and got.count() == 15
    assert "other" not in got._jdf.queryExecution().executedPlan().toString()
    assert ds.read_rows(spark, source, "n", [ds.Selection("id")]).count() == 20
    ds.write(rows, source, "n", "replace", text_only=True)
    assert ds.probe(spark, source, "n") and {r.data_type for r in ds.schema(spark, source, ["n"]).collect()} == {"string"}
    with pytest.raises(ValueError):
        ds.read_rows(spark, source, "n", [])
    with pytest.raises(PermissionError):
        ds.write(rows, ds.Source("r", base=str(tmp_path), writable=False), "n")


def test_schema_shapes(spark):
    rows = [("dbo", "t", "BASE TABLE", "b", "decimal", None, 10, 2, "NO", 2), ("dbo", "t", "BASE TABLE", "a", "nvarchar", -1, None, None, "yes", 1), ("dbo", "t", "BASE TABLE", "c", "char", 5, None, None, "NO", 3), ("x", "v", "VIEW", None, None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "table_schema string, table_name string, table_type string, column_name string, data_type string, length int, precision int, scale int, is_nullable string, position int")
    got = {r.name: (r.kind, [tuple(f) for f in r.fields]) for r in ds.shape_schema(frame).collect()}
    assert got == {"dbo.t": ("Table", [("a", "nvarchar(max)", True), ("b", "decimal(10,2)", False), ("c", "char(5)", False)]), "x.v": ("View", [])}


def test_changes_of_the_ledger(spark):
    ledger = spark.createDataFrame([(k, "duplicate", "medium", st, 1, 1, 1, "ann", None) for k, st in (("a", "open"), ("b", "resolved"), ("c", "open"), ("d", "open"))], ex.SNAPSHOT + ", owner string, reason string")
    asks = [("a", "bob", "high", "resolved", "done", "fixed"), ("b", None, None, "accepted", None, "x"), ("c", "", "medium", "open", "note", None), ("d", None, None, "resolved", None, " "), ("z", None, None, None, None, None)]
    after, events, skipped = ex.change(ledger, spark.createDataFrame(asks, "fingerprint string, owner string, severity string, to_status string, comment string, reason string"))
    assert {r.fingerprint: (r.status, r.severity, r.owner, r.reason) for r in after.collect()} == {"a": ("resolved", "high", "bob", "fixed"), "b": ("resolved", "medium", "ann", None), "c": ("open", "medium", None, None), "d": ("open", "medium", "ann", None)}
    assert sorted((r.fingerprint, r.action) for r in events.collect()) == [("a", "assigned"), ("a", "severity-change"), ("a", "status-change"), ("c", "assigned"), ("c", "comment")]
    assert {r.fingerprint: r.problem for r in skipped.collect()} == {"b": "barred:resolved>accepted", "d": "reason_missing", "z": "unknown"}
    folded = ex.fold(ledger, spark.createDataFrame([("b", "duplicate", "medium")], "fingerprint string, outcome string, severity string"), 2)
    assert {r.fingerprint: (r.status, r.owner) for r in folded.collect()}["b"] == ("open", "ann")


def test_streams(spark, tmp_path):
    findings = [("f1", "duplicate", "medium"), ("f2", "duplicate", "medium")]
    frame = spark.createDataFrame(findings, "fingerprint string, outcome string, severity string")
    for n in range(2):
        frame.limit(2 - n).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = live.fold_stream(stream, f"{tmp_path}/ledger", f"{tmp_path}/check")
    query.awaitTermination()
    assert sorted(r.occurrence_count for r in live.ledger(spark, f"{tmp_path}/ledger", 2).collect()) == [1, 2]

    events = spark.sql("select 'a' k, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 20) ts from range(6)")
    events.write.parquet(f"{tmp_path}/events")
    live_events = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    query = live.hits(live_events, "k", "ts", 60, 2).writeStream.outputMode("complete").format("memory").queryName("hits").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.hits, r.limited) for r in spark.table("hits").collect()) == [(3, True), (3, True)]
    assert live.sessions(events, "k", "ts", 10).count() == 6 and live.sessions(events, "k", "ts", 30).count() == 1
