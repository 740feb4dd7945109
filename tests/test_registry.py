import pytest
from pyspark.sql import functions as F

from recordmill.functions import convert
from recordmill.operators import build, compare, ledger, registry
from recordmill.operators.reconcile import Compare
from recordmill.sources import datasets, landing


def test_operands_and_legacy_fields():
    f = registry.compare_field({"fieldA": "Net", "fieldB": "Amount", "type": "number"}, 0)
    assert f["label"] == "Net" and f["a"] == {"kind": "field", "value": "Net"} and f["trim"] and f["fold_case"]
    assert registry.compare_field({"a": {"kind": "constant", "value": None}}, 2)["label"] == "Value 3"
    assert registry.operand({"kind": "odd", "value": 1}, "x") == {"kind": "field", "value": "x"}


def test_problems_are_all_named():
    fields = [{"a": {"kind": "field", "value": " "}, "b": {"kind": "expression", "value": "drop t"}}, {"a": {"kind": "constant", "value": 1}, "b": {"kind": "constant", "value": 2}}]
    assert registry.field_problems(fields) == [(1, "a", "missing"), (1, "b", "changes_data"), (2, "", "both_constant")]
    rule = {"name": "r", "source_a": 1, "source_b": 2, "dataset_a": "a", "dataset_b": "b", "key_a": "k", "key_b": "k", "fields": [{"fieldA": "x", "fieldB": "y"}]}
    assert registry.rule_problems(rule) == [] and registry.rule_problems(rule | {"key_b": ""}) == ["missing:key_a+key_b"]
    model = {"name": "m", "source": 1, "dataset": "d", "config": {"fields": [{"column": "a", "weight": 0}, {}], "match": 0.7, "review": "0.8"}, "destination_table": "t"}
    assert registry.model_problems(model) == ["field:2:no_column", "no_weight", "review_above_match", "missing:destination"]
    assert registry.model_problems({})[:2] == ["missing:name", "missing:source"]


def test_plans_read_only_what_is_compared():
    rule = {"key": "id", "fields": [{"a": {"kind": "constant", "value": "it's"}, "fieldB": "s"}, {"fieldA": "n", "fieldB": "m", "type": "number", "tolerance": {"value": 2, "type": "percent"}, "caseInsensitive": False}]}
    a, b, plan = registry.plan_rule(rule)
    assert [s.alias for s in a] == ["recon_key", "recon_c1a"] and [s.alias for s in b] == ["recon_key", "recon_c0b", "recon_c1b"]
    assert plan.fields == (Compare("it's", "'it\\'s'", "recon_c0b"), Compare("n", "recon_c1a", "recon_c1b", "number", 2.0, True, True, False))
    assert registry.columns_for({"fields": [{"column": "a"}, {"column": "a"}, {}], "id_column": "i", "updated_column": "a"}) == ["a", "i"]


def test_filters():
    assert ledger.read_filter({}).open_only and not ledger.read_filter({"all": "1"}).open_only and not ledger.read_filter({"status": "open"}).open_only
    assert ledger.read_filter({"rule": "x", "run": "7"}) == ledger.Filter(run=7, open_only=True)
    assert ledger.clamp(None, 500, 2000) == 500 and ledger.clamp(9999, 500, 2000) == 2000 and ledger.clamp(-4, 500, 2000) == 1


def test_bulk_actions_need_a_narrow_filter(spark):
    with pytest.raises(ValueError, match="filter_too_wide"):
        ledger.for_action(spark.range(1), ledger.Filter(owner="ann"))


def test_runs_that_cannot_be_compared(spark):
    runs = spark.createDataFrame([(1, 1, 1, 5, 1, 1, 1, 1, 2), (2, 1, 2, 3, 1, 1, 1, 0, 0), (3, 2, 1, 9, 1, 1, 1, 1, 0)], "run int, rule int, version int, started int, records_a int, records_b int, keys_compared int, matched int, exception_count int")
    findings = spark.createDataFrame([(2, "f1", "duplicate", "low"), (2, "f2", "duplicate", "low")], "run int, fingerprint string, outcome string, severity string")
    for pair, code in (((1, 1), "same_run"), ((1, 9), "unknown_run"), ((1, 3), "other_rule")):
        with pytest.raises(ValueError, match=code):
            compare.compare_runs(runs, findings, *pair)
    c = compare.compare_runs(runs, findings, 1, 2, most=1)
    assert (c.earlier, c.later, c.swapped, c.version_changed, c.missing_detail) == (2, 1, True, True, [1])
    assert [tuple(r) for r in c.totals.collect()] == [("resolved", 2)] and [r.fingerprint for r in c.sample.collect()] == ["f1"]
    assert c.verdict.first()["verdict"] == "better"


def test_numbers_and_times(spark):
    texts = [" 1,234.50 ", "12x", "  ", "", None, "0x1F", "-1e3", "Infinity", "5d", ".5", "1 000"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(convert.to_number(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [1234.5, None, 0.0, None, None, 31.0, -1000.0, None, None, 0.5, 1000.0]


def test_master_data_end_to_end(spark, tmp_path):
    rows = [("1", "CRM", "Acme Ltd", "PL", 9), ("2", "ERP", "ACME  LTD", "PL", 5), ("3", "CRM", "Acme Ltd", "DE", 7), ("4", "ERP", "Globex", None, None), ("5", "CRM", None, "PL", 1)]
    frame = spark.createDataFrame(rows, "id string, sys string, name string, country string, n int")
    fields = (build.Field("name", "name"), build.Field("country", "country", ("upper",), blocker=True), build.Field("n", "n", weight=0.0001, missing="neutral", strategy="sum"))
    model = build.Model(fields, "id", "sys", priority=("ERP",), match=0.6, review=0.5, golden_id="primary_source_id")
    out = build.build_master(frame, model)
    golden = {r.golden_id: r for r in out.golden.collect()}
    assert set(golden) == {"2", "3", "4", "5"} and golden["2"].member_count == 2 and golden["2"].source_systems == ["CRM", "ERP"]
    assert golden["2"].name.value == "ACME  LTD" and golden["2"].n.value == "14.0" and golden["4"].country.value is None
    stats = out.stats.first().asDict()
    assert len(stats) == 15 and (stats["raw_records"], stats["golden_records"], stats["records_merged"], stats["pairs_truncated"]) == (5, 4, 2, False)
    target = datasets.Source("t", "parquet", str(tmp_path))
    build.publish(out, model, target, "golden", "links")
    assert spark.read.parquet(f"{tmp_path}/golden").columns == ["golden_id", "name", "country", "n", "source_systems", "source_record_count"] and spark.read.parquet(f"{tmp_path}/links").count() == 5
    build.save_results(out, 7, f"{tmp_path}/runs")
    build.save_results(out, 7, f"{tmp_path}/runs")
    assert spark.read.parquet(f"{tmp_path}/runs/crosswalk").where("run = 7").count() == 5
    with pytest.raises(PermissionError):
        build.publish(out, model, datasets.Source("r", base="x", writable=False), "golden")
    with pytest.raises(ValueError):
        build.build_master(frame, build.Model((), "id"))


def test_writes_know_types_and_batches(spark):
    frame = spark.sql("select 1 a, 'x' b, true c, timestamp'2024-01-01 00:00:00' d, cast(null as string) e")
    assert datasets.parameter_types(frame) == {"a": "FLOAT", "b": "NVARCHAR", "c": "BIT", "d": "DATETIME2", "e": "NVARCHAR"}
    assert (datasets.batch_rows(8), datasets.batch_rows(8, 10), datasets.batch_rows(8, 999), datasets.batch_rows(5000)) == (250, 10, 250, 1)
    assert datasets.create_statement("dbo.t", ["a b"]) == 'CREATE TABLE IF NOT EXISTS "dbo"."t" ("a b" VARCHAR(4000))'
    assert [df.first()[0] for df in datasets.run_statements(spark, ["select 1", "select 2"])] == [1, 2]
    assert datasets.Split("id", "0", "9", 0).options()["numPartitions"] == "1"


def test_pages_are_followed_and_tried_again(spark, tmp_path):
    book = {("u", None): {"value": [{"a": 1}], "continuationToken": "t"}, ("u", "t"): {"itemEntities": [{"a": 2}], "continuationUri": "v"}, ("v", None): {"value": [{"a": 3}]}}
    assert list(landing.pages(lambda url, p: book[url, p.get("continuationToken")], "u", {"x": 1})) == [[{"a": 1}], [{"a": 2}], [{"a": 3}]]
    rows = [{"a": i} for i in range(250)]
    found = landing.offset_pages(lambda url, p: {"value": rows[p["$skip"] : p["$skip"] + p["$top"]]}, "u")
    assert landing.land(spark, found, f"{tmp_path}/p") == 250 and landing.landed(spark, f"{tmp_path}/p", "a int")[0].count() == 250
    assert len(list(landing.offset_pages(lambda url, p: {"value": [0] * 100}, "u"))) == 51
    tries, slept, told = iter([landing.HttpError(429, 900), landing.HttpError(503), None]), [], []

    def call():
        e = next(tries)
        if e:
            raise e
        return {"ok": 1}

    assert landing.retried(call, lambda kind, status: told.append(kind), slept.append) == {"ok": 1}
    assert slept == [60.0, 2.0] and told == ["throttled", "retry", "request"]
    with pytest.raises(landing.HttpError):
        landing.retried(lambda: (_ for _ in ()).throw(landing.HttpError(404)), lambda *a: told.append(a[0]), slept.append)
    assert told[-1] == "failure" and len(slept) == 2


def test_runs_are_never_broadcast(spark, tmp_path):
    """A table of runs that is small on disk is unfolded by metric only after the runs of a pair have met."""
    spark.range(1, 7).selectExpr("id run", "id % 2 rule", "'completed' status", "id started", "id * 10 records_a", "id records_b", "id keys_compared", "nullif(id, 6) matched", "7 - id exception_count").write.parquet(f"{tmp_path}/runs")
    runs = spark.read.parquet(f"{tmp_path}/runs")
    found = compare.metric_deltas(compare.latest_pairs(runs), runs)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    rows = {(r["later"], r["metric"]): r for r in found.collect()}
    assert len(rows) == 2 * len(compare.METRICS) and (rows[5, "records_a"]["delta"], rows[5, "records_a"]["percent"]) == (20.0, 66.7)
    assert (rows[6, "matched"]["direction"], rows[6, "exception_count"]["direction"]) == ("unchanged", "improved")
