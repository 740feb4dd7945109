import pytest

from recordmill.functions.text import trim
from recordmill.operators import exceptions as ex
from recordmill.operators.reconcile import Compare, Rule, fingerprint, outcome_counts, reconcile

FIELDS = (Compare("Customer", "Customer", "CustomerName"), Compare("Net amount", "NetAmount", "Net", "number"))


def sides(spark, a, b):
    return spark.createDataFrame(a, "InvoiceNumber string, Customer string, NetAmount double"), spark.createDataFrame(b, "Invoice_No string, CustomerName string, Net double")


def run(spark, a, b, fields=FIELDS, **options):
    return reconcile(*sides(spark, a, b), Rule("InvoiceNumber", "Invoice_No", fields, **options))


def counts(found):
    return {r["outcome"]: r["total"] for r in outcome_counts(found).collect() if r["total"]}


def test_keys_match_whatever_their_case_and_space(spark):
    assert counts(run(spark, [(" inv-1 ", "Acme", 100.0)], [("INV-1", "Acme", 100.0)])) == {"match": 1}


def test_missing_on_either_side(spark):
    assert counts(run(spark, [("INV-1", "Acme", 100.0)], [("INV-2", "Beta", 50.0)])) == {"missing_from_a": 1, "missing_from_b": 1}


def test_differences_name_every_unequal_field(spark):
    rows = run(spark, [("INV-1", "Acme", 100.0)], [("INV-1", "Acme Corp", 120.0)]).collect()
    assert rows[0]["differences"] == ["Customer", "Net amount"] and rows[0]["severity"] == "medium"


@pytest.mark.parametrize(("policy", "expected"), [("exception", {"duplicate": 1}), ("first", {"match": 1}), ("ignore", {})])
def test_duplicates(spark, policy, expected):
    a = [("INV-1", "Acme", 100.0)] * 2
    assert counts(run(spark, a, [("INV-1", "Acme", 100.0)], duplicates=policy)) == expected


@pytest.mark.parametrize(("policy", "expected"), [("exception", {"invalid_key": 2}), ("ignore", {})])
def test_blank_keys_never_match(spark, policy, expected):
    assert counts(run(spark, [("", "Acme", 1.0)], [("   ", "Acme", 1.0)], blank_keys=policy)) == expected


@pytest.mark.parametrize(("a", "b", "same"), [(1000.0, 1005.0, True), (1000.0, 1050.0, False), (0.0, 5.0, False), (None, None, True), (None, 1.0, False)])
def test_percent_tolerance(spark, a, b, same):
    got = counts(run(spark, [("k", "x", a)], [("k", "x", b)], (Compare("n", "NetAmount", "Net", "number", 1, True),)))
    assert got == ({"match": 1} if same else {"value_mismatch": 1})


def test_empty_sides(spark):
    assert counts(run(spark, [], [])) == {}


def test_fold_counts_once_and_reopens(spark):
    first = fingerprint("r", run(spark, [("A", "x", 1.0), ("", "x", 1.0), ("", "y", 1.0)], []))
    ledger = ex.fold(spark.createDataFrame([], ex.SNAPSHOT), first, 1)
    closed = ledger.selectExpr("fingerprint", "outcome", "severity", "'resolved' status", "first_run", "last_run", "occurrence_count")
    again = {r["fingerprint"]: r for r in ex.fold(closed, first, 2).collect()}
    assert {(r["status"], r["first_run"], r["last_run"], r["occurrence_count"]) for r in again.values()} == {("open", 1, 2, 2)}


def test_churn(spark):
    before = spark.createDataFrame([("f1", "value_mismatch"), ("f2", "missing_from_b"), ("f3", "duplicate")], "fingerprint string, outcome string")
    after = spark.createDataFrame([("f2", "missing_from_b"), ("f4", "duplicate")], "fingerprint string, outcome string")
    r = ex.verdict(ex.diff(before, after)).first()
    assert (r["resolved"], r["introduced"], r["persisting"], r["verdict"]) == (2, 1, 1, "churn")


def test_spaces_go_without_a_pattern_and_a_number_leads_the_sorts(spark, capsys):
    """Keys that begin alike are slow to sort as text, and a pattern for each trim is slow on many rows (F9)."""
    odd = ["\t a b ", "﻿　x ", "  ", "y \u0085", "", None]
    got = [r["t"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, s string").orderBy("i").select(trim("s").alias("t")).collect()]
    assert got == ["a b", "x", "", "y \u0085", "", None]
    found = fingerprint("r", run(spark, [("a", "x", 1.0), ("a", "x", 1.0), (" B", "y", 2.0)], [("A ", "x", 1.0), ("b", "z", 2.0), ("c", "z", 2.0)]))
    assert sorted((r["business_key"], r["outcome"]) for r in found.collect()) == [("B", "value_mismatch"), ("a", "duplicate"), ("c", "missing_from_a")]
    ex.fold(spark.createDataFrame([], ex.SNAPSHOT), found, 1).explain()
    plan = capsys.readouterr().out
    assert "Join [h#" in plan and "Join [__lead#" in plan and "regexp_replace(" not in plan
