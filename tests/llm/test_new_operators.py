"""op11 to op13 against brute force: nulls, empty and long texts, ties, repeats, hot groups, clashing columns, empty tables."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordmill.llm import filter_audit, hard_negatives, license_scan

VECTORS = "vec_id long, embedding array<float>, label int, q string, list int, a string"


def negatives_by_hand(rows):
    kept = {}
    for i, v, label, *_ in rows:
        if None in (i, v, label) or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(256 * float(np.float32(x))) for x in v)
        kept[i, (label + 1) % 10 if i % 7 == 0 else label, q] = None
    out = set()
    for i, label, q in kept:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, x, strict=False)), j, other) for j, other, x in kept if (j, other, x) != (i, label, q))
        for s, j, _ in [x for x in scored if x[2] == label and x[1] != i][:5]:
            fit = [(t, n) for t, n, other in scored if other != label and 30 * -s <= 100 * -t <= 90 * -s]
            out |= {(i, j, rank + 1, n, -s, -t) for rank, (t, n) in enumerate(fit[:10])}
    return sorted(out)


def vectors(n, draw, copies=0):
    rows = [(i, [draw.gauss(0, 0.3) for _ in range(6)], draw.randrange(10), "x", 1, "y") for i in range(n)]
    same = [0.5] * 6
    return rows + [(n + i, same, i % 3, "x", 1, "y") for i in range(copies)]


@pytest.mark.parametrize(("n", "copies", "lists"), [(300, 0, 12), (240, 200, 9), (3, 0, 1)])
def test_hard_negatives(spark, monkeypatch, n, copies, lists):
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "CHUNK", 2)
    rows = vectors(n, random.Random(n), copies)
    rows += [(400, None, 1, "x", 1, "y"), (500, [1.0, None], 1, "x", 1, "y"), (600, [float("nan")] * 6, 1, "x", 1, "y"), (700, [float("inf")] * 6, 1, "x", 1, "y"), (800, [0.1] * 6, None, "x", 1, "y"), (None, [0.1] * 6, 1, "x", 1, "y"), (900, [], 3, "x", 1, "y"), (901, [0.9], 3, "x", 1, "y"), rows[0], rows[-1]]
    got = sorted(tuple(r) for r in hard_negatives.mine_digest(spark.createDataFrame(rows, VECTORS).repartition(3)).collect())
    assert got == negatives_by_hand(rows) and (n < 100 or got)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    ready = hard_negatives.quantised(spark.createDataFrame(rows, VECTORS), F.col("vec_id"), F.col("embedding"), label, F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in hard_negatives.mine(ready, lists=lists).collect()) == got


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine_digest(spark.createDataFrame([], VECTORS)).count() == 0
    assert hard_negatives.mine_digest(spark.createDataFrame([(1, [0.5], 1, "", 1, "")], VECTORS)).count() == 0


def test_far_lists_are_not_visited(spark):
    """Two tight groups far apart: an anchor's five best are in its own group, so the other's list is left out."""
    rows = [(i, [1.0 + 0.001 * (i % 7), 0.0] if i % 2 else [-1.0, 0.001 * (i % 5)], 1) for i in range(1, 400)] + [(400, [-1.0, 0.0], 1)]
    ready = hard_negatives.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id"), F.col("embedding"), F.col("label"), F.col("vec_id") == 400)
    index = hard_negatives.Lists(ready, lists=8)
    whole = lambda c: F.array(F.lit(c).cast("long"))
    near = [r["score"] for r in index.first(index.anchors.withColumn("lows", whole(-(1 << 61))).withColumn("ceilings", whole(1 << 61)), 5, True, "t").collect()]
    now = index.anchors.withColumn("lows", whole(-(1 << 61))).withColumn("floors", whole(min(near))).withColumn("ceilings", whole(1 << 61))
    assert 0 < index.visits(now, 0, 99, True).select("list").distinct().count() < 8


def licenses_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, t.label) for t in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(t.words)] == t.words]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


NOTICE = license_scan.NOTICES[0].text


def test_licenses(spark):
    draw = random.Random(3)
    edited = NOTICE.split()
    edited[10:12] = ["every", "legal", "person"]
    del edited[25]
    texts = [None, "", " \n", "MIT License", "mit\x00LICENSE", "mit license mit license mit", "ümit license", "MIT KLicense", "GNU General Public License, CC BY-NC 4.0; CC-BY", "gnu general public", "one " * 30_000 + "apache license", NOTICE.upper(), " ".join(edited), NOTICE[: len(NOTICE) // 3], " ".join(draw.choices(NOTICE.split(), k=50)), "x " + "mit license " * 3000]
    texts += [" ".join(draw.choices(["mit", "license", "apache", "cc", "by", "gnu", "general", "public", "x"], k=40)) for _ in range(60)]
    rows = [(i, t, "k", "w", 1) for i, t in enumerate(texts)] + [(3, "MIT License", "k", "w", 1), (None, "cc by", "k", "w", 1), (None, "cc by", "k", "w", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, words string, t int").repartition(3)
    got = license_scan.license_digest(docs).collect()
    own = lambda r: (str(r["doc_id"]), r["n_words"], r["n_base"], str(r["first_word"]), str(r["last_word"]), r["base_labels"])
    by_hand = [(str(i), *licenses_by_hand(t)) for i, t, *_ in rows]
    assert sorted(map(own, got)) == sorted((i, n, k, str(a), str(b), x) for i, n, k, a, b, x in by_hand)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    named = {r["doc_id"]: (r["labels"], r["score"]) for r in got}
    assert named[11] == ("mit", 1.0) and named[12][0] == "mit" and 0.8 < named[12][1] < 1
    assert named[13] == ("", 0.0) and named[14] == ("", 0.0) and named[8][0] == "cc-by,cc-by-nc,gpl"
    found = {(r["label"], r["start"], r["stop"]) for r in license_scan.scan_licenses(docs.where("doc_id in (12, 5)")).collect()}
    assert {("mit", 0, 2), ("mit", 2, 4), ("mit", 0, len(edited))} == found
    assert license_scan.license_digest(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        license_scan.positions((license_scan.Template("x", "one"),), 2)


def audit_by_hand(docs, labels):
    good, toxic = {i for i, q, _ in labels if i is not None and q == 1}, {i for i, _, t in labels if i is not None and t == 1}
    fails = []
    for i, t, lang in docs:
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        upper = sum("A" <= c <= "Z" for c in t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        found = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * upper > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": copy}
        fails.append((lang or "", {f for f, x in found.items() if x}, i in good, i in toxic))
    out = []
    for part in {x[0] for x in fails}:
        own = [x for x in fails if x[0] == part]
        sums = dict.fromkeys("ABCDE", 0)
        rows = []
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                alive = [x for x in own if not x[1] & set(order[:k])]
                gone = [x for x in alive if f in x[1]]
                sums[f] += len(gone)
                rows.append([part, order, k + 1, len(alive) - len(gone), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone), f])
        out += [(*r[:-1], sums[r[-1]]) for r in rows]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_filter_audit(spark):
    draw = random.Random(9)
    words = ["".join(draw.choices("abcdefg", k=5)) for _ in range(400)]
    docs = [(i, " ".join(draw.sample(words, 120) if i % 2 else draw.choices(words[: 40 + i], k=100 + i % 3)) + draw.choice(["", " #", " A", " " + "ABC" * 60]), draw.choice(["en", "de", None])) for i in range(60)]
    docs += [(60 + i, docs[i % 7][1], "en") for i in range(30)]
    docs += [(100, None, "en"), (101, "", None), (99, " \x0b\n", ""), (None, docs[0][1], "fr"), (7, docs[7][1], "de"), (102, "é" * 200_000 + " ü", "en"), (103, "w " * 50_000, "en")]
    labels = [(i, draw.randrange(2), draw.randrange(2)) for i in range(0, 90, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, 1)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, lang string, part int, digest string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit_documents(frame, marks)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == audit_by_hand(docs, labels)
    assert filter_audit.audit_documents(frame.limit(0), marks).count() == 0
    assert filter_audit.audit_documents(frame, marks.limit(0)).where("good_lost > 0").count() == 0


def test_trie_walks_each_state_once(spark):
    """Three filters: 12 edges instead of the 15 of six orders, and nothing stays persisted."""
    rows = spark.createDataFrame([("p", i % 2 == 0, i % 3 == 0, None if i % 5 else True) for i in range(60)], "g string, x boolean, y boolean, z boolean")
    edges = filter_audit.trie_edges(rows, "g", {"x": "x", "y": "y", "z": "z"})
    assert sorted((r["state"], r["filter"], r["alive"], r["removed"]) for r in edges.collect()) == sorted(
        (s, f, len(alive), sum(i % d == 0 for i in alive)) for s in range(7) for alive in [[i for i in range(60) if not any(s >> b & 1 and i % e == 0 for b, e in enumerate((2, 3, 5)))]] for b, (f, d) in enumerate((("x", 2), ("y", 3), ("z", 5))) if not s >> b & 1
    )
    assert not spark.sparkContext._jsc.getPersistentRDDs()
    with pytest.raises(ValueError):
        filter_audit.trie_edges(rows, "g", {})
