"""The pipeline against brute force on planted cases, and stages on gaps and empty tables."""

import hashlib
import math
import random
from collections import defaultdict

import corpus_pipeline
from recordmill.llm import decontaminate, mixing, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(draw, n):
    return " ".join("".join(draw.choices("abcdefghij", k=draw.randint(3, 7))) for _ in range(n))


def planted():
    """Rows of documents, labels and benchmark, and the texts by id that the first four stages leave."""
    draw = random.Random(8)
    texts, left, labels = {}, {}, []
    for i in range(400):
        toxic = i % 4 == 0
        texts[i] = words(draw, 40) + (" vilest" if toxic else "")
        labels.append((i, 1, int(toxic)))
        if not toxic:
            left[i] = texts[i]
    for i in range(400, 410):  # near and exact copies of clean texts
        part = texts[4 * i - 1600 + 1].split()
        if i % 2:
            part[-1] = "other"
        texts[i] = " ".join(part)
    shared = words(draw, 9)
    for i in (410, 411):
        own = words(draw, 30)
        texts[i] = f"{own}\n{shared}"
        left[i] = texts[i] if i == 410 else own
    items = [(n, words(draw, 25)) for n in range(5)] + [(90, None), (None, words(draw, 25)), (91, "")]
    for i in range(412, 417):
        texts[i] = f"{words(draw, 30)} {items[i - 412][1].upper()} {words(draw, 30)}"
    texts[417] = left[417] = None
    texts[418] = left[418] = ""
    docs = [(i, t, None if i % 50 == 1 else "de" if i % 3 else "en", "hot" if i % 5 else "s1", len(t) if t is not None else None) for i, t in texts.items()]
    return docs, labels, items, left


def raked(rows, keep=0.8, rounds=8):
    """Ids that mixing keeps, by plain raking."""
    cell = {}
    for i, t, lang, source, _ in rows:
        cell[i] = (source or "(none)", lang or "(none)", next((n for x, n in mixing.TOPICS if x in (t or "")), "prose"))
    tokens = defaultdict(int)
    for i, t, *_ in rows:
        tokens[cell[i]] += max(1, math.ceil(len(t or "") / 4))
    total = sum(tokens.values())
    aims, size = [], keep
    for d, name in enumerate(mixing.DIMS):
        sums = defaultdict(int)
        for c, n in tokens.items():
            sums[c[d]] += n
        powers = {k: n ** mixing.TEMPER[name] for k, n in sums.items()}
        aims.append({k: p / sum(powers.values()) for k, p in powers.items()})
        size = min([size, *[n / total / aims[d][k] for k, n in sums.items()]])
    x = {c: n * size for c, n in tokens.items()}
    for _ in range(rounds):
        for d, aim in enumerate(aims):
            new = {}
            for k, share in aim.items():
                own, wanted = [c for c in x if c[d] == k], total * size * share
                there, fixed, free = sum(x[c] for c in own), sum(tokens[c] for c in own if x[c] >= tokens[c]), sum(x[c] for c in own if x[c] < tokens[c])
                for c in own:
                    new[c] = x[c] * wanted / there if wanted <= there else tokens[c] if x[c] >= tokens[c] else min(tokens[c], x[c] * (wanted - fixed) / free)
            x = new
    chance = {c: x[c] / tokens[c] for c in x}
    return {i for i in cell if int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) / 2**52 < chance[cell[i]]}


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs, labels, items, left = planted()
    for name, rows, schema in (("documents", docs, DOCS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    clean, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        clean = corpus_pipeline.staged(stage(spark, clean, str(tmp_path)), name)
        assert clean.columns == [c.split()[0] for c in DOCS.split(", ")]
        ids[name] = {r.doc_id for r in clean.select("doc_id").collect()}
    # Each stage does its own work: copies stay until near-dedup, leaks until decontamination.
    assert ids["toxicity"] - ids["line_dedup"] == set()
    assert ids["line_dedup"] - ids["near_dedup"] == set(range(400, 410))
    assert ids["near_dedup"] - ids["decontamination"] == set(range(412, 417))
    assert {r.doc_id: r.text for r in clean.collect()} == left
    rows = [(i, t, lang, source, n) for i, _, lang, source, n in docs if i in left for t in [left[i]]]
    before = corpus_pipeline.known()
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert corpus_pipeline.known() - before == {result.staged_at}
    got = {r.doc_id: (r.text, r.n_chars) for r in result.collect()}
    assert got == {i: (left[i], None if left[i] is None else len(left[i])) for i in raked(rows)}


def test_stages_on_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words of a text", None, None, None), (None, None, None, None, None)], DOCS)
    none, labels, items = docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string")
    assert toxicity.drop_toxic(docs, labels).count() == 2 and toxicity.score_toxicity(none, labels).isEmpty()
    assert decontaminate.drop_leaks(docs, items).count() == 2 and decontaminate.find_leaks(docs, items).isEmpty() and decontaminate.find_leaks(none, items).isEmpty()
    assert token_counts.token_counts(spark, none).isEmpty()
    assert [(r.doc_id, r.n_tokens) for r in token_counts.token_counts(spark, docs).collect()][1] == (None, 0)
    assert mixing.sample_mix(none).isEmpty()


def test_leaks_of_repeated_ids_and_long_texts(spark):
    draw = random.Random(3)
    item = words(draw, 20)
    rows = [(1, item), (1, item), (2, words(draw, 20_000) + " " + item), (3, words(draw, 200)), (None, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 item_id", "2 start", "'x' hits")
    found = decontaminate.find_leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted(str((r.doc_id, r.item_id, r.edits)) for r in found) == ["(1, 7, 0)", "(1, 7, 0)", "(2, 7, 0)", "(None, 7, 0)"]
    assert {r.end - r.start for r in found} == {len(item)}
