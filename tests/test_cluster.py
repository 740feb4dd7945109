import random
import unicodedata

from pyspark.sql import functions as F

from recordmill.functions.text import jaro_winkler, strip_diacritics
from recordmill.operators import cluster


def test_components_equal_a_search(spark):
    draw = random.Random(4)
    pairs = [(draw.randrange(120), draw.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(40)] + [(300, 301 + i) for i in range(30)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    got = cluster.components(spark.createDataFrame(pairs, "l int, r int")).collect()
    assert {r.id: r.component for r in got} == {x: top(x) for x in parent}
    assert len(got) == len(parent)
    assert cluster.components(spark.createDataFrame([], "l int, r int")).count() == 0


def test_strict_clusters(spark):
    rows = spark.createDataFrame([(i,) for i in range(4)], "id int")
    chain = [(0, 1), (1, 2)]
    for links, strict, expected in ((chain, False, [0, 0, 0, 3]), (chain, True, [0, 1, 2, 3]), ([*chain, (0, 2)], True, [0, 0, 0, 3])):
        got = cluster.clusters(rows, "id", spark.createDataFrame(links, "l int, r int"), strict).orderBy("id")
        assert [r.cluster for r in got.collect()] == expected


def test_jaro_winkler(spark):
    rows = [("MARTHA", "MARHTA", 0.961111), ("DIXON", "DICKSONX", 0.813333), ("abc", "abc", 1.0), ("", "", 1.0), ("", "a", 0.0), ("ab", "xy", 0.0), (None, "a", None)]
    got = spark.createDataFrame(rows, "a string, b string, e double").select("e", F.round(jaro_winkler(F.col("a"), F.col("b")), 6).alias("s")).collect()
    assert all(r.s == r.e for r in got), got


def test_strip_diacritics(spark):
    texts = ["Café Ångström", "plain", "", None, "ﬁ"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", strip_diacritics(F.col("x")).alias("y")).orderBy("i").collect()
    assert [r.y for r in got] == [x and "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)) for x in texts]
