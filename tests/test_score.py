from recordmill.functions.text import edit_similarity
from recordmill.operators.score import Feature, score_pairs


def test_missing_values_and_required_fields(spark):
    same = lambda a, b: (a == b).cast("double")
    rows = spark.createDataFrame([(1, "ab", "x", 1), (2, "ab", None, 2), (3, "cd", "x", None), (4, None, None, None)], "id int, name string, tag string, n int")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (1, 9)], "l int, r int")

    def scored(*features):
        return {(r.l, r.r): (r.score, r.decision) for r in score_pairs(pairs, rows, "id", list(features)).collect()}

    assert scored(Feature("name", edit_similarity), Feature("tag", same)) == {(1, 2): (1.0, "match"), (1, 3): (0.5, "distinct"), (2, 4): (0.0, "distinct")}
    assert scored(Feature("name", edit_similarity, 0), Feature("tag", same, 1, "neutral"))[1, 2] == (0.75, "review")
    assert scored(Feature("name", edit_similarity), Feature("tag", same, 1, "disagree"))[1, 2] == (0.5, "distinct")
    assert scored(Feature("name", edit_similarity, required=True), Feature("tag", same))[1, 3][1] == "rejected"
    assert scored(Feature("name", edit_similarity, required=True))[2, 4][1] == "rejected"


def test_name_similarities_score_all_pairs(spark):
    from recordmill import plans

    names = {r[0] for r in spark.read.parquet("/root/testdata/sf0.01/part.parquet").select("p_name").distinct().collect()}
    for query in ("edit_similarity", "token_jaccard", "jaro_winkler"):
        pairs = [(r.l, r.r) for r in plans.QUERIES[query](spark, "/root/testdata/sf0.01").collect()]
        assert len(pairs) == 2016 and set(pairs) == {(a, b) for a in names for b in names if a < b}, query
