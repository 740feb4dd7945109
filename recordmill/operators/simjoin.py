"""Similarity joins at a threshold: token sets by prefix filters, texts by segments. Exact, and never every row with every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.functions.text import edit_similarity
from recordmill.operators import master

#: Of the rounding of thresholds: 0.2 * 5 counts as 1.
SLACK = 1e-9


def prefixes(sets: DataFrame, least: float) -> DataFrame:
    """(id, n, token): of each set of ``sets`` (id, tokens) its rarest tokens, so many that similar sets share one.

    Sets of n and m tokens with a Jaccard similarity of ``least`` or more share at least ceil(least * n) tokens, so of
    each set's tokens in one common order the first n - ceil(least * n) + 1 hold a shared one. Rarest first keeps the
    groups small. An empty set has the token '' and n = 0.
    """
    flat = sets.select("id", F.size("tokens").alias("n"), F.explode_outer("tokens").alias("token")).withColumn("token", F.coalesce("token", F.lit("")))
    often = flat.groupBy("token").agg(F.count("*").alias("often"))
    ordered = flat.join(often, "token").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("t"))  # one set
    keep = F.greatest(F.lit(1), F.col("n") - F.ceil(F.col("n") * least - SLACK) + 1).cast("int")
    return ordered.select("id", "n", F.explode(F.slice("t", F.lit(1), keep)).alias("x")).select("id", "n", "x.token")


def token_sets(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"\s+"), lambda x: x != ""))


def jaccard_join(sets: DataFrame, least: float) -> DataFrame:
    """(l, r, score) of all pairs l < r of ``sets`` (id, tokens: distinct) whose Jaccard similarity is at least ``least`` (over 0).

    Sets meet under the tokens of their prefixes; sizes too far apart are dropped where pairs are made, and each pair is
    made once. Rows without id or tokens take no part; two empty sets are alike.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    sets = sets.where("id is not null and tokens is not null").select("id", "tokens")
    blocked = prefixes(sets, least).select(F.struct("id", "n").alias("id"), F.col("token").alias("block"))
    near = F.least("l.n", "r.n") >= F.greatest("l.n", "r.n") * least - SLACK
    pairs = master.block_pairs(blocked).where(near).select(F.col("l.id").alias("l"), F.col("r.id").alias("r"))
    a, b = (sets.select(F.col("id").alias(s), F.col("tokens").alias(t)) for s, t in (("l", "a"), ("r", "b")))
    shared = F.size(F.array_intersect("a", "b"))
    union = F.size("a") + F.size("b") - shared
    scored = pairs.join(a, "l").join(b, "r").select("l", "r", F.when(union == 0, 1.0).otherwise(shared / union).alias("score"))
    return scored.where(F.col("score") >= least - SLACK)


def edit_join(texts: DataFrame, least: float) -> DataFrame:
    """(l, r, score) of all pairs l < r of ``texts`` (id, text) with 1 - distance / longer length >= ``least`` (over 0).

    The longer text of a pair, of m characters, allows d = floor((1 - least) * m) edits. The shorter one is cut into d + 1
    segments, of which the edits leave one whole, and the longer one holds it close to the segment's own place: segment i
    (from 0) can't have moved by more than i, nor, seen from the end, by more than d - i. Texts meet by an equal segment
    under an equal (length, d, i), and the exact distance decides. Rows without id or text take no part.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    rows = texts.where("id is not null and text is not null").select("id", "text", F.length("text").alias("n"))
    edits = lambda n: f"cast(floor({1 - least} * {n} + {SLACK}) as int)"
    # Segments are as even as can be; the longer ones come last.
    cut = ("n div (d + 1)", "(d + 1 - n % (d + 1))")
    place = f"i * ({cut[0]}) + greatest(0, i - {cut[1]})"
    size = f"cast({cut[0]} + if(i >= {cut[1]}, 1, 0) as int)"
    grid = rows.selectExpr("id", "text", "n", f"explode(sequence({edits('n')}, {edits(f'floor(n / {least} + {SLACK})')})) as d").selectExpr("id", "text", "n", "d", "explode(sequence(0, d)) as i")
    own = grid.selectExpr("id as id1", "text as text1", "n", "d", "i", f"substr(text, cast({place} as int) + 1, {size}) as part")
    probe = rows.withColumnsRenamed({"id": "id2", "text": "text2", "n": "m"}).selectExpr("id2", "text2", "m", f"{edits('m')} as d").selectExpr("id2", "text2", "m", "d", "explode(sequence(greatest(0, m - d), m)) as n")
    probe = probe.selectExpr("*", "explode(sequence(0, d)) as i").selectExpr("*", f"cast({place} as int) as p", f"{size} as s")
    low, high = "greatest(0, p - i, p + m - n - (d - i))", "least(m - s, p + i, p + m - n + (d - i))"
    probe = probe.where(f"{low} <= {high}").selectExpr("id2", "text2", "m", "n", "d", "i", "s", f"explode(sequence({low}, {high})) as at").selectExpr("id2", "text2", "m", "n", "d", "i", "substr(text2, at + 1, s) as part").distinct()
    met = own.join(probe, ["n", "d", "i", "part"]).where("id1 <> id2 and (n < m or id1 < id2)")
    alike = met.where(F.levenshtein("text1", "text2", 1 << 20) <= F.col("d"))
    out = alike.select(F.least("id1", "id2").alias("l"), F.greatest("id1", "id2").alias("r"), edit_similarity(F.col("text1"), F.col("text2")).alias("score"))
    return out.where(F.col("score") >= least - SLACK).distinct()
