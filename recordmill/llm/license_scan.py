"""License scans by diagonal voting, in DataFrame functions only.

Every run of ``k`` words of every text is hashed and joined to the positions at which templates hold the same run; the
words themselves are compared in the join, so a collision casts no vote. A vote lies on the diagonal
``place in the text - place in the template``, which is where the template would begin. Votes are counted by diagonal.
A phrase needs all its votes on one diagonal. A notice may have been edited: words put in or left out move what follows
to a neighbouring diagonal, so diagonals at most ``gap`` apart are merged, and a merged span is verified by how many of
the template's words, and of the span's own words, lie in runs that matched.

Words are maximal runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. Null text counts as empty and has no
words. Results belong to a row's id and text, so rows that repeat both have equal results, and no row is numbered. Only
votes are shuffled, never texts; the template positions are broadcast, as their number is known before and checked
(beyond ``MOST_POSITIONS`` they are joined by a shuffle).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

#: Template positions that are broadcast at most; 100,000 take a few MB.
MOST_POSITIONS = 100_000
WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """Words of a license text. ``cover`` is the share of its words that must match, 1 for a phrase that stands as it is."""

    label: str
    text: str
    base: bool = False
    cover: float = 1.0

    @property
    def words(self) -> list[str]:
        return self.text.split()


# The phrases of the base.
PHRASES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)
# Opening words of public license notices, and short phrases that name one.
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", cover=0.7),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", cover=0.7),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", cover=0.7),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", cover=0.7),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", cover=0.7),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc0", "cc0 1 0 universal"),
)
TEMPLATES = PHRASES + NOTICES
K, GAP, WITHIN = 2, 4, 0.6


def positions(templates: tuple[Template, ...], k: int) -> list[tuple]:
    """(template, place, its k words) of every run of a template."""
    short = [t.text for t in templates if len(t.words) < k]
    if short:
        raise ValueError(f"templates of fewer than {k} words: {short}")
    return [(n, p, *t.words[p : p + k]) for n, t in enumerate(templates) for p in range(len(t.words) - k + 1)]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, ``key`` (a digest of id and text) and ``words`` of each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = F.concat(F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("")), F.lit("\n"), text)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(own, 256)).alias("key"), F.split(F.translate(text, UPPER, LOWER), WORDS, -1).alias("w"))
    # Only the first and the last piece can be empty.
    first = F.when(F.element_at("w", 1) == "", 2).otherwise(1)
    last = F.size("w") - F.when((F.element_at("w", -1) == "") & (F.size("w") > 1), 1).otherwise(0)
    return rows.select("doc_id", "key", F.slice("w", first, F.greatest(F.lit(0), last - first + 1)).alias("words"))


def votes(rows: DataFrame, templates: tuple[Template, ...], k: int = K) -> DataFrame:
    """(key, t, diagonal, at): by template and diagonal the places ``at`` of the template that the text has there."""
    spark = rows.sparkSession
    own, names = positions(templates, k), [f"t{i}" for i in range(k)]
    grams = spark.createDataFrame(own, "t int, p int, " + ", ".join(f"{n} string" for n in names)).withColumn("h", F.xxhash64(*names))
    if len(own) <= MOST_POSITIONS:
        grams = F.broadcast(grams)
    runs = F.arrays_zip(*[F.slice("words", i + 1, F.size("words")).alias(f"w{i}") for i in range(k)])
    each = rows.select("key", F.posexplode(runs).alias("pos", "x")).select("key", "pos", F.xxhash64(*[F.col(f"x.w{i}") for i in range(k)]).alias("g"), *[F.col(f"x.w{i}").alias(f"w{i}") for i in range(k)])
    same = F.col("g") == F.col("h")
    for i in range(k):
        same = same & (F.col(f"w{i}") == F.col(f"t{i}"))
    # A row that is repeated votes for the same places again, and a set holds each once.
    return each.join(grams, same).groupBy("key", "t", (F.col("pos") - F.col("p")).alias("diagonal")).agg(F.collect_set("p").alias("at"))


def spans(rows: DataFrame, templates: tuple[Template, ...] = TEMPLATES, k: int = K, gap: int = GAP, within: float = WITHIN) -> DataFrame:
    """(key, t, start, stop, cover) of every verified place of a template, in words, ``stop`` exclusive."""
    facts = rows.sparkSession.createDataFrame([(n, len(t.words), float(t.cover)) for n, t in enumerate(templates)], "t int, size int, need double")
    cast = staged(votes(rows, templates, k).join(F.broadcast(facts), "t"), "license-votes")  # a row for each template
    whole = cast.where(F.size("at") == F.col("size") - (k - 1)).select("key", "t", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("size")).alias("stop"), F.lit(1.0).alias("cover"))
    # One word in common is no trace of an edited notice.
    loose = cast.where("need < 1").where(F.size("at") > 1)
    along = W.partitionBy("key", "t").orderBy("diagonal")
    begins = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > gap, F.lit(True))
    grouped = loose.withColumn("begins", begins).withColumn("group", F.sum(F.col("begins").cast("int")).over(along))
    reach = lambda base: F.flatten(F.transform("at", lambda p: F.sequence(base + p, base + p + k - 1)))
    merged = grouped.groupBy("key", "t", "group").agg(  # no more than one text's own votes
        F.first("size").alias("size"), F.first("need").alias("need"), F.max(F.size("at") == F.col("size") - (k - 1)).alias("is_whole"),
        F.array_distinct(F.flatten(F.collect_list(reach(F.lit(0))))).alias("of_template"), F.array_distinct(F.flatten(F.collect_list(reach(F.col("diagonal"))))).alias("of_text"),
    )
    start, stop = F.array_min("of_text"), F.array_max("of_text") + 1
    cover = F.size("of_template") / F.col("size")
    edited = merged.where(~F.col("is_whole")).select("key", "t", start.alias("start"), stop.alias("stop"), cover.alias("cover"), "need", (F.size("of_text") / (stop - start)).alias("own"))
    return whole.unionByName(edited.where((F.col("cover") >= F.col("need")) & (F.col("own") >= within)).select("key", "t", "start", "stop", "cover"))


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, label, base, start, stop and cover of every place, in words; repeated rows have their places once."""
    rows = keyed(docs, id_col, text_col)
    names = rows.sparkSession.createDataFrame([(n, t.label, t.base) for n, t in enumerate(templates)], "t int, label string, base boolean")
    ids = rows.select("key", "doc_id").dropDuplicates(["key"])
    return spans(rows, templates).join(F.broadcast(names), "t").join(ids, "key").select("doc_id", "label", "base", "start", "stop", "cover")


def license_digest(docs: DataFrame) -> DataFrame:
    """op12: per row its words, the base's places and labels, all labels, and as score the best cover of a verified place."""
    rows = keyed(docs, "doc_id", "text")
    names = rows.sparkSession.createDataFrame([(n, t.label, t.base) for n, t in enumerate(TEMPLATES)], "t int, label string, base boolean")
    base = lambda c: F.when(F.col("base"), c)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans(rows).join(F.broadcast(names), "t").groupBy("key").agg(
        F.count_if("base").alias("n_base"), F.min(base(F.col("start"))).alias("first_word"), F.max(base(F.col("start"))).alias("last_word"),
        joined(base(F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"), F.round(F.max("cover"), 6).alias("score"),
    )
    found = staged(found, "license-found")
    told = lambda c, other: F.coalesce(F.col(c), F.lit(other)).alias(c)
    return rows.select("doc_id", "key", F.size("words").cast("long").alias("n_words")).join(found, "key", "left").select(
        "doc_id", "n_words", told("n_base", 0), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"), told("base_labels", ""), told("labels", ""), told("score", 0.0)
    )


def oracle() -> str:
    """DuckDB's form: the same votes, merged and verified."""
    grams = ", ".join(f"({t}, {p}, '{a}', '{b}')" for t, p, a, b in positions(TEMPLATES, 2))
    facts = ", ".join(f"({n}, '{t.label}', {t.base}, {len(t.words)}, {t.cover})" for n, t in enumerate(TEMPLATES))
    return rf"""with d as materialized (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
 g(t, p, a, b) as (values {grams}), f(t, label, base, size, need) as (values {facts}),
 e as (select r, i, w[i + 1] a, w[i + 2] b from (select r, w, unnest(range(0, len(w) - 1)) i from d)),
 v as (select r, t, i - p diagonal, list(p) ps from e join g using (a, b) group by all),
 x as (select v.*, label, base, size, need, len(ps) = size - 1 whole from v join f using (t)),
 s as (select *, sum(n) over (partition by r, t order by diagonal) k from (select *, case when diagonal - lag(diagonal) over (partition by r, t order by diagonal) <= {GAP} then 0 else 1 end n from x where need < 1 and len(ps) > 1)),
 m as (select r, t, k, label, base, max(size) size, max(need) need, bool_or(whole) is_whole, list_distinct(flatten(list(list_concat(ps, list_transform(ps, lambda p: p + 1))))) a,
   list_distinct(flatten(list(list_concat(list_transform(ps, lambda p: p + diagonal), list_transform(ps, lambda p: p + diagonal + 1))))) b from s group by r, t, k, label, base),
 o as (select r, label, base, diagonal as start, 1.0::double cover from x where whole
   union all select r, label, base, list_min(b), len(a) / size::double from m where not is_whole and len(a) / size::double >= need and len(b) / (list_max(b) + 1 - list_min(b))::double >= {WITHIN}),
 z as (select r, count(*) filter (base) n_base, min(start) filter (base) first_word, max(start) filter (base) last_word, list_sort(list(distinct label) filter (base)) bl, list_sort(list(distinct label)) al, round(max(cover), 6) score from o group by r)
 select doc_id, len(w)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word, coalesce(array_to_string(bl, ','), '') base_labels, coalesce(array_to_string(al, ','), '') labels, coalesce(score, 0.0)::double score from d left join z using (r)"""
