"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Token counts are summed in cells of source, language and topic, and the cells of a sample are raked to each target
marginal in turn, ``rounds`` times. The sample holds the share ``keep`` of all tokens, or the largest share at which every
group has enough tokens for its target: a group that is asked for a tenth of the sample but holds a twentieth of the
corpus allows half. No cell gives more than it has: one that a round asks for more is fixed at all of its tokens, and the
other cells of its groups are raked to what is left, so a small cell that is wanted much doesn't make the sample small. A
document stays with its cell's probability, decided by the MD5 digest of its id, so that repeated rows share their fate.
Where cells contradict each other (a source that has one language only), the targets of the last dimension hold best.

Targets not given are the corpus' own marginals raised to ``temper`` and normalised: large groups give way to small
ones. A target table may leave groups out: they divide what the listed ones leave of 1 in the proportions of their
tempered sizes, and nothing if nothing is left, so their documents get probability 0 but stay in ``mixed``. Listed
groups that no document has are ignored and the rest is normalised; repeated groups add up.

Tokens are estimated as a quarter of the characters, at least one. Null source and language form a group of their own,
``(none)``; null text has one token and topic ``prose``; a null id counts as an empty one. An empty table gives no
rows. Extra columns pass through; where one has a name that is needed here, the new column's name gets underscores
behind it. Only cells and marginals are aggregated, and those partially before the shuffle, so a hot source needs no
further care.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, staged

DIMS = ("source", "lang", "topic")
#: Topics by the first text found; the rest is prose.
TOPICS = (("Licensed under", "licence"), (" | ", "table"), ("@", "contact"), ("token =", "config"))
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.8}


def topic(text: Column) -> Column:
    chain = F
    for needle, name in TOPICS:
        chain = chain.when(text.contains(needle), name)
    return chain.otherwise("prose")


#: Shares that the query asks for; languages that aren't listed divide the rest.
TARGETS = {"lang": {"en": 0.4, "de": 0.2, "fr": 0.15}}


def names(docs: DataFrame) -> list[str]:
    """Names of the columns that ``mixed`` adds: topic, tokens, probability and whether the row is kept."""
    return fresh(docs.columns, "__topic", "__tokens", "__keep", "__kept")


def with_cells(docs: DataFrame, cell: str) -> DataFrame:
    """``docs`` with the struct ``cell``: source, lang, topic and tokens."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    groups = [F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(c) for c in ("source", "lang")]
    tokens = F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long").alias("tokens")
    return docs.select("*", F.struct(*groups, topic(text).alias("topic"), tokens).alias(cell))


def aims(cells: DataFrame, d: str, wanted: DataFrame | None, temper: float) -> DataFrame:
    """(``d``, aim) of every group of ``cells``; the aims add up to 1."""
    own = cells.groupBy(d).agg(F.sum("tokens").alias("t")).withColumn("p", F.pow(F.col("t").cast("double"), F.lit(temper)))
    if wanted is None:
        own = own.withColumn("share", F.lit(None).cast("double"))
    else:
        own = own.join(wanted.groupBy(F.col(d).cast("string").alias(d)).agg(F.sum(F.greatest(F.lit(0.0), F.col("share").cast("double"))).alias("share")), d, "left")
    listed, rest = F.coalesce(F.sum("share"), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("share").isNull(), F.col("p"))), F.lit(0.0))
    sums = F.broadcast(own.agg(listed.alias("listed"), rest.alias("rest"), F.sum("p").alias("all")))  # one row
    left = F.greatest(F.lit(0.0), 1 - F.col("listed"))
    free = F.when(F.col("rest") > 0, left * F.col("p") / F.expr("nullif(rest, 0)")).otherwise(0.0)
    raw = own.crossJoin(sums).select(d, "p", "all", F.coalesce("share", free).alias("x"))
    total = F.broadcast(raw.agg(F.sum("x").alias("sum")))  # one row
    aim = F.when(F.col("sum") > 0, F.col("x") / F.expr("nullif(sum, 0)")).otherwise(F.col("p") / F.col("all"))
    return raw.crossJoin(total).select(d, aim.alias(f"aim_{d}"))


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = 8, temper: dict[str, float] | None = None, keep: float = 0.8) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``w``, the share of the sample, ``factor``, that share over the corpus's, and ``chance``.

    A target has the dimension and ``share``.
    """
    total = cells.agg(F.sum("tokens").alias("total"))
    now = staged(cells.crossJoin(F.broadcast(total)), "mix-cells")  # total is one row
    cells = now
    for d in DIMS:  # from the cells themselves: the joined ones would nest each dimension's plan in the next
        now = now.join(aims(cells, d, (targets or {}).get(d), (temper or TEMPER)[d]), d)
    now = staged(now, "mix-aims")
    # A group holds cells, as many as the other dimensions have combinations, never documents.
    holds = [F.when(F.col(f"aim_{d}") > 0, F.sum("tokens").over(W.partitionBy(d)) / F.col("total") / F.expr(f"nullif(aim_{d}, 0)")) for d in DIMS]
    size = now.select(F.least(*holds).alias("x")).agg(F.least(F.lit(keep), F.coalesce(F.min("x"), F.lit(keep))).alias("size"))
    now = staged(now.crossJoin(F.broadcast(size)).withColumn("x", F.col("tokens") * F.col("size")), "mix-sizes")  # size is one row
    for _ in range(rounds):
        for d in DIMS:
            own = W.partitionBy(d)
            full = F.col("x") >= F.col("tokens")
            wanted, there = F.col("total") * F.col("size") * F.col(f"aim_{d}"), F.sum("x").over(own)
            fixed, free = F.sum(F.when(full, F.col("tokens")).otherwise(0)).over(own), F.sum(F.when(full, 0.0).otherwise(F.col("x"))).over(own)
            less = F.col("x") * wanted / F.nullif(there, F.lit(0.0))
            more = F.when(full, F.col("tokens").cast("double")).otherwise(F.least(F.col("tokens").cast("double"), F.col("x") * (wanted - fixed) / F.nullif(free, F.lit(0.0))))
            now = now.withColumn("x", F.coalesce(F.when(wanted <= there, less).otherwise(more), F.lit(0.0)))
        now = staged(now, "mix-cells")
    chance, share = F.col("x") / F.col("tokens"), F.col("x") / (F.col("total") * F.col("size"))
    return now.select(*DIMS, "tokens", share.alias("w"), (chance / F.col("size")).alias("factor"), chance.alias("chance"))


def uniform(id_: Column) -> Column:
    """52 bits of the id's MD5 digest as a fraction."""
    text = F.coalesce(id_.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def mixed(docs: DataFrame, keep: float = 0.8, targets: dict[str, DataFrame] | None = None, rounds: int = 8) -> DataFrame:
    """Every row of ``docs`` with the columns of ``names``: topic, tokens, probability and whether it is kept."""
    topic_, tokens, chance_, kept = names(docs)
    cell, = fresh([*docs.columns, topic_, tokens, chance_, kept], "__cell")
    rows = with_cells(docs, cell)
    cells = rows.groupBy(*[F.col(f"{cell}.{d}").alias(d) for d in DIMS]).agg(F.sum(f"{cell}.tokens").alias("tokens"))
    chance = rake(cells, targets, rounds, keep=keep).select(F.struct(*DIMS).alias("cell"), "chance")
    joined = rows.join(chance, F.struct(*[F.col(f"{cell}.{d}") for d in DIMS]) == chance["cell"])
    u = uniform(docs["doc_id"])
    return joined.select(*[docs[f"`{c}`"] for c in docs.columns], F.col(f"{cell}.topic").alias(topic_), F.col(f"{cell}.tokens").alias(tokens), chance["chance"].alias(chance_), (u < chance["chance"]).alias(kept))


def mix_digest(docs: DataFrame, shares: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """op8: per row its topic, tokens, probability (six decimals) and whether it is sampled, under the shares of ``TARGETS``."""
    own = docs.select("doc_id", "text", "lang", "source")
    spark = docs.sparkSession
    targets = {d: spark.createDataFrame(list(x.items()), f"{d} string, share double") for d, x in (TARGETS if shares is None else shares).items()}
    return mixed(own, targets=targets).select("doc_id", F.col("__topic").alias("topic"), F.col("__tokens").alias("tokens"), F.round("__keep", 6).alias("probability"), F.col("__kept").alias("sampled"))


def sample_mix(docs: DataFrame) -> DataFrame:
    """Stage: the sampled rows with their columns; all targets are the tempered marginals."""
    *_, kept = names(docs)
    return mixed(docs).where(F.col(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle(rounds: int = 8, keep: float = 0.8) -> str:
    """DuckDB's form of ``mix_digest``: the rounds unrolled."""
    cases = " ".join(f"when contains(coalesce(text,''),'{n}') then '{t}'" for n, t in TOPICS)
    steps = [
        f"d as materialized (select doc_id, coalesce(source,'(none)') source, coalesce(lang,'(none)') lang, case {cases} else 'prose' end topic, greatest(1, ceil(length(coalesce(text,''))/4.0))::bigint tokens from documents)",
        "b as materialized (select source, lang, topic, sum(tokens)::double tokens, (select sum(tokens) from d)::double total from d group by all)",
    ]
    for x in DIMS:
        wanted = " union all ".join(f"select '{g}' g, {v}::double share" for g, v in TARGETS.get(x, {}).items()) or "select null::varchar g, null::double share where false"
        steps.append(f"o_{x} as materialized (select {x}, pow(sum(tokens)::double, {TEMPER[x]}) p, max(t.share) share from b left join ({wanted}) t on t.g = b.{x} group by {x})")
        steps.append(f"x_{x} as materialized (select {x}, coalesce(share, greatest(0, 1 - coalesce(sum(share) over (), 0)) * p / sum(case when share is null then p end) over ()) x from o_{x})")
        steps.append(f"a_{x} as materialized (select {x}, x/sum(x) over () aim_{x} from x_{x})")
    holds = ", ".join(f"sum(tokens) over (partition by {x}) / total / nullif(aim_{x}, 0)" for x in DIMS)
    steps.append("j as materialized (select * from b " + " ".join(f"join a_{x} using ({x})" for x in DIMS) + ")")
    steps.append(f"c0 as materialized (select *, tokens * size x from j, (select least({keep}, min(h)) size from (select least({holds}) h from j)))")
    n = 0
    for _ in range(rounds):
        for d in DIMS:
            inner = f"select *, total * size * aim_{d} wanted, sum(x) over (partition by {d}) there, coalesce(sum(tokens) filter (x >= tokens) over (partition by {d}), 0) fixed, coalesce(sum(x) filter (x < tokens) over (partition by {d}), 0) free from c{n}"
            new = "coalesce(case when wanted <= there then x * wanted / nullif(there, 0) when x >= tokens then tokens else least(tokens, x * (wanted - fixed) / nullif(free, 0)) end, 0)"
            steps.append(f"c{n + 1} as materialized (select source, lang, topic, tokens, total, size, {', '.join(f'aim_{x}' for x in DIMS)}, {new} x from ({inner}))")
            n += 1
    steps.append(f"f as materialized (select source, lang, topic, x / tokens p from c{n})")
    u = "('0x' || substr(md5(coalesce(doc_id::varchar,'')),1,13))::bigint / 4503599627370496.0"
    return "with " + ", ".join(steps) + f" select doc_id, topic, d.tokens, round(p, 6) probability, {u} < p as sampled from d join f using (source, lang, topic)"
