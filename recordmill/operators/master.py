"""Blocking: keys, candidate pairs with a cap, and what they cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.functions.text import ngrams, sort_tokens, soundex
from recordmill.operators.cluster import cut, running, sequenced


def block_keys(field: str, strategy: str, n: int = 4) -> Column:
    """An array of ``field:value`` keys; none for a missing value or an unknown strategy."""
    c = F.col(field)
    made = {"exact": lambda: F.array(c), "prefix": lambda: F.array(F.substring(c, 1, max(1, n))), "phonetic": lambda: F.array(soundex(c)), "sorted_tokens": lambda: F.array(sort_tokens(c)), "ngram": lambda: ngrams(c, n)}.get(strategy)
    none = F.expr("cast(array() as array<string>)")
    if made is None:
        return none
    keyed = F.transform(F.filter(made(), lambda x: x != ""), lambda x: F.concat(F.lit(f"{field}:"), x))
    return F.when(c.isNull(), none).otherwise(keyed)


def blocks(records: DataFrame, id_col: str, keys: list[Column]) -> DataFrame:
    return records.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.flatten(F.array(*keys)))).alias("block"))


#: Records of a block that are held in one row; larger blocks are split into tiles of about so many.
CHUNK = 256
#: Tile pairs that one row is unfolded into.
RANGE = 4096


def block_sizes(blocked: DataFrame) -> DataFrame:
    return blocked.groupBy("block").agg(F.count("*").alias("n"))


def keyed(blocked: DataFrame) -> DataFrame:
    """(id, keys, block): every record with all of its keys, sorted, in each of its blocks; rows without id or block are left out."""
    keys = blocked.where("id is not null and block is not null").groupBy("id").agg(F.sort_array(F.collect_set("block")).alias("keys"))  # one record's keys
    return keys.select("id", "keys", F.explode("keys").alias("block"))


def _first_common(block: str, l: str, r: str) -> Column:  # noqa: E741
    """Whether ``block`` is the least key that two records share: a pair that meets in several blocks counts in one only."""
    alone = (F.size(f"{l}.keys") == 1) | (F.size(f"{r}.keys") == 1)
    return alone | (F.array_min(F.array_intersect(f"{l}.keys", f"{r}.keys")) == F.col(block))


def _packed(rows: DataFrame, tile: Column) -> DataFrame:
    """(block, tile, members): about a tile's size of records in one row."""
    return rows.groupBy("block", tile.alias("tile")).agg(F.collect_list(F.struct("id", "keys")).alias("members"))


def tile_pairs(blocks_: DataFrame) -> DataFrame:
    """(block, x, y), x <= y, of the tiles 0 to k - 1 of each (block, k).

    Pair number m stands for y = the largest number with y (y + 1) / 2 <= m and x = what is left, so ranges of numbers
    are dealt to tasks and no block's pairs come from one row or from a join of the block with itself.
    """
    total = "k * (k + 1) div 2"
    ranges = blocks_.select("block", F.col("k").cast("long").alias("k")).selectExpr("block", f"{total} as total", f"explode(sequence(0L, ({total} - 1) div {RANGE})) as part").repartition("block", "part")
    numbers = ranges.selectExpr("block", f"explode(sequence(part * {RANGE}, least(total, (part + 1) * {RANGE}) - 1)) as m")
    # The root is off by one at most, for numbers that doubles don't hold.
    root = numbers.selectExpr("block", "m", "cast(floor((sqrt(8.0D * m + 1) - 1) / 2) as long) as y0")
    fixed = root.selectExpr("block", "m", "case when y0 * (y0 + 1) div 2 > m then y0 - 1 when (y0 + 1) * (y0 + 2) div 2 <= m then y0 + 1 else y0 end as y")
    return fixed.selectExpr("block", "m - y * (y + 1) div 2 as x", "y")


def _unfolded(rows: DataFrame) -> DataFrame:
    """Pairs l < r of ``rows`` (block, a, b), the members of two tiles, each in the least block of both."""
    each = rows.select("block", F.explode("a").alias("l"), "b").select("block", "l", F.explode("b").alias("r"))
    return each.where(_first_common("block", "l", "r")).select(F.least("l.id", "r.id").alias("l"), F.greatest("l.id", "r.id").alias("r"))


def block_pairs(blocked: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Distinct candidate pairs l < r that share a block.

    The records of a block lie in tiles of about ``chunk`` records, by a hash of the ids. A block of one tile is unfolded
    where it lies; the tiles of larger blocks meet by pairs of tiles, numbered and dealt out, so that shuffles carry tiles
    and never pairs. A pair comes out of the least block that both records are in, so nothing is made twice and no
    ``distinct`` is needed.
    """
    return _all_pairs(keyed(blocked), chunk)


def _all_pairs(entries: DataFrame, chunk: int) -> DataFrame:
    sizes = block_sizes(entries).where("n > 1").select("block", F.ceil(F.col("n") / chunk).cast("int").alias("k"))
    rows = entries.join(sizes, "block")
    # Two records of one tile would be unfolded in both orders.
    own = _packed(rows, F.pmod(F.xxhash64("id"), F.col("k")).cast("long"))
    inside = own.select("block", F.col("members").alias("a"), F.col("members").alias("b"))
    within = inside.select("block", F.explode("a").alias("l"), "b").select("block", "l", F.explode("b").alias("r")).where(F.col("l.id") < F.col("r.id"))
    within = within.where(_first_common("block", "l", "r")).select(F.col("l.id").alias("l"), F.col("r.id").alias("r"))
    met = tile_pairs(sizes.where("k > 1")).where("x < y")
    a, b = (own.select("block", F.col("tile").alias(t), F.col("members").alias(m)) for t, m in (("x", "a"), ("y", "b")))
    return within.unionByName(_unfolded(met.join(a, ["block", "x"]).join(b, ["block", "y"])))


def _least_pairs(entries: DataFrame, most: int, chunk: int) -> DataFrame:
    """The least ``most`` pairs (l, r), from the least records that have so many.

    Records are ranked in their blocks by id. A record has at least as many partners above it as its largest rest of a
    block; these are summed up in the order of the ids until ``most`` are reached, and only records up to there look for
    partners. So at most (``most`` + the largest block) * keys of a record pairs are made, however large the blocks are.
    """
    placed = sequenced(entries, [F.col("block"), F.col("id")], "place")
    sizes = placed.groupBy("block").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = placed.join(sizes, "block").select("id", "keys", "block", "n", (F.col("place") - F.col("first")).alias("rank"))
    rests = rows.groupBy("id").agg(F.max(F.col("n") - 1 - F.col("rank")).alias("rest")).where("rest > 0")
    last = running(rests, [F.col("id")], "rest", "sum").where(F.col("sum") >= most).agg(F.min("id").alias("last"))  # one row
    lows = rows.where(F.col("rank") + 1 < F.col("n")).crossJoin(F.broadcast(last)).where("last is null or id <= last")
    lows = lows.select(F.struct("id", "keys").alias("l"), "block", F.explode(F.expr(f"sequence((rank + 1) div {chunk}, (n - 1) div {chunk})")).alias("tile"))
    tiles = _packed(rows, F.expr(f"rank div {chunk}"))
    each = lows.join(tiles, ["block", "tile"]).select("block", "l", F.explode("members").alias("r")).where(F.col("l.id") < F.col("r.id"))
    pairs = each.where(_first_common("block", "l", "r")).select(F.col("l.id").alias("l"), F.col("r.id").alias("r"))
    return sequenced(pairs, [F.col("l"), F.col("r")], "place").where(F.col("place") <= most).select("l", "r")


def candidates(blocked: DataFrame, most: int = 500_000, chunk: int = CHUNK, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """The least ``most`` pairs (l, r), and one row: candidate_pairs, truncated, blocks_examined, largest_block.

    With ``whole`` all pairs, of which ``truncated`` then only says that there are ``most`` or more.

    As in the specification, ``truncated`` also holds if there are just as many pairs as allowed. The blocks' sizes say
    before any pair is made whether the cap can be reached; if so, the pairs that it leaves out are never made.
    """
    most = max(1, most)
    entries = cut(keyed(blocked))
    known = block_stats(entries)
    few = whole or block_cost(entries).head()[0] < most
    kept = cut(_all_pairs(entries, chunk) if few else _least_pairs(entries, most, chunk))
    found = kept.agg(F.count("*").alias("candidate_pairs")).withColumn("truncated", F.col("candidate_pairs") >= most)
    return kept, found.crossJoin(F.broadcast(known.select(F.col("blocks").alias("blocks_examined"), "largest_block")))  # one row each


def block_stats(blocked: DataFrame) -> DataFrame:
    return block_sizes(blocked).agg(F.count("*").alias("blocks"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_block"))


def block_cost(blocked: DataFrame) -> DataFrame:
    """Pairs within blocks, counted from the blocks' sizes: what comparing costs before any pair is made."""
    return block_sizes(blocked).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).cast("long").alias("pairs"))


def comparisons(records: DataFrame) -> DataFrame:
    """All pairs of the records, which blocking saves from being compared."""
    return records.agg(F.count("*").alias("records")).select("records", F.expr("records * (records - 1) div 2").alias("exhaustive"))
