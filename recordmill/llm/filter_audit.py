"""Filter interaction audit: what each filter removes after every set of others, by a depth-first walk of the permutation trie.

A node of the trie is a prefix of an order of filters. What survives a prefix doesn't depend on the order inside it, so
nodes are memoised by their set: n filters have n! orders but 2**n sets, and n * 2**(n-1) edges. A node's survivors are
a persisted DataFrame made by one filter from those of its parent, released when the walk leaves the node; at most n are
held at once, and a lost executor's part is filtered again from the staged rows. At each node one aggregation counts what
every filter that is still open would remove from it: the node's edges.

Counts are summed by part before the shuffle, so a hot part costs a row for each task. Parts aren't collected.
"""

from __future__ import annotations

import math
import uuid
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import adopt, shared_dir, staged

SPACE = " \t\n\x0b\x0c\r"
#: Filters that ``trie_edges`` takes; 12 have 4,096 states, each of them a job.
MOST_FILTERS = 12


def trie_edges(rows: DataFrame, part: str, fails: dict[str, str], marks: dict[str, str] | None = None, name: str = "audit") -> DataFrame:
    """(part, state, filter, alive, removed, lost_<mark>...) of every edge from which rows of a part go on.

    ``fails`` names the boolean column of each filter, true where a row fails it; ``marks`` names boolean columns whose
    removals are counted too. Null counts as false. ``state`` has bit i set where the filter number i of ``fails`` was
    applied before; ``alive`` counts what reaches the edge. A part that nothing is left of has no row for that state.
    """
    names, marks = list(fails), marks or {}
    if not 0 < len(names) <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters")
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/recordmill/{name}-edges-{uuid.uuid4().hex}"
    full, seen = (1 << len(names)) - 1, set()
    fails_of = {f: F.coalesce(F.col(fails[f]), F.lit(False)) for f in names}
    marked = {m: F.coalesce(F.col(c), F.lit(False)) for m, c in marks.items()}

    def visit(state: int, survivors: DataFrame) -> None:
        seen.add(state)
        left = [i for i in range(len(names)) if not state >> i & 1]
        counts = [F.count("*").alias("alive")]
        for i in left:
            gone = fails_of[names[i]]
            counts += [F.count_if(gone).alias(f"r{i}"), *[F.count_if(gone & c).alias(f"r{i}_{m}") for m, c in marked.items()]]
        edge = lambda i: F.struct(F.lit(names[i]).alias("filter"), F.col(f"r{i}").alias("removed"), *[F.col(f"r{i}_{m}").alias(f"lost_{m}") for m in marked])
        table = survivors.groupBy(F.col(part).alias("part")).agg(*counts).select("part", "alive", F.explode(F.array(*[edge(i) for i in left])).alias("e")).select("part", "alive", "e.*")
        table.write.parquet(f"{path}/state={state}")
        for i in left:
            after = state | 1 << i
            if after != full and after not in seen:
                child = survivors.where(~fails_of[names[i]]).persist(StorageLevel.MEMORY_AND_DISK)
                visit(after, child)
                child.unpersist()

    visit(0, rows)
    schema = "part string, alive long, filter string, removed long, " + "".join(f"lost_{m} long, " for m in marked) + "state int"
    return adopt(spark.read.schema(schema).parquet(path), path)


def all_orders(edges: DataFrame, parts: DataFrame, filters: list[str], marks: list[str]) -> DataFrame:
    """One row for each part, order of the filters and step, zeros included; ``parts`` has the distinct values of ``part``.

    kept, removed, redundant, unique_fails, lost_<mark>... and shapley (a filter's removals summed over all orders).
    """
    n, full = len(filters), (1 << len(filters)) - 1
    every = [(s, f, full ^ 1 << i, math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count())) for s in range(full + 1) for i, f in enumerate(filters) if not s >> i & 1]
    grid = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(others).alias("others"), F.lit(w).cast("long").alias("weight")) for s, f, others, w in every]))
    found = parts.select("part", grid.alias("g")).select("part", "g.*").join(edges, ["part", "state", "filter"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    lost = [f"lost_{m}" for m in marks]
    found = found.select("part", "state", "filter", "others", "weight", *[zero(c).alias(c) for c in ("alive", "removed", *lost)])
    own = W.partitionBy("part", "filter")  # as many rows as there are states
    at = lambda state: F.max(F.when(F.col("state") == state, F.col("removed"))).over(own)
    told = found.select("*", at(F.lit(0)).alias("fails"), at(F.col("others")).alias("unique_fails"), F.sum(F.col("weight") * F.col("removed")).over(own).alias("shapley"))
    bit = {f: 1 << i for i, f in enumerate(filters)}
    steps = [("".join(o), k + 1, sum(bit[x] for x in o[:k]), f) for o in permutations(filters) for k, f in enumerate(o)]
    orders = parts.sparkSession.createDataFrame(steps, "filter_order string, step int, state int, filter string")
    out = told.join(F.broadcast(orders), ["state", "filter"])  # n! * n rows, 600 for five filters
    return out.select("part", "filter_order", "step", (F.col("alive") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *lost, "shapley")


def failures(docs: DataFrame, shortest: int = 100, distinct: int = 80, capitals: int = 10) -> DataFrame:
    """doc_id, part and failA to failE of each row: short, repetitive, in capitals, with symbols, and text that a smaller id has too.

    Null text counts as empty and null lang as ''. Rows with a null id, and rows that repeat the smallest id of their
    text, don't fail E. Texts are compared by their SHA-256. Copies are joined to the least id of their text, which only
    texts under several ids have; a text that most rows share is split by the skew join.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("t"))
    bare = F.btrim("t", F.lit(SPACE))
    words, none = F.split(bare, r"[\x20\x09-\x0D]+", -1), (bare == "").cast("int")
    n, different = F.size(words) - none, F.size(F.array_distinct(words)) - none
    upper = F.size(F.split("t", "[A-Z]", -1)) - 1
    facts = own.select(
        "doc_id", "part", (n < shortest).alias("failA"), (100 * different < distinct * n).alias("failB"), (100 * upper > capitals * F.length("t")).alias("failC"),
        F.col("t").rlike(r"[#$%&*|]").alias("failD"), F.unhex(F.sha2("t", 256)).alias("digest"),
    )
    facts = staged(facts, "audit-facts")
    least = staged(facts.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("digest", "least"), "audit-copies")
    return facts.join(least, "digest", "left").select("doc_id", "part", "failA", "failB", "failC", "failD", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("failE"))


FILTERS = {f: f"fail{f}" for f in "ABCDE"}


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op13: the audit of the five filters by language, with what is lost of good and toxic documents.

    A row of ``docs`` is good or toxic where any row of ``labels`` with its id says 1; a null id has no labels. Repeated rows count each. No rows
    for an empty table. Other columns are ignored.
    """
    said = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("doc_id is not null and (good or toxic)")
    said = staged(said, "audit-labels")
    rows = staged(failures(docs).join(said, "doc_id", "left").drop("doc_id"), "audit-rows")
    edges = trie_edges(rows, "part", FILTERS, {"good": "good", "toxic": "toxic"})
    out = all_orders(edges, rows.select("part").distinct(), list(FILTERS), ["good", "toxic"])
    return out.withColumnsRenamed({"lost_good": "good_lost", "lost_toxic": "toxic_lost"})


def oracle() -> str:
    """DuckDB's form: rows by the set of filters that they fail, against all orders."""
    return r"""with d as (select doc_id, coalesce(text, '') t, coalesce(lang, '') part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
 l as (select doc_id, max(quality) = 1 good, max(toxic) = 1 toxic from labels group by 1),
 f as (select part, (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::int
   + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(d.doc_id > min(d.doc_id) over (partition by t), false)::int mask, coalesce(good, false) good, coalesce(toxic, false) toxic from d left join l using (doc_id)),
 m as (select part, mask, count(*) n, count(*) filter (good) g, count(*) filter (toxic) x from f group by all),
 v as (select unnest(['A', 'B', 'C', 'D', 'E']) c),
 p as (select a.c || b.c || c.c || d.c || e.c filter_order from v a, v b, v c, v d, v e where len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
 o as (select filter_order, step::int step, substr(filter_order, step, 1) c, 1 << (ascii(substr(filter_order, step, 1)) - 65) b,
   list_sum([0] || list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65)))::int before from p, (select unnest(range(1, 6)) step)),
 r as (select part, filter_order, step, c, sum(n) filter (mask & before = 0 and mask & b = 0) kept, sum(n) filter (mask & before = 0 and mask & b <> 0) removed,
   sum(n) filter (mask & before <> 0 and mask & b <> 0) redundant, sum(n) filter (mask = b) unique_fails, sum(g) filter (mask & before = 0 and mask & b <> 0) good_lost,
   sum(x) filter (mask & before = 0 and mask & b <> 0) toxic_lost from o, m group by all)
 select part, filter_order, step, coalesce(kept, 0)::bigint kept, coalesce(removed, 0)::bigint removed, coalesce(redundant, 0)::bigint redundant, coalesce(unique_fails, 0)::bigint unique_fails,
 coalesce(good_lost, 0)::bigint good_lost, coalesce(toxic_lost, 0)::bigint toxic_lost, coalesce(sum(removed) over (partition by part, c), 0)::bigint shapley from r"""
