"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong parts are the base patterns (``assign``, ``access``, ``hex``). Weak parts (an account name, an unlabelled
40-character key, an endpoint) are common in harmless text, so one is reported only when parts of complementary roles
occur within ``scope`` characters: a strong part of another role, or weak parts of both other roles. The link is an
interval join evaluated as nearest-neighbour windows over the parts of one row, so no pairs are formed.

Null or empty text has no parts. Rows are kept one to one, repeated and null ids included; other input columns are
ignored. Ties at one start are ordered by kind in the order of KINDS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

# Fixed patterns of the base kinds: pattern, minimum length, group that the minimum is asked of.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    "access": (r"AKIA[A-Z0-9]+", 16, 0),
    "hex": (r"[0-9a-f]{32,}", 32, 0),
}
WEAK = {
    "account": (r"""(?i)(?:user(?:_?name)?|login|client_?id|account)["']?\x20?[:=]\x20?["']?[A-Za-z0-9_.@-]{3,}""", 0, 0),
    "opaque": (r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", 40, 0),
    "endpoint": (r"""(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3|ftp)://[^\s"'<>]+""", 0, 0),
}
KINDS = [*BASE, *WEAK]
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "account": "identifier", "opaque": "secret", "endpoint": "endpoint"}
#: Cheap necessary conditions, so that most texts skip the extraction.
HINT = {"assign": r"(?i)(?:passw|secret|token|api_?key)", "account": r"(?i)(?:user|login|client_?id|account)", "endpoint": "://"}
PIECES = "array<struct<k:int,p:int,m:int,ok:boolean>>"


def _pieces(text: Column, kind: str) -> Column:
    """One entry for each match of a kind: the lengths of the text before it and of itself, and whether it is long enough."""
    pattern, least, group = (BASE | WEAK)[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("p"), found.alias("m"), sizes.alias("g"))
    number = F.lit(KINDS.index(kind)).alias("k")
    made = F.transform(parts, lambda x: F.struct(number, F.length(x["p"]).alias("p"), F.length(x["m"]).alias("m"), (F.length(x["g"]) >= least).alias("ok")))
    hint = text.contains(HINT[kind]) if kind == "endpoint" else text.rlike(HINT.get(kind, pattern))
    return F.when(hint, made).otherwise(F.expr(f"cast(array() as {PIECES})"))


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``row`` (a number of the row's own), s, k (kind number) and e of every part, in code points; a row without any has one with nulls.

    Starts are running sums over a kind's matches, so a text with many parts costs no more for each.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    found = own.select("doc_id", F.flatten(F.array(*[_pieces(F.col("t"), k) for k in KINDS])).alias("parts")).withColumn("row", F.monotonically_increasing_id())
    found = staged(found, "secret-parts")  # a task that runs again must not number its rows anew
    flat = found.select("doc_id", "row", F.posexplode_outer("parts").alias("i", "x")).repartition("row")
    # The matches of a kind lie side by side in the array, in the text's order.
    before = W.partitionBy("row", "x.k").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = flat.select("doc_id", "row", F.col("x.k").alias("k"), "x.m", "x.ok", F.sum(F.col("x.p") + F.col("x.m")).over(before).cast("int").alias("e"))
    return ends.select("doc_id", "row", (F.col("e") - F.col("m")).alias("s"), "k", "e", F.coalesce("ok", F.lit(False)).alias("ok"))


def link_parts(found: DataFrame, scope: int = 200) -> DataFrame:
    """One row per row that was searched: id, ``base`` and ``spans`` (sorted arrays); weak parts only where linked.

    Both sides of a part are seen by frames that begin at an end of the text, so each part costs the same.
    """
    rows = found.withColumn("k", F.when(F.col("ok"), F.col("k")))
    ahead = W.partitionBy("row").orderBy("s", "k", "e").rowsBetween(W.unboundedPreceding, -1)
    behind = W.partitionBy("row").orderBy(F.desc("s"), F.desc("k"), F.desc("e")).rowsBetween(W.unboundedPreceding, -1)
    strong = F.col("k") < len(BASE)
    role = F.lit(None).cast("string")
    for number, kind in enumerate(KINDS):
        role = F.when(F.col("k") == number, ROLE[kind]).otherwise(role)
    rows = rows.withColumn("role", role)
    roles = ("identifier", "secret", "endpoint")
    chosen = {f"any_{r}": F.col("role") == r for r in roles} | {f"strong_{r}": strong & (F.col("role") == r) for r in roles}
    rows = rows.select("*", *[F.max(F.when(c, F.col("e"))).over(ahead).alias(f"before_{n}") for n, c in chosen.items()])
    rows = rows.select("*", *[F.min(F.when(c, F.col("s"))).over(behind).alias(f"after_{n}") for n, c in chosen.items()])

    def near(name: str) -> Column:
        return F.coalesce(F.col("s") - F.col(f"before_{name}") <= scope, F.lit(False)) | F.coalesce(F.col(f"after_{name}") - F.col("e") <= scope, F.lit(False))

    others = {r: [x for x in roles if x != r] for r in roles}
    linked = F.lit(False)
    for r, (a, b) in others.items():
        linked = linked | ((F.col("role") == r) & (near(f"strong_{a}") | near(f"strong_{b}") | (near(f"any_{a}") & near(f"any_{b}"))))
    span = F.struct("s", "k", "e")
    return rows.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.array_sort(F.collect_list(F.when(strong, span))).alias("base"),
        F.array_sort(F.collect_list(F.when(F.col("k").isNotNull() & (strong | linked), span))).alias("spans"),
    )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """Id, ``base`` and ``spans``: arrays of (start, kind, end) with kinds by name."""
    names = F.array(*[F.lit(k) for k in KINDS])
    linked = link_parts(find_parts(docs, id_col, text_col), scope)
    named = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("start"), F.element_at(names, x["k"] + 1).alias("kind"), x["e"].alias("end")))
    return linked.select("doc_id", named(F.col("base")).alias("base"), named(F.col("spans")).alias("spans"))


def op10(docs: DataFrame) -> DataFrame:
    found = scan_secrets(docs)
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
