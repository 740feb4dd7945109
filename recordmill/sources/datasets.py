"""Sources and sinks: checked projections, reads, dataset schemas and writes."""

from __future__ import annotations

import re
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a side, where a limit is asked for.
MOST_ROWS = 200_000
#: Code of a problem, and the pattern of an author's expression that has it.
FORBIDDEN = {
    "several_statements": r";",
    "line_comment": r"--",
    "block_comment": r"/\*|\*/",
    # Words of statements that change something or reach outside.
    "changes_data": r"(?i)\b(insert|update|delete|drop|alter|create|truncate|merge|exec|execute|grant|revoke|backup|shutdown|waitfor|openrowset|openquery|xp_\w+|sp_\w+)\b",
}
LONGEST = 1000


@dataclass(frozen=True)
class Source:
    """A registered system. ``kind`` is a Spark format; ``base`` the folder, or the URL of a database."""

    name: str
    kind: str = "parquet"
    base: str = ""
    options: dict[str, str] = field(default_factory=dict)
    writable: bool = True


@dataclass(frozen=True)
class Selection:
    value: str
    alias: str = ""
    kind: str = "field"  # or expression


def quote(name: str) -> str:
    """A dotted name in back-ticks; only letters, digits, space and ``_ . $ # @ -`` may occur."""
    if not re.fullmatch(r"[A-Za-z0-9_ .$#@-]+", name):
        raise ValueError(f"bad identifier: {name!r}")
    return ".".join(f"`{part}`" for part in name.split("."))


@dataclass(frozen=True)
class Dialect:
    """What databases write differently: quotation marks, the type of text, and whether CREATE TABLE takes IF NOT EXISTS."""

    marks: tuple[str, str] = ('"', '"')
    text: str = "VARCHAR(4000)"
    guarded: bool = True

    def name(self, dotted: str, split: bool = True) -> str:
        """A checked name in the database's marks; without ``split`` dots belong to the name."""
        parts = [x.strip("`") for x in quote(dotted).split(".")]
        return ".".join(f"{self.marks[0]}{x}{self.marks[1]}" for x in (parts if split else [".".join(parts)]))


ANSI = Dialect()
#: By the word after ``jdbc:`` in a source's address. Spark writes nulls of text to Derby as CLOB, which no other text type there takes.
DIALECTS = {"derby": Dialect(text="CLOB", guarded=False), "sqlserver": Dialect(("[", "]"), "NVARCHAR(4000)", False), "mysql": Dialect(("`", "`")), "oracle": Dialect(text="VARCHAR2(4000)", guarded=False)}


def dialect_of(source: Source) -> Dialect:
    kind = source.base.split(":")[1] if source.base.startswith("jdbc:") else ""
    return DIALECTS.get(kind, ANSI)


def expression_problem(text: str | None) -> str | None:
    """The code of what is wrong with an author's expression (empty, too_long, unbalanced or one of ``FORBIDDEN``), or None."""
    text = (text or "").strip()
    if not text or len(text) > LONGEST:
        return "too_long" if text else "empty"
    for code, pattern in FORBIDDEN.items():
        if re.search(pattern, text):
            return code
    closed = re.sub(r"[^()]", "", text)
    while "()" in closed:
        closed = closed.replace("()", "")
    return "unbalanced" if closed else None


def project(df: DataFrame, selections: list[Selection], limit: int | None = None) -> DataFrame:
    """Only the selected columns and expressions; a positive ``limit`` holds, up to MOST_ROWS."""
    if not selections:
        raise ValueError("nothing is selected")
    out = []
    for s in selections:
        if s.kind == "expression":
            if problem := expression_problem(s.value):
                raise ValueError(f"bad expression: {problem}")
            out.append(F.expr(f"({s.value.strip()})").alias(s.alias or s.value))
        else:
            out.append(F.col(quote(s.value)).alias(s.alias or s.value))
    df = df.select(*out)
    return df.limit(min(limit, MOST_ROWS)) if limit and limit > 0 else df


@dataclass(frozen=True)
class Split:
    """How a database's table is read in parallel: a numeric, date or time column, its range and the number of parts."""

    column: str
    lower: str
    upper: str
    parts: int = 8

    def options(self) -> dict[str, str]:
        return {"partitionColumn": quote(self.column).strip("`"), "lowerBound": str(self.lower), "upperBound": str(self.upper), "numPartitions": str(max(1, self.parts))}


def read(spark: SparkSession, source: Source, dataset: str, split: Split | None = None) -> DataFrame:
    """A dataset, lazily: projections and filters reach its scan or its database, which ``split`` reads in parallel."""
    reader = spark.read.format(source.kind).options(**source.options)
    if source.kind == "jdbc":
        if split is not None:
            reader = reader.options(**split.options())
        return reader.option("url", source.base).option("dbtable", dialect_of(source).name(dataset)).load()
    return reader.load(f"{source.base.rstrip('/')}/{dataset}")


def read_rows(spark: SparkSession, source: Source, dataset: str, selections: list[Selection], limit: int | None = None, split: Split | None = None) -> DataFrame:
    return project(read(spark, source, dataset, split), selections, limit)


def probe(spark: SparkSession, source: Source, dataset: str) -> bool:
    """Whether a dataset can be read at all."""
    read(spark, source, dataset).limit(1).collect()
    return True


def schema(spark: SparkSession, source: Source, datasets: list[str]) -> DataFrame:
    """(dataset, position, name, data_type, nullable) of each column, without reading rows."""
    rows = [(d, i, f.name, f.dataType.simpleString(), f.nullable) for d in datasets for i, f in enumerate(read(spark, source, d).schema)]
    return spark.createDataFrame(rows, "dataset string, position int, name string, data_type string, nullable boolean")


def shape_schema(rows: DataFrame) -> DataFrame:
    """A database's columns (table_schema, table_name, table_type, column_name, data_type, length, precision, scale, is_nullable, position) as datasets with fields."""
    size = F.when(F.col("length") == -1, "(max)").when(F.coalesce("length", F.lit(0)) != 0, F.format_string("(%d)", "length"))
    size = size.when((F.coalesce("precision", F.lit(0)) != 0) & F.col("scale").isNotNull(), F.format_string("(%d,%d)", "precision", "scale")).otherwise("")
    one = F.struct("position", F.col("column_name").alias("name"), F.concat("data_type", size).alias("data_type"), (F.upper("is_nullable") == "YES").alias("nullable"))
    kind = F.when(F.lower(F.coalesce("table_type", F.lit(""))).contains("view"), "View").otherwise("Table")
    grouped = rows.groupBy(F.concat_ws(".", "table_schema", "table_name").alias("name"), kind.alias("kind")).agg(F.collect_list(F.when(F.col("column_name").isNotNull(), one)).alias("f"))
    return grouped.select("name", "kind", F.transform(F.array_sort("f"), lambda x: F.struct(x["name"], x["data_type"], x["nullable"])).alias("fields"))


# The column type that a database gives each Spark type when rows are published.
COLUMN_TYPES = {"boolean": "BIT", "double": "FLOAT", "float": "FLOAT", "byte": "FLOAT", "short": "FLOAT", "integer": "FLOAT", "long": "FLOAT", "decimal": "FLOAT", "timestamp": "DATETIME2", "timestamp_ntz": "DATETIME2", "date": "DATETIME2"}


def parameter_types(df: DataFrame) -> dict[str, str]:
    """The type that each column is written as; nulls and what isn't a number, flag or time as text."""
    return {f.name: COLUMN_TYPES.get(f.dataType.typeName(), "NVARCHAR") for f in df.schema}


def batch_rows(columns: int, asked: int | None = None) -> int:
    """Rows of one insert: a statement takes 2,000 parameters, and ``asked`` can only lower it."""
    most = max(1, 2000 // max(1, columns))
    return max(1, min(asked, most)) if asked else most


def create_statement(dataset: str, columns: list[str], dialect: Dialect = ANSI) -> str:
    """A statement that makes a table of nullable text columns, guarded where the database knows a guard."""
    return f"CREATE TABLE {'IF NOT EXISTS ' if dialect.guarded else ''}{dialect.name(dataset)} ({', '.join(f'{dialect.name(c, False)} {dialect.text}' for c in columns)})"


@contextmanager
def connection(spark: SparkSession, source: Source):
    """A connection to a database from the driver, for statements; rows never pass through it. Rolled back unless committed."""
    properties = spark._jvm.java.util.Properties()
    for k in ("user", "password"):
        if k in source.options:
            properties.setProperty(k, source.options[k])
    # Spark's own registry loads drivers from its jars and from those added to the session.
    driver = source.options.get("driver") or spark._jvm.java.sql.DriverManager.getDriver(source.base).getClass().getName()
    spark._jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(driver)
    c = spark._jvm.java.sql.DriverManager.getConnection(source.base, properties)
    try:
        c.setAutoCommit(False)
        yield c
    finally:
        c.rollback()
        c.close()


def _execute(c, statement: str) -> bool:
    s = c.createStatement()
    try:
        return s.execute(statement)
    finally:
        s.close()


def table_exists(spark: SparkSession, source: Source, dataset: str) -> bool:
    *schema, table = [x.strip("`") for x in quote(dataset).split(".")]
    with connection(spark, source) as c:
        found = c.getMetaData().getTables(None, schema[-1] if schema else c.getSchema(), table, None)
        try:
            return found.next()
        finally:
            found.close()


def create_table(spark: SparkSession, source: Source, dataset: str, columns: list[str]) -> bool:
    """Make a table of text columns in a database unless it is there; says whether it was made."""
    if not source.writable:
        raise PermissionError(f"{source.name} is read-only")
    if table_exists(spark, source, dataset):
        return False
    with connection(spark, source) as c:
        _execute(c, create_statement(dataset, columns, dialect_of(source)))
        c.commit()
    return True


def run_statements(spark: SparkSession, statements: list[str], source: Source | None = None) -> list[DataFrame]:
    """Run statements in order and stop at the first that fails; the results of those that return rows.

    With a database as ``source`` they run there, in one transaction that a failure takes back, and results are read from
    it by Spark after it is committed; else they run on Spark.
    """
    if source is None or source.kind != "jdbc":
        return [df for s in statements if (df := spark.sql(s)).columns]
    if not source.writable:
        raise PermissionError(f"{source.name} is read-only")
    with connection(spark, source) as c:
        rows = [s for s in statements if _execute(c, s)]
        c.commit()
    return [spark.read.format("jdbc").options(**source.options).option("url", source.base).option("query", s).load() for s in rows]


def publish_staged(df: DataFrame, source: Source, dataset: str, batch: int | None = None) -> int:
    """Replace a database's table so that readers see the old rows or the new ones; says how many were written.

    Executors write a staging table, whose rows are counted against those that Spark wrote, so that a task that ran twice
    can't publish twice; then one transaction empties the target, fills it and drops the staging table. What a run that
    died has left is overwritten by the next one. The target is made if it is missing.
    """
    if not source.writable:
        raise PermissionError(f"{source.name} is read-only")
    spark, d, stage = df.sparkSession, dialect_of(source), f"{dataset}_staged"
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("n")), source, stage, "replace", batch=batch)
    n = seen.get["n"]
    if not table_exists(spark, source, dataset):
        write(df.limit(0), source, dataset, "replace")
    columns = ", ".join(d.name(c, False) for c in df.columns)
    with connection(spark, source) as c:
        s = c.createStatement()
        found = s.executeQuery(f"SELECT COUNT(*) FROM {d.name(stage)}")
        found.next()
        if found.getLong(1) != n:
            raise RuntimeError(f"{found.getLong(1)} staged rows instead of {n}")
        s.close()
        for text in (f"DELETE FROM {d.name(dataset)}", f"INSERT INTO {d.name(dataset)} ({columns}) SELECT {columns} FROM {d.name(stage)}", f"DROP TABLE {d.name(stage)}"):
            _execute(c, text)
        c.commit()
    return n


def write(df: DataFrame, source: Source, dataset: str, mode: str = "append", text_only: bool = False, batch: int | None = None) -> None:
    """``replace`` or ``append``, which adds nothing for no rows. ``text_only`` writes every column as text."""
    if not source.writable:
        raise PermissionError(f"{source.name} is read-only")
    if mode not in ("append", "replace"):
        raise ValueError(f"unknown mode: {mode}")
    if text_only:
        df = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    writer = df.write.format(source.kind).options(**source.options).mode("overwrite" if mode == "replace" else "append")
    if source.kind != "jdbc":
        writer.save(f"{source.base.rstrip('/')}/{dataset}")
        return
    d = dialect_of(source)
    writer.option("url", source.base).option("dbtable", d.name(dataset)).option("truncate", "true").option("batchsize", batch_rows(len(df.columns), batch)).save()
