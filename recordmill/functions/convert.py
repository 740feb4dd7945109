"""Conversions of text to numbers, days and codes, and roundings, as Column expressions. What can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampNTZType, TimestampType

from recordmill.functions.text import SPACE

# Names of the first three stages of a deployment.
STAGES = ("Development", "Test", "Production")
# HTTP codes that are tried again.
RETRIED = (408, 429, 500, 502, 503, 504)


def to_number(c: Column, commas: bool = True) -> Column:
    """Text as a double: decimal, exponent or 0x form, blanks (and thousands' commas) left out; blank text is 0, no text and '' null."""
    text = c.cast("string")
    bare = F.regexp_replace(text, f"{SPACE}+|," if commas else f"{SPACE}+", "")
    value = F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))
    value = value.when(bare.rlike(r"^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(bare, 3, 15), 16, 10).cast("double"))
    value = value.when((bare == "") & (text != ""), 0.0)
    return F.when(F.abs(value) < float("inf"), value)


def number(c: Column, kind) -> Column:
    """A column of type ``kind`` as a number: numeric ones as they are, without NaN and infinities, others read as text."""
    if isinstance(kind, NumericType):
        return F.when(F.abs(c.cast("double")) < float("inf"), c) if kind.typeName() in ("double", "float") else c
    return to_number(c)


def to_count(c: Column) -> Column:
    """A finite number, else 0."""
    return F.coalesce(to_number(c, commas=False), F.lit(0.0))


#: Pattern of a text and the format it is read by. Texts of other shapes are no dates.
DATE_FORMATS = (
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
)


def to_time(c: Column) -> Column:
    """Text as a timestamp: ISO forms with or without time and zone, and those of ``DATE_FORMATS``; UTC unless a zone is given."""
    text = F.regexp_replace(F.regexp_replace(c.cast("string"), f"^{SPACE}+|{SPACE}+$", ""), f"{SPACE}+", " ")
    value = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?( ?(Z|[+-]\d{2}:?\d{2}))?)?$"), text.try_cast("timestamp"))
    for shape, form in DATE_FORMATS:
        value = value.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(form)))
    return value


def time(c: Column, kind) -> Column:
    """A column of type ``kind`` as a timestamp: dates and times as they are, numbers as epoch milliseconds, others read as text."""
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return c.cast("timestamp")
    if isinstance(kind, NumericType):
        return F.timestamp_millis(c.cast("long"))
    return to_time(c)


def as_text(c: Column, kind) -> Column:
    """Text of a value; a double without a fraction reads as a whole number."""
    if isinstance(kind, StringType):
        return c
    if isinstance(kind, NumericType) and kind.typeName() in ("double", "float"):
        return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("long").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def half_up(c: Column, digits: int = 0) -> Column:
    """Rounded with halves towards plus infinity."""
    scale = 10**digits
    return F.floor(c.cast("double") * scale + 0.5) / scale


def share(part: Column, total: Column) -> Column:
    """Whole percent of a total, 0 of none."""
    return F.when(total > 0, F.floor(part * 100.0 / total + 0.5).cast("long")).otherwise(F.lit(0).cast("long"))


def status_code(c: Column) -> Column:
    """The HTTP code in a message: three digits in brackets, or named by ``status`` or ``code``, whichever stands first; null outside 100 to 599."""
    bracketed, named = F.lit("[(][0-9]{3}[)]"), F.lit(r"(?i)\b(status|code)\s*[:=]?\s*[0-9]{3}\b")
    at, other = F.regexp_instr(c, bracketed), F.regexp_instr(c, named)
    in_brackets = (at > 0) & ((other == 0) | (at < other))
    code = F.when(in_brackets, F.substr(c, at + 1, F.lit(3))).when(other > 0, F.right(F.regexp_substr(c, named), F.lit(3))).try_cast("int")
    return F.when(code.between(100, 599), code)


def url_path(c: Column) -> Column:
    """The path of an absolute URL, ``/`` for none; other texts as they are."""
    path = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), F.when(path == "", "/").otherwise(path)).otherwise(c)


def stage_name(order: Column) -> Column:
    out = F.when(order.isNull() | (order < 0), "Stage")
    for i, name in enumerate(STAGES):
        out = out.when(order == i, name)
    return out.otherwise(F.concat(F.lit("Stage "), (order + 1).cast("string")))


def size_label(c: Column) -> Column:
    """Bytes in units of 1,024 with one decimal beyond bytes."""
    out = F.when(F.coalesce(c, F.lit(0)) < 1024, F.concat(F.coalesce(c, F.lit(0)).cast("long").cast("string"), F.lit(" B")))
    for i, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(c < 1024 ** (i + 1), F.concat(F.format_string("%.1f", c / 1024.0**i), F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.format_string("%.1f", c / 1024.0**4), F.lit(" TB")))


def retry_delay(status: Column, attempt: Column, retry_after: Column, cap_ms: int = 60_000) -> Column:
    """Milliseconds before attempt ``attempt`` (from 0) is followed by another; null where the code isn't tried again."""
    asked = F.when(retry_after > 0, F.least(retry_after.cast("long") * 1000, F.lit(cap_ms).cast("long")))
    return F.when(status.isin(*RETRIED), F.coalesce(asked, F.least((F.pow(F.lit(2), attempt) * 1000).cast("long"), F.lit(10_000).cast("long"))))


def direction(delta: Column, better: Column) -> Column:
    """unchanged, changed, improved or worsened, by whether ``up``, ``down`` or ``none`` is better."""
    out = F.when(delta.isNull() | (delta == 0), "unchanged").when(better == "none", "changed")
    return out.when(F.when(better == "up", delta > 0).otherwise(delta < 0), "improved").otherwise("worsened")


def json_or(c: Column, schema: str, fallback: Column) -> Column:
    """Parsed JSON, ``fallback`` where it is missing or broken."""
    return F.coalesce(F.from_json(c, schema), fallback)


#: Order of texts as people expect it; the second takes no notice of case and accents.
COLLATION, LOOSE = "UNICODE", "UNICODE_CI_AI"


def leading_number(c: Column) -> Column:
    """The number that a text begins with, in digits, with a point or an exponent; null if it begins with none."""
    found = F.regexp_extract(F.trim(c.cast("string")), r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", 0)
    return F.nullif(found, F.lit("")).try_cast("double")


def cell_order(c: Column, ascending: bool = True) -> list[Column]:
    """Sort columns for the cells of a table: what begins with a number by number and first, then texts regardless of case and accents, then none.

    A pairwise rule (numbers if both are, else texts) is no order where numbers and texts mix; this one agrees with it
    among numbers and among texts.
    """
    number, text = leading_number(c), F.collate(F.trim(c.cast("string")), LOOSE)
    way = (lambda x: x.asc()) if ascending else (lambda x: x.desc())
    kind = F.when(c.isNull(), 2).when(number.isNotNull(), 0).otherwise(1)
    return [way(kind), way(number), way(text)]
