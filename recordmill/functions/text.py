"""Text standardisers and similarities as Column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: All Unicode white space, as a character class.
SPACE = r"[\s   -     　﻿]"
#: The same characters, one behind the other.
SPACES = "".join(filter(re.compile(SPACE, re.ASCII).match, map(chr, range(1 << 16))))
# Texts that mean "no value".
NULL_TOKENS = ("", "null", "none", "n/a", "na", "nan", "-", "--", "unknown", "undefined", "?")

# Short forms and what they stand for.
ABBREVIATIONS = {
    "st": "street", "str": "street", "rd": "road", "ave": "avenue", "av": "avenue", "blvd": "boulevard",
    "ln": "lane", "dr": "drive", "ct": "court", "sq": "square", "apt": "apartment", "ste": "suite",
    "ltd": "limited", "llc": "limited", "inc": "incorporated", "co": "company", "corp": "corporation",
    "intl": "international", "mfg": "manufacturing", "assoc": "associates", "bros": "brothers",
    "n": "north", "s": "south", "e": "east", "w": "west",
}


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+", " ")


def strip_punctuation(c: Column) -> Column:
    return trim(collapse(F.regexp_replace(c, r"""[.,;:!"'`()\[\]{}/|_*&%$#~^=-]""", " ")))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def alphanumeric(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9]", "")


def sort_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, " "), lambda x: x != "")), " ")


def _decomposed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if not "\u0300" <= c <= "\u036f"))


def strip_diacritics(c: Column) -> Column:
    """Canonical decomposition without its combining marks; Spark has no built-in for it, so it runs in Arrow batches."""
    udf = F.pandas_udf(_decomposed, "string")
    return F.when(c.rlike(r"[^\x00-\x7F]"), udf(c)).otherwise(c)


def expand_abbreviations(c: Column, table: dict[str, str] | None = None) -> Column:
    """Each word found in ``table``, in any case and without its dots, gives way to the long form."""
    known = F.create_map(*[F.lit(x) for pair in (table or ABBREVIATIONS).items() for x in pair])
    long = lambda w: F.coalesce(F.element_at(known, F.lower(F.replace(w, F.lit("."), F.lit("")))), w)
    return F.array_join(F.transform(F.split(c, f"{SPACE}+"), long), " ")


STANDARDISERS: dict[str, Callable[[Column], Column]] = {
    "trim": trim,
    "collapse_whitespace": collapse,
    "upper": F.upper,
    "lower": F.lower,
    "strip_punctuation": strip_punctuation,
    "digits_only": digits,
    "alnum_only": alphanumeric,
    "sort_tokens": sort_tokens,
    "strip_diacritics": strip_diacritics,
    "expand_abbreviations": expand_abbreviations,
}


def is_nullish(c: Column) -> Column:
    return c.isNull() | F.lower(trim(c)).isin(*NULL_TOKENS)


def standardise(c: Column, rules: list[str]) -> Column:
    """Null tokens become null, then the rules in order (unknown ones are ignored); empty results are null."""
    done = reduce(lambda x, r: STANDARDISERS.get(r, lambda y: y)(x), rules, c.cast("string"))
    return F.when(is_nullish(c), None).otherwise(F.nullif(trim(done), F.lit("")))


def normalise_key(c: Column, fold_case: bool = True) -> Column:
    text = F.coalesce(trim(c.cast("string")), F.lit(""))
    return F.lower(text) if fold_case else text


def soundex(c: Column) -> Column:
    letters = F.regexp_replace(F.lower(c), "[^a-z]", "")
    return F.when(letters == "", "").otherwise(F.soundex(letters))


def ngrams(c: Column, n: int = 3) -> Column:
    n = max(2, n)
    made = F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(c, i, F.lit(n)))
    return F.when(F.length(c) >= n, F.array_distinct(made)).otherwise(F.expr("cast(array() as array<string>)"))


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def token_jaccard(a: Column, b: Column) -> Column:
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda x: x != ""))
    union = F.size(F.array_union(words(a), words(b)))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(words(a), words(b))) / union)


def numeric_similarity(a: Column, b: Column, absolute: float = 0.0, relative: float = 0.0) -> Column:
    allowed = F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(a), F.abs(b)))
    d = F.abs(a - b)
    return F.when(d <= allowed, 1.0).when(allowed == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - (d - allowed) / (4 * allowed)))


@lru_cache(100_000)
def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, pairs = list(b), []
    for i, ch in enumerate(a):
        low = max(0, i - reach)
        try:
            at = free.index(ch, low, i + reach + 1)
        except ValueError:
            continue
        free[at] = ""
        pairs.append(at)
    n = len(pairs)
    if not n:
        return 0.0
    matched = "".join(b[at] for at in pairs)
    moved = sum(x != b[at] for x, at in zip(matched, sorted(pairs), strict=True))
    jaro = (n / len(a) + n / len(b) + 1 - moved / 2 / n) / 3
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + same / 10 * (1 - jaro)


def _jaro_winklers(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for l, r in parts:  # noqa: E741
        yield pd.Series([None if a is None or b is None else _jaro_winkler(a, b) for a, b in zip(l, r, strict=True)], dtype="float64")


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler with the prefix bonus at any similarity and half transpositions counted whole; Arrow batches."""
    return F.pandas_udf(_jaro_winklers, "double")(a, b)


def date_similarity(a: Column, b: Column, days: float = 0.0) -> Column:
    """1 if two timestamps lie within ``days`` (fractions count), else 0; unreadable ones are 0."""
    gap = F.abs(F.unix_millis(a) - F.unix_millis(b)) / 86_400_000
    return F.when(gap <= days, 1.0).otherwise(0.0)
