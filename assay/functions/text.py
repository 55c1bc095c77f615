"""String helpers: name sanitising, numeric parsing, category normalising."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NUMERIC_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
UNSAFE_NAME_PATTERN = r"[^\w\-_.]"
NUMERIC_SYMBOLS_PATTERN = r"[,()<>=]"
NULL_TOKENS = ["Nan", "None", "null", ""]


def sanitize_name(name: str) -> str:
    """Every character outside word characters, '-', '_' and '.' -> '_'."""
    return re.sub(UNSAFE_NAME_PATTERN, "_", name)


def sanitize_value(c: Column) -> Column:
    return F.regexp_replace(c, UNSAFE_NAME_PATTERN, "_")


def parse_number(c: Column) -> Column:
    """Text -> double; anything that is not a plain number -> null.

    The regex gate keeps Spark from accepting forms DuckDB and pandas reject
    ('1d', 'NaN', 'Infinity').
    """
    t = F.trim(c)
    return F.when(t.rlike(NUMERIC_PATTERN), t.cast("double"))


def strip_numeric_symbols(c: Column) -> Column:
    """Drop , ( ) > < = and the text 'nan' / 'NaN'; empty text reads as '0'."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), NUMERIC_SYMBOLS_PATTERN + "|nan|NaN", "")
    t = F.trim(t)
    return F.when(t == "", F.lit("0")).otherwise(t)


def title_case(c: Column) -> Column:
    """Upper case for every letter that follows no letter, lower case for the others (``str.title``: B-Cell, O'Neil)."""
    runs = F.regexp_extract_all(c, F.lit(r"(?s)(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 2**31 - 1)))), "")


def normalize_target(c: Column) -> Column:
    """C3 (target): trim + upper; null reads as the text 'NAN'."""
    return F.upper(F.trim(F.coalesce(c, F.lit("nan"))))


def normalize_category(c: Column) -> Column:
    """C3 (categories): trim + title case; null tokens -> 'Unknown' (C9)."""
    t = title_case(F.trim(F.coalesce(c, F.lit("nan"))))
    return F.when(t.isin(*NULL_TOKENS), F.lit("Unknown")).otherwise(t)
