"""Encoders: fixed maps, first-seen codes, sorted label codes, one-hot (E*).

Code maps are tables ``(value, code, n)``: one row per distinct value.  They
are numbered on the distinct-value table, never on the rows, by range
partitions and offsets, and reach the rows as a map (few values, or those
that many rows share) or by a join (all others).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.numbering import number_rows
from assay.functions.stats import lookup
from assay.functions.text import sanitize_name


def encode_fixed(c: Column, mapping: Mapping) -> Column:
    """Fixed code map; unmapped values -> null."""
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[c]


def first_seen_map(df: DataFrame, col: str, id_col: str) -> DataFrame:
    """``value, code, n``: codes in order of first appearance (smallest id), rows per value; null is a value too."""
    firsts = df.groupBy(F.col(col).alias("value")).agg(F.min(id_col).alias("__first"), F.count(F.lit(1)).alias("n"))
    return number_rows(firsts, ["__first", "value"], name="first-seen", number="code").select("value", "code", "n")


def sorted_code_map(df: DataFrame, col: str) -> DataFrame:
    """``value, code, n``: codes in sorted value order (LabelEncoder / StringIndexer alphabetAsc), null left out."""
    d = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return number_rows(d, ["value"], name="sorted-codes", number="code").select("value", "code", "n")


def apply_code_map(df: DataFrame, col: str, code_map: DataFrame, out: str) -> DataFrame:
    """Code of every row (null-safe, so a null value can carry a code); hot values travel as a map (:func:`lookup`)."""
    weight = "n" if "n" in code_map.columns else None
    m = code_map.select(F.col("value").alias(col), F.col("code").alias(out), *([F.col("n").alias("__n")] if weight else []))
    return lookup(df, m, col, "__n" if weight else None)


def decode(df: DataFrame, code_col: str, code_map: DataFrame, out: str) -> DataFrame:
    """Code -> value; codes that many rows hold travel as a map."""
    return lookup(df, code_map.select(F.col("code").alias(code_col), F.col("value").alias(out)), code_col)


def fit_one_hot(df: DataFrame, col: str, max_levels: int = 64) -> list[str]:
    """E5 fit: sorted levels (the schema of the output depends on them).

    The level list is small by construction (run C6 first); the bound is
    checked so a high-cardinality column fails loudly instead of OOM-ing.
    """
    levels = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct()
              .orderBy(col).limit(max_levels + 1).collect()]
    if len(levels) > max_levels:
        raise ValueError(f"{col} has more than {max_levels} levels; cap it with top_k_or_other first")
    return levels


def one_hot(df: DataFrame, col: str, levels: Sequence[str], drop_first: bool = True) -> DataFrame:
    """E5: 0/1 columns ``col_<level>``; the first level is dropped (get_dummies).

    Spark ML's ``OneHotEncoder`` drops the *last* level instead, hence SQL.
    """
    keep = list(levels)[1:] if drop_first else list(levels)
    return df.select("*", *[F.coalesce((F.col(col) == lv).cast("int"), F.lit(0))
                            .alias(sanitize_name(f"{col}_{lv}")) for lv in keep])
