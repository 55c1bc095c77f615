"""Aggregate-expression helpers shared by the fit stages."""

from __future__ import annotations

import math
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Accuracy of the sketch that brackets an exact quantile: a bracket holds about 4 / SKETCH of the rows.
SKETCH = 10_000
#: A bracket reaches so many times the sketch's rank error to both sides, and so many times as far where it misses a rank.
REACH, WIDEN = 2.0, 16.0


def _value(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def local_table(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """A few rows of fitted statistics as a table inside the plan: no job reads it."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=to_arrow_schema(schema)), schema)


def quantile_row(df: DataFrame, spec: Mapping[str, tuple], relative_error: float | None = None,
                 by: str | None = None, lower: bool = False, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Linear-interpolated quantiles (pandas ``quantile`` / DuckDB ``quantile_cont``), exact by default.

    With ``lower``, between two values the lower one (DuckDB ``quantile_disc`` at 0.5).

    ``spec`` maps an output column to ``(column, p)`` (a double) or ``(column, [p, ...])`` (an array).  One row, or one
    row per value of ``by`` (few by contract; a null group is left out).  ``extra`` names further aggregates of ``df`` that
    are computed along with the sketch and returned in the same row.

    The quantiles are fitted at once, like ``approxQuantile``, in two passes, and no task holds the values of a column.  A
    mergeable sketch brackets the wanted ranks: its rank error is at most one in ``SKETCH``, and a bracket reaches ``REACH``
    times as far.  The second pass is one wide aggregate: per point it counts the values below the bracket and at its two
    ends, and keeps the largest value below and the smallest above; only values strictly inside a bracket (at most about
    ``2 * REACH / SKETCH`` of the rows, whatever their ties) are expanded and counted one by one.  The ranks are read off
    these counts.  A bracket that does not hold its rank is seen by the counts and widened.  With ``relative_error`` the
    sketch's answer (``percentile_approx``) is returned after one pass, when the result is read.
    """
    extra = dict(extra or {})
    points = {n: (list(p) if isinstance(p, (list, tuple)) else [p]) for n, (_, p) in spec.items()}
    keys = [by] if by else []
    rows = df.where(F.col(by).isNotNull()) if by else df
    value = {n: _value(c) for n, (c, _) in spec.items()}
    more = [e.alias(k) for k, e in extra.items()]
    if relative_error is not None:
        acc = int(round(1.0 / relative_error))
        out = rows.groupBy(*keys).agg(*[F.percentile_approx(value[n], points[n], acc).alias(n) for n in spec], *more)
        return out.select(*keys, *[F.col(n) if isinstance(spec[n][1], (list, tuple)) else F.col(n)[0].alias(n) for n in spec],
                          *extra)
    slack, found = REACH / SKETCH, None
    while found is None:
        bounds = _bounds(rows, keys, value, points, slack, more)
        found = _ranked(rows.select(*keys, *[value[n].alias(f"__v{i}") for i, n in enumerate(spec)]), bounds, by,
                        list(points.values()), slack)
        slack *= WIDEN
    kinds = [T.StructField(n, T.ArrayType(T.DoubleType()) if isinstance(spec[n][1], (list, tuple)) else T.DoubleType())
             for n in spec]
    out = []
    for row in bounds.collect():
        cell = {}
        for i, n in enumerate(spec):
            got = [_between(found.get((row[by] if by else None, i, k)), lower) for k in range(len(points[n]))]
            cell[n] = got if isinstance(spec[n][1], (list, tuple)) else got[0]
        out.append(cell | {c: row[c] for c in (*keys, *extra)})
    schema = T.StructType([*[bounds.schema[c] for c in keys], *kinds, *[bounds.schema[c] for c in extra]])
    return local_table(df.sparkSession, out, schema)


def _between(cell, lower: bool) -> float | None:
    if cell is None or cell["below"] is None:
        return None
    part = cell["rank"] - math.floor(cell["rank"])
    if part == 0 or lower or cell["below"] == cell["above"]:
        return cell["below"]
    return (1 - part) * cell["below"] + part * cell["above"]


def _bounds(rows: DataFrame, keys: list[str], value: Mapping[str, Column], points: Mapping[str, list], slack: float,
            more: list[Column]) -> DataFrame:
    """First pass: per quantile column, sketched bounds around its points, least and greatest value, and count."""
    ex = []
    for i, n in enumerate(value):
        around = [max(0.0, p - slack) for p in points[n]] + [min(1.0, p + slack) for p in points[n]]
        ex += [F.percentile_approx(value[n], around, SKETCH).alias(f"__v{i}_b"), F.min(value[n]).alias(f"__v{i}_min"),
               F.max(value[n]).alias(f"__v{i}_max"), F.count(value[n]).alias(f"__v{i}_n")]
    fitted = rows.groupBy(*keys).agg(*ex, *more)
    return local_table(rows.sparkSession, [r.asDict(recursive=True) for r in fitted.collect()], fitted.schema)


def _ranked(src: DataFrame, bounds: DataFrame, by: str | None, points: list[list], slack: float) -> dict | None:
    """Second pass: ``(group, column, point) -> rank`` and the values at its floor and ceiling; None if a bracket missed."""
    keys = [by] if by else []
    bounds = bounds.select(*keys, *[c for c in bounds.columns if c.startswith("__v")])

    def bounded(table: DataFrame) -> DataFrame:
        return attach_by(table, bounds, by) if by else attach(table, bounds)
    inner, sides, wide = [], [], []
    inside = F.lit(False)
    for i, ps in enumerate(points):
        v = F.col(f"__v{i}")
        for k, p in enumerate(ps):
            lo = F.col(f"__v{i}_min") if p - slack <= 0 else F.col(f"__v{i}_b")[k]
            hi = F.col(f"__v{i}_max") if p + slack >= 1 else F.col(f"__v{i}_b")[len(ps) + k]
            held = (v > lo) & (v < hi)
            inside = inside | F.coalesce(held, F.lit(False))
            at = [F.lit(i).alias("i"), F.lit(k).alias("k")]
            inner.append(F.when(held, F.struct(*at, v.alias("v"))))
            # these see every row once, in its cell without a value
            every = F.col("c").isNull()
            wide += [F.count_if(every & (v < lo)).alias(f"b{i}_{k}"), F.max(F.when(every & (v < lo), v)).alias(f"x{i}_{k}"),
                     F.count_if(every & (v == lo)).alias(f"l{i}_{k}"), F.count_if(every & (v == hi)).alias(f"h{i}_{k}"),
                     F.min(F.when(every & (v > hi), v)).alias(f"y{i}_{k}")]
            rank = ((F.col(f"__v{i}_n") - 1) * F.lit(float(p))).alias("rank")
            above = F.when(hi > lo, F.col(f"h{i}_{k}")).otherwise(0).cast("long")
            sides += [F.struct(*at, rank, F.lit(s).alias("side"), x.alias("value"), m.alias("n")) for s, x, m in (
                (-1, F.col(f"x{i}_{k}"), F.col(f"b{i}_{k}")), (0, lo, F.col(f"l{i}_{k}")), (0, hi, above),
                (1, F.col(f"y{i}_{k}"), F.lit(1).cast("long")))]
    alone = F.array(F.lit(None).cast("struct<i:int,k:int,v:double>"))
    cells = F.when(inside, F.concat(alone, F.filter(F.array(*inner), lambda x: x.isNotNull()))).otherwise(alone)
    counted = bounded(src).select("*", F.explode(cells).alias("c")).groupBy(*keys, "c").agg(F.count(F.lit(1)).alias("n"), *wide)
    one = F.struct(F.col("c.i").alias("i"), F.col("c.k").alias("k"), F.lit(None).cast("double").alias("rank"), F.lit(0).alias("side"),
                   F.col("c.v").alias("value"), F.col("n").alias("n"))
    seen = bounded(counted).select(*keys, F.inline(F.when(F.col("c").isNull(), F.array(*sides)).otherwise(F.array(one))))
    w = Window.partitionBy(*keys, "i", "k")
    seen = seen.select("*", F.sum("n").over(w.orderBy("side", "value")).alias("upto"), F.max("rank").over(w).alias("r"))
    r, has = F.col("r"), F.col("value").isNotNull()
    picked = seen.groupBy(*keys, "i", "k").agg(
        F.max("rank").alias("rank"), F.min(F.when(has & (F.col("upto") > F.floor(r)), F.col("value"))).alias("below"),
        F.min(F.when(has & (F.col("upto") > F.ceil(r)), F.col("value"))).alias("above"),
        F.sum(F.when(F.col("side") < 0, F.col("n")).otherwise(0)).alias("left_of"),
        F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("held"))
    found = {}
    for c in picked.collect():  # one row per group and point
        # the value below the bracket is the last of left_of, the one above it the first after held
        if c["rank"] is not None and (math.floor(c["rank"]) < c["left_of"] - 1 or math.ceil(c["rank"]) > c["left_of"] + c["held"]):
            return None
        found[(c[by] if by else None, c["i"], c["k"])] = c
    return found


def attach_by(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Make the columns of a table with one row per value of ``key`` available on the rows of that value.

    The table is small by contract (classes, features, levels that are kept).  It travels as one map-valued scalar
    subquery, so the rows are neither shuffled nor joined, and a value that a third of the rows share costs nothing.
    Values that the table lacks, and null, get nulls.
    """
    fields = [c for c in table.columns if c != key]
    entries = table.where(F.col(key).isNotNull()).select(F.struct(
        F.col(key).alias("k"), F.struct(*[F.col(c) for c in fields]).alias("v")).alias("e"))
    packed = entries.agg(F.map_from_entries(F.collect_list("e")).alias("__map")).scalar()
    j = df.select("*", packed.alias("__map"))
    j = j.select(*df.columns, F.when(F.col(key).isNotNull(), F.try_element_at(F.col("__map"), F.col(key))).alias("__row"))
    return j.select(*df.columns, *[F.col("__row").getField(c).alias(c) for c in fields])


#: Keys that travel to the rows as a map: a table of at most so many rows, or the keys with more than one in HEAVY rows each.
HEAVY = 1000
SALTS = 1024


def lookup(df: DataFrame, table: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """The columns of ``table``, which has one row per value of ``key`` and any number of them, on the rows of that value.

    A table of at most ``HEAVY`` rows travels as a map, like :func:`attach_by`.  Of a longer one only the heavy keys do,
    which more than one in ``HEAVY`` rows of ``df`` have each, so that they are fewer than that; ``weight`` names the column of
    ``table`` that holds the rows of ``df`` per key (counted here without it).  All other rows are joined by key, and the
    rows that the map has answered take part with a salt, so that no task meets a key with a large share of the rows.

    Null is a key like any other.  Values that the table lacks get nulls.  ``table`` is read several times: pass a written one.
    """
    fields = [c for c in table.columns if c != key and c != weight]
    packed = F.struct(*[F.col(c) for c in fields])
    head = table.limit(HEAVY + 1).collect()
    small = len(head) <= HEAVY
    if small:
        table = hot = local_table(df.sparkSession, [r.asDict(recursive=True) for r in head], table.schema)
    null_row = table.where(F.col(key).isNull()).agg(F.first(packed).alias("__null")).scalar()
    if not small:
        counts = table.select(key, F.col(weight).alias("__n")) if weight else df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
        heavy = attach(counts, counts.agg(F.sum("__n").alias("__total"))).where(
            F.col(key).isNotNull() & (F.col("__n") * HEAVY > F.col("__total"))).select(F.col(key).alias("__k"))
        hot = table.join(F.broadcast(heavy), F.col(key) == F.col("__k"), "left_semi")
    j = attach_by(df, hot.select(key, packed.alias("__hot")), key)
    j = j.select(*df.columns, F.when(F.col(key).isNull(), null_row).otherwise(F.col("__hot")).alias("__found"))
    if not small:
        plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
        rest = F.col("__found").isNull() & F.col(key).isNotNull()
        j = j.select("*", F.when(rest, F.col(key)).alias("__k"),
                     F.when(rest, 0).otherwise(F.pmod(F.xxhash64(*plain), F.lit(SALTS)) + 1).cast("int").alias("__salt"))
        others = table.where(F.col(key).isNotNull()).select(F.col(key).alias("__k"), F.lit(0).alias("__salt"), packed.alias("__cold"))
        j = j.join(others, ["__k", "__salt"], "left").select(*df.columns, F.coalesce("__found", "__cold").alias("__found"))
    return j.select(*df.columns, *[F.col("__found").getField(c).alias(c) for c in fields])


def one_row(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """Global aggregate -> exactly one row; safe to broadcast (size is fixed)."""
    return df.agg(*[e.alias(k) for k, e in exprs.items()])


def attach(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Make the columns of a one-row statistics table available on every row.

    The whole row travels as ONE struct-valued scalar subquery: Spark runs the
    aggregate once, before the main query, and inlines the result as a literal,
    so there is no join (and one pass even when hash and object-hash
    aggregates, e.g. avg and percentile, are mixed).
    """
    fields = stats.columns
    packed = stats.select(F.struct(*[F.col(c) for c in fields]).alias("__stats")).scalar()
    j = df.select("*", packed.alias("__stats"))
    return j.select(*df.columns, *[F.col("__stats").getField(c).alias(c) for c in fields])


def r6(c: Column | str, digits: int = 6) -> Column:
    """Round to ``digits`` decimals as round(x * 10^d) / 10^d on the binary value.

    Spark's ``round(double, d)`` rounds the shortest decimal string, other
    engines the binary value; this form gives the same double everywhere.
    """
    c = F.col(c) if isinstance(c, str) else c
    m = float(10 ** digits)
    return F.round(c * F.lit(m)) / F.lit(m)


def not_nan(c: Column) -> Column:
    """Null for NaN (``try_cast('NaN')`` yields NaN in Spark and DuckDB)."""
    return F.when(~F.isnan(c), c)
