"""Column profiles and aggregate statistics (A*).

Wide statistics are computed in ONE aggregate over all columns and then
unpivoted with ``stack`` into a long table ``(feature, ...)``; grouped
statistics aggregate map-side before the shuffle.  Nothing row-sized
reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.stats import attach, attach_by, one_row, quantile_row


def _unpivot(wide: DataFrame, cols: Sequence[str], stats: Sequence[str], key: str = "feature") -> DataFrame:
    """Wide one-row ``{col}__{stat}`` -> long rows ``(feature, stat...)``."""
    body = ", ".join(f"'{c}', " + ", ".join(f"`{c}__{s}`" for s in stats) for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {body}) as ({key}, {', '.join(stats)})")


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A2: null count and percent per column, one pass."""
    cols = list(cols or df.columns)
    ex = {f"{c}__n_null": F.count_if(F.col(c).isNull()) for c in cols}
    ex["__n"] = F.count(F.lit(1))
    w = one_row(df, ex)
    w = w.select(*[F.col(f"{c}__n_null").alias(f"{c}__n_null") for c in cols],
                 *[F.coalesce(F.try_divide(F.col(f"{c}__n_null") * 100.0, F.col("__n")), F.lit(0.0)).alias(f"{c}__pct_null") for c in cols])
    return _unpivot(w, cols, ["n_null", "pct_null"])


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequency table (map-side combined)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def value_share(df: DataFrame, col: str) -> DataFrame:
    """A4: percent of rows per value; the total is a scalar subquery over the count table."""
    c = value_counts(df, col)
    return attach(c, c.agg(F.sum("n").alias("__total"))).select(
        col, "n", (F.col("n") * 100.0 / F.col("__total")).alias("pct"))


def describe(df: DataFrame, cols: Sequence[str], relative_error: float | None = None) -> DataFrame:
    """A5: count, mean, sample std, min, quartiles, max (exact quartiles by default)."""
    ex = {}
    for c in cols:
        ex[f"{c}__count"] = F.count(c)
        ex[f"{c}__mean"] = F.avg(c)
        ex[f"{c}__std"] = F.stddev_samp(c)
        ex[f"{c}__min"] = F.min(c).cast("double")
        ex[f"{c}__max"] = F.max(c).cast("double")
    w = quantile_row(df, {f"{c}__q": (c, [0.25, 0.5, 0.75]) for c in cols}, relative_error, extra=ex)
    w = w.select("*", *[F.col(f"{c}__q")[i].alias(f"{c}__{n}") for c in cols
                        for i, n in enumerate(["p25", "p50", "p75"])])
    return _unpivot(w, cols, ["count", "mean", "std", "min", "p25", "p50", "p75", "max"])


def range_profile(df: DataFrame, cols: Sequence[str], relative_error: float | None = None) -> DataFrame:
    """Min / max / mean / median / non-negative count."""
    ex = {}
    for c in cols:
        ex[f"{c}__min"] = F.min(c).cast("double")
        ex[f"{c}__max"] = F.max(c).cast("double")
        ex[f"{c}__mean"] = F.avg(c)
        ex[f"{c}__n_non_negative"] = F.sum((F.col(c) >= 0).cast("bigint"))
    w = quantile_row(df, {f"{c}__median": (c, 0.5) for c in cols}, relative_error, extra=ex)
    return _unpivot(w, cols, ["min", "max", "mean", "median", "n_non_negative"])


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
              relative_error: float | None = None) -> DataFrame:
    """Linear-interpolated quantiles, long form (feature, p, value)."""
    w = quantile_row(df, {c: (c, list(probs)) for c in cols}, relative_error)
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(p).alias("p"), F.col(c)[i].alias("value"))
                    for c in cols for i, p in enumerate(probs)])
    return w.select(F.inline(arr))


def skewness_by(df: DataFrame, col: str, by: str | None = None) -> DataFrame:
    """Population skewness (scipy ``skew`` default), optionally per group."""
    agg = [F.skewness(col).alias("skewness"), F.count(col).alias("n")]
    return df.groupBy(by).agg(*agg) if by else df.agg(*agg)


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every ordered pair, one aggregate."""
    ex = {f"{a}__{b}": F.corr(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]}
    w = one_row(df, ex)
    rows = []
    for a in cols:
        for b in cols:
            v = F.lit(1.0) if a == b else F.col(f"{a}__{b}" if f"{a}__{b}" in ex else f"{b}__{a}")
            rows.append(F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), v.alias("corr")))
    return w.select(F.inline(F.array(*rows)))


def distinct_profile(df: DataFrame, cols: Sequence[str], approx: bool = False, rsd: float = 0.02) -> DataFrame:
    """A10: distinct count per column (exact, or HyperLogLog++ at scale)."""
    fn = (lambda c: F.approx_count_distinct(c, rsd)) if approx else (lambda c: F.countDistinct(c))
    w = one_row(df, {f"{c}__n_distinct": fn(c) for c in cols})
    return _unpivot(w, cols, ["n_distinct"])


def class_balance(df: DataFrame, col: str) -> DataFrame:
    """Min / max class count and their ratio (two-level aggregate)."""
    c = value_counts(df, col)
    return c.agg(F.count(F.lit(1)).alias("n_classes"), F.min("n").alias("min_count"),
                 F.max("n").alias("max_count"), (F.min("n") / F.max("n")).alias("balance_ratio"))


def class_weights(df: DataFrame, col: str) -> DataFrame:
    """Balanced weights n / (k * n_c)."""
    c = value_counts(df, col)
    t = c.agg(F.sum("n").alias("__total"), F.count(F.lit(1)).alias("__k"))
    return attach(c, t).select(col, "n", (F.col("__total") / (F.col("__k") * F.col("n"))).alias("weight"))


def histogram(df: DataFrame, col: str, bins: int = 20, by: str | None = None) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed; empty bins kept.

    A constant column has all its rows in bin 0 and bins of width 0.
    """
    st = one_row(df, {"__lo": F.min(col), "__hi": F.max(col)})
    width = (F.col("__hi") - F.col("__lo")) / bins
    b = F.least(F.floor(F.coalesce(F.try_divide(F.col(col) - F.col("__lo"), width), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    keys = [by] if by else []
    counts = (attach(df.where(F.col(col).isNotNull()), st).select(*keys, b.alias("bin"))
              .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n")))
    groups = df.select(by).distinct() if by else st.select()
    grid = attach(groups, st).select(*keys, "__lo", "__hi",
                                     F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counts, keys + ["bin"], "left")
    return out.select(*keys, "bin", (F.col("__lo") + F.col("bin") * width).alias("bin_lo"),
                      (F.col("__lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
                      F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))


def box_stats(df: DataFrame, col: str, by: str, k: float = 1.5,
              relative_error: float | None = None) -> DataFrame:
    """Quartiles, whiskers at the outermost data points inside the fences, outlier count."""
    q = quantile_row(df, {"__q": (col, [0.25, 0.5, 0.75])}, relative_error, by)
    q = q.select(by, F.col("__q")[0].alias("q1"), F.col("__q")[1].alias("median"), F.col("__q")[2].alias("q3"))
    j = attach_by(df.select(by, col).where(F.col(by).isNotNull()), q, by)
    lo = F.col("q1") - k * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + k * (F.col("q3") - F.col("q1"))
    x = F.col(col)
    return j.groupBy(by, "q1", "median", "q3").agg(
        F.min(F.when(x >= lo, x)).alias("whisker_lo"), F.max(F.when(x <= hi, x)).alias("whisker_hi"),
        F.sum(((x < lo) | (x > hi)).cast("bigint")).alias("n_outliers"), F.count(x).alias("n"))


def kde(df: DataFrame, col: str, by: str, points: int = 32) -> DataFrame:
    """Gaussian kernel density per group on a shared grid (null for a group of one value, which has no bandwidth).

    Bandwidth is Scott's rule (sample std * n^(-1/5)) per group.  Each row is
    expanded by a generator over the fixed grid (``points`` rows, no join)
    and reduced per (group, grid point) with map-side partial sums.
    """
    rng = one_row(df, {"__lo": F.min(col), "__hi": F.max(col)})
    bw = df.groupBy(by).agg((F.stddev_samp(col) * F.pow(F.count(col), -0.2)).alias("__h"))
    j = attach_by(attach(df.select(by, col).where(F.col(col).isNotNull() & F.col(by).isNotNull()), rng), bw, by)
    g = F.col("__lo") + F.col("__i") * (F.col("__hi") - F.col("__lo")) / (points - 1)
    e = j.select(by, col, "__h", "__lo", "__hi", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("__i"))
    u = F.try_divide(g - F.col(col), F.col("__h"))
    return (e.groupBy(by, "__i", "__lo", "__hi", "__h")
            .agg(F.avg(F.exp(-u * u / 2)).alias("__m"))
            .select(by, F.col("__i").alias("grid_index"), g.alias("x"),
                    F.try_divide(F.col("__m"), F.col("__h") * math.sqrt(2 * math.pi)).alias("density")))


def pair_bins(df: DataFrame, a: str, b: str, by: str, bins: int = 10) -> DataFrame:
    """2-D equal-width bin counts per group (scatter / pair-plot table)."""
    st = one_row(df, {"__alo": F.min(a), "__ahi": F.max(a), "__blo": F.min(b), "__bhi": F.max(b)})

    def bidx(c, lo, hi):
        share = F.try_divide(F.col(c) - F.col(lo), (F.col(hi) - F.col(lo)) / bins)  # null: a constant column, one bin
        return F.least(F.floor(F.coalesce(share, F.lit(0.0))), F.lit(bins - 1)).cast("int")
    j = attach(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), st)
    return (j.select(by, bidx(a, "__alo", "__ahi").alias("bin_a"), bidx(b, "__blo", "__bhi").alias("bin_b"))
            .groupBy(by, "bin_a", "bin_b").agg(F.count(F.lit(1)).alias("n")))


def null_patterns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count of rows per null pattern ('1' = null), columns in the given order."""
    pat = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in cols])
    return df.groupBy(pat.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def errors_by_class(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Misclassified rows per true class."""
    return df.groupBy(label).agg(F.sum((F.col(label) != F.col(pred)).cast("bigint")).alias("n_errors"),
                                 F.count(F.lit(1)).alias("n"))


def quality_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Type, distinct count, null count, min and max (as text) per column."""
    types = dict(df.dtypes)
    ex = {}
    for c in cols:
        ex[f"{c}__n_distinct"] = F.countDistinct(c)
        ex[f"{c}__n_null"] = F.sum(F.col(c).isNull().cast("bigint"))
        ex[f"{c}__min"] = F.min(c).cast("string")
        ex[f"{c}__max"] = F.max(c).cast("string")
    w = one_row(df, ex)
    w = w.select("*", *[F.lit(types[c]).alias(f"{c}__dtype") for c in cols])
    return _unpivot(w, cols, ["dtype", "n_distinct", "n_null", "min", "max"])


def top_values(df: DataFrame, cols: Sequence[str], k: int = 5) -> DataFrame:
    """Top-k values per column (ties: smaller value first).

    The rows are unpivoted to (feature, value), counted with a map-side
    combine, and ranked per feature on the count table only.
    """
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in cols])
    long = df.select(F.inline(arr))
    cnt = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("feature").orderBy(F.desc("n"), F.asc_nulls_first("value"))
    return cnt.select("*", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def any_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Does each column hold a null (``bool_or``), one pass."""
    w = one_row(df, {f"{c}__has_null": F.bool_or(F.col(c).isNull()) for c in cols})
    return _unpivot(w, cols, ["has_null"])
