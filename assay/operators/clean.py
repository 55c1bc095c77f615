"""Row filters, type coercion, imputation and outlier capping (P*, C*)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.stats import attach, attach_by, lookup, not_nan, one_row, quantile_row
from assay.functions.text import parse_number, strip_numeric_symbols
from assay.session import write_scratch


# ---------------------------------------------------------------- filters
def filter_in(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Keep rows whose value is in ``values`` (null is never kept)."""
    return df.filter(F.col(col).isin(list(values)))


def invalid_values(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """P4 report: each value outside ``values`` (null included) with its count."""
    bad = ~F.coalesce(F.col(col).isin(list(values)), F.lit(False))
    return df.filter(bad).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def drop_null_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null in any of ``cols`` (default all)."""
    return df.na.drop("any", subset=list(cols) if cols else None)


def filter_non_negative(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Keep rows with every column >= 0 (null fails, as NaN >= 0 does)."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & (F.col(c) >= 0)
    return df.filter(cond)


def filter_range(df: DataFrame, col: str, lo, hi) -> DataFrame:
    """Keep lo <= value <= hi."""
    return df.filter(F.col(col).between(lo, hi))


def header_row_mask(target: str, target_pattern: str, numeric_cols: Iterable[str]) -> Column:
    """True for rows that repeat the header inside the data.

    The target is matched case-insensitively against ``target_pattern``; each
    numeric text column against its own name with '_' read as '|'.
    """
    m = F.coalesce(F.col(target).rlike(f"(?i){target_pattern}"), F.lit(False))
    for c in numeric_cols:
        m = m | F.coalesce(F.col(c).rlike("(?i)" + c.replace("_", "|")), F.lit(False))
    return m


def remove_header_rows(df: DataFrame, target: str, target_pattern: str,
                       numeric_cols: Iterable[str]) -> DataFrame:
    return df.filter(~header_row_mask(target, target_pattern, list(numeric_cols)))


def outlier_counts(df: DataFrame, bounds: Mapping[str, tuple]) -> DataFrame:
    """Rows below / above fixed bounds per column, one pass, long form."""
    aggs = []
    for c, (lo, hi) in bounds.items():
        aggs += [F.sum(F.when(F.col(c) < lo, 1).otherwise(0)).cast("bigint").alias(f"{c}__low"),
                 F.sum(F.when(F.col(c) > hi, 1).otherwise(0)).cast("bigint").alias(f"{c}__high")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}__low`, `{c}__high`" for c in bounds)
    return wide.selectExpr(f"stack({len(bounds)}, {stack}) as (feature, n_low, n_high)")


def drop_singleton_classes(df: DataFrame, target: str, min_rows: int = 2) -> DataFrame:
    """Keep classes with at least ``min_rows`` rows (null is no class).

    Class counts reach the rows as a map where classes are few; beyond that the classes of many rows do, and only the
    rows of small classes are joined (:func:`lookup`).  No list of all classes is ever gathered.
    """
    sizes = write_scratch(df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("__size")), "class-sizes")
    kept = sizes.select(target, "__size", F.col("__size").alias("__rows"))
    return lookup(df, kept, target, "__rows").where(F.col("__size") >= min_rows).select(*df.columns)


def numeric_detection(df: DataFrame, cols: Sequence[str], threshold: float = 0.7) -> DataFrame:
    """Share of values that parse as numbers after C2 cleaning, one pass."""
    n = F.count(F.lit(1))
    aggs = [(F.count(parse_number(strip_numeric_symbols(F.col(c)))) / n).alias(c) for c in cols]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return (wide.selectExpr(f"stack({len(cols)}, {stack}) as (feature, parse_ratio)")
            .withColumn("is_numeric", F.col("parse_ratio") >= threshold))


# ---------------------------------------------------------------- coercion
def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text -> double, unparsable -> null; other columns untouched."""
    return df.select(*[parse_number(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def coerce_null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column, non-null text that failed to parse (nulls created)."""
    aggs = []
    for c in cols:
        aggs += [F.count(F.col(c)).alias(f"{c}__text"),
                 F.sum(F.when(F.col(c).isNotNull() & parse_number(F.col(c)).isNull(), 1)
                       .otherwise(0)).cast("bigint").alias(f"{c}__created")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}__text`, `{c}__created`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {stack}) as (feature, n_text, n_nulls_created)")


def strip_and_coerce(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Symbol stripping then C1."""
    return df.select(*[parse_number(strip_numeric_symbols(F.col(c))).alias(c) if c in cols
                       else F.col(c) for c in df.columns])


def consolidate(c: Column, mapping: Mapping[str, str]) -> Column:
    """C4: replace values by a synonym map; unmapped values pass through."""
    if not mapping:
        return c
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(m[c], c)


def merge_rare_classes(df: DataFrame, col: str, min_share: float = 0.01, min_count: int = 3) -> DataFrame:
    """Classes with fewer than max(min_count, int(min_share * n)) rows -> commonest class.

    The commonest class is the largest count, ties to the smaller value (null first).  A class that stays has at least
    ``min_share`` of the rows, so the classes that stay are at most ``1 / min_share``; they reach the rows as one map, and
    whatever the map lacks becomes the commonest class.  Without a share, classes are looked up by size instead.
    """
    counts = write_scratch(df.groupBy(col).agg(F.count(F.lit(1)).alias("n")), "class-counts")
    tot = counts.agg(F.sum("n").alias("__total"), F.min_by(F.col(col), F.struct(-F.col("n"), F.col(col))).alias("__top"))
    thr = F.greatest(F.lit(min_count), F.floor(F.col("__total") * min_share).cast("bigint"))
    judged = attach(counts, tot).select(F.col(col), (F.col("n") >= thr).alias("__stays"), F.col("n").alias("__n"))
    if min_share > 0:
        null_stays = judged.where(F.col(col).isNull()).agg(F.max("__stays").alias("__null_stays"))
        out = attach(attach_by(df, judged.where("__stays").select(col, "__stays"), col), null_stays)
        stays = F.when(F.col(col).isNull(), F.col("__null_stays")).otherwise(F.col("__stays"))
    else:
        out, stays = lookup(df, judged, col, "__n"), F.col("__stays")
    out = attach(out, tot)
    new = F.when(F.coalesce(stays, F.lit(False)), F.col(col)).otherwise(F.col("__top"))
    return out.select(*[new.alias(col) if c == col else F.col(c) for c in df.columns])


def top_k_or_other(df: DataFrame, col: str, max_levels: int = 10, keep: int = 8,
                   other: str = "Other", fit_on: DataFrame | None = None) -> DataFrame:
    """When a column has more than ``max_levels`` values keep the ``keep``
    commonest (ties: smaller value first) and replace the rest by ``other``.

    The kept values are the top ``keep`` of the distinct-value counts (a distributed top-k) and reach the rows as one
    array (counted on ``fit_on``, if given); neither the rows nor all distinct values are sorted or gathered, whatever the cardinality.
    """
    counts = (df if fit_on is None else fit_on).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    levels = counts.agg((F.count(F.lit(1)) > max_levels).alias("__cut"))
    top = counts.orderBy(F.desc("n"), F.asc(col)).limit(keep).agg(
        F.collect_list(col).alias("__kept"), F.max(F.col(col).isNull()).alias("__null_kept"))
    out = attach(attach(df, levels), top)
    x = F.col(col)
    held = F.when(x.isNull(), F.col("__null_kept")).otherwise(F.array_contains(F.col("__kept"), x))
    new = F.when(F.col("__cut") & ~F.coalesce(held, F.lit(False)), F.lit(other)).otherwise(x)
    return out.select(*[new.alias(col) if c == col else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- imputation
def fit_median(df: DataFrame, cols: Sequence[str], relative_error: float | None = None) -> DataFrame:
    return quantile_row(df, {f"{c}__median": (c, 0.5) for c in cols}, relative_error)


def impute_median(df: DataFrame, cols: Sequence[str], stats: DataFrame | None = None,
                  relative_error: float | None = None) -> DataFrame:
    """Fill nulls with the column median (of ``stats``, fitted on other rows, if given)."""
    stats = stats if stats is not None else fit_median(df, cols, relative_error)
    j = attach(df, stats)
    return j.select(*[F.coalesce(F.col(c), F.col(f"{c}__median")).alias(c) if c in cols else F.col(c)
                      for c in df.columns])


def fit_mode(df: DataFrame, cols: Sequence[str], missing: str = "Unknown") -> DataFrame:
    """Commonest value per column, ties to the smallest; all-null -> ``missing``."""
    return one_row(df, {f"{c}__mode": F.coalesce(F.mode(F.col(c), True).cast("string"), F.lit(missing))
                        for c in cols})


def impute_mode(df: DataFrame, cols: Sequence[str], stats: DataFrame | None = None) -> DataFrame:
    stats = stats if stats is not None else fit_mode(df, cols)
    j = attach(df, stats)
    return j.select(*[F.coalesce(F.col(c).cast("string"), F.col(f"{c}__mode")).alias(c) if c in cols
                      else F.col(c) for c in df.columns])


def fit_iqr(df: DataFrame, cols: Sequence[str], relative_error: float | None = None) -> DataFrame:
    """Quartiles of every column."""
    st = quantile_row(df, {f"{c}__q": (c, [0.25, 0.75]) for c in cols}, relative_error)
    return st.select(*[x for c in cols for x in (F.col(f"{c}__q")[0].alias(f"{c}__q1"),
                                                   F.col(f"{c}__q")[1].alias(f"{c}__q3"))])


def cap_expr(c: str, k: float, guard_zero_iqr: bool) -> Column:
    q1, q3 = F.col(f"{c}__q1"), F.col(f"{c}__q3")
    iqr = q3 - q1
    lo, hi = q1 - k * iqr, q3 + k * iqr
    x = F.col(c)
    # greatest/least skip nulls in Spark and DuckDB, so guard the null first.
    capped = F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))
    if guard_zero_iqr:
        capped = F.when(iqr > 0, capped).otherwise(x)
    return capped


def iqr_cap(df: DataFrame, cols: Sequence[str], k: float = 1.5, guard_zero_iqr: bool = False,
            stats: DataFrame | None = None, relative_error: float | None = None) -> DataFrame:
    """C12 (k=1.5) / C13 (k=2, skipped when IQR is 0): winsorise at the IQR fences."""
    stats = stats if stats is not None else fit_iqr(df, cols, relative_error)
    j = attach(df, stats)
    return j.select(*[cap_expr(c, k, guard_zero_iqr).alias(c) if c in cols else F.col(c)
                      for c in df.columns])


def fit_imputer_model(df: DataFrame, cols: Sequence[str], relative_error: float | None = None):
    """Spark ML ``ImputerModel`` of the given (train) rows' medians, of an even number of values the lower one.

    The median is exact (``quantile_row``, no task holds a column); NaN and null are missing values and do not count, and a
    column without any value raises.  With ``relative_error``, ``Imputer`` fits it from a sketch of the rows.
    """
    from pyspark.ml.feature import Imputer
    cols = list(cols)
    imputer = Imputer(strategy="median", inputCols=cols, outputCols=cols)
    if relative_error is not None:
        return imputer.setRelativeError(relative_error).fit(df)
    values = df.select(*[not_nan(F.col(c).cast("double")).alias(c) for c in cols])
    row = quantile_row(values, {c: (c, 0.5) for c in cols}, lower=True).first()
    medians = df.sparkSession.createDataFrame([tuple(row) if row else (None,) * len(cols)],
                                              ", ".join(f"`{c}` double" for c in cols))
    return imputer.fit(medians)  # the median of one row is its value


def impute_regression(df: DataFrame, targets: Sequence[str], rounds: int = 2) -> DataFrame:
    """C11: chained regression imputation of all ``targets`` from each other.

    Missing values start at the column median; in every round each target that has any is fitted by ``LinearRegression`` on
    the rows where it is present (a distributed fit), with the other columns as they stand, and its missing values are
    predicted anew.  Predictors are never null this way, so no row is skipped and no value becomes NaN.  A column without any
    value stays null and is no predictor; a column that has no other predictor keeps its median.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    targets = list(targets)
    n = df.agg(*[F.count(c).alias(c) for c in targets], F.count(F.lit(1)).alias("__rows")).first()
    used = [c for c in targets if n[c]]
    gaps = [c for c in used if n[c] < n["__rows"]]
    marked = df.select("*", *[F.col(c).isNull().alias(f"__gap_{c}") for c in gaps])
    out = impute_median(marked, used) if used else marked
    for _ in range(rounds):
        for c in gaps:
            others = [x for x in used if x != c]
            if not others:
                continue
            va = VectorAssembler(inputCols=others, outputCol="__x", handleInvalid="error")
            data = va.transform(out)
            model = LinearRegression(featuresCol="__x", labelCol=c, predictionCol="__pred", regParam=0.0).fit(
                data.where(~F.col(f"__gap_{c}")))
            filled = F.when(F.col(f"__gap_{c}"), F.col("__pred")).otherwise(F.col(c))
            # written, so that a later fit does not run the projections of all earlier ones again
            out = write_scratch(model.transform(data).select(*[filled.alias(x) if x == c else F.col(x) for x in out.columns]),
                                "imputed")
    return out.select(*df.columns)
