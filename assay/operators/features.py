"""Derived-feature scalars: ratios, interactions, powers, logs, bins, flags (M*).

Every operator adds columns in a single ``select`` (no chained
``withColumn``), and every learned threshold comes from one aggregate pass
whose one-row result is broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.stats import attach, one_row, quantile_row


def add(df: DataFrame, cols: Mapping[str, Column]) -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in cols.items()])


def safe_ratio(x: str, y: str, eps: float = 1.0) -> Column:
    """M1: x / (y + eps); null when the denominator is 0."""
    return F.try_divide(F.col(x), F.col(y) + F.lit(eps))


def ratio_features(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """M1: x/(y+1) for each pair, named ``x_per_y``."""
    return add(df, {f"{x}_per_{y}": safe_ratio(x, y) for x, y in pairs})


def pairwise_features(df: DataFrame, cols: Sequence[str], limit: int = 4) -> DataFrame:
    """M2: product, eps-ratio x/(y+1e-8) and difference for all pairs of the first ``limit`` columns."""
    out = {}
    for a, b in combinations(list(cols)[:limit], 2):
        out[f"{a}_x_{b}"] = F.col(a) * F.col(b)
        out[f"{a}_ratio_{b}"] = F.try_divide(F.col(a), F.col(b) + F.lit(1e-8))
        out[f"{a}_diff_{b}"] = F.col(a) - F.col(b)
    return add(df, out)


def interaction_features(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """M3: named products."""
    return add(df, {f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs})


def power_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M4 square and M5 square root (null for negative input)."""
    out = {}
    for c in cols:
        out[f"{c}_sq"] = F.col(c) * F.col(c)
        out[f"{c}_sqrt"] = F.when(F.col(c) >= 0, F.sqrt(F.col(c)))
    return add(df, out)


def log_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M6: log1p (null for values <= -1)."""
    return add(df, {f"{c}_log": F.when(F.col(c) > -1, F.log1p(F.col(c))) for c in cols})


def fit_skew(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Minimum and population skewness of every column in one pass."""
    ex = {}
    for c in cols:
        ex[f"{c}__min"] = F.min(c)
        ex[f"{c}__skew"] = F.skewness(c)
    return one_row(df, ex)


def log_if_skewed(df: DataFrame, cols: Sequence[str], threshold: float = 1.0, fit_on: DataFrame | None = None) -> DataFrame:
    """M7: add ``c_log`` only for columns with min > 0 and |skew| > threshold (of ``fit_on``, if given).

    The decision changes the output schema, so the one-row statistics are
    read on the driver (2 values per column) before the projection is built.
    """
    st = fit_skew(df if fit_on is None else fit_on, cols).first()
    chosen = [c for c in cols
              if st[f"{c}__min"] is not None and st[f"{c}__min"] > 0
              and st[f"{c}__skew"] is not None and abs(st[f"{c}__skew"]) > threshold]
    return add(df, {f"{c}_log": F.log1p(F.col(c)) for c in chosen})


def fit_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return one_row(df, {**{f"{c}__mean": F.avg(c) for c in cols},
                        **{f"{c}__sd": F.stddev_samp(c) for c in cols}})


def zscore_features(df: DataFrame, cols: Sequence[str], stats: DataFrame | None = None) -> DataFrame:
    """M8: (x - mean) / sample std."""
    stats = stats if stats is not None else fit_moments(df, cols)
    j = attach(df, stats)
    return j.select(*df.columns, *[F.try_divide(F.col(c) - F.col(f"{c}__mean"), F.col(f"{c}__sd"))
                                   .alias(f"{c}_z") for c in cols])


def fit_quantile_points(df: DataFrame, spec: Mapping[str, Sequence[float]],
                        relative_error: float | None = None) -> DataFrame:
    """Quantiles ``{col: [p, ...]}`` in one pass -> columns ``col__p<100p>``."""
    st = quantile_row(df, {f"{c}__qs": (c, list(ps)) for c, ps in spec.items()}, relative_error)
    return st.select(*[F.col(f"{c}__qs")[i].alias(f"{c}__p{int(round(p * 100))}")
                       for c, ps in spec.items() for i, p in enumerate(ps)])


def flag(cond: Column) -> Column:
    """0/1 flag; a null comparison reads as 0 (pandas compares NaN as False)."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def quantile_flags(df: DataFrame, rules: Sequence[tuple[str, str, str, float]],
                   stats: DataFrame | None = None, relative_error: float | None = None) -> DataFrame:
    """Flags ``name = col (> | <) quantile(col, p)``.

    ``rules`` items are (name, col, op, p).  All thresholds come from one pass.
    """
    spec: dict[str, list[float]] = {}
    for _, c, _, p in rules:
        spec.setdefault(c, [])
        if p not in spec[c]:
            spec[c].append(p)
    stats = stats if stats is not None else fit_quantile_points(df, spec, relative_error)
    j = attach(df, stats)
    out = []
    for name, c, op, p in rules:
        t = F.col(f"{c}__p{int(round(p * 100))}")
        cond = F.col(c) > t if op == ">" else F.col(c) < t
        out.append(flag(cond).alias(name))
    return j.select(*df.columns, *out)


def median_flags(df: DataFrame, col: str, relative_error: float | None = None) -> DataFrame:
    """X > median and x < 0.5 * median."""
    st = quantile_row(df, {"__med": (col, 0.5)}, relative_error)
    j = attach(df, st)
    return j.select(*df.columns, flag(F.col(col) > F.col("__med")).alias(f"{col}_above_median"),
                    flag(F.col(col) < 0.5 * F.col("__med")).alias(f"{col}_below_half_median"))


def weighted_score(weights: Mapping[str, float]) -> Column:
    """Sum of weight * column (null-propagating)."""
    terms = [F.lit(w) * F.col(c) for c, w in weights.items()]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def bin_fixed(c: Column, edges: Sequence[float]) -> Column:
    """Right-closed bins (e0,e1] -> 0, (e1,e2] -> 1, ...; outside -> null.

    ``Bucketizer`` is left-closed, so a ``when`` chain is used instead.
    """
    expr = None
    for i in range(len(edges) - 1):
        cond = (c > edges[i]) & (c <= edges[i + 1])
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def fit_quantile_edges(df: DataFrame, col: str, q: int = 5, relative_error: float | None = None) -> DataFrame:
    ps = [i / q for i in range(1, q)]
    return quantile_row(df, {f"{col}__edges": (col, ps)}, relative_error)


def bin_quantile(df: DataFrame, col: str, q: int = 5, stats: DataFrame | None = None,
                 relative_error: float | None = None) -> DataFrame:
    """Quantile bins, right-closed, lowest included; duplicate edges collapse.

    bin = number of distinct interior edges strictly below the value.
    """
    stats = stats if stats is not None else fit_quantile_edges(df, col, q, relative_error)
    j = attach(df, stats)
    x = F.col(col)
    edges = F.array_distinct(F.col(f"{col}__edges"))
    b = F.when(x.isNotNull(), F.size(F.filter(edges, lambda e: e < x)))
    return j.select(*df.columns, b.alias(f"{col}_qbin"))


def poly_interactions(df: DataFrame, cols: Sequence[str], limit: int = 3) -> DataFrame:
    """Degree-2 interaction-only terms of the first ``limit`` columns."""
    return add(df, {f"poly_{a}_x_{b}": F.col(a) * F.col(b)
                    for a, b in combinations(list(cols)[:limit], 2)})


def ratio_of_ratio(df: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """(a/(b+1)) / (c+1)."""
    r = safe_ratio(a, b)
    return add(df, {f"{a}_per_{b}": r, f"{a}_per_{b}_per_{c}": F.try_divide(r, F.col(c) + 1)})


# Score tiers and train/test gap tiers.
SCORE_TIERS = [(0.90, "excellent"), (0.80, "good"), (0.70, "fair")]
SCORE_TIER_ELSE = "poor"
GAP_TIERS = [(0.05, "low"), (0.10, "moderate")]
GAP_TIER_ELSE = "high"


def tier(score: Column, gap: Column) -> tuple[Column, Column]:
    """Tier of a score and of a train/test gap."""
    s = None
    for t, name in SCORE_TIERS:
        s = F.when(score >= t, name) if s is None else s.when(score >= t, name)
    g = None
    for t, name in GAP_TIERS:
        g = F.when(gap < t, name) if g is None else g.when(gap < t, name)
    return s.otherwise(SCORE_TIER_ELSE), g.otherwise(GAP_TIER_ELSE)
