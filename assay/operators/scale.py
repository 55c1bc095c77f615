"""Scaling and projection (Z*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.stats import attach, one_row, quantile_row


def fit_standard(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return one_row(df, {**{f"{c}__mean": F.avg(c) for c in cols}, **{f"{c}__sd": F.stddev_pop(c) for c in cols}})


def standard_scale(df: DataFrame, cols: Sequence[str], stats: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population std (sklearn StandardScaler).

    Spark ML's ``StandardScaler`` divides by the sample std, hence SQL.
    A zero std leaves the centred value (sklearn divides by 1).
    """
    stats = stats if stats is not None else fit_standard(df, cols)
    j = attach(df, stats)
    sd = {c: F.when(F.col(f"{c}__sd") == 0, F.lit(1.0)).otherwise(F.col(f"{c}__sd")) for c in cols}
    return j.select(*[((F.col(c) - F.col(f"{c}__mean")) / sd[c]).alias(c) if c in cols else F.col(c)
                      for c in df.columns])


def fit_robust(df: DataFrame, cols: Sequence[str], relative_error: float | None = None) -> DataFrame:
    return quantile_row(df, {f"{c}__q": (c, [0.25, 0.5, 0.75]) for c in cols}, relative_error)


def robust_scale(df: DataFrame, cols: Sequence[str], stats: DataFrame | None = None,
                 relative_error: float | None = None) -> DataFrame:
    """(x - median) / IQR (sklearn RobustScaler); IQR 0 -> divide by 1."""
    stats = stats if stats is not None else fit_robust(df, cols, relative_error)
    j = attach(df, stats)
    out = []
    for c in df.columns:
        if c in cols:
            q = F.col(f"{c}__q")
            iqr = q[2] - q[0]
            out.append(((F.col(c) - q[1]) / F.when(iqr == 0, F.lit(1.0)).otherwise(iqr)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def pca(df: DataFrame, cols: Sequence[str], k: int = 2):
    """Z3: centre (Z1), then ``ml.feature.PCA``; returns (projected df, explained variance list).

    Nulls take the column mean (0 after centring), so every row comes back; a column without any value is refused.
    """
    from pyspark.ml.feature import PCA, VectorAssembler
    void = [c for c, n in df.agg(*[F.count(c).alias(c) for c in cols]).first().asDict().items() if not n]
    if void:
        raise ValueError(f"columns without any value: {void}")
    z = standard_scale(df, cols).na.fill(0.0, list(cols))
    va = VectorAssembler(inputCols=list(cols), outputCol="__x", handleInvalid="error")
    model = PCA(k=k, inputCol="__x", outputCol="pca").fit(va.transform(z))
    return model.transform(va.transform(z)).drop("__x"), list(model.explainedVariance), model
