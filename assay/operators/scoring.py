"""Batch scoring with a fitted pipeline (T1, T2) and its persistence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IndexToString
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.stats import attach, one_row, quantile_row


def fit_scoring_pipeline(train: DataFrame, features: Sequence[str], label: str = "label",
                         classifier=None) -> PipelineModel:
    """Preprocessing (index, assemble, scale) + classifier + label decoding in one
    ``PipelineModel`` so scoring applies exactly the fitted transformations
    (no pasted constants, no train/serve skew)."""
    from assay.operators.models import estimator, prepare
    prep = prepare(train, features, label)
    clf = classifier or estimator("logreg")
    fitted = Pipeline(stages=prep.getStages() + [clf]).fit(train)
    labels = fitted.stages[0].labels
    return PipelineModel(stages=fitted.stages + [IndexToString(inputCol="prediction", outputCol="pred",
                                                               labels=labels)])


def batch_score(model: PipelineModel, df: DataFrame, id_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Decoded prediction, confidence (max probability) and every class probability."""
    labels = model.stages[0].labels
    p = model.transform(df)
    arr = vector_to_array(F.col("probability"))
    return p.select(id_col, *keep, "pred", F.array_max(arr).alias("confidence"),
                    *[arr[i].alias(f"p_{lab}") for i, lab in enumerate(labels)])


def median_record(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (),
                  relative_error: float | None = None) -> DataFrame:
    """The median of every numeric column and the mode of every categorical one (one row)."""
    med = quantile_row(df, {c: (c, 0.5) for c in numeric}, relative_error)
    if not categorical:
        return med
    return attach(one_row(df, {c: F.mode(F.col(c), True) for c in categorical}), med).select(*numeric, *categorical)
