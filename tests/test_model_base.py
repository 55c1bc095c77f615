"""The table that the model queries share is written once, and repeated passes over it stay few and narrow."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from assay.operators import models as md
from assay.plans import q_models
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_base_is_read_back_without_joins(spark):
    b = q_models.model_base(spark, SF_SMALL)
    assert "Join" not in _plan(b) and "Window" not in _plan(b)
    _, train, test = q_models.prepared(spark, SF_SMALL, b)
    assert train.count() + test.count() == b.count()
    assert set(train.columns) == {"id", "label", "split", "sfold", "y", "features"}


def test_tasks_of_a_pass_follow_the_cores_then_the_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    assert [md.pass_tasks(spark, n) for n in (0, 1500, 1 << 14, 3 << 14, 4_000_000, 100 << 20)] == [1, 1, 1, 3, 2 * cores, 100]
    assert md.held(spark.range(100, numPartitions=40)).rdd.getNumPartitions() == 1


def test_linear_svm_equals_one_vs_rest(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=3) + (i % 3)], float(i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y double").select(
        "id", md.array_to_vector("x").alias("features"), "y").coalesce(1).persist()
    whole = md.estimator("linear_svm", maxIter=15).fit(df)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    for threads in (1, 3):
        mine = md.fit_linear_svm(df.select("id", "features", "y"), threads, maxIter=15)
        for a, b in zip(whole.models, mine.models, strict=True):
            assert np.allclose(a.coefficients.toArray(), b.coefficients.toArray()) and np.isclose(a.intercept, b.intercept)
        got = mine.transform(df).join(whole.transform(df).select("id", F.col("prediction").alias("p")), "id")
        assert got.where("p <> prediction").count() == 0
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before


def test_grid_medians_are_not_collected_in_one_task(spark):
    plan = entry.queries()["decision_grid"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "median" not in plan.lower() and "percentile" not in plan.lower()


def test_single_fits_do_not_store_their_rows(spark, monkeypatch):
    held, kept = md.held, []
    monkeypatch.setattr(md, "held", lambda df: kept.append(df.columns) or held(df))
    for name in ("coef_importance", "tree_importance"):
        assert entry.queries()[name](spark, SF_SMALL).count() == len(q_models.FEATURES)
    assert kept == []
    b = q_models.model_base(spark, SF_SMALL)
    _, train, test = q_models.prepared(spark, SF_SMALL, b, hold=False)
    assert not train.storageLevel.useMemory and train.count() + test.count() == b.count()


def test_selection_stores_its_code_and_features_only(spark):
    b = q_models._coded(q_models.model_base(spark, SF_SMALL).where(F.col("split") == "train"))
    assert b.columns == ["y", *q_models.FEATURES] and b.storageLevel.useMemory
    b.unpersist()
