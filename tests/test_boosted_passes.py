"""The boosting fit in shared passes grows the trees of Spark ML's classifier, in one job per level for all classes."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from assay.operators import boosting as bo
from assay.operators import models as md


def _table(spark, n=1500, nan=False):
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n), rng.exponential(size=n).round(1), np.full(n, 3.0)])
    y = np.digitize(x[:, 0] + 0.4 * x[:, 1] - x[:, 2] + 0.5 * rng.normal(size=n), [-0.5, 0.8])
    if nan:
        x[::7, 0] = np.nan
    return spark.createDataFrame([(i, Vectors.dense(v), float(c)) for i, (v, c) in enumerate(zip(x, y))], ["id", "features", "y"])


def _margins(model, df):
    return np.array([r[0] for r in model.transform(df).orderBy("id").select(vector_to_array("rawPrediction")[1]).collect()])


def test_equals_spark_ml(spark):
    df = _table(spark).repartition(3).cache()
    est = GBTClassifier(labelCol="yc", maxIter=12, maxDepth=3, seed=4)  # more rounds than a lineage is long
    for c, mine in enumerate(bo.fit_one_vs_rest(df, 3, est)):
        own = est.fit(df.withColumn("yc", (F.col("y") == c).cast("double")))
        assert mine.getNumTrees == own.getNumTrees == 12 and mine.treeWeights == own.treeWeights
        assert np.allclose(_margins(mine, df), _margins(own, df))
        # where two features part a node's rows alike, rounding decides which of them is named
        assert np.allclose(mine.featureImportances.toArray(), own.featureImportances.toArray(), atol=5e-3)
        assert mine.getMaxIter() == 12 and mine.numFeatures == 4
    df.unpersist()


def test_one_job_per_level_serves_all_classes(spark):
    df = _table(spark, 400).cache()
    df.count()
    sc = spark.sparkContext
    before = set(sc.statusTracker().getJobIdsForGroup(None))
    md.fit_gbt_ovr(df, 3, max_iter=12)
    # each class by itself takes 12 rounds of three levels and more
    assert len(set(sc.statusTracker().getJobIdsForGroup(None)) - before) < 3 * 12 * 3
    df.unpersist()


def test_thresholds():
    assert bo.thresholds(np.array([3.0, 1.0, np.nan, 1.0, 2.0]), 3).tolist() == [1.5, 2.5]
    assert bo.thresholds(np.array([5.0, 5.0]), 4).tolist() == [] and bo.thresholds(np.array([np.nan]), 4).tolist() == []
    assert bo.thresholds(np.arange(100.0), 4).tolist() == [24.5, 49.5, 74.5]


def test_missing_values_lone_classes_and_empty_tables(spark):
    df = _table(spark, 300, nan=True)
    models = md.fit_gbt_ovr(df, 4, max_iter=3)  # class 3 has no row
    out = md.predict_gbt_ovr(models, df).collect()
    assert len(out) == 300 and all(0 < r.p_3 < min(r.p_0, 0.5) or r.p_3 < 0.25 for r in out)
    with pytest.raises(ValueError):
        md.fit_gbt_ovr(df.limit(0), 3, max_iter=2)
    with pytest.raises(Exception, match="need a label"):
        md.fit_gbt_ovr(df.withColumn("y", F.when(F.col("id") > 5, F.col("y"))), 3, max_iter=2)
