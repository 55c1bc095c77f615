"""The perceptron's fit: exact gradient, a loss no worse than that of Spark ML's own fit, few and narrow passes."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from assay.operators import models as md
from assay.operators import perceptron as pc

LAYERS = [4, 8, 5, 3]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 4))
    y = np.digitize(x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.3 * rng.normal(size=3000), [0.0, 0.8])
    return spark.createDataFrame([(i, Vectors.dense(v), float(c)) for i, (v, c) in enumerate(zip(x, y))], ["id", "features", "y"]) \
        .repartition(3).cache()


def _loss(model, df):
    p = vector_to_array(F.col("probability"))
    return model.transform(df).select(F.avg(-F.log(F.get(p, F.col("y").cast("int"))))).first()[0]


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    n = sum(a * b + b for a, b in zip(LAYERS, LAYERS[1:]))
    w, x, y = rng.normal(size=n), rng.normal(size=(20, 4)), rng.integers(0, 3, 20)
    _, g = pc.gradient(w, LAYERS, x, y)
    for i in rng.choice(n, 25, replace=False):
        e = np.zeros(n)
        e[i] = 1e-6
        slope = (pc.gradient(w + e, LAYERS, x, y)[0] - pc.gradient(w - e, LAYERS, x, y)[0]) / 2e-6
        assert abs(slope - g[i]) < 1e-4


def test_fit_is_as_good_as_spark_ml(spark, rows):
    rows.count()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    est = md.estimator("mlp", 42, layers=LAYERS, maxIter=60)
    assert isinstance(est, pc.Perceptron)
    mine = est.fit(rows)
    own = MultilayerPerceptronClassifier(layers=LAYERS, maxIter=60, seed=42, featuresCol="features", labelCol="y").fit(rows)
    assert mine.getMaxIter() == 60 and len(mine.weights) == len(own.weights)
    assert _loss(mine, rows) < 1.05 * _loss(own, rows)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before
    # the weights are laid out as Spark ML reads them
    x = np.stack([r.features.toArray() for r in rows.orderBy("id").collect()])
    y = np.array([int(r.y) for r in rows.orderBy("id").collect()])
    assert abs(pc.gradient(mine.weights.toArray(), LAYERS, x, y)[0] / len(y) - _loss(mine, rows)) < 1e-9
    # and the first weights are its own
    first = est.copy({est.maxIter: 0}).fit(rows)
    theirs = MultilayerPerceptronClassifier(layers=LAYERS, maxIter=0, seed=42, labelCol="y").fit(rows)
    assert np.allclose(first.weights.toArray(), theirs.weights.toArray())


def test_rows_that_spark_ml_refuses_are_refused(rows):
    est = md.estimator("mlp", 42, layers=LAYERS, maxIter=5)
    for x, message in ((F.array(*[F.lit(float("nan"))] * 4), "finite"), (F.array(F.lit(1.0)), "vectors of 4")):
        odd = F.when(F.col("id") == 2999, md.array_to_vector(x)).otherwise(F.col("features"))
        with pytest.raises(Exception, match=message):
            est.fit(rows.sortWithinPartitions("id").withColumn("features", odd))
    with pytest.raises(Exception, match="labels must be|Labels MUST"):
        est.fit(rows.withColumn("y", F.when(F.col("id") == 2999, 3.0).otherwise(F.col("y"))))
