"""Loss per boosting iteration, calibrated SVM probabilities, polynomial tensor sketch."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from assay.operators import boosting as bo
from assay.operators import models as md


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 4))
    y = np.digitize(x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.3 * rng.normal(size=900), [0.0, 0.8])
    data = [(i, Vectors.dense(v), float(c), "test" if i % 4 == 0 else "train", i % 3) for i, (v, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, ["id", "features", "y", "split", "sfold"]).cache()


def test_loss_per_iteration(rows):
    train = rows.where("split = 'train'")
    models = md.fit_gbt_ovr(train, 3, max_iter=12)
    out = bo.staged_loss(models, rows).orderBy("iteration").collect()
    assert len(out) == 24 and {r.rows for r in out} == {675, 225}
    losses = [r.loss for r in out if r.split == "train"]
    assert [r.iteration for r in out if r.split == "train"] == list(range(1, 13))
    assert all(b <= a + 1e-9 for a, b in zip(losses, losses[1:]))
    # the losses of Spark ML's own staged evaluation, and the log loss of the final probabilities
    own = sum(np.array(m.evaluateEachIteration(train.withColumn("yc", (F.col("y") == c).cast("double"))))
              for c, m in enumerate(models))
    assert np.allclose(own / 2, losses)  # its log loss is twice the usual one
    p = md.predict_gbt_ovr(models, rows.where("split = 'test'"))
    true = F.when(F.col("y") == 0, F.col("p_0")).when(F.col("y") == 1, F.col("p_1")).otherwise(F.col("p_2"))
    final = p.select(F.avg(-F.log(true))).first()[0]
    assert abs(final - [r.log_loss for r in out if r.split == "test"][-1]) < 1e-9
    assert bo.staged_loss(models, rows.limit(0)).count() == 0


def test_calibrated_svm_votes(rows):
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    out = md.fit_calibrated_svm(train, 3, maxIter=30).transform(test).collect()
    p = np.array([[r.p_0, r.p_1, r.p_2] for r in out])
    assert np.allclose(p.sum(1), 1) and (p > 0).all()
    assert [r.prediction for r in out] == p.argmax(1).tolist()
    truth = np.array([int(r.y) for r in out])
    assert (p.argmax(1) == truth).mean() > 0.6
    share = np.bincount(truth, minlength=3) / len(truth)
    assert np.abs(p.mean(0) - share).max() < 0.1  # calibrated on the whole
    loss = -np.log(p[np.arange(len(p)), truth]).mean()
    assert loss < -(share * np.log(share)).sum()  # better than the class shares alone


@pytest.mark.parametrize("degree", [2, 3])
def test_tensor_sketch_estimates_the_kernel(spark, degree):
    rng = np.random.default_rng(degree)
    x = rng.normal(size=(60, 8)) / 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").select(
        "id", array_to_vector("v").alias("features"))
    kernel = (x @ x.T + 1.0) ** degree
    errors = {}
    for n_out in (256, 4096):
        z = np.stack([r.sketch.toArray() for r in md.tensor_sketch(df, degree=degree, n_out=n_out).orderBy("id").collect()])
        errors[n_out] = np.abs(z @ z.T - kernel).mean() / kernel.mean()
    assert errors[4096] < 0.1 and errors[4096] < errors[256] < 0.5
