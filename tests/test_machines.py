"""Linear SVMs and factorization machines of all classes in the same passes are those of Spark ML."""

import numpy as np
import pytest
from pyspark.ml.classification import FMClassifier, LinearSVC, OneVsRest
from pyspark.sql import functions as F

from assay.operators import machines as mc, models as md


def _rows(spark, n, seed, parts=1, d=4):
    rng = np.random.default_rng(seed)
    data = [(i, [float(v) for v in rng.normal(size=d) * 3 + (i % 3)], float(i % 3)) for i in range(n)]
    return spark.createDataFrame(data, "id long, x array<double>, y double").select(
        "id", md.array_to_vector("x").alias("features"), "y").repartition(parts).persist()


@pytest.mark.parametrize("steps, most", [(10, 1.0), (100, 1e-3)])
def test_svms_reach_the_loss_of_spark_mls(spark, steps, most):
    df = _rows(spark, 900, 5, 3)
    svc = LinearSVC(maxIter=steps, regParam=0.01)
    whole = OneVsRest(classifier=svc, featuresCol="features", labelCol="y").fit(df)
    mine = mc.fit_svms(df, svc)
    x, y = (np.array(v) for v in zip(*[(r.features.toArray(), r.y) for r in df.collect()]))

    def loss(m, c):
        w = m.coefficients.toArray()
        short = 1 - np.where(y == c, 1, -1) * (x @ w + m.intercept)
        return np.maximum(short, 0).mean() + 0.005 * ((w * x.std(0, ddof=1)) ** 2).sum()
    for c, (a, b) in enumerate(zip(whole.models, mine.models, strict=True)):
        assert loss(b, c) <= loss(a, c) + 1e-3
        assert np.abs(loss(b, c) - loss(a, c)) <= most
    got = mine.transform(df).join(whole.transform(df).select("id", F.col("prediction").alias("p")), "id")
    assert got.where("p = prediction").count() >= 850


def test_margins_choose_like_one_vs_rest(spark):
    df = _rows(spark, 300, 6)
    whole = OneVsRest(classifier=LinearSVC(maxIter=5), featuresCol="features", labelCol="y").fit(df)
    want = {r.id: r for r in whole.transform(df).collect()}
    got = mc.Margins(whole.models).transform(df).collect()
    assert len(got) == 300 and all(r.prediction == want[r.id].prediction for r in got)
    assert all(np.array_equal(r.rawPrediction.toArray(), want[r.id].rawPrediction.toArray()) for r in got)


def test_lifted_fits_store_narrow_rows_and_pass_once_for_all_classes(spark, monkeypatch):
    df, widths, packed = _rows(spark, 300, 8).select("id", "features", "y"), [], mc.packed
    monkeypatch.setattr(mc, "packed", lambda rows, f, y: widths.append(len(rows.first()[f])) or packed(rows, f, y))
    lift = md.sketcher(degree=3, n_out=32, gamma=0.25)
    m = md.fit_lifted_svm(df, lift, maxIter=5)
    sketched = md.tensor_sketch(df, degree=3, n_out=32, gamma=0.25).select("id", "y", F.col("sketch").alias("features"))
    assert widths == [4] and all(v.coefficients.size == 32 for v in m.models)
    x = np.stack([r.features.toArray() for r in df.orderBy("id").collect()])
    assert np.allclose(lift(x), np.stack([r.features.toArray() for r in sketched.orderBy("id").collect()]))
    theirs = md.fit_linear_svm(sketched, maxIter=5).transform(sketched).where("prediction = y").count()
    assert m.transform(sketched).where("prediction = y").count() >= theirs - 30
    names = [f"f{i}" for i in range(4)]
    cols = df.select("id", *[md.vector_to_array("features")[i].alias(n) for i, n in enumerate(names)]).orderBy("id").select(
        *md.rff_columns(names, 10, 0.5, 42))
    assert np.allclose(md.fourier(4, 10, 0.5, 42)(x), np.array(cols.collect()))


def test_factor_machines_are_spark_mls(spark, monkeypatch):
    df = _rows(spark, 600, 7, 3)
    fm = FMClassifier(maxIter=12, stepSize=0.05, seed=42)
    whole = OneVsRest(classifier=fm, featuresCol="features", labelCol="y").fit(df)
    passes, summed = [], mc.summed
    monkeypatch.setattr(mc, "summed", lambda *a: passes.append(1) or summed(*a))
    mine = md.candidate("fm", 4, 3, 42, maxIter=12).fit(df)
    assert len(passes) == 12
    for a, b in zip(whole.models, mine.models, strict=True):
        assert np.allclose(a.factors.toArray(), b.factors.toArray()) and np.allclose(a.linear.toArray(), b.linear.toArray())
        assert np.isclose(a.intercept, b.intercept)
    got = mine.transform(df).join(whole.transform(df).select("id", F.col("prediction").alias("p")), "id")
    assert got.count() == 600 and got.where("p <> prediction").count() == 0


def test_nothing_stays_stored(spark):
    df = _rows(spark, 60, 9)
    df.count()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    mc.fit_svms(df, LinearSVC(maxIter=2)).transform(df).count()
    md.candidate("fm", 4, 3, 42, maxIter=2).fit(df).transform(df).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before
