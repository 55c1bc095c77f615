"""The random forest has the size of the survey's, and its parts add up to it."""

import numpy as np
import pytest

import __spark_entry__ as entry
from assay.operators import models as md
from tests.conftest import SF_SMALL


def _rows(spark, n, seed):
    rng = np.random.default_rng(seed)
    data = [(i, [float(v) for v in rng.normal(size=4) + (i % 3)], float(i % 3)) for i in range(n)]
    return spark.createDataFrame(data, "id long, x array<double>, y double").select(
        "id", md.array_to_vector("x").alias("features"), "y").coalesce(1).persist()


def test_forest_of_one_part_is_spark_mls(spark):
    train, test = _rows(spark, 300, 3), _rows(spark, 90, 4)
    whole = md.estimator("rf", 42, numTrees=7, maxDepth=5, minInstancesPerNode=2).fit(train)
    assert whole.getOrDefault("minInstancesPerNode") == 2
    want = {r.id: r for r in whole.transform(test).collect()}
    for r in md.forest_scores(train, test, 7, 42, part=7, maxDepth=5, minInstancesPerNode=2).collect():
        assert r.prediction == want[r.id].prediction
        assert np.allclose(r.probability.toArray(), want[r.id].probability.toArray())


def test_parts_of_a_forest_add_up(spark):
    train, test = _rows(spark, 300, 3), _rows(spark, 90, 4)
    parts = [md.estimator("rf", 42 + (i << 20), numTrees=n, maxDepth=4).fit(train) for i, n in enumerate((3, 3, 1))]
    scored = [{r.id: r.rawPrediction.toArray() for r in m.transform(test).collect()} for m in parts]
    got = md.forest_scores(train, test, 7, 42, part=3, maxDepth=4).collect()
    assert len(got) == 90
    for r in got:
        votes = sum(s[r.id] for s in scored)
        assert votes.sum() == pytest.approx(7) and np.allclose(r.probability.toArray(), votes / 7)
        assert r.prediction == votes.argmax()


def test_model_rf_grows_the_whole_forest(spark, monkeypatch):
    whole, asked = md.estimator, []
    monkeypatch.setattr(md, "estimator", lambda name, seed=42, **p: asked.append(p) or whole(name, seed, **(p | {"numTrees": 1})))
    entry.queries()["model_rf"](spark, SF_SMALL).count()
    assert sum(p["numTrees"] for p in asked) == 300 and all(p["maxDepth"] == 15 and p["minInstancesPerNode"] == 2 for p in asked)
