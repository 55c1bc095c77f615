"""Invariants for the queries checked by row count only."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from assay.functions.hashing import hash60
from assay.operators import sampling as sa
from assay.sources.views import doc_obs, obs
from tests.conftest import SF_SMALL

Q = entry.queries()


def _counts(df, col):
    return {r[0]: r[1] for r in df.groupBy(col).count().collect()}


def test_salted_rank_equals_plain_rank(spark):
    o = obs(spark, SF_SMALL).select("obs_id", "label")
    h = hash60(F.col("obs_id"), 42)
    salted = sa.rank_within(o, ["label"], h, "obs_id", salt_bits=4).select("obs_id", "__rk")
    plain = o.select("obs_id", (F.row_number().over(Window.partitionBy("label").orderBy(h, "obs_id")) - 1)
                     .alias("rk"))
    j = salted.join(plain, "obs_id")
    assert j.where(F.col("__rk") != F.col("rk")).count() == 0
    assert j.count() == o.count()


def test_split_is_a_partition_with_exact_sizes(spark):
    s = Q["split_stratified"](spark, SF_SMALL)
    o = obs(spark, SF_SMALL)
    assert s.count() == o.count() and s.select("obs_id").distinct().count() == o.count()
    n = _counts(o, "label")
    t = _counts(s.where(F.col("split") == "test"), "label")
    assert all(t[c] == math.ceil(0.2 * n[c]) for c in n)


def test_result_independent_of_shuffle_partitions(spark):
    a = Q["folds_stratified"](spark, SF_SMALL).collect()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = Q["folds_stratified"](spark, SF_SMALL).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(a) == sorted(b)


def test_rerun_gives_same_rows(spark):
    assert sorted(Q["balance_max"](spark, SF_SMALL).collect()) == sorted(Q["balance_max"](spark, SF_SMALL).collect())


def test_balance_noise_sizes_and_noise_only_on_draws(spark):
    b = Q["balance_noise"](spark, SF_SMALL)
    n = _counts(obs(spark, SF_SMALL), "label")
    target = int(sorted(n.values())[1] * 1.3)
    got = _counts(b, "label")
    for c, k in n.items():
        assert got[c] == (target if k < target else k)
    kept = b.where(F.col("draw").isNull()).join(obs(spark, SF_SMALL).select("obs_id", F.col("total_price").alias("tp")),
                                                "obs_id")
    assert kept.where(F.col("tp") != F.col("total_price")).count() == 0


def test_balance_median_band_sizes(spark):
    b = Q["balance_median_band"](spark, SF_SMALL)
    n = _counts(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), "lang")
    vals = sorted(n.values())
    med = (vals[len(vals) // 2] if len(vals) % 2 else (vals[len(vals) // 2 - 1] + vals[len(vals) // 2]) / 2)
    target = int(med * 1.2)
    got = _counts(b, "lang")
    for c, k in n.items():
        want = target if (k < target or k > 1.5 * target) else k
        assert got[c] == want


def test_smote_points_on_segment_and_sizes(spark):
    s = Q["smote"](spark, SF_SMALL)
    sizes = _counts(s, "label")
    assert len(set(sizes.values())) == 1
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    base = e.select(F.col("vec_id").alias("base_id"), F.col("embedding").alias("bv"))
    nb = e.select(F.col("vec_id").alias("neighbor_id"), F.col("embedding").alias("nv"))
    syn = s.where("synthetic").join(base, "base_id").join(nb, "neighbor_id")
    for r in syn.limit(50).collect():
        for x, a, b in zip(r["vec"], r["bv"], r["nv"]):
            assert x == pytest.approx(a + r["gap"] * (b - a), abs=2e-6)
        assert 0.0 <= r["gap"] < 1.0


def test_isolation_forest_share(spark):
    d = Q["isolation_forest"](spark, SF_SMALL)
    share = d.agg(F.avg(F.col("is_outlier").cast("double"))).first()[0]
    assert 0.03 <= share <= 0.07


def test_importances_sum_to_one(spark):
    t = Q["tree_importance"](spark, SF_SMALL)
    assert t.agg(F.sum("importance")).first()[0] == pytest.approx(1.0, abs=1e-5)


def test_scores_are_probabilities_and_stream_equals_batch(spark):
    b = Q["batch_score"](spark, SF_SMALL)
    tot = b.select((F.col("p_F") + F.col("p_O") + F.col("p_P")).alias("t")).agg(F.min("t"), F.max("t")).first()
    assert tot[0] == pytest.approx(1.0, abs=1e-5) and tot[1] == pytest.approx(1.0, abs=1e-5)
    s = Q["stream_score"](spark, SF_SMALL)
    assert sorted(b.collect()) == sorted(s.collect())


def test_distinct_approx_close(spark):
    ex = {r["feature"]: r["n_distinct"] for r in Q["distinct_profile"](spark, SF_SMALL).collect()}
    ap = {r["feature"]: r["n_distinct"] for r in Q["distinct_approx"](spark, SF_SMALL).collect()}
    for k, v in ex.items():
        assert abs(ap[k] - v) <= max(2, 0.06 * v)


def test_poisson_sizes_in_expectation(spark):
    p = Q["balance_poisson"](spark, SF_SMALL)
    got = _counts(p, "label")
    n = _counts(doc_obs(spark, SF_SMALL), "label")
    t = max(n.values())
    for c in n:
        assert abs(got[c] - t) <= 4 * math.sqrt(t) + 5


def test_regression_imputation_fills(spark):
    d = Q["impute_regression"](spark, SF_SMALL)
    assert d.where(F.col("qty_sum").isNull()).count() == 0


def test_model_predictions_cover_test_split(spark):
    for name in ["model_dt", "model_logreg", "model_gbt"]:
        d = Q[name](spark, SF_SMALL)
        assert d.count() == Q["split_stratified"](spark, SF_SMALL).where("split = 'test'").count()
        assert set(r[0] for r in d.select("pred").distinct().collect()) <= {"F", "O", "P"}


def test_grid_and_pca(spark):
    assert Q["grid_search"](spark, SF_SMALL).count() == 4
    ev = [r["explained_variance"] for r in Q["pca_variance"](spark, SF_SMALL).orderBy("component").collect()]
    assert ev[0] >= ev[1] > 0 and sum(ev) <= 1.0 + 1e-9
