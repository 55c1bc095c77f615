"""The end-to-end run ranks its rows once and fits nothing twice for the same score."""

from pyspark.sql import functions as F

from assay.operators import models as md, sampling as sa


def test_one_ranking_gives_split_and_folds(spark):
    df = spark.range(500).select(F.col("id").alias("i"), F.when(F.col("id") % 7 == 0, None).otherwise(
        F.concat(F.lit("c"), (F.col("id") % 3).cast("string"))).alias("c"))
    two = sa.folds_stratified(sa.split_stratified(df, "c", "i", 0.2, 42), "c", "i", 3, 42)
    one = sa.split_and_folds(df, "c", "i", 0.2, 3, 42)
    assert one.columns == two.columns
    rows = sorted(tuple(r) for r in one.collect())
    assert rows == sorted(tuple(r) for r in two.collect()) and {r[2] for r in rows} == {"train", "test"}


def test_known_scores_are_not_fitted_again(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(md, "cv_scores", lambda est, maps, *a: asked.append(list(maps)) or [(0.2 + 0.1 * m["v"], 0.0) for m in maps])
    found = md.gated_search(None, [{}, {"v": 1}, {"v": 2}], [{"v": 0}], None, "fold", 0.9, 3, known=[(0.35, 0.0)])
    assert asked == [[{"v": 1}, {"v": 2}], [{"v": 0}]]
    assert found == {"stage": "first", "params": {"v": 2}, "accuracy": 0.4, "ran_wider": True}
    assert md.gated_search(None, [{}, {"v": 1}], [], None, "fold", 0.9, 3, known=[(0.95, 0.0)])["params"] == {}
