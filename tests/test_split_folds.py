"""Split and folds by one ranking are those of two rankings and a join, for ids that repeat or are null as well."""

from pyspark.sql import functions as F

from assay.functions.hashing import hash60
from assay.operators import sampling as sa


def test_one_ranking_gives_split_and_folds(spark):
    data = [(i, "abc"[i * i % 3], i) for i in range(200)] + [(i, "abc"[i * i % 3], i) for i in range(0, 200, 7)]
    data += [(i, "b", -i) for i in range(0, 200, 11)] + [(None, "a", 1), (None, "b", 2), (5, None, 3), (900, "d", 4)]
    df = spark.createDataFrame(data, "id long, label string, x long")
    s = sa.split_stratified(df, "label", "id", 0.2, 7)
    f = sa.folds_stratified(s.where("split = 'train'").select("id", "label"), "label", "id", 3, 7)
    want = s.join(f.select("id", "fold"), "id", "left").select("id", "label", "x", "split", "fold")
    got = sa.split_with_folds(df.withColumn("h", hash60(F.col("id"), 7)), "label", "id", 0.2, 3, 7, F.col("h"), 5)
    assert got.rdd.getNumPartitions() == 5
    # of rows with one id and label, those that go to test are any of them: x is left out where they differ
    cols = ["id", "label", "split", "fold"]
    assert sorted(map(repr, got.select(cols).collect())) == sorted(map(repr, want.select(cols).collect()))
    assert got.where("copy = 0").count() == s.count() and got.count() > s.count()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") == 1 and plan.count("Join") == 1  # the ranks and their offsets


def test_model_base_ranks_once(spark, monkeypatch):
    from assay.plans import q_models
    from tests.conftest import SF_SMALL
    calls, rank = [], sa.rank_within
    monkeypatch.setattr(sa, "rank_within", lambda *a, **k: calls.append(1) or rank(*a, **k))
    b = q_models.model_base(spark, SF_SMALL)
    assert len(calls) == 1 and b.where("split = 'train' and sfold is null").count() == 0
    assert b.where("split = 'test' and sfold is not null").count() == 0


def test_ranks_and_folds_share_one_shuffle_of_the_rows(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(500).selectExpr("id", "concat('a', id % 3) as label", "id * 2 as x").withColumn(
        "h", hash60(F.col("id"), 7)).write.parquet(path)
    got = sa.split_with_folds(spark.read.parquet(path), "label", "id", 0.2, 3, 7, F.col("h"), 5)
    lines = got._jdf.queryExecution().executedPlan().toString().split("\n")
    # of the way of the rows: everything above the counts of the salts, which is the last and deepest branch
    rows = lines[:next(i for i, line in enumerate(lines) if "FileScan" in line)]
    shuffles = [line for line in rows if "Exchange" in line]
    assert len(shuffles) == 1 and "hashpartitioning(__b" in shuffles[0] and ", 5)" in shuffles[0]
