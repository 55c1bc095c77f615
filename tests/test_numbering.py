import pytest
from pyspark.sql import functions as F

from assay.functions.numbering import number_rows


@pytest.mark.parametrize("within", [(), ("g",)])
def test_numbers_equal_the_sorted_order(spark, within):
    rows = [(None if i % 7 == 0 else f"g{i % 5 if i % 3 else 0}", (i * 37) % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, x long, label long").repartition(5)
    out = number_rows(df, ["x"], within).collect()
    assert len(out) == 1000
    groups = {}
    for g, x, _ in rows:
        groups.setdefault(g if within else "", []).append(x)
    for r in out:
        mine = sorted(groups[r.g if within else ""])
        assert mine[r.number] == r.x and (not within or r.total == len(mine))


def test_null_first_ties_and_empty(spark):
    df = spark.createDataFrame([(None,), ("b",), (None,), ("",), ("a",), ("b",)], "x string")
    out = sorted((r.number, r.x) for r in number_rows(df, ["x"]).collect())
    assert out == [(0, None), (1, None), (2, ""), (3, "a"), (4, "b"), (5, "b")]
    assert number_rows(df.limit(0), ["x"]).count() == 0
    assert number_rows(df.limit(0).withColumn("g", F.lit(1)), ["x"], ["g"]).count() == 0


def test_tied_rows_spread_over_partitions(spark):
    placed = number_rows(spark.range(20_000).select(F.lit(None).cast("string").alias("x"), "id"), ["x"])
    assert sorted(r.number for r in placed.collect()) == list(range(20_000))
    assert "Window" not in placed._jdf.queryExecution().toString()
