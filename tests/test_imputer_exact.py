import math

import pytest
from pyspark.sql import functions as F

from assay.operators import clean


@pytest.mark.parametrize("n", [400_000, 400_001])
def test_the_median_of_many_rows_is_exact(spark, n):
    """The lower median of 0 .. n-1 in mixed order, where a sketch at 1e-4 may be 40 ranks off."""
    ids = spark.range(n, numPartitions=4)
    df = ids.select(F.pmod(F.col("id") * 48_271, F.lit(n)).cast("double").alias("x"))
    df = df.unionByName(spark.range(50).select(F.when(F.col("id") % 2 == 0, float("nan")).alias("x")))
    m = clean.fit_imputer_model(df, ["x"])
    assert m.surrogateDF.first().x == float((n - 1) // 2)
    out = m.transform(spark.createDataFrame([(None,), (math.nan,), (3.0,)], "x double"))
    assert [r.x for r in out.collect()] == [(n - 1) // 2, (n - 1) // 2, 3.0]


def test_a_column_without_values_raises(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "x double, y double")
    assert clean.fit_imputer_model(df, ["y"]).surrogateDF.first().y == 1.0
    with pytest.raises(Exception, match="surrogate"):
        clean.fit_imputer_model(df, ["x", "y"])
