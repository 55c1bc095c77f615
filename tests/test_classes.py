"""Codes and class sizes over many values: no window over a whole table, no list of all values, hot values not joined."""

import pytest
from pyspark.sql import functions as F

from assay.functions import stats
from assay.operators import clean, encode
from tests.conftest import SF_SMALL

N = 1_000_000


@pytest.fixture(scope="module")
def many(spark):
    """A third of the rows share one class, a few are null, and a million classes have one or two rows."""
    i = F.col("id")
    cls = F.when(i % 3 == 0, "hot").when(i % 1001 == 1, None).otherwise(F.concat(F.lit("c"), F.floor(i * 2 / 3 * 3 / 4).cast("string")))
    return spark.range(0, 3 * N // 2, 1, 8).select("id", cls.alias("cls"))


def test_singletons_of_a_million_classes(spark, many):
    kept = clean.drop_singleton_classes(many, "cls")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert kept.columns == ["id", "cls"]
    want = many.where("cls is not null").groupBy("cls").count().where("count >= 2").agg(F.sum("count")).first()[0]
    classes = many.select("cls").distinct().count()
    assert classes > 700_000
    got = kept.agg(F.count(F.lit(1)), F.count_if(F.col("cls") == "hot")).first()
    assert tuple(got) == (want, N // 2)
    assert "LeftSemi" in plan or "Join LeftOuter" in plan  # the rest is joined, not carried as a list


def test_rare_classes_of_a_million(many):
    merged = clean.merge_rare_classes(many, "cls")
    assert [tuple(r) for r in merged.groupBy("cls").count().collect()] == [("hot", 3 * N // 2)]
    by_count = clean.merge_rare_classes(many, "cls", min_share=0, min_count=2)
    singles = many.groupBy("cls").count().where("count < 2").count()
    assert by_count.where("cls = 'hot'").count() == N // 2 + singles


def test_codes_of_a_million_values(spark, many):
    codes = encode.sorted_code_map(many, "cls")
    n = codes.count()
    got = codes.agg(F.min("code"), F.max("code"), F.countDistinct("code")).first()
    assert tuple(got) == (0, n - 1, n)
    coded = encode.apply_code_map(many, "cls", codes, "code")
    assert coded.where("cls is not null and code is null").count() == 0 and coded.where("cls is null and code is not null").count() == 0
    back = encode.decode(coded, "code", codes, "decoded")
    assert back.where("not (decoded <=> cls)").count() == 0 and back.count() == 3 * N // 2
    top = codes.where("value = 'hot'").first()
    assert top.n == N // 2 and top.code == n - 1  # 'c...' sorts before 'hot'


def test_first_seen_codes(spark):
    rows = [(5, "b"), (3, None), (9, "a"), (4, "b"), (7, "a"), (8, "c")]
    df = spark.createDataFrame(rows, "id long, v string")
    m = encode.first_seen_map(df, "v", "id")
    assert {r.value: (r.code, r.n) for r in m.collect()} == {None: (0, 1), "b": (1, 2), "a": (2, 2), "c": (3, 1)}
    out = {r.id: r.code for r in encode.apply_code_map(df, "v", m, "code").collect()}
    assert out == {5: 1, 3: 0, 9: 2, 4: 1, 7: 2, 8: 3}


def test_lookup_long_table_equals_join(spark, monkeypatch):
    monkeypatch.setattr(stats, "HEAVY", 5)
    df = spark.createDataFrame([(i, "hot" if i % 2 else None if i % 10 == 0 else f"k{i % 9}") for i in range(400)], "id long, k string")
    table = spark.createDataFrame([("hot", 1), (None, 2), *[(f"k{i}", 10 + i) for i in range(7)]], "k string, x int")
    want = {(r.id, r.x) for r in df.join(table, df.k.eqNullSafe(table.k), "left").select("id", "x").collect()}
    got = stats.lookup(df, table, "k")
    assert {(r.id, r.x) for r in got.collect()} == want and got.columns == ["id", "k", "x"]


def test_no_window_over_all_values_with_broadcasts_off(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet").selectExpr("o_orderkey as id", "o_orderpriority as v")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for m in (encode.first_seen_map(o, "v", "id"), encode.sorted_code_map(o, "v")):
            plan = m._jdf.queryExecution().toString() + encode.apply_code_map(o, "v", m, "c")._jdf.queryExecution().toString()
            assert "Window" not in plan and "SinglePartition" not in m._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
