"""Literal edge fixtures."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assay.functions.stats import quantile_row
from assay.functions.text import parse_number, sanitize_name, strip_numeric_symbols, title_case
from assay.operators import clean, encode as en, evaluate as ev, features as fe, outliers, profile as pr
from assay.operators import sampling as sa
from assay.operators import scale
from assay.sources import tables as tb
from assay.sources.tables import find_column, require_columns


def test_empty_input(spark):
    df = spark.createDataFrame([], "id long, x double, label string")
    assert clean.impute_median(df, ["x"]).count() == 0
    assert clean.iqr_cap(df, ["x"]).count() == 0
    assert sa.split_stratified(df, "label", "id").count() == 0
    assert pr.value_counts(df, "label").count() == 0


def test_single_class_and_singleton_class(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, label string")
    assert sorted(r[0] for r in clean.drop_singleton_classes(df, "label").collect()) == [1, 2]
    one = spark.createDataFrame([(1, "a"), (2, "a")], "id long, label string")
    assert sa.balance_max(one, "label", "id").count() == 2


def test_all_null_column(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id long, s string")
    assert [r[1] for r in clean.impute_mode(df, ["s"]).collect()] == ["Unknown", "Unknown"]
    p = {r["feature"]: r["n_null"] for r in pr.null_profile(df).collect()}
    assert p["s"] == 2


def test_iqr_zero_guard(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(8)] + [(8, 100.0)], "id long, x double")
    guarded = [r[1] for r in clean.iqr_cap(df, ["x"], k=2.0, guard_zero_iqr=True).orderBy("id").collect()]
    plain = [r[1] for r in clean.iqr_cap(df, ["x"], k=1.5).orderBy("id").collect()]
    assert guarded[-1] == 100.0 and plain[-1] == 5.0


def test_null_kept_by_cap(spark):
    df = spark.createDataFrame([(1, None), (2, 1.0), (3, 2.0)], "id long, x double")
    assert clean.iqr_cap(df, ["x"]).orderBy("id").first()["x"] is None


def test_mode_tie_smallest(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, "a"), (5, None)], "id long, s string")
    assert clean.impute_mode(df, ["s"]).where("id = 5").first()["s"] == "a"


def test_top8_tie(spark):
    rows = [(i, f"v{k:02d}") for i, k in enumerate([k for k in range(12) for _ in range(3 if k < 7 else 2)])]
    df = spark.createDataFrame(rows, "id long, v string")
    out = {r["v"] for r in clean.top_k_or_other(df, "v").collect()}
    assert out == {f"v{k:02d}" for k in range(8)} | {"Other"}


def test_bin_edges_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (18.0,), (18.5,), (35.0,), (100.0,), (101.0,)], "x double")
    b = [r[0] for r in df.select(fe.bin_fixed(F.col("x"), [0, 18, 35, 50, 65, 100])).collect()]
    assert b == [None, 0, 1, 1, 4, None]


def test_quantile_bins_collapse_duplicates(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 1, 1, 1, 1, 1, 2, 3]], "x double")
    got = sorted(set(r[0] for r in fe.bin_quantile(df, "x").select("x_qbin").collect()))
    assert got == [0, 2]  # edges {1, 1.6}: bins (.., 1], (1, 1.6], (1.6, ..]


def test_header_row_and_nan_text(spark):
    df = spark.createDataFrame([("Label", "qty_sum"), ("F", "12"), ("O", "NaN"), ("P", "1d")],
                               "label_txt string, qty_txt string")
    kept = clean.remove_header_rows(df, "label_txt", "label_txt|label", ["qty_txt"])
    assert kept.count() == 3
    vals = [r[0] for r in kept.select(parse_number(F.col("qty_txt"))).collect()]
    assert vals == [12.0, None, None]
    assert [r[0] for r in spark.createDataFrame([("(1,200)",), (None,)], "s string")
            .select(strip_numeric_symbols(F.col("s"))).collect()] == ["1200", "0"]


def test_one_hot_drops_first_level(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "c string")
    out = en.one_hot(df, "c", en.fit_one_hot(df, "c"))
    assert out.columns == ["c", "c_b", "c_c"]


def test_schema_helpers(spark):
    df = spark.createDataFrame([(1, "x")], "Cancer_Type_X long, `Platelet Count( (/cumm)` string")
    with pytest.raises(ValueError, match="available"):
        require_columns(df, ["missing"])
    assert find_column(df, "cancer") == "Cancer_Type_X"
    assert sanitize_name("Platelet Count( (/cumm)") == "Platelet_Count____cumm_"


def test_rare_class_merge(spark):
    rows = [(i, "big") for i in range(400)] + [(400 + i, "mid") for i in range(10)] + [(500, "tiny")]
    df = spark.createDataFrame(rows, "id long, c string")
    out = {r[0]: r[1] for r in pr.value_counts(clean.merge_rare_classes(df, "c"), "c").collect()}
    assert out == {"big": 401, "mid": 10}


def test_soft_vote_tie_goes_to_first_class(spark):
    a = spark.createDataFrame([(1, 0.5, 0.5)], "id long, p_x double, p_y double")
    assert ev.soft_vote([a], "id", ["x", "y"]).first()["pred"] == "x"


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text("b,a,c\n1,2,3\n4,5,6\n7\n8,9,10,11\n")
    path = str(tmp_path / "t.csv")
    assert [tuple(r) for r in tb.read_delimited(spark, path, ["a", "b"]).collect()][:2] == [("2", "1"), ("5", "4")]
    assert [r[0] for r in tb.read_delimited(spark, path, ["c"]).collect()][:2] == ["3", "6"]
    with pytest.raises(ValueError):
        tb.read_delimited(spark, path, ["missing"])
    assert tuple(tb.malformed_rows(spark, path).first()) == (4, 2)


def test_constant_columns_and_empty_tables_do_not_fail(spark):
    d = spark.createDataFrame([(i, 5.0, "x" if i else "y") for i in range(4)], "id long, v double, g string")
    h = {r["bin"]: r["n"] for r in pr.histogram(d, "v", 3).collect()}
    assert h == {0: 4, 1: 0, 2: 0}
    assert pr.pair_bins(d, "v", "v", "g", 3).agg(F.max("bin_a")).first()[0] == 0
    assert all(r["density"] is None for r in pr.kde(d, "v", "g", 4).collect())
    e = d.limit(0)
    assert [tuple(r) for r in pr.null_profile(e, ["v"]).collect()] == [("v", 0, 0.0)]
    s = spark.createDataFrame([(1, "a", "a", 0.5), (2, "a", "a", 0.4)], "id long, label string, cls string, p double")
    assert ev.roc_auc_ovr(s).first()["auc"] == 0.0


def test_title_case_matches_python(spark):
    texts = ["b-cell acute o'neil", "ALL 2nd x", "", "é1a", "  two  words "]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", title_case(F.col("t")).alias("x"))
    assert all(r["x"] == r["t"].title() for r in d.collect())


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(0)
    ps = [0.0, 0.1, 0.25, 0.5, 0.8, 0.999, 1.0]
    for v in (rng.normal(size=1001), np.round(rng.normal(size=2500), 1), np.ones(7), rng.pareto(1, 40_000)):
        d = spark.createDataFrame(pd.DataFrame({"v": v, "g": np.where(np.arange(len(v)) % 3 == 0, "a", "b")}))
        row = quantile_row(d, {"q": ("v", ps), "m": ("v", 0.5)}).first()
        assert np.allclose(row["q"], np.quantile(v, ps)) and np.isclose(row["m"], np.median(v))
        for r in quantile_row(d, {"q": ("v", ps)}, by="g").collect():
            assert np.allclose(r["q"], np.quantile(v[(np.arange(len(v)) % 3 == 0) == (r["g"] == "a")], ps))
    none = spark.createDataFrame([(None, "a")], "v double, g string")
    assert quantile_row(none, {"m": ("v", 0.5)}).first()["m"] is None
    assert quantile_row(none.limit(0), {"m": ("v", 0.5)}).first()["m"] is None


def test_poisson_copies_of_a_tiny_class_reach_the_target(spark):
    d = spark.range(20_010).select("id", F.when(F.col("id") < 10, "rare").otherwise("common").alias("label"))
    n = {r[0]: r[1] for r in sa.poisson_oversample(d, "label", "id").groupBy("label").count().collect()}
    assert all(abs(n[c] - 20_000) <= 5 * math.sqrt(20_000) for c in n)


def test_isolation_trees_have_all_their_rows(spark):
    for rows, want in ((100, 100), (1_500, 256), (150_000, 256)):
        d = spark.range(rows).select("id", F.rand(1).alias("x"))
        trees = outliers.fit_isolation_forest(d, "id", ["x"], n_trees=20)
        assert {r["size"][0] for r in trees.collect()} == {want} and trees.count() == 20


def test_chained_imputation_leaves_no_null_and_keeps_values(spark):
    rows = [(i, float(i) if i % 5 else None, 2.0 * i if i % 7 else None, None) for i in range(1, 200)]
    d = spark.createDataFrame(rows, "id long, a double, b double, c double")
    out = {r["id"]: r for r in clean.impute_regression(d, ["a", "b", "c"], rounds=6).collect()}
    assert len(out) == len(rows)
    for i, a, b, _ in rows:
        assert out[i]["c"] is None and (a is None or out[i]["a"] == a) and (b is None or out[i]["b"] == b)
        if i % 35:  # one of the two is known
            assert out[i]["a"] == pytest.approx(i, abs=3) and out[i]["b"] == pytest.approx(2 * i, abs=6)


def test_pca_keeps_rows_with_nulls(spark):
    d = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 1.0), (3, 4.0, 7.0), (4, 2.0, 3.0)], "id long, a double, b double")
    assert scale.pca(d, ["a", "b"])[0].count() == 4
    with pytest.raises(ValueError):
        scale.pca(d.withColumn("b", F.lit(None).cast("double")), ["a", "b"])


def test_rare_and_top_values_with_nulls(spark):
    d = spark.createDataFrame([(x,) for x in ["a"] * 50 + ["b"] * 5 + [None] * 2 + ["c"]], "v string")
    n = {r[0]: r[1] for r in clean.merge_rare_classes(d, "v").groupBy("v").count().collect()}
    assert n == {"a": 53, "b": 5}
    n = {r[0]: r[1] for r in clean.top_k_or_other(d, "v", 3, 2).groupBy("v").count().collect()}
    assert n == {"a": 50, "b": 5, "Other": 3}
    n = {r[0]: r[1] for r in clean.drop_singleton_classes(d, "v").groupBy("v").count().collect()}
    assert n == {"a": 50, "b": 5}
