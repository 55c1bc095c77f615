"""Plan-shape checks: pushdown, pruning, no nested-loop joins, no Python in SQL-native queries."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL

Q = entry.queries()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_reaches_the_scan(spark):
    plan = _plan(Q["filter_range"](spark, SF_SMALL))
    scan = [l for l in plan.split("\n") if "FileScan parquet" in l and "c_acctbal" in l][0]
    assert "c_acctbal" in scan and "<= 5000.0" in scan


def test_projection_is_pruned(spark):
    plan = _plan(Q["scan_pruned"](spark, SF_SMALL))
    scans = [l for l in plan.split("\n") if "FileScan parquet" in l]
    # qty_sum is not used: the left join to the lineitem aggregate (unique key) is removed
    assert not [l for l in scans if "l_orderkey" in l]
    orders = [l for l in scans if "o_orderkey" in l][0]
    assert "o_orderdate" not in orders and "o_orderpriority" not in orders
    nation = [l for l in scans if "n_nationkey" in l][0]
    assert "n_name" not in nation


@pytest.mark.parametrize("name", ["feature_summary", "iqr_cap", "feat_zscore", "histogram", "outlier_counts",
                                  "box_stats_by_class", "split_stratified", "balance_max", "confusion_matrix"])
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = _plan(Q[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["feature_summary", "cleaning_audit", "anova_f", "mutual_information",
                                  "roc_auc_ovr", "classification_report", "balance_max", "leaderboard"])
def test_sql_native_queries_have_no_python(spark, name):
    plan = _plan(Q[name](spark, SF_SMALL))
    for marker in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert marker not in plan


def test_class_tables_reach_the_rows_without_join_or_percentile(spark):
    """With broadcasts off, no operator that fits per class or per column joins or shuffles the rows on a class."""
    from assay.operators import clean, profile, sampling, select
    d = spark.read.parquet(f"{SF_SMALL}/orders.parquet").selectExpr(
        "o_orderkey as id", "o_totalprice as v", "o_orderstatus as g")
    long = select.to_long(d.withColumnRenamed("g", "label"), ["id", "label"], ["v"])
    plans = {
        "singletons": lambda: clean.drop_singleton_classes(d, "g"), "rare": lambda: clean.merge_rare_classes(d, "g"),
        "top": lambda: clean.top_k_or_other(d, "g", 2, 1), "median": lambda: clean.impute_median(d, ["v"]),
        "cap": lambda: clean.iqr_cap(d, ["v"]), "box": lambda: profile.box_stats(d, "v", "g"),
        "kde": lambda: profile.kde(d, "v", "g", 4), "copies": lambda: sampling.poisson_oversample(d, "g", "id"),
        "mi": lambda: select.mutual_information(long)}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, build in plans.items():
            plan = build()._jdf.queryExecution().toString()
            # the quantiles of groups are completed by one join of two tables with a row per class
            assert plan.count("Join") == 0 or name in ("box", "mi"), name
            assert "percentile(" not in plan, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
