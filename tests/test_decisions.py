"""Driver-side decisions: dtype selection (P12), rebalance gate (R8), search gate."""

from pyspark.sql import functions as F

from assay.operators import models as md
from assay.operators import neighbors as nb
from assay.sources.tables import columns_of_type
from tests.conftest import SF_SMALL


def test_columns_of_type(spark):
    df = spark.createDataFrame([(1, 2.0, "x", True)], "a long, b double, c string, d boolean")
    assert columns_of_type(df, "numeric") == ["a", "b"]
    assert columns_of_type(df, "string") == ["c"]
    assert columns_of_type(df, "boolean") == ["d"]


def _emb(spark):
    return spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def test_rebalance_gate(spark):
    e = _emb(spark)
    # balanced enough -> untouched
    same, how = nb.rebalance_if_needed(e, "label", threshold=0.0)
    assert how == "none" and same.count() == e.count()
    # imbalanced -> SMOTE to the largest class
    skew = e.where((F.col("label") != 1) | (F.col("id") % 3 == 0))
    out, how = nb.rebalance_if_needed(skew, "label", threshold=0.99)
    assert how == "smote"
    sizes = [r[1] for r in out.groupBy("label").count().collect()]
    assert len(set(sizes)) == 1


def test_search_gate(spark):
    from assay.plans.q_models import prepared
    _, train, _ = prepared(spark, SF_SMALL)
    t = train.withColumn("fold", F.col("sfold").cast("int"))
    est = md.estimator("dt", 42)
    first = [{est.maxDepth: 2}]
    wider = [{est.maxDepth: 4}, {est.maxDepth: 6}]
    never = md.gated_search(est, first, wider, t, threshold=0.0, k=3)
    assert never["ran_wider"] is False and never["stage"] == "first"
    always = md.gated_search(est, first, wider, t, threshold=1.01, k=3)
    assert always["ran_wider"] is True
    assert always["accuracy"] >= never["accuracy"]


def test_rebalance_is_decided_from_class_sizes(spark):
    rows = [(i, [float(i), 0.0], "a") for i in range(20)] + [(100, [50.0, 0.0], "b")]
    one = spark.createDataFrame(rows, "id long, vec array<double>, label string")
    out, how = nb.rebalance_if_needed(one, "label")
    assert how == "none" and out.count() == 21
    more = one.unionByName(spark.createDataFrame([(101, [4.5, 0.0], "b"), (102, [6.5, 0.0], "b")], one.schema))
    for methods, name in ((("smote",), "smote"), (("adasyn", "smote"), "adasyn"), (("smote_tomek",), "smote_tomek")):
        out, how = nb.rebalance_if_needed(more, "label", methods=methods)
        assert how == name and out.count() > 0
    assert nb.smote(one, "label").where("synthetic").count() == 0  # a class of one row has no neighbour


def test_adasyn_rows_follow_the_allocation(spark):
    rows = [(i, [float(i), float(i % 3)], "a") for i in range(40)] + [(100 + i, [10.0 + i, 0.5], "b") for i in range(8)]
    d = spark.createDataFrame(rows, "id long, vec array<double>, label string")
    want = {r["id"]: round(r["g"]) for r in nb.adasyn_allocation(d, "label").collect() if round(r["g"])}
    out = nb.adasyn(d, "label")
    got = {r[0]: r[1] for r in out.where("synthetic").groupBy("base_id").count().collect()}
    assert got == want and out.where("not synthetic").count() == 48
    vec = {r["id"]: r["vec"] for r in d.collect()}
    for r in out.where("synthetic").collect():
        assert r["label"] == "b" and r["id"] < 0 and r["neighbor_id"] >= 100
        for x, a, b in zip(r["vec"], vec[r["base_id"]], vec[r["neighbor_id"]]):
            assert abs(x - (a + r["gap"] * (b - a))) < 1e-9
