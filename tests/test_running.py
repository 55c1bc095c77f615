"""Running sums by ranges, and the ROC AUC on scores that crowd near zero."""

import numpy as np
from pyspark.sql import functions as F

from assay.functions import numbering
from assay.operators import evaluate as ev


def test_running_sum_equals_plain(spark):
    rows = [(f"g{i % 3}", (i * 7919) % 5003, i % 11) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, x long, v long").dropDuplicates(["g", "x"]).repartition(7)
    got = numbering.running_sum(df, "x", "v", ["g"]).collect()
    for g in ("g0", "g1", "g2"):
        total = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: r.x):
            assert r.before == total
            total += r.v
    assert numbering.running_sum(df.limit(0), "x", "v", ["g"]).count() == 0


def test_auc_of_crowded_scores(spark, monkeypatch):
    rng = np.random.default_rng(8)
    n = 40_000
    p = rng.random(n) ** 8  # most scores lie near zero
    truth = rng.random(n) < 0.02 + 0.5 * p
    df = spark.createDataFrame([(("a" if t else "b"), "a", float(x)) for t, x in zip(truth, p)], "label string, cls string, p double")
    df = df.repartition(8)
    parts = []
    write = numbering.write_scratch
    monkeypatch.setattr(numbering, "write_scratch", lambda d, name: (lambda t: parts.extend(
        r["count"] for r in t.groupBy("cls", "__part").count().collect()) or t)(write(d, name)))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as many ranges as shuffle partitions
    try:
        auc = ev.roc_auc_ovr(df).first()["auc"]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    order = np.argsort(p)
    rank = np.empty(n)
    rank[order] = np.arange(1, n + 1)
    pos = truth.sum()
    assert abs(auc - (rank[truth].sum() - pos * (pos + 1) / 2) / (pos * (n - pos))) < 1e-9
    assert len(parts) == 8 and max(parts) < 4 / 8 * n
