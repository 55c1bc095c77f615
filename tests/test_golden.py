"""The evaluation operators reproduce a published classification report from its matrix."""

import pytest
from pyspark.sql import functions as F

from assay.operators import evaluate as ev

# The published 4 x 4 confusion matrix (rows = truth, columns = prediction)
# and its published classification report.
CLASSES = ["ALL", "AML", "CLL", "CML"]
MATRIX = [[7, 5, 65, 3], [4, 13, 52, 4], [15, 14, 194, 6], [4, 6, 65, 2]]
REPORT = {
    "ALL": (0.23333333333333334, 0.0875, 0.12727272727272726, 80),
    "AML": (0.34210526315789475, 0.1780821917808219, 0.23423423423423423, 73),
    "CLL": (0.5159574468085106, 0.8471615720524017, 0.6413223140495867, 229),
    "CML": (0.13333333333333333, 0.025974025974025976, 0.043478260869565216, 77),
    "macro avg": (0.306182344158268, 0.2846794474518124, 0.26157688410652835, 459),
    "weighted avg": (0.37486116092158733, 0.47058823529411764, 0.3866918372227215, 459),
}
ACCURACY = 0.47058823529411764


def _cm(spark):
    rows = [(CLASSES[i], CLASSES[j], MATRIX[i][j]) for i in range(4) for j in range(4)]
    return spark.createDataFrame(rows, "label string, pred string, n bigint")


def test_report_matches_published(spark):
    rep = {r["cls"]: r for r in ev.classification_report(_cm(spark)).collect()}
    for cls, (p, r, f1, sup) in REPORT.items():
        assert rep[cls]["precision"] == pytest.approx(p, abs=1e-12)
        assert rep[cls]["recall"] == pytest.approx(r, abs=1e-12)
        assert rep[cls]["f1"] == pytest.approx(f1, abs=1e-12)
        assert rep[cls]["support"] == sup
    assert rep["accuracy"]["f1"] == pytest.approx(ACCURACY, abs=1e-12)
    assert (7 + 13 + 194 + 2) / 459 == pytest.approx(ACCURACY)


def test_confusion_from_pairs_roundtrip(spark):
    pairs = [(CLASSES[i], CLASSES[j]) for i in range(4) for j in range(4) for _ in range(MATRIX[i][j])]
    df = spark.createDataFrame(pairs, "label string, pred string")
    cm = {(r["label"], r["pred"]): r["n"] for r in ev.confusion_matrix(df).collect()}
    assert all(cm[(CLASSES[i], CLASSES[j])] == MATRIX[i][j] for i in range(4) for j in range(4))
    acc = ev.accuracy(df).first()["accuracy"]
    assert acc == pytest.approx(ACCURACY)


def test_zero_cells_and_absent_class(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "a")], "label string, pred string")
    df = df.union(spark.createDataFrame([("a", "c")], "label string, pred string"))
    cm = ev.confusion_matrix(df)
    assert cm.count() == 9  # labels = union of truth and prediction
    rep = {r["cls"]: r for r in ev.classification_report(cm).collect()}
    assert rep["c"]["precision"] == 0.0 and rep["c"]["recall"] == 0.0 and rep["c"]["f1"] == 0.0
    assert rep["c"]["support"] == 0


def test_auc_perfect_and_ties(spark):
    rows = [(1, "x", "x", 0.9), (2, "y", "x", 0.1), (3, "x", "x", 0.5), (4, "y", "x", 0.5)]
    df = spark.createDataFrame(rows, "id long, label string, cls string, p double")
    auc = ev.roc_auc_ovr(df).first()["auc"]
    # positives 0.9, 0.5; negatives 0.1, 0.5 -> (1 + 1 + 1 + 0.5) / 4
    assert auc == pytest.approx(0.875)
    assert F is not None
