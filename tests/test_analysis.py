"""The end-to-end run: every stage reports, its figures hang together, and what it writes reads back."""

import __spark_entry__ as entry
from assay.operators import models as md
from assay.plans import analysis
from tests.conftest import SF_SMALL


def test_complete_analysis(spark):
    rows = entry.queries()["complete_analysis"](spark, SF_SMALL).collect()
    got = {(r.stage, r.item, r.metric): r.value for r in rows}
    assert {r.stage for r in rows} == {name for name, _ in analysis.STAGES} and len(got) == len(rows)
    n_test = got["split", "test", "rows"]
    kept = [r.item for r in rows if (r.stage, r.metric) == ("select", "kept") and r.value]
    assert 1 <= len(kept) <= analysis.KEEP <= got["features", "all", "features"]
    sizes = [r.value for r in rows if (r.stage, r.metric) == ("rebalance", "rows")]
    balanced = got["rebalance", "train", "balance_ratio"] >= 0.7
    assert sum(sizes) == got["split", "train", "rows"] if balanced else len(set(sizes)) == 1
    models = {r.item for r in rows if (r.stage, r.metric) == ("choose", "test_accuracy")}
    fitted = {r.item for r in rows if r.stage == "fit"}
    assert fitted == {"logreg", "rf", "mlp", "gbt", "linear_svm"} and got["fit", "rf", "complexity"] == 100
    (tuned,) = {m for m in models if m.endswith("_tuned")}
    assert models == fitted | {tuned, "Voting_Ensemble", "Stacking_Ensemble"}
    assert got["ensemble", "Voting_Ensemble", "members"] == 6
    # the search holds the untuned model too, so it never falls behind it
    assert got["tune", tuned, "cv_accuracy"] >= max(v for (s, i, m), v in got.items() if s == "tune" and m == "cv_accuracy")
    assert all(got["choose", m, "n"] == n_test for m in models)
    (chosen,) = [m for m in models if got["choose", m, "chosen"]]
    assert got["choose", chosen, "test_accuracy"] == max(got["choose", m, "test_accuracy"] for m in models)
    assert got["sink", "predictions", "rows_read_back"] == n_test
    assert got["sink", "leaderboard", "rows_read_back"] == len(models)
    assert got["sink", "features", "rows_read_back"] == len(kept)
    assert got["sink", "model", "predictions_that_differ"] == 0


def test_copies_of_a_row_share_its_fold(spark):
    run = analysis.Run(spark, SF_SMALL)
    for _, stage in analysis.STAGES[:4]:
        stage(run)
    ids = [(r.id, r.sfold) for r in run.train.select("id", "sfold").collect()]
    assert len({i for i, _ in ids}) == len(ids)
    folds = {}
    for i, f in ids:
        folds.setdefault(i.split("#")[0], set()).add(f)
    assert all(len(f) == 1 for f in folds.values())
    test = {r.id for r in run.test.select("id").collect()}
    assert not test & set(folds)


def test_select_by_importance(spark):
    t = spark.createDataFrame([("a", 0.4), ("b", 0.1), ("c", 0.4), ("d", 0.1)], "feature string, importance double")
    top = {r.feature: r.selected for r in md.select_by_importance(t, 1).collect()}
    assert top == {"a": True, "b": False, "c": False, "d": False}
    half = {r.feature: (r.rank, r.selected) for r in md.select_by_importance(t).collect()}
    assert half == {"a": (1, True), "c": (2, True), "b": (3, False), "d": (4, False)}
