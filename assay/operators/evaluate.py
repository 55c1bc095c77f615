"""Evaluation tables: accuracy, confusion matrix, report, ROC AUC, CV, log loss (V*, L10).

Inputs are prediction tables ``(id, label, pred[, by...])`` or long
probability tables ``(id, label, cls, p[, by...])``.  All metrics are
aggregates; the only windows run over small tables (classes, the distinct
scores of one range, models).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.numbering import running_sum
from assay.functions.stats import attach


def accuracy(df: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """V1: share of rows with pred == label."""
    return df.groupBy(*by).agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"),
                               F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """V2: long confusion matrix ``(by..., label, pred, n)`` with zero cells kept.

    One pass over the rows: a map-side combined count per (truth, prediction).  The class set (truths and predictions)
    and the k x k grid come from these at most k * k counts per group; null truths and predictions are left out.
    """
    by = list(by)
    cnt = df.groupBy(*by, label, pred).agg(F.count(F.lit(1)).alias("n")).where(
        F.col(label).isNotNull() | F.col(pred).isNotNull())
    g = cnt.groupBy(*by).agg(
        F.array_sort(F.array_union(F.collect_set(label), F.collect_set(pred))).alias("__cs"),
        F.map_from_entries(F.filter(F.collect_list(F.struct(F.struct(label, pred).alias("k"), F.col("n").alias("v"))),
                                    lambda e: e["k"][label].isNotNull() & e["k"][pred].isNotNull())).alias("__n"))
    grid = g.select(*by, "__cs", "__n", F.explode("__cs").alias(label)).select(
        *by, label, "__n", F.explode("__cs").alias(pred))
    return grid.select(*by, label, pred, F.coalesce(F.try_element_at("__n", F.struct(label, pred)), F.lit(0))
                       .cast("bigint").alias("n"))


def confusion_wide(cm: DataFrame, classes: Sequence[str], label: str = "label", pred: str = "pred") -> DataFrame:
    """Pivot the long matrix to one column per predicted class."""
    return cm.groupBy(label).pivot(pred, list(classes)).agg(F.sum("n")).na.fill(0)


def _safe_div(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def classification_report(cm: DataFrame, label: str = "label", pred: str = "pred",
                          by: Sequence[str] = ()) -> DataFrame:
    """V3-V5: per-class precision / recall / F1 / support, plus the accuracy,
    macro-average and weighted-average rows; 0 on empty denominators."""
    by = list(by)
    tp = cm.groupBy(*by, F.col(label).alias("cls")).agg(
        F.sum(F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0)).alias("tp"),
        F.sum("n").alias("support"))
    pc = cm.groupBy(*by, F.col(pred).alias("cls")).agg(F.sum("n").alias("predicted"))
    j = tp.join(pc, by + ["cls"])
    prec = _safe_div(F.col("tp"), F.col("predicted"))
    rec = _safe_div(F.col("tp"), F.col("support"))
    per = j.select(*by, "cls", "tp", "support", prec.alias("precision"), rec.alias("recall"))
    per = per.select("*", _safe_div(2 * F.col("precision") * F.col("recall"),
                                    F.col("precision") + F.col("recall")).alias("f1"))
    tot = per.groupBy(*by).agg(
        F.sum("support").alias("total"), F.sum("tp").alias("tp_all"),
        F.avg("precision").alias("m_p"), F.avg("recall").alias("m_r"), F.avg("f1").alias("m_f"),
        F.sum(F.col("precision") * F.col("support")).alias("w_p"),
        F.sum(F.col("recall") * F.col("support")).alias("w_r"),
        F.sum(F.col("f1") * F.col("support")).alias("w_f"))
    rows = per.select(*by, "cls", "precision", "recall", "f1", F.col("support").cast("bigint").alias("support"))
    acc = tot.select(*by, F.lit("accuracy").alias("cls"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), (F.col("tp_all") / F.col("total")).alias("f1"),
                     F.col("total").cast("bigint").alias("support"))
    mac = tot.select(*by, F.lit("macro avg").alias("cls"), F.col("m_p").alias("precision"),
                     F.col("m_r").alias("recall"), F.col("m_f").alias("f1"), F.col("total").cast("bigint").alias("support"))
    wei = tot.select(*by, F.lit("weighted avg").alias("cls"), (F.col("w_p") / F.col("total")).alias("precision"),
                     (F.col("w_r") / F.col("total")).alias("recall"), (F.col("w_f") / F.col("total")).alias("f1"),
                     F.col("total").cast("bigint").alias("support"))
    return rows.unionByName(acc).unionByName(mac).unionByName(wei)


def roc_auc_ovr(scores: DataFrame, label: str = "label", cls: str = "cls", p: str = "p",
                by: Sequence[str] = ()) -> DataFrame:
    """V6: one-vs-rest ROC AUC per class with tie-averaged ranks.

    AUC_c = sum_s pos(s) * (neg_below(s) + neg(s) / 2) / (npos * nneg) over the
    distinct scores s of class c.  The running negative count is summed by
    ranges of scores that are cut where the scores lie (``running_sum``), so no
    window holds all scores of a class, however they crowd.  A class without
    positives or without negatives has AUC 0.
    """
    k = [*by, cls]
    pos = (F.col(label) == F.col(cls))
    d = scores.groupBy(*k, p).agg(F.sum(pos.cast("bigint")).alias("pos"), F.sum((~pos).cast("bigint")).alias("neg"))
    e = running_sum(d, p, "neg", k, "auc-scores", "below")
    return e.groupBy(*k).agg(
        F.coalesce(F.try_divide(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)),
                                F.sum("pos").cast("double") * F.sum("neg").cast("double")), F.lit(0.0)).alias("auc"))


def macro_auc(auc: DataFrame, by: Sequence[str] = (), zero_if_binary: bool = True) -> DataFrame:
    """Macro average of the per-class AUCs; 0 when there are <= 2 classes (as the reference reports)."""
    m = auc.groupBy(*by).agg(F.avg("auc").alias("auc"), F.count(F.lit(1)).alias("n_classes"))
    if zero_if_binary:
        m = m.select(*by, F.when(F.col("n_classes") > 2, F.col("auc")).otherwise(0.0).alias("auc"), "n_classes")
    return m


def log_loss(scores: DataFrame, label: str = "label", cls: str = "cls", p: str = "p",
             by: Sequence[str] = (), eps: float = 1e-15) -> DataFrame:
    """Mean of -ln(max(p_true, eps))."""
    t = scores.where(F.col(label) == F.col(cls))
    return t.groupBy(*by).agg(F.avg(-F.log(F.greatest(F.col(p), F.lit(eps)))).alias("log_loss"))


def cv_summary(fold_acc: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """V7: mean, population std and mean +/- 2 std of per-fold accuracies."""
    s = fold_acc.groupBy(*by).agg(F.avg("accuracy").alias("cv_mean"), F.stddev_pop("accuracy").alias("cv_std"),
                                  F.count(F.lit(1)).alias("n_folds"))
    return s.select("*", (F.col("cv_mean") - 2 * F.col("cv_std")).alias("cv_lo"),
                    (F.col("cv_mean") + 2 * F.col("cv_std")).alias("cv_hi"))


def soft_vote(prob_tables: Sequence[DataFrame], id_col: str, classes: Sequence[str],
              keep: Sequence[str] = ()) -> DataFrame:
    """Average class probabilities over models, arg-max (ties: earlier class).

    Each input has ``id_col``, ``keep`` columns and ``p_<class>`` columns; the
    union is reduced with one group-by on the id (map-side partial averages).
    """
    u = prob_tables[0]
    for t in prob_tables[1:]:
        u = u.unionByName(t)
    g = u.groupBy(id_col, *keep).agg(*[F.avg(f"p_{c}").alias(f"p_{c}") for c in classes])
    pred = None
    for i, c in enumerate(classes):
        cond = F.lit(True)
        for j, o in enumerate(classes):
            if j < i:
                cond = cond & (F.col(f"p_{c}") > F.col(f"p_{o}"))
            elif j > i:
                cond = cond & (F.col(f"p_{c}") >= F.col(f"p_{o}"))
        pred = F.when(cond, F.lit(c)) if pred is None else pred.when(cond, F.lit(c))
    return g.select("*", pred.alias("pred"), F.greatest(*[F.col(f"p_{c}") for c in classes]).alias("confidence"))


def best_of(board: DataFrame, score: str = "test_accuracy", name: str = "model",
            ensemble_pattern: str = "Ensemble|Voting|Stacking") -> DataFrame:
    """Best single model, best ensemble, and the choice; a tie keeps the single model."""
    ens = F.col(name).rlike(ensemble_pattern)

    def best(rows, tag):
        return rows.agg(F.min_by(F.col(name), F.struct(-F.col(score), F.col(name))).alias(f"best_{tag}"),
                        F.max(score).alias(f"{tag}_score"))
    s = attach(best(board.where(~ens), "single"), best(board.where(ens), "ensemble"))
    chosen = F.when(F.col("ensemble_score") > F.col("single_score"), F.col("best_ensemble")) \
        .otherwise(F.col("best_single"))
    return s.select("best_single", "single_score", "best_ensemble", "ensemble_score", chosen.alias("chosen"),
                    F.greatest("single_score", F.coalesce("ensemble_score", "single_score")).alias("chosen_score"))


def macro_f1(counts: DataFrame, by: Sequence[str], label: str = "label", pred: str = "pred", n: str = "n") -> DataFrame:
    """Macro F1 per group from a table of counts ``(by..., label, pred, n)``; every class seen as truth or prediction counts.

    F1 = 2 tp / (support + predicted): each count adds to its truth's support and to its prediction's total, no join.
    """
    by = list(by)
    hit = F.when(F.col(label) == F.col(pred), F.col(n)).otherwise(0)
    parts = F.array(F.struct(F.col(label).alias("cls"), F.col(n).alias("m"), hit.alias("tp")),
                    F.struct(F.col(pred).alias("cls"), F.col(n).alias("m"), F.lit(0).cast("bigint").alias("tp")))
    per = counts.select(*by, F.inline(parts)).groupBy(*by, "cls").agg(
        _safe_div(2.0 * F.sum("tp"), F.sum("m")).alias("f1"))
    return per.groupBy(*by).agg(F.avg("f1").alias("f1"))


def full_leaderboard(preds: DataFrame, scores: DataFrame, expected: Sequence[str]) -> DataFrame:
    """V9: one row per expected model, all columns 0 for a model without predictions.

    ``preds``: ``model, split, fold, label, pred``; ``scores``: ``model, label, cls, p`` of the test rows.  The tables that
    are joined have one row per model.
    """
    keys = ["model", "split", "fold"]
    c = preds.groupBy(*keys, "label", "pred").agg(F.count(F.lit(1)).alias("n"))
    train, test = c.where(F.col("split") == "train"), c.where(F.col("split") == "test")
    ok = F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0))
    fold = train.groupBy("model", "fold").agg((ok / F.sum("n")).alias("a"))
    tables = [
        fold.groupBy("model").agg(F.avg("a").alias("cv_accuracy"), F.stddev_pop("a").alias("cv_accuracy_std")),
        macro_f1(train, ["model", "fold"]).groupBy("model").agg(F.avg("f1").alias("cv_f1"), F.stddev_pop("f1").alias("cv_f1_std")),
        test.groupBy("model").agg((ok / F.sum("n")).alias("test_accuracy")),
        macro_f1(test.groupBy("model", "label", "pred").agg(F.sum("n").alias("n")), ["model"]).withColumnRenamed("f1", "test_f1"),
        macro_auc(roc_auc_ovr(scores, by=["model"]), by=["model"]).select("model", F.col("auc").alias("roc_auc"))]
    board = preds.sparkSession.createDataFrame([(m,) for m in expected], "model string")
    for t in tables:
        board = board.join(t, "model", "left")
    return board.na.fill(0.0)
