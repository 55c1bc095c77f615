"""Queries for evaluation, ensembles and model tables (V*, W*, L10, L17, P14, P15, M17, A24, S6, S7, J2, J3)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assay.functions.stats import r6
from assay.operators import evaluate as ev
from assay.operators.features import tier
from assay.plans.registry import register
from assay.sources.views import CLASSES, RULE_MODELS, model_preds, obs, pred, scores, scores_wide

VOTE = "Voting_Ensemble"
BASE_MODEL = "rule_c"
MODELS = list(RULE_MODELS) + [VOTE]


def _rnd(df, digits=6, skip=()):
    return df.select(*[r6(c, digits).alias(c) if t == "double" and c not in skip else F.col(c)
                       for c, t in df.dtypes])


def all_preds(spark, sf):
    """Rule-model predictions plus the soft-voting ensemble (L10) over them."""
    v = ev.soft_vote([scores_wide(spark, sf)], "obs_id", CLASSES, keep=["label", "split", "fold"])
    v = v.select("obs_id", "label", "split", "fold", F.lit(VOTE).alias("model"), "pred", "confidence")
    return model_preds(spark, sf).unionByName(v)


SQL_ALL_PREDS = f"""
vote as (
  select obs_id, label, split, fold, '{VOTE}' as model,
         case when pf >= po and pf >= pp then 'F' when po >= pp then 'O' else 'P' end as pred,
         greatest(pf, po, pp) as confidence
  from (select obs_id, label, split, fold, avg(case when cls = 'F' then p end) as pf,
               avg(case when cls = 'O' then p end) as po, avg(case when cls = 'P' then p end) as pp
        from scores group by obs_id, label, split, fold) t),
all_preds as (select obs_id, label, split, fold, model, pred, confidence from model_preds
              union all select * from vote)"""

SQL_BOARD = SQL_ALL_PREDS + f""",
f as (select model, fold,
        sum(case when split = 'test' and label = pred then 1 else 0 end) as tc,
        sum(case when split = 'test' then 1 else 0 end) as tn,
        sum(case when split = 'train' and label = pred then 1 else 0 end) as rc,
        sum(case when split = 'train' then 1 else 0 end) as rn
      from all_preds group by model, fold),
m as (select model, sum(tc) / sum(tn) as test_accuracy, sum(rc) / sum(rn) as train_accuracy,
             avg(rc / rn) as cv_mean, stddev_pop(rc / rn) as cv_std from f group by model),
board as (select m.*, (m.test_accuracy - b.test_accuracy) / b.test_accuracy * 100 as improvement_pct,
                 row_number() over (order by m.test_accuracy desc, m.model) as rank
          from m cross join (select test_accuracy from m where model = '{BASE_MODEL}') b)"""


def leaderboard_df(spark, sf):
    """One row per model: test / train accuracy, CV mean and std over
    folds, improvement over the base model, rank.  One grouped pass over the
    prediction table, then work on a table with one row per model."""
    ap = all_preds(spark, sf)
    test, train, ok = F.col("split") == "test", F.col("split") == "train", F.col("label") == F.col("pred")
    f = ap.groupBy("model", "fold").agg(
        F.sum((test & ok).cast("bigint")).alias("tc"), F.sum(test.cast("bigint")).alias("tn"),
        F.sum((train & ok).cast("bigint")).alias("rc"), F.sum(train.cast("bigint")).alias("rn"))
    m = f.groupBy("model").agg((F.sum("tc") / F.sum("tn")).alias("test_accuracy"),
                               (F.sum("rc") / F.sum("rn")).alias("train_accuracy"),
                               F.avg(F.col("rc") / F.col("rn")).alias("cv_mean"),
                               F.stddev_pop(F.col("rc") / F.col("rn")).alias("cv_std"))
    # the base model's accuracy is a window over the per-model table (no self-join)
    j = m.select("*", F.max(F.when(F.col("model") == BASE_MODEL, F.col("test_accuracy")))
                 .over(Window.partitionBy()).alias("__base"))
    return j.select("model", "test_accuracy", "train_accuracy", "cv_mean", "cv_std",
                    ((F.col("test_accuracy") - F.col("__base")) / F.col("__base") * 100).alias("improvement_pct"),
                    F.row_number().over(Window.orderBy(F.desc("test_accuracy"), "model")).cast("bigint").alias("rank"))


BOARD_COLS = "model, round(test_accuracy, 6) as test_accuracy, round(train_accuracy, 6) as train_accuracy, " \
             "round(cv_mean, 6) as cv_mean, round(cv_std, 6) as cv_std, round(improvement_pct, 6) as improvement_pct, rank"


@register("leaderboard", f"with {SQL_BOARD}\nselect {BOARD_COLS} from board", ("model_preds",))
def leaderboard(spark, sf):
    """Leaderboard sorted by test accuracy."""
    return _rnd(leaderboard_df(spark, sf)).orderBy("rank")


@register("top_models", f"with {SQL_BOARD}\nselect {BOARD_COLS} from board where rank <= 3", ("model_preds",))
def top_models(spark, sf):
    """Top-3 models."""
    return _rnd(leaderboard_df(spark, sf).orderBy(F.desc("test_accuracy"), "model").limit(3))


@register("ensemble_rows", f"with {SQL_BOARD}\nselect {BOARD_COLS} from board "
          "where regexp_matches(model, 'Ensemble|Voting|Stacking')", ("model_preds",))
def ensemble_rows(spark, sf):
    """Leaderboard rows of ensembles."""
    return _rnd(leaderboard_df(spark, sf).where(F.col("model").rlike("Ensemble|Voting|Stacking")))


@register("best_model", f"""with {SQL_BOARD},
s as (select model as best_single, test_accuracy as single_score from board
      where not regexp_matches(model, 'Ensemble|Voting|Stacking') order by test_accuracy desc, model limit 1),
e as (select model as best_ensemble, test_accuracy as ensemble_score from board
      where regexp_matches(model, 'Ensemble|Voting|Stacking') order by test_accuracy desc, model limit 1)
select best_single, round(single_score, 6) as single_score, best_ensemble, round(ensemble_score, 6) as ensemble_score,
       case when ensemble_score > single_score then best_ensemble else best_single end as chosen,
       round(greatest(single_score, coalesce(ensemble_score, single_score)), 6) as chosen_score
from s cross join e""", ("model_preds",))
def best_model(spark, sf):
    """Keep the ensemble only if it beats the best single model."""
    return _rnd(ev.best_of(leaderboard_df(spark, sf)))


@register("tier_models", f"""with {SQL_BOARD}
select model, round(test_accuracy, 6) as test_accuracy,
  case when test_accuracy >= 0.90 then 'excellent' when test_accuracy >= 0.80 then 'good'
       when test_accuracy >= 0.70 then 'fair' else 'poor' end as score_tier,
  case when abs(train_accuracy - test_accuracy) < 0.05 then 'low'
       when abs(train_accuracy - test_accuracy) < 0.10 then 'moderate' else 'high' end as gap_tier
from board""", ("model_preds",))
def tier_models(spark, sf):
    """Score and overfitting tiers per model."""
    b = leaderboard_df(spark, sf)
    s, g = tier(F.col("test_accuracy"), F.abs(F.col("train_accuracy") - F.col("test_accuracy")))
    return _rnd(b.select("model", "test_accuracy", s.alias("score_tier"), g.alias("gap_tier")))


@register("overfit_gap", f"""with {SQL_BOARD}
select model, round(train_accuracy, 6) as train_accuracy, round(test_accuracy, 6) as test_accuracy,
       round(train_accuracy - test_accuracy, 6) as gap, round(abs(train_accuracy - test_accuracy), 6) as abs_gap
from board""", ("model_preds",))
def overfit_gap(spark, sf):
    """V8: train - test accuracy, signed and absolute."""
    b = leaderboard_df(spark, sf)
    return _rnd(b.select("model", "train_accuracy", "test_accuracy",
                         (F.col("train_accuracy") - F.col("test_accuracy")).alias("gap"),
                         F.abs(F.col("train_accuracy") - F.col("test_accuracy")).alias("abs_gap")))


@register("cv_summary", f"""with {SQL_ALL_PREDS},
fa as (select model, fold, avg(case when label = pred then 1.0 else 0.0 end) as accuracy
       from all_preds where split = 'train' group by model, fold)
select model, round(avg(accuracy), 6) as cv_mean, round(stddev_pop(accuracy), 6) as cv_std, count(*) as n_folds,
       round(avg(accuracy) - 2 * stddev_pop(accuracy), 6) as cv_lo, round(avg(accuracy) + 2 * stddev_pop(accuracy), 6) as cv_hi
from fa group by model""", ("model_preds",))
def cv_summary(spark, sf):
    """V7: per-fold accuracy -> mean, population std, +/- 2 std."""
    fa = ev.accuracy(all_preds(spark, sf).where(F.col("split") == "train"), by=["model", "fold"])
    return _rnd(ev.cv_summary(fa, by=["model"]))


_METRICS = ["test_accuracy", "train_accuracy", "cv_mean"]


@register("metrics_pivot", f"""with {SQL_BOARD},
l as ({" union all ".join(f"select model, '{m}' as metric, {m} as value from board" for m in _METRICS)})
select metric, {", ".join(f"round(max(case when model = '{m}' then value end), 6) as {m}" for m in MODELS)}
from l group by metric""", ("model_preds",))
def metrics_pivot(spark, sf):
    """Metric table transposed: metrics as rows, models as columns."""
    b = leaderboard_df(spark, sf)
    stack = ", ".join(f"'{m}', {m}" for m in _METRICS)
    long = b.selectExpr("model", f"stack({len(_METRICS)}, {stack}) as (metric, value)")
    return _rnd(long.groupBy("metric").pivot("model", MODELS).agg(F.max("value")))


# Nominal complexity parameters of the rule models (trees / C).
MODEL_PARAMS = {"rule_a": (300, None), "rule_b": (100, None), "rule_c": (None, 1.0),
                "rule_d": (None, 10.0), "rule_e": (None, None), VOTE: (None, None)}


@register("model_complexity", f"""with {SQL_BOARD},
p(model, n_estimators, c) as (values {", ".join(f"('{m}', {'NULL' if t is None else t}, {'NULL' if c is None else c})"
                                                for m, (t, c) in MODEL_PARAMS.items())})
select board.model, cast(coalesce(p.n_estimators, p.c * 100, 100) as double) as complexity,
       round(test_accuracy, 6) as test_accuracy from board join p on board.model = p.model""", ("model_preds",))
def model_complexity(spark, sf):
    """Complexity proxy (trees, or 100 * C, else 100) beside accuracy."""
    rows = [(m, None if t is None else float(t), c) for m, (t, c) in MODEL_PARAMS.items()]
    p = spark.createDataFrame(rows, "model string, n_estimators double, c double")
    b = leaderboard_df(spark, sf).join(F.broadcast(p), "model")
    return _rnd(b.select("model", F.coalesce(F.col("n_estimators"), F.col("c") * 100, F.lit(100.0)).alias("complexity"),
                         "test_accuracy"))


@register("accuracy", f"""with {SQL_ALL_PREDS}
select model, round(avg(case when label = pred then 1.0 else 0.0 end), 6) as accuracy, count(*) as n
from all_preds where split = 'test' group by model""", ("model_preds",))
def accuracy(spark, sf):
    """V1: test accuracy per model."""
    return _rnd(ev.accuracy(all_preds(spark, sf).where(F.col("split") == "test"), by=["model"]))


@register("vote_soft", f"""with {SQL_ALL_PREDS}
select obs_id, label, pred, round(confidence, 6) as confidence from vote where split = 'test'""", ("model_preds",))
def vote_soft(spark, sf):
    """Soft voting over the rule models (test rows)."""
    v = ev.soft_vote([scores_wide(spark, sf)], "obs_id", CLASSES, keep=["label", "split"])
    return _rnd(v.where(F.col("split") == "test").select("obs_id", "label", "pred", "confidence"))


_CM_SQL = """
cls as (select label as c from pred union select pred from pred),
grid as (select a.c as label, b.c as pred from cls a cross join cls b),
cnt as (select label, pred, count(*) as n from pred group by label, pred),
cm as (select grid.label, grid.pred, cast(coalesce(cnt.n, 0) as bigint) as n from grid left join cnt
       on grid.label = cnt.label and grid.pred = cnt.pred)"""


@register("confusion_matrix", f"""with
truth as (select obs_id, label from obs),
guess as (select obs_id, model, pred from model_preds where split = 'test'),
pr as (select g.model, t.label, g.pred from truth t join guess g on t.obs_id = g.obs_id),
cls as (select model, label as c from pr union select model, pred from pr),
grid as (select a.model, a.c as label, b.c as pred from cls a join cls b on a.model = b.model),
cnt as (select model, label, pred, count(*) as n from pr group by model, label, pred)
select grid.model, grid.label, grid.pred, cast(coalesce(cnt.n, 0) as bigint) as n from grid left join cnt
  on grid.model = cnt.model and grid.label = cnt.label and grid.pred = cnt.pred""", ("model_preds",))
def confusion_matrix(spark, sf):
    """Truth x prediction of every model, paired by an id join, zero cells kept."""
    truth = obs(spark, sf).select("obs_id", "label")
    guess = model_preds(spark, sf).where(F.col("split") == "test").select("obs_id", "model", "pred")
    return ev.confusion_matrix(truth.join(guess, "obs_id"), by=["model"])


@register("confusion_wide", f"""with {_CM_SQL}
select label, {", ".join(f"cast(sum(case when pred = '{c}' then n else 0 end) as bigint) as {c}" for c in CLASSES)}
from cm group by label""", ("pred",))
def confusion_wide(spark, sf):
    """Confusion matrix as a headerless-style wide integer table."""
    cm = ev.confusion_matrix(pred(spark, sf))
    w = ev.confusion_wide(cm, CLASSES)
    return w.select("label", *[F.col(c).cast("bigint").alias(c) for c in CLASSES])


@register("classification_report", f"""with {_CM_SQL},
per as (select t.cls, t.tp, t.support,
          coalesce(case when p.predicted = 0 then null else t.tp / p.predicted end, 0.0) as precision,
          coalesce(case when t.support = 0 then null else t.tp / t.support end, 0.0) as recall
        from (select label as cls, sum(case when label = pred then n else 0 end) as tp, sum(n) as support from cm group by label) t
        join (select pred as cls, sum(n) as predicted from cm group by pred) p on t.cls = p.cls),
per2 as (select *, coalesce(case when precision + recall = 0 then null else 2 * precision * recall / (precision + recall) end, 0.0) as f1 from per),
tot as (select sum(support) as total, sum(tp) as tp_all, avg(precision) as m_p, avg(recall) as m_r, avg(f1) as m_f,
               sum(precision * support) as w_p, sum(recall * support) as w_r, sum(f1 * support) as w_f from per2)
select cls, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, cast(support as bigint) as support from per2
union all select 'accuracy', null, null, round(tp_all / total, 6), cast(total as bigint) from tot
union all select 'macro avg', round(m_p, 6), round(m_r, 6), round(m_f, 6), cast(total as bigint) from tot
union all select 'weighted avg', round(w_p / total, 6), round(w_r / total, 6), round(w_f / total, 6), cast(total as bigint) from tot""",
          ("pred",))
def classification_report(spark, sf):
    """V3-V5: classification report of the rule-based prediction."""
    return _rnd(ev.classification_report(ev.confusion_matrix(pred(spark, sf))))


@register("roc_auc_ovr", """
with s as (select model, cls, p, sum(case when label = cls then 1 else 0 end) as pos,
                  sum(case when label <> cls then 1 else 0 end) as neg
           from scores where split = 'test' group by model, cls, p),
c as (select *, coalesce(sum(neg) over (partition by model, cls order by p rows between unbounded preceding and 1 preceding), 0) as below from s),
a as (select model, cls, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) as auc from c group by model, cls)
select model, cls, round(auc, 6) as auc from a
union all
select model, 'macro', round(case when count(*) > 2 then avg(auc) else 0 end, 6) from a group by model""", ("scores",))
def roc_auc_ovr(spark, sf):
    """V6: one-vs-rest ROC AUC per class and macro, per model (test rows)."""
    s = scores(spark, sf).where(F.col("split") == "test")
    a = ev.roc_auc_ovr(s, by=["model"])
    m = ev.macro_auc(a, by=["model"]).select("model", F.lit("macro").alias("cls"), "auc")
    return _rnd(a.unionByName(m))


@register("log_loss", """
select model, round(avg(-ln(greatest(p, 1e-15))), 6) as log_loss from scores
where split = 'test' and label = cls group by model""", ("scores",))
def log_loss(spark, sf):
    """Multi-class log loss per model."""
    return _rnd(ev.log_loss(scores(spark, sf).where(F.col("split") == "test"), by=["model"]))


@register("prediction_table", """
select obs_id, model as Model, label as True_Label, pred as Predicted_Label,
  cast(case label when 'F' then 0 when 'O' then 1 else 2 end as bigint) as True_Index,
  cast(case pred when 'F' then 0 when 'O' then 1 else 2 end as bigint) as Predicted_Index,
  round(pf, 6) as Probability_F, round(po, 6) as Probability_O, round(pp, 6) as Probability_P
from (select m.obs_id, m.model, m.label, m.pred,
        max(case when s.cls = 'F' then s.p end) as pf, max(case when s.cls = 'O' then s.p end) as po,
        max(case when s.cls = 'P' then s.p end) as pp
      from model_preds m join scores s on m.obs_id = s.obs_id and m.model = s.model
      where m.split = 'test' group by m.obs_id, m.model, m.label, m.pred) t""", ("model_preds",))
def prediction_table(spark, sf):
    """For every model, true / predicted label, their codes and one probability column per class."""
    w = scores_wide(spark, sf).where(F.col("split") == "test")
    pf, po, pp = F.col("p_F"), F.col("p_O"), F.col("p_P")
    pr_ = F.when((pf >= po) & (pf >= pp), "F").when(po >= pp, "O").otherwise("P")
    code = {c: i for i, c in enumerate(CLASSES)}

    def idx(c):
        return F.create_map(*[F.lit(x) for kv in code.items() for x in kv])[c].cast("bigint")
    t = w.select("obs_id", F.col("model").alias("Model"), F.col("label").alias("True_Label"), pr_.alias("Predicted_Label"), *[
        F.col(f"p_{c}").alias(f"Probability_{c}") for c in CLASSES])
    return _rnd(t.select("obs_id", "Model", "True_Label", "Predicted_Label", idx(F.col("True_Label")).alias("True_Index"),
                         idx(F.col("Predicted_Label")).alias("Predicted_Index"),
                         *[f"Probability_{c}" for c in CLASSES]))


@register("bind_columns", """
select a.obs_id, a.total_price, a.acct_bal, b.segment, b.label from obs a join obs b on a.obs_id = b.obs_id""",
          ("obs",))
def bind_columns(spark, sf):
    """Row-aligned column bind as an id join (both sides hash-partitioned on the id)."""
    o = obs(spark, sf)
    return o.select("obs_id", "total_price", "acct_bal").join(o.select("obs_id", "segment", "label"), "obs_id")


#: Models that a run should deliver; one of them made no prediction and gets a row of zeros.
EXPECTED_MODELS = [*MODELS, "rule_f"]


@register("leaderboard_full", f"""with {SQL_ALL_PREDS},
c as (select model, split, fold, label, pred, count(*) as n from all_preds group by all),
x as (select model, split, fold, label as cls, n as s, 0 as p, case when label = pred then n else 0 end as tp from c
      union all select model, split, fold, pred, 0, n, 0 from c),
ff as (select model, fold, avg(f1) as f1 from (
         select model, fold, cls, 2.0 * sum(tp) / (sum(s) + sum(p)) as f1 from x where split = 'train' group by model, fold, cls)
       group by model, fold),
tf as (select model, avg(f1) as test_f1 from (
         select model, cls, 2.0 * sum(tp) / (sum(s) + sum(p)) as f1 from x where split = 'test' group by model, cls)
       group by model),
fa as (select model, fold, sum(case when label = pred then n else 0 end) / sum(n) as acc from c where split = 'train'
       group by model, fold),
ta as (select model, sum(case when label = pred then n else 0 end) / sum(n) as test_accuracy from c where split = 'test'
       group by model),
cv as (select model, avg(acc) as cv_accuracy, stddev_pop(acc) as cv_accuracy_std from fa group by model),
cf as (select model, avg(f1) as cv_f1, stddev_pop(f1) as cv_f1_std from ff group by model),
s as (select model, cls, p, sum(case when label = cls then 1 else 0 end) as pos,
             sum(case when label <> cls then 1 else 0 end) as neg
      from (select model, label, cls, p from scores where split = 'test'
            union all select '{VOTE}', label, cls, avg(p) from scores where split = 'test' group by obs_id, label, cls)
      group by model, cls, p),
b as (select *, coalesce(sum(neg) over (partition by model, cls order by p rows between unbounded preceding and 1 preceding), 0)
        as below from s),
auc as (select model, avg(auc) as roc_auc from (
          select model, cls, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) as auc from b group by model, cls)
        group by model),
e(model) as (values {", ".join(f"('{m}')" for m in EXPECTED_MODELS)})
select e.model, {", ".join(f"round(coalesce({c}, 0.0), 6) as {c}" for c in (
    "cv_accuracy", "cv_accuracy_std", "cv_f1", "cv_f1_std", "test_accuracy", "test_f1", "roc_auc"))}
from e left join cv on e.model = cv.model left join cf on e.model = cf.model left join ta on e.model = ta.model
  left join tf on e.model = tf.model left join auc on e.model = auc.model""", ("model_preds", "scores"))
def leaderboard_full(spark, sf):
    """V9: cross-validated and test accuracy and macro F1 and the macro ROC AUC of every expected model; zeros for one
    that failed.  One pass counts (model, split, fold, truth, prediction); all but the AUC comes from these counts."""
    s = scores(spark, sf).where(F.col("split") == "test").select("obs_id", "model", "label", "cls", "p")
    vote = s.groupBy("obs_id", "label", "cls").agg(F.avg("p").alias("p")).select(
        "obs_id", F.lit(VOTE).alias("model"), "label", "cls", "p")
    return _rnd(ev.full_leaderboard(all_preds(spark, sf), s.unionByName(vote), EXPECTED_MODELS))
