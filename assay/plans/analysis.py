"""T4: the whole analysis as a registry of stages over the library's operators.

Every stage of ``STAGES`` takes the run's state, leaves its part there and returns its lines of the report.  The rows are
written to the shared folder after cleaning, splitting and folding (a checkpoint), with their features, and resampled; all statistics, selections, fits
and searches see the train rows only.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.stats import r6
from assay.functions.text import normalize_category, normalize_target, parse_number, strip_numeric_symbols
from assay.operators import clean, encode as en, evaluate as ev, features as fe, models as md
from assay.operators import profile as pr, sampling as sa, select as se
from assay.plans.registry import register
from assay.session import ensure_checkpoint_dir, scratch_path, write_scratch
from assay.sources import tables
from assay.sources.views import obs_raw

SEED = 42
FOLDS = 3
SYNONYMS = {"OPEN": "O", "FILLED": "F"}
NUMERIC = ["qty", "price"]
#: Features that each univariate ranking may put forward, and features that the forest's importances leave.
UNIVARIATE, KEEP = 8, 6
#: Values that a second, wider search tries for the models that are tuned.
WIDER = {"logreg": [0.0, 1.0], "dt": [2, 12], "rf": [2, 12]}
#: Cross-validated accuracy from which the wider search is not run.
GOOD_ENOUGH = 0.9
REPORT = "stage string, item string, metric string, value double"


@dataclass
class Run:
    """What the stages of one run share; ``preds`` and ``probs`` hold one table per model, over the test rows."""

    spark: SparkSession
    sf: str
    rows: DataFrame | None = None
    feats: list[str] = field(default_factory=list)
    train: DataFrame | None = None
    test: DataFrame | None = None
    prep: PipelineModel | None = None
    labels: list[str] = field(default_factory=list)
    probs: dict[str, DataFrame] = field(default_factory=dict)
    preds: dict[str, DataFrame] = field(default_factory=dict)
    tuned: object = None
    board: list = field(default_factory=list)
    chosen: str = ""

    def of(self, split: str) -> DataFrame:
        return self.rows.where(F.col("split") == split)

    def add(self, name: str, scored: DataFrame) -> None:
        """Keep the probabilities and decoded predictions of ``scored`` (``id, label, prediction, p_0 ..``)."""
        codes = range(len(self.labels))
        self.probs[name] = scored.select("id", "label", *[F.col(f"p_{i}").alias(f"p_{self.labels[i]}") for i in codes])
        decoded = IndexToString(inputCol="prediction", outputCol="pred", labels=self.labels).transform(scored)
        self.preds[name] = decoded.select("id", "label", "pred")


def cleaned(spark, sf):
    """Header rows out, numbers coerced, target normalised and consolidated, rare classes merged."""
    r = write_scratch(obs_raw(spark, sf), "analysis-raw")  # the class sizes and the ranks read the rows again
    r = clean.remove_header_rows(r, "label_txt", "label_txt|label", ["qty_txt", "price_txt"])
    r = r.select("obs_id",
                 parse_number(strip_numeric_symbols(F.col("qty_txt"))).alias("qty"),
                 parse_number(strip_numeric_symbols(F.col("price_txt"))).alias("price"),
                 normalize_category(F.col("segment_txt")).alias("segment"),
                 clean.consolidate(normalize_target(F.col("label_txt")), SYNONYMS).alias("label"))
    r = clean.merge_rare_classes(r, "label")
    return clean.drop_singleton_classes(r, "label")


def split_stage(run: Run) -> list[tuple]:
    """Clean, split (R9) and fold (R11); the one checkpoint of the run."""
    ensure_checkpoint_dir(run.spark)
    c = sa.split_and_folds(cleaned(run.spark, run.sf), "label", "obs_id", 0.2, FOLDS, SEED)
    run.rows = c.withColumnRenamed("fold", "sfold").checkpoint()
    sizes = run.rows.groupBy("split").count().collect()  # two rows
    return [(r["split"], "rows", r["count"]) for r in sizes]


def feature_stage(run: Run) -> list[tuple]:
    """Median fill, IQR cap, ratio, logs of skewed columns, top levels one-hot, with the statistics of the train rows."""
    run.rows = clean.impute_median(run.rows, NUMERIC, clean.fit_median(run.of("train"), NUMERIC))
    run.rows = clean.iqr_cap(run.rows, NUMERIC, k=2.0, guard_zero_iqr=True, stats=clean.fit_iqr(run.of("train"), NUMERIC))
    run.rows = fe.ratio_features(run.rows, [("price", "qty")])
    run.rows = fe.log_if_skewed(run.rows, NUMERIC, fit_on=run.of("train"))
    run.rows = clean.top_k_or_other(run.rows, "segment", fit_on=run.of("train"))
    run.rows = en.one_hot(run.rows, "segment", en.fit_one_hot(run.of("train"), "segment")).withColumn(
        "id", F.col("obs_id").cast("string"))
    run.rows = write_scratch(md.dealt(run.rows, run.rows.count()), "analysis-rows")
    run.feats = [c for c in run.rows.columns if c not in ("obs_id", "id", "label", "segment", "split", "sfold")]
    return [("all", "features", len(run.feats))]


def select_stage(run: Run) -> list[tuple]:
    """features that vary, the best by F or by mutual information, and of these the most important of a forest."""
    train = run.of("train")
    long = se.to_long(train, ["id", "label"], run.feats)
    vary = se.variance_table(long).where("variance > 0").select("feature")
    either = se.union_of([se.top_k(se.anova_f(long), "f_score", UNIVARIATE),
                          se.top_k(se.mutual_information(long), "mi", UNIVARIATE)])
    names = sorted(r["feature"] for r in either.join(vary, "feature").collect())  # at most twice UNIVARIATE rows
    coded = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(train).transform(train)
    coded = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(coded)
    forest = md.estimator("rf", SEED, numTrees=100).fit(coded)
    ranked = md.select_by_importance(md.importance_table(forest, names, run.spark), KEEP).collect()
    run.feats = sorted(r["feature"] for r in ranked if r["selected"])
    return [(r["feature"], m, float(v)) for r in ranked for m, v in (("importance", r["importance"]), ("kept", r["selected"]))]


def rebalance_stage(run: Run) -> list[tuple]:
    """The train rows, resampled to the largest class if their classes are uneven.

    A row drawn several times keeps its fold, so that its copies never stand on both sides of a fold, and gets ids of its own.
    """
    columns = ["id", "label", "sfold", *run.feats]
    run.train, run.test = run.of("train").select(columns), run.of("test").select(columns)
    ratio = pr.class_balance(run.train, "label").first()["balance_ratio"]
    if ratio is not None and ratio < 0.7:
        given = [r["count"] for r in run.train.groupBy("label").count().collect()]  # one row per class
        drawn = sa.balance_max(run.train, "label", "id", SEED)
        drawn = drawn.withColumn("id", F.concat_ws("#", "id", F.col("draw").cast("string"))).drop("draw")
        run.train = write_scratch(md.dealt(drawn, len(given) * max(given)), "analysis-train")
    run.prep = md.prepare(run.train, run.feats).fit(run.train)
    run.labels = run.prep.stages[0].labels
    run.train = md.held(run.prep.transform(run.train).select("id", "label", "sfold", "y", "features"))
    run.test = md.held(run.prep.transform(run.test))
    sizes = run.train.groupBy("label").count().collect()  # one row per class
    return [("train", "balance_ratio", ratio)] + [(r["label"], "rows", r["count"]) for r in sizes]


def fit_stage(run: Run) -> list[tuple]:
    """Five models; the report names the complexity of each (A24): its trees, else 100 C, else 100."""
    k = len(run.labels)
    native = {"logreg": {"regParam": 0.01}, "rf": {"numTrees": 100}, "mlp": {"layers": [len(run.feats), 32, 16, k]}}
    *models, boosted, svm = md.together(
        [lambda name=name, params=params: md.estimator(name, SEED, **params).fit(run.train) for name, params in native.items()]
        + [lambda: md.fit_gbt_ovr(run.train, k, max_iter=10, seed=SEED),
           lambda: md.fit_calibrated_svm(run.train, k, folds=FOLDS, maxIter=20, regParam=0.01)], len(native) + 2)
    out = []
    for name, model in zip(native, models):
        run.add(name, md.probability_columns(model.transform(run.test), k))
        reg = model.getOrDefault("regParam") if model.hasParam("regParam") else None
        out.append((name, "complexity", model.getNumTrees if name == "rf" else 100.0 / reg if reg else 100.0))
    run.add("gbt", md.predict_gbt_ovr(boosted, run.test))
    run.add("linear_svm", svm.transform(run.test))
    return out + [("gbt", "complexity", sum(m.getNumTrees for m in boosted)), ("linear_svm", "complexity", 100.0 / 0.01)]


def tune_stage(run: Run) -> list[tuple]:
    """The best of three models by cross-validation is searched, wider if it is not good enough (L16), and fitted anew."""
    k, n = len(run.labels), len(run.feats)
    cv = {m: md.cv_scores(md.candidate(m, n, k, SEED), [{}], run.train, "sfold", FOLDS)[0] for m in WIDER}
    name = min(cv, key=lambda m: (-cv[m][0], m))
    est = md.candidate(name, n, k, SEED)
    param = est.getParam(md.CANDIDATES[name][1])
    found = md.gated_search(est, [{}] + [{param: v} for v in md.CANDIDATES[name][2]], [{param: v} for v in WIDER[name]],
                            run.train, "sfold", GOOD_ENOUGH, FOLDS, known=[cv[name]])
    run.tuned = est.copy(found["params"]).fit(run.train)
    run.add(f"{name}_tuned", md.probability_columns(run.tuned.transform(run.test), k))
    value = run.tuned.getOrDefault(param.name)
    return [(m, "cv_accuracy", a) for m, (a, _) in cv.items()] + [
        (f"{name}_tuned", "cv_accuracy", found["accuracy"]), (f"{name}_tuned", param.name, value),
        (f"{name}_tuned", "searched_wider", found["ran_wider"])]


def ensemble_stage(run: Run) -> list[tuple]:
    """Soft vote of all models, and a logistic model over the out-of-fold probabilities of two."""
    members = list(run.probs)
    vote = ev.soft_vote(list(run.probs.values()), "id", run.labels, keep=["label"])
    run.preds["Voting_Ensemble"] = vote.select("id", "label", "pred")
    stacked = md.stacked(run.train, run.test, ["logreg", "rf"], len(run.labels), FOLDS, SEED)
    run.add("Stacking_Ensemble", md.probability_columns(stacked, len(run.labels)))
    return [("Voting_Ensemble", "members", len(members)), ("Stacking_Ensemble", "members", 2)]


def choose_stage(run: Run) -> list[tuple]:
    """Accuracy and macro F1 of every model on the test rows, and the choice between the best model and ensemble."""
    every = reduce(DataFrame.unionByName, [p.withColumn("model", F.lit(m)) for m, p in run.preds.items()])
    counts = every.groupBy("model", "label", "pred").agg(F.count(F.lit(1)).alias("n")).persist()
    hit = F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0))
    acc = counts.groupBy("model").agg((hit / F.sum("n")).alias("test_accuracy"), F.sum("n").alias("n"))
    board = acc.join(ev.macro_f1(counts, ["model"]).withColumnRenamed("f1", "macro_f1"), "model").select(
        "model", r6("test_accuracy").alias("test_accuracy"), r6("macro_f1").alias("macro_f1"), "n")
    run.board = board.collect()  # one row per model
    run.chosen = ev.best_of(run.spark.createDataFrame(run.board, board.schema)).first()["chosen"]
    counts.unpersist()
    out = [(r["model"], m, r[m]) for r in run.board for m in ("test_accuracy", "macro_f1", "n")]
    return out + [(r["model"], "chosen", r["model"] == run.chosen) for r in run.board]


def sink_stage(run: Run) -> list[tuple]:
    """Predictions (S7), leaderboard (S5), feature list (S9) and the tuned pipeline (S8) are written and read back."""
    path, spark = scratch_path(run.spark, "analysis"), run.spark
    tables.write_parquet(run.preds[run.chosen], f"{path}/predictions")
    board = spark.createDataFrame(run.board, "model string, test_accuracy double, macro_f1 double, n long")
    tables.write_json_summary(tables.run_metadata(board, chosen=run.chosen, seed=SEED), f"{path}/leaderboard")
    tables.write_csv(spark.createDataFrame([(f,) for f in run.feats], "feature string"), f"{path}/features")
    md.save_model(PipelineModel(stages=[*run.prep.stages, run.tuned]), f"{path}/model")
    rows = spark.read.parquet(f"{path}/predictions").count()
    models = spark.read.json(f"{path}/leaderboard").count()
    feats = spark.read.option("header", True).csv(f"{path}/features").count()
    again = md.load_model(f"{path}/model").transform(run.test.select("id", "label", *run.feats))
    here = run.tuned.transform(run.test).select("id", F.col("prediction").alias("before"))
    differ = again.select("id", "prediction").join(here, "id").where("prediction <> before").count()
    return [("predictions", "rows_read_back", rows), ("leaderboard", "rows_read_back", models),
            ("features", "rows_read_back", feats), ("model", "predictions_that_differ", differ)]


STAGES = [("split", split_stage), ("features", feature_stage), ("select", select_stage), ("rebalance", rebalance_stage),
          ("fit", fit_stage), ("tune", tune_stage), ("ensemble", ensemble_stage), ("choose", choose_stage), ("sink", sink_stage)]


@register("complete_analysis")
def complete_analysis(spark, sf):
    """T4: the end-to-end run; returns the report of its stages, ``stage, item, metric, value`` (rows-only; invariants tested)."""
    run, report = Run(spark, sf), []
    for name, stage in STAGES:
        report += [(name, item, metric, None if v is None else round(float(v), 6)) for item, metric, v in stage(run)]
    run.train.unpersist()
    run.test.unpersist()
    return spark.createDataFrame(report, REPORT)
