"""Model training, ensembles and search on Spark ML.

Fits are distributed Spark ML jobs; what reaches the driver is the fitted
model (O(features x classes)) and small metric tables.  Probabilities are
exported as ``p_<code>`` columns so the evaluation operators and soft
voting (L10) consume every model the same way.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, FMClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       OneVsRest, RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assay.functions.hashing import uniform
from assay.functions.stats import attach
from assay.operators.boosting import fit_one_vs_rest
from assay.operators.machines import FactorMachines, Margins, fit_svms
from assay.operators.perceptron import Perceptron
from assay.session import ensure_checkpoint_dir, write_scratch


def prepare(df: DataFrame, features: Sequence[str], label: str = "label", scale: bool = True) -> Pipeline:
    """Label index (sorted codes, E3), vector assembly and standardisation."""
    stages = [StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep"),
              VectorAssembler(inputCols=list(features), outputCol="raw", handleInvalid="keep")]
    stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True) if scale
                  else VectorAssembler(inputCols=["raw"], outputCol="features"))
    return Pipeline(stages=stages)


def estimator(name: str, seed: int = 42, **params):
    """Spark ML estimator for a model family name (features -> y)."""
    common = dict(featuresCol="features", labelCol="y")
    if name == "logreg":
        lr = LogisticRegression(family="multinomial", maxIter=params.get("maxIter", 20),
                                regParam=params.get("regParam", 0.0),
                                elasticNetParam=params.get("elasticNetParam", 0.0), **common)
        if params.get("weightCol"):
            lr.setWeightCol(params["weightCol"])
        return lr
    if name == "rf":
        return RandomForestClassifier(numTrees=params.get("numTrees", 50), maxDepth=params.get("maxDepth", 8),
                                      minInstancesPerNode=params.get("minInstancesPerNode", 1), seed=seed, **common)
    if name == "dt":
        return DecisionTreeClassifier(maxDepth=params.get("maxDepth", 10), seed=seed, **common)
    if name == "mlp":
        return Perceptron(layers=params["layers"], maxIter=params.get("maxIter", 50), seed=seed, **common)
    if name == "gaussian_nb":
        from pyspark.ml.classification import NaiveBayes
        return NaiveBayes(modelType="gaussian", **common)
    if name == "linear_svm":
        return OneVsRest(classifier=LinearSVC(maxIter=params.get("maxIter", 10), regParam=params.get("regParam", 0.01)),
                         parallelism=3, **common)
    if name == "gbt":
        return OneVsRest(classifier=GBTClassifier(maxIter=params.get("maxIter", 10), maxDepth=params.get("maxDepth", 3), seed=seed),
                         parallelism=3, **common)
    if name == "fm":
        return FactorMachines(classifier=FMClassifier(maxIter=params.get("maxIter", 30), stepSize=params.get("stepSize", 0.05), seed=seed),
                              parallelism=3, **common)
    raise ValueError(name)


#: Models that a screening compares, with the value that tuning varies and its grid.
CANDIDATES: dict[str, tuple[str, str, list]] = {
    "logreg": ("logreg", "regParam", [0.001, 0.01, 0.1]), "logreg_l1": ("logreg", "regParam", [0.001, 0.01, 0.1]),
    "dt": ("dt", "maxDepth", [3, 5, 8]), "rf": ("rf", "maxDepth", [4, 6, 10]), "gbt": ("gbt", "maxDepth", [2, 4]),
    "gaussian_nb": ("gaussian_nb", "thresholds", []), "linear_svm": ("linear_svm", "regParam", [0.001, 0.1]),
    "mlp": ("mlp", "maxIter", [50, 150]), "fm": ("fm", "stepSize", [0.01, 0.1])}


def candidate(name: str, n_features: int, n_classes: int, seed: int = 42, **params):
    """Estimator of a name in :data:`CANDIDATES`."""
    fixed = {"logreg_l1": {"regParam": 0.01, "elasticNetParam": 1.0}, "mlp": {"layers": [n_features, 32, 16, n_classes]},
             "rf": {"numTrees": 20}, "gbt": {"maxIter": 5}}.get(name, {})
    return estimator(CANDIDATES[name][0], seed, **(fixed | params))


def screen_and_tune(train: DataFrame, n_features: int, n_classes: int, fold_col: str = "sfold", k: int = 3, top: int = 3,
                    seed: int = 42) -> list[tuple[str, str, str, float, float]]:
    """Cross-validate every candidate on one shared fold column, tune the ``top`` best of them over their grids.

    Rows ``(model, stage, params, accuracy, std)``: ``screen`` for every model, ``tuned`` with the best of its grid for every top
    model that has one, and ``final``: the tuned result where it beats the screened one, else the screened one, which models
    outside the top keep as well.
    """
    def score(name, **params):
        return cv_scores(candidate(name, n_features, n_classes, seed, **params), [{}], train, fold_col, k)[0]
    screened = dict(zip(CANDIDATES, together([lambda name=name: score(name) for name in CANDIDATES], 3)))
    rows = [(name, "screen", "", a, s) for name, (a, s) in screened.items()]
    best = sorted(screened, key=lambda n: (-screened[n][0], n))[:top]
    for name, (a, s) in screened.items():
        _, param, grid = CANDIDATES[name]
        final = ("", a, s)
        if name in best and grid:
            scores = together([lambda v=v: score(name, **{param: v}) for v in grid], 3)
            tried = [(f"{param}={v}", *s) for v, s in zip(grid, scores)]
            tuned = max(tried, key=lambda t: t[1])
            rows.append((name, "tuned", *tuned))
            final = tuned if tuned[1] > a else final
        rows.append((name, "final", *final))
    return rows


def successive_halving(est, maps: list, df: DataFrame, fold_col: str = "sfold", k: int = 3, eta: int = 3, rungs: int = 4,
                       id_col: str = "id", seed: int = 42) -> list[dict]:
    """Random search by successive halving: all ``maps`` on ``eta ** -(rungs - 1)`` of the rows, the best of every
    ``eta`` of them on ``eta`` times as many, and so on; the last rung sees all rows.

    The rows of a rung are those whose hash lies below its share, so every rung holds the rows of the one before, and
    one fold column serves all.  Returns ``rung, share, map, accuracy, std`` for everything that was tried.
    """
    out, alive = [], list(range(len(maps)))
    for rung in range(rungs):
        share = float(eta) ** (rung - rungs + 1)
        rows = df if share == 1 else held(df.where(uniform(F.col(id_col), seed, "rung") < share))
        scores = cv_scores(est, [maps[i] for i in alive], rows, fold_col, k, 8)
        if share < 1:
            rows.unpersist()
        tried = [{"rung": rung, "share": share, "map": i, "accuracy": a, "std": s} for i, (a, s) in zip(alive, scores)]
        out += tried
        alive = [t["map"] for t in sorted(tried, key=lambda t: (-t["accuracy"], t["map"]))[: max(1, -(-len(alive) // eta))]]
    return out


def together(jobs: Sequence[Callable], threads: int = 4) -> list:
    """Results of independent fits, in order; they run on driver threads and Spark schedules their tasks side by side."""
    with ThreadPoolExecutor(threads) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


#: Rows that a task of a repeated pass has at least, and at most where the cores would otherwise decide.
LEAST_ROWS, MOST_ROWS = 1 << 14, 1 << 20


def pass_tasks(spark: SparkSession, rows: int) -> int:
    """Partitions of a table of so many rows that is passed over again and again: two a core, but none below ``LEAST_ROWS`` or
    above ``MOST_ROWS`` rows.

    An iterative fit starts a job per step, and each of its tasks costs the scheduler and the driver the same, however few rows
    it has.
    """
    return max(1, min(2 * spark.sparkContext.defaultParallelism, rows // LEAST_ROWS), -(-rows // MOST_ROWS))


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of so many rows, dealt over :func:`pass_tasks` partitions of one size."""
    parts = pass_tasks(df.sparkSession, rows)
    return df.repartition(parts) if parts > 1 else df.coalesce(1)


def gathered(df: DataFrame) -> DataFrame:
    """``df`` in at most :func:`pass_tasks` partitions."""
    return df.coalesce(pass_tasks(df.sparkSession, df.count()))


def held(df: DataFrame) -> DataFrame:
    """``df`` persisted for repeated passes, in at most :func:`pass_tasks` partitions."""
    return gathered(df).persist(StorageLevel.MEMORY_AND_DISK)


def fit_linear_svm(train: DataFrame, threads: int = 3, maxIter: int = 10, regParam: float = 0.01) -> Margins:
    """The one-vs-rest linear SVM of ``estimator("linear_svm")``, its classes ``threads`` at a time.

    ``OneVsRest`` stores a copy of the rows before each class stores its own blocks of them.  Here only the blocks are stored, and
    with one thread those of one class: for wide vectors that are quickly computed from narrow rows.
    """
    whole = estimator("linear_svm", maxIter=maxIter, regParam=regParam)
    classes = int(train.agg(F.max("y")).first()[0]) + 1
    classifier = whole.getClassifier().copy({whole.getClassifier().featuresCol: "features", whole.getClassifier().labelCol: "yc"})

    def one(c):
        return classifier.fit(train.select("features", (F.col("y") == c).cast("double").alias("yc")))
    models = together([lambda c=c: one(c) for c in range(classes)], threads)
    return Margins(models)


#: Trees of a forest that are grown and scored together: a deep tree has tens of thousands of nodes, which the driver holds.
FOREST_PART = 20


def forest_scores(train: DataFrame, test: DataFrame, trees: int, seed: int = 42, part: int = FOREST_PART, **params) -> DataFrame:
    """L2: the ``test`` rows with ``probability`` and ``prediction`` of a random forest of any size, ``part`` trees at a time.

    The trees of a forest are independent, and its raw prediction is the sum of theirs.  Each part is fitted with a seed of its own and
    scores the rows, which are written with their sums so far: neither the driver, nor the bootstrap counts of a row, nor a
    task's sums ever hold more than a part.  A row keeps its node in every tree, so that a deep level does not start at the roots.
    """
    ensure_checkpoint_dir(train.sparkSession)
    rows, raw = test.select("*", F.lit(None).cast("array<double>").alias("__votes")), vector_to_array(F.col("rawPrediction"))
    for i, first in enumerate(range(0, trees, part)):
        # Spark ML seeds the draws of partition p with seed + p
        model = estimator("rf", seed + (i << 20), numTrees=min(part, trees - first), **params).setCacheNodeIds(True).fit(train)
        both = F.coalesce(F.zip_with("__votes", raw, lambda a, b: a + b), raw)
        rows = write_scratch(model.transform(rows).select(*test.columns, both.alias("__votes")), "forest")
    total = F.aggregate("__votes", F.lit(0.0), lambda a, v: a + v)
    best = F.array_position("__votes", F.array_max("__votes")) - 1
    return rows.select(*test.columns, array_to_vector(F.transform("__votes", lambda v: v / total)).alias("probability"),
                       best.cast("double").alias("prediction"))


def fit_lifted_svm(train: DataFrame, lift: Callable[[np.ndarray], np.ndarray], maxIter: int = 10, regParam: float = 0.01) -> Margins:
    """The one-vs-rest linear SVM over ``lift`` of the features, all classes in the same passes over the features themselves."""
    return fit_svms(train, estimator("linear_svm", maxIter=maxIter, regParam=regParam).getClassifier(), lift=lift)


def probability_columns(pred: DataFrame, n_classes: int, col: str = "probability") -> DataFrame:
    """Vector probability -> ``p_0 .. p_{k-1}``; keeps every other column."""
    arr = vector_to_array(F.col(col))
    return pred.select("*", *[arr[i].alias(f"p_{i}") for i in range(n_classes)])


def fit_gbt_ovr(train: DataFrame, n_classes: int, max_iter: int = 100, seed: int = 42) -> list:
    """L4: one binary ``GBTClassifier`` per class (GBT is binary-only in Spark ML), the trees of all classes grown side by side."""
    est = GBTClassifier(featuresCol="features", labelCol="yc", maxIter=max_iter, maxDepth=3, seed=seed)
    return fit_one_vs_rest(train, n_classes, est)


def predict_gbt_ovr(models: list, df: DataFrame) -> DataFrame:
    """Margins of the per-class GBTs normalised with a softmax -> p_c, prediction = arg-max."""
    out = df
    for c, m in enumerate(models):
        out = m.setPredictionCol(f"__pr{c}").setProbabilityCol(f"__pb{c}").setRawPredictionCol(f"__rw{c}") \
            .transform(out)
        out = out.select("*", vector_to_array(F.col(f"__rw{c}"))[1].alias(f"__m{c}")) \
            .drop(f"__pr{c}", f"__pb{c}", f"__rw{c}")
    k = len(models)
    mx = F.greatest(*[F.col(f"__m{c}") for c in range(k)])
    ex = [F.exp(F.col(f"__m{c}") - mx) for c in range(k)]
    tot = ex[0]
    for e in ex[1:]:
        tot = tot + e
    out = out.select("*", *[(ex[c] / tot).alias(f"p_{c}") for c in range(k)])
    return with_argmax(out.drop(*[f"__m{c}" for c in range(k)]), k)


def with_argmax(df: DataFrame, k: int) -> DataFrame:
    """prediction = arg-max of p_0..p_{k-1} (ties: smaller code)."""
    best = F.lit(0.0)
    pred = None
    for c in range(k):
        cond = F.lit(True)
        for o in range(k):
            if o < c:
                cond = cond & (F.col(f"p_{c}") > F.col(f"p_{o}"))
            elif o > c:
                cond = cond & (F.col(f"p_{c}") >= F.col(f"p_{o}"))
        pred = F.when(cond, F.lit(float(c))) if pred is None else pred.when(cond, F.lit(float(c)))
    return df.select("*", pred.alias("prediction"))


def rff_columns(features: Sequence[str], n_out: int = 50, gamma: float = 0.5, seed: int = 42) -> list[Column]:
    """L6 (re-aimed): random Fourier features sqrt(2/D) cos(w.x + b), w ~ N(0, 2 gamma).

    Weights are a fixed function of the seed (D x d numbers), so the columns
    are plain expressions evaluated inside whole-stage codegen.
    """
    w, b = _fourier(len(features), n_out, gamma, seed)
    cols = []
    for d in range(n_out):
        z = F.lit(float(b[d]))
        for j, f in enumerate(features):
            z = z + F.lit(float(w[d, j])) * F.col(f)
        cols.append((F.lit(math.sqrt(2.0 / n_out)) * F.cos(z)).alias(f"rff_{d}"))
    return cols


def _fourier(n_in: int, n_out: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, math.sqrt(2 * gamma), size=(n_out, n_in)), rng.uniform(0, 2 * math.pi, size=n_out)


def fourier(n_in: int, n_out: int = 50, gamma: float = 0.5, seed: int = 42) -> Callable[[np.ndarray], np.ndarray]:
    """The function of :func:`rff_columns` on a block of vectors (rows x components)."""
    w, b = _fourier(n_in, n_out, gamma, seed)
    return lambda x: math.sqrt(2.0 / n_out) * np.cos(x @ w.T + b)


class CalibratedSvm:
    """A one-vs-rest linear SVM whose margins a sigmoid per class turns into probabilities (Platt scaling)."""

    def __init__(self, svm, sigmoids: list[tuple[float, float]]):
        self.svm, self.sigmoids = svm, sigmoids

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``p_0 .. p_{k-1}`` (they sum to 1), ``probability`` (their vector) and ``prediction``."""
        k = len(self.sigmoids)
        m = vector_to_array(F.col("rawPrediction"))
        raw = self.svm.transform(df).select(*df.columns, *[
            (1.0 / (1.0 + F.exp(-(F.lit(a) * m[c] + F.lit(b))))).alias(f"__s{c}") for c, (a, b) in enumerate(self.sigmoids)])
        total = sum((F.col(f"__s{c}") for c in range(1, k)), F.col("__s0"))
        out = raw.select(*df.columns, *[
            F.when(total > 0, F.col(f"__s{c}") / total).otherwise(F.lit(1.0 / k)).alias(f"p_{c}") for c in range(k)])
        return with_argmax(out.withColumn("probability", array_to_vector(F.array(*[f"p_{c}" for c in range(k)]))), k)


def fit_calibrated_svm(train: DataFrame, n_classes: int, fold_col: str = "sfold", folds: int = 3, **params) -> CalibratedSvm:
    """L5 with probabilities: margins of every training row come from an SVM that did not see its fold; on these a logistic
    regression per class fits the sigmoid (Platt's targets keep it finite), and the SVM itself is fitted on all rows.

    All fits are Spark ML fits over the rows; the margins are written once, since every class reads them.
    """
    *blind, svm = together([lambda d=d: fit_linear_svm(d, **params) for d in
                            [*[train.where(F.col(fold_col) != f) for f in range(folds)], train]])
    parts = [m.transform(train.where(F.col(fold_col) == f)).select("y", vector_to_array("rawPrediction").alias("m"))
             for f, m in enumerate(blind)]
    margins = write_scratch(reduce(DataFrame.unionByName, parts), "svm-margins")
    sizes = {int(r["y"]): r["count"] for r in margins.groupBy("y").count().collect()}  # one row per class
    total = sum(sizes.values())

    def sigmoid(c):
        pos = sizes.get(c, 0)
        hi, lo = (pos + 1.0) / (pos + 2.0), 1.0 / (total - pos + 2.0)
        target = F.when(F.col("y") == c, hi).otherwise(lo)
        # a row with target t counts as t of a positive and 1 - t of a negative
        both = margins.select(array_to_vector(F.array(F.col("m")[c])).alias("features"), F.inline(F.array(
            F.struct(F.lit(1.0).alias("t"), target.alias("w")), F.struct(F.lit(0.0).alias("t"), (1.0 - target).alias("w")))))
        lr = LogisticRegression(featuresCol="features", labelCol="t", weightCol="w", maxIter=50).fit(both)
        return float(lr.coefficients[0]), float(lr.intercept)
    return CalibratedSvm(svm, together([lambda c=c: sigmoid(c) for c in range(n_classes)]))


def tensor_sketch(df: DataFrame, features: str = "features", out: str = "sketch", degree: int = 2, n_out: int = 256,
                  coef0: float = 1.0, gamma: float = 1.0, seed: int = 42) -> DataFrame:
    """L6, polynomial form: a vector ``out`` whose inner products estimate ``(gamma x.y + coef0) ** degree``.

    A tensor sketch: the vector, with ``sqrt(coef0)`` as one more component, is count-sketched ``degree`` times with
    independent hashes, and the sketches are convolved (a product of their Fourier transforms), so the work grows with
    the size of the vector and of the sketch and never with ``size ** degree``.  Unbiased; the error falls with ``1 / sqrt(n_out)``.
    """
    lift = sketcher(degree, n_out, coef0, gamma, seed)

    @F.pandas_udf("array<double>")
    def sketch(col: pd.Series) -> pd.Series:
        return pd.Series(list(lift(np.stack(col.to_numpy()).astype(np.float64)))) if len(col) else col
    return df.withColumn(out, array_to_vector(sketch(vector_to_array(features))))


def sketcher(degree: int = 2, n_out: int = 256, coef0: float = 1.0, gamma: float = 1.0, seed: int = 42) -> Callable[[np.ndarray], np.ndarray]:
    """The function of :func:`tensor_sketch` on a block of vectors (rows x components)."""
    def lift(x: np.ndarray) -> np.ndarray:
        x = np.column_stack([x * math.sqrt(gamma), np.full(len(x), math.sqrt(coef0))])
        rng = np.random.default_rng([seed, x.shape[1]])
        product = 1.0
        for _ in range(degree):
            at, sign = rng.integers(0, n_out, x.shape[1]), rng.choice([-1.0, 1.0], x.shape[1])
            counted = np.zeros((x.shape[1], n_out))
            counted[np.arange(x.shape[1]), at] = sign
            # the transform of a count sketch is a product with the transforms of its components, interleaved real and imaginary
            product = product * (x @ np.fft.rfft(counted, axis=1).view(np.float64)).view(np.complex128)
        return np.fft.irfft(product, n=n_out, axis=1)
    return lift


def cross_validate(est, grid: list, train: DataFrame, fold_col: str = "fold", parallelism: int = 4):
    """Grid search with a precomputed stratified fold column."""
    ev = MulticlassClassificationEvaluator(labelCol="y", predictionCol="prediction", metricName="accuracy")
    cv = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=ev, foldCol=fold_col,
                        parallelism=parallelism, seed=42)
    return cv.fit(train)


def sample_param_maps(est, space: dict, n: int, seed: int = 42) -> list:
    """``n`` param maps drawn by hash from a discrete space (without replacement)."""
    keys = list(space)
    combos = list(itertools.product(*[space[k] for k in keys]))
    import hashlib
    order = sorted(range(len(combos)), key=lambda i: hashlib.md5(f"{i}|{seed}".encode()).hexdigest())
    picked = [combos[i] for i in order[:n]]
    return [{getattr(est, k): v for k, v in zip(keys, combo)} for combo in picked]


def cv_table(cv_model, names: Sequence[str]) -> list[tuple]:
    """(params, mean accuracy, std accuracy) per param map of a fitted CrossValidator."""
    out = []
    stds = cv_model.stdMetrics if cv_model.stdMetrics else [0.0] * len(cv_model.avgMetrics)
    for pm, m, s in zip(cv_model.getEstimatorParamMaps(), cv_model.avgMetrics, stds):
        out.append(({p.name: v for p, v in pm.items() if p.name in names}, float(m), float(s)))
    return out


def around(best: float, factors: Sequence[float] = (0.5, 1.0, 2.0), lo: float | None = None) -> list[float]:
    """Second-stage values around the best first-stage value (clamped, deduplicated)."""
    vals = sorted({max(lo, best * f) if lo is not None else best * f for f in factors})
    return vals


def importance_table(model, features: Sequence[str], spark) -> DataFrame:
    """``featureImportances`` as ``(feature, importance)`` (sums to 1)."""
    imp = model.featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")


def select_by_importance(table: DataFrame, top: int | None = None) -> DataFrame:
    """``table`` (``feature, importance``) with ``rank`` (ties: name) and ``selected``: the ``top`` most important features,
    or without ``top`` those of at least the median importance."""
    place = F.row_number().over(Window.orderBy(F.desc("importance"), F.asc("feature")))  # one row per feature
    ranked = table.select("*", place.alias("rank"))
    if top is not None:
        return ranked.select("*", (F.col("rank") <= top).alias("selected"))
    ranked = attach(ranked, table.agg(F.median("importance").alias("__median")))
    return ranked.select(*table.columns, "rank", (F.col("importance") >= F.col("__median")).alias("selected"))


def coef_importance(model, features: Sequence[str], spark) -> DataFrame:
    """|coefficient| of the first class of a linear model."""
    m = model.coefficientMatrix.toArray()
    return spark.createDataFrame([(f, float(abs(m[0, j]))) for j, f in enumerate(features)],
                                 "feature string, importance double")


def rfe(train: DataFrame, features: Sequence[str], n_keep: int, seed: int = 42, num_trees: int = 20) -> list[str]:
    """recursive elimination, step 1: fit a forest, drop the least important, repeat."""
    keep = list(features)
    while len(keep) > n_keep:
        va = VectorAssembler(inputCols=keep, outputCol="features", handleInvalid="keep")
        m = RandomForestClassifier(featuresCol="features", labelCol="y", numTrees=num_trees, maxDepth=6,
                                   seed=seed).fit(va.transform(train))
        imp = m.featureImportances.toArray()
        worst = min(range(len(keep)), key=lambda i: (imp[i], keep[i]))
        keep.pop(worst)
    return keep


def stacking_oof(train: DataFrame, test: DataFrame, base: Sequence[str], n_classes: int, k: int = 3,
                 seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold base probabilities on train (k folds) and full-train
    base probabilities on test, as wide ``(id, <model>_p_<c>)`` tables."""
    def probs(model, df, tag):
        p = probability_columns(model.transform(df), n_classes)
        return p.select("id", *[F.col(f"p_{c}").alias(f"{tag}_p_{c}") for c in range(n_classes)])
    sides = [(train.where(F.col("sfold") != f), train.where(F.col("sfold") == f)) for f in range(k)] + [(train, test)]
    fits = together([lambda b=b, tr=tr: estimator(b, seed).fit(tr) for tr, _ in sides for b in base])
    scored = []
    for i, (_, held) in enumerate(sides):
        mine = [probs(m, held, b) for m, b in zip(fits[i * len(base):], base)]
        scored.append(reduce(lambda x, y: x.join(y, "id"), mine))
    *oof_parts, tcols = scored
    oof = reduce(DataFrame.unionByName, oof_parts)
    return oof, tcols


def stacked(train: DataFrame, test: DataFrame, base: Sequence[str], n_classes: int, k: int = 3, seed: int = 42) -> DataFrame:
    """The ``test`` rows scored by a logistic model over the out-of-fold probabilities of the ``base`` models."""
    oof, tp = stacking_oof(train, test, base, n_classes, k, seed)
    va = VectorAssembler(inputCols=[c for c in oof.columns if c != "id"], outputCol="features")
    # the fit reads its rows more than once: the base models score them once
    rows = write_scratch(oof.join(train.select("id", "label", "y"), "id"), "out-of-fold")
    meta = estimator("logreg", seed).fit(va.transform(rows))
    return meta.transform(va.transform(tp.join(test.select("id", "label", "y"), "id")))


def save_model(model: PipelineModel, path: str) -> None:
    """Spark ML persistence."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def cv_scores(est, maps: list, df: DataFrame, fold_col: str = "fold", k: int | None = None,
              parallelism: int = 4) -> list[tuple[float, float]]:
    """Mean / population std of fold accuracy per param map, without the final refit.

    Fits run on driver threads (Spark schedules their tasks concurrently), the
    way ``CrossValidator(parallelism=...)`` does.
    """
    folds = list(range(k)) if k is not None else sorted(r[0] for r in df.select(fold_col).distinct().collect())
    ev = MulticlassClassificationEvaluator(labelCol="y", predictionCol="prediction", metricName="accuracy")

    def one(job):
        i, f = job
        m = est.copy(maps[i]).fit(df.where(F.col(fold_col) != f))
        return i, f, ev.evaluate(m.transform(df.where(F.col(fold_col) == f)))
    with ThreadPoolExecutor(parallelism) as pool:
        res = list(pool.map(one, [(i, f) for i in range(len(maps)) for f in folds]))
    out = []
    for i in range(len(maps)):
        acc = [a for j, _, a in res if j == i]
        mu = sum(acc) / len(acc)
        out.append((mu, (sum((a - mu) ** 2 for a in acc) / len(acc)) ** 0.5))
    return out


def gated_search(est, first_maps: list, wider_maps: list, df: DataFrame, fold_col: str = "fold",
                 threshold: float = 0.90, k: int | None = None, known: Sequence[tuple[float, float]] = ()) -> dict:
    """Run the first search; run the wider one only if its best accuracy is
    below ``threshold``, and keep the wider result only if it is better.  ``known``: scores of its first maps, if there are any."""
    first = [*known, *cv_scores(est, first_maps[len(known):], df, fold_col, k)]
    bi = max(range(len(first)), key=lambda i: first[i][0])
    out = {"stage": "first", "params": first_maps[bi], "accuracy": first[bi][0], "ran_wider": False}
    if first[bi][0] < threshold and wider_maps:
        wide = cv_scores(est, wider_maps, df, fold_col, k)
        wi = max(range(len(wide)), key=lambda i: wide[i][0])
        out["ran_wider"] = True
        if wide[wi][0] > first[bi][0]:
            out.update(stage="wider", params=wider_maps[wi], accuracy=wide[wi][0])
    return out
