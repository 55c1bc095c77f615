"""Queries that train and evaluate Spark ML models.

Model quality is not a target (the driver tables carry little signal); these
are checked by row counts here and by invariants in ``tests/``.
"""

from __future__ import annotations

import json

from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from assay.functions.hashing import hash60
from assay.functions.stats import attach, one_row, quantile_row, r6
from assay.operators import boosting as bo, clean, models as md, profile as pr, sampling as sa
from assay.operators import scale as sc
from assay.plans.registry import register
from assay.session import write_scratch
from assay.sources.views import obs

SEED = 42
FEATURES = ["qty_f", "price_k", "bal_k", "priority_score", "is_auto", "price_per_qty_k"]
N_CLASSES = 3
CV_FOLDS = 3
#: Features that the top-n form of the importance selection keeps.
TOP = 3
#: Features that the funnel starts from besides ``FEATURES``, and features that each of its univariate rankings puts forward: both
#: rankings together keep fewer than they are given.
FUNNEL = {"qty_log": "ln(1 + qty_f)", "price_log": "ln(1 + 1000 * price_k)", "bal_sq_m": "bal_k * bal_k",
          "is_urgent": "cast(priority_score = 2 as double)", "bal_negative": "cast(bal_k < 0 as double)",
          "bal_over_9990": "cast(bal_k > 9.99 as double)"}
UNIVARIATE = 5


def model_base(spark, sf):
    """obs -> stratified split (R9), numeric feature columns with statistics of the train rows, folds on train.

    The view and the split with its folds are written once: the ranks read the written view, and every statistic, fit and score
    reads the rows it needs, dealt evenly, and none repeats the joins and ranks that lead to them.  Between the two the rows are
    shuffled once, by a part of their id's hash.
    """
    cols = ["obs_id", "qty_sum", "total_price", "acct_bal", "segment", "priority", "label"]
    o = write_scratch(obs(spark, sf).select(*cols, hash60(F.col("obs_id"), SEED).alias("order")), "model-obs")
    parts = md.pass_tasks(spark, o.count())
    s = sa.split_with_folds(o, "label", "obs_id", 0.2, CV_FOLDS, SEED, F.col("order"), parts)
    o = write_scratch(s.select(*cols, "split", "copy", "fold"), "model-split")
    o = clean.impute_median(o, ["qty_sum"], clean.fit_median(o.where("split = 'train' and copy = 0"), ["qty_sum"]))
    return o.select(F.col("obs_id").alias("id"), "label", F.col("qty_sum").alias("qty_f"),
                    (F.col("total_price") / 1000).alias("price_k"), (F.col("acct_bal") / 1000).alias("bal_k"),
                    F.coalesce(F.create_map(*[F.lit(x) for kv in {"1-URGENT": 2.0, "2-HIGH": 1.0, "3-MEDIUM": 0.5}.items()
                                              for x in kv])[F.col("priority")], F.lit(0.0)).alias("priority_score"),
                    (F.col("segment") == "AUTOMOBILE").cast("double").alias("is_auto"),
                    (F.col("total_price") / 1000 / (F.col("qty_sum") + 1)).alias("price_per_qty_k"),
                    "split", F.col("fold").alias("sfold"))


def prepared(spark, sf, base=None, hold=True):
    """Fit the preprocessing pipeline on train only; return (pipeline model, train, test), persisted.

    Without ``hold`` they are not: a single fit of Spark ML reads its rows two or three times and stores its own form of them.
    """
    b = model_base(spark, sf) if base is None else base
    pm = md.prepare(b, FEATURES).fit(b.where(F.col("split") == "train"))
    d = pm.transform(b).select("id", "label", "split", "sfold", "y", "features")
    d = md.held(d) if hold else md.gathered(d)
    return pm, d.where(F.col("split") == "train"), d.where(F.col("split") == "test")


def _decoded(pm, pred_df, with_prob=True):
    labels = pm.stages[0].labels
    out = IndexToString(inputCol="prediction", outputCol="pred", labels=labels).transform(pred_df)
    cols = [F.col("id"), F.col("label"), F.col("pred")]
    if with_prob:
        arr = md.vector_to_array(F.col("probability"))
        cols.append(r6(F.array_max(arr)).alias("confidence"))
    return out.select(*cols)


@register("model_logreg")
def model_logreg(spark, sf):
    """L1: multinomial logistic regression with balanced class weights."""
    pm, train, test = prepared(spark, sf)
    w = pr.class_weights(train, "label").select("label", F.col("weight").alias("w"))
    m = md.estimator("logreg", SEED, weightCol="w").fit(train.join(F.broadcast(w), "label"))
    return _decoded(pm, m.transform(test))


@register("model_rf")
def model_rf(spark, sf):
    """L2: random forest, 300 trees of depth 15 whose leaves have two rows or more, grown in parts."""
    pm, train, test = prepared(spark, sf)
    return _decoded(pm, md.forest_scores(train, test, 300, SEED, maxDepth=15, minInstancesPerNode=2))


@register("model_dt")
def model_dt(spark, sf):
    """L3: decision tree, depth 10."""
    pm, train, test = prepared(spark, sf)
    return _decoded(pm, md.estimator("dt", SEED).fit(train).transform(test))


@register("model_gbt")
def model_gbt(spark, sf):
    """L4: gradient boosting, one GBT per class, softmax of margins."""
    pm, train, test = prepared(spark, sf)
    ms = md.fit_gbt_ovr(train, N_CLASSES, max_iter=10, seed=SEED)
    p = md.predict_gbt_ovr(ms, test)
    labels = pm.stages[0].labels
    out = IndexToString(inputCol="prediction", outputCol="pred", labels=labels).transform(p)
    return out.select("id", "label", "pred", r6(F.greatest(*[F.col(f"p_{c}") for c in range(N_CLASSES)]))
                      .alias("confidence"))


#: Rounds of the registered boosting queries; ``fit_gbt_ovr`` itself defaults to 100.
LOSS_ROUNDS = 40


@register("boosting_loss")
def boosting_loss(spark, sf):
    """Loss of class-wise boosting after every iteration, on train and test (rows-only; invariants tested)."""
    _, train, test = prepared(spark, sf)
    models = md.fit_gbt_ovr(train, N_CLASSES, max_iter=LOSS_ROUNDS, seed=SEED)
    out = bo.staged_loss(models, train.unionByName(test))
    return out.select("split", "iteration", "rows", r6("loss").alias("loss"), r6("log_loss").alias("log_loss"))


@register("model_linear_svm")
def model_linear_svm(spark, sf):
    """One-vs-rest linear SVM with calibrated probabilities."""
    pm, train, test = prepared(spark, sf)
    scored = md.fit_calibrated_svm(train, N_CLASSES, folds=CV_FOLDS, maxIter=30).transform(test)
    p = [r6(f"p_{c}", 9).alias(f"p_{c}") for c in range(N_CLASSES)]
    return _decoded(pm, scored).join(scored.select("id", *p), "id")


@register("model_poly_svm")
def model_poly_svm(spark, sf):
    """Polynomial-kernel SVM of degree 3 via a tensor sketch and a linear SVM."""
    pm, train, test = prepared(spark, sf)

    def sketched(df):
        return md.tensor_sketch(df.select("id", "label", "y", "features"), degree=3, n_out=128, gamma=1.0 / len(FEATURES)).select(
            "id", "label", "y", F.col("sketch").alias("features"))
    m = md.fit_lifted_svm(train, md.sketcher(degree=3, n_out=128, gamma=1.0 / len(FEATURES)), maxIter=50)
    return _decoded(pm, m.transform(sketched(test)), with_prob=False)


@register("model_rff_svm")
def model_rff_svm(spark, sf):
    """L6 re-aimed: RBF-like kernel SVM via random Fourier features + linear SVM."""
    pm, train, test = prepared(spark, sf)
    arr = md.vector_to_array(F.col("features"))
    names = [f"f{i}" for i in range(len(FEATURES))]

    def rff(df):
        x = df.select("id", "label", "y", *[arr[i].alias(n) for i, n in enumerate(names)])
        x = x.select("id", "label", "y", *md.rff_columns(names, 50, 0.5, SEED))
        return VectorAssembler(inputCols=[f"rff_{d}" for d in range(50)], outputCol="features").transform(x)
    m = md.fit_lifted_svm(train, md.fourier(len(FEATURES), 50, 0.5, SEED))
    return _decoded(pm, m.transform(rff(test)), with_prob=False)


@register("model_mlp")
def model_mlp(spark, sf):
    """Multi-layer perceptron (100, 50)."""
    pm, train, test = prepared(spark, sf)
    m = md.estimator("mlp", SEED, layers=[len(FEATURES), 100, 50, N_CLASSES], maxIter=100).fit(train)
    return _decoded(pm, m.transform(test))


@register("model_stacking")
def model_stacking(spark, sf):
    """Stacking of logistic regression and random forest, logistic meta-model, 3 folds."""
    pm, train, test = prepared(spark, sf)
    return _decoded(pm, md.stacked(train, test, ["logreg", "rf"], N_CLASSES, CV_FOLDS, SEED))


def _cv_rows(spark, rows, stage="grid"):
    data = [(stage, json.dumps(p, sort_keys=True), round(m, 6), round(s, 6)) for p, m, s in rows]
    return spark.createDataFrame(data, "stage string, params string, cv_accuracy double, cv_std double")


@register("grid_search")
def grid_search(spark, sf):
    """2 x 2 grid, 3 stratified folds (foldCol), parallel fits."""
    pm, train, test = prepared(spark, sf)
    est = md.estimator("logreg", SEED)
    grid = md.ParamGridBuilder().addGrid(est.regParam, [0.0, 0.1]).addGrid(est.elasticNetParam, [0.0, 0.5]).build()
    cv = md.cross_validate(est, grid, train.withColumn("fold", F.col("sfold").cast("int")))
    return _cv_rows(spark, md.cv_table(cv, ["regParam", "elasticNetParam"]))


@register("random_search")
def random_search(spark, sf):
    """10 hash-sampled draws from a 4 x 3 space."""
    pm, train, test = prepared(spark, sf)
    est = md.estimator("dt", SEED)
    maps = md.sample_param_maps(est, {"maxDepth": [2, 4, 6, 8], "minInstancesPerNode": [1, 5, 20]}, 10, SEED)
    cv = md.cross_validate(est, maps, train.withColumn("fold", F.col("sfold").cast("int")))
    return _cv_rows(spark, md.cv_table(cv, ["maxDepth", "minInstancesPerNode"]), "random")


@register("search_two_stage")
def search_two_stage(spark, sf):
    """Coarse grid, then a grid around the best value."""
    pm, train, test = prepared(spark, sf)
    t = train.withColumn("fold", F.col("sfold").cast("int"))
    est = md.estimator("logreg", SEED)
    g1 = md.ParamGridBuilder().addGrid(est.regParam, [0.001, 0.1]).build()
    r1 = md.cv_table(md.cross_validate(est, g1, t), ["regParam"])
    best = max(r1, key=lambda r: (r[1], -r[0]["regParam"]))[0]["regParam"]
    g2 = md.ParamGridBuilder().addGrid(est.regParam, md.around(best, (0.5, 2.0), lo=1e-6)).build()
    r2 = md.cv_table(md.cross_validate(est, g2, t), ["regParam"])
    return _cv_rows(spark, r1, "coarse").unionByName(_cv_rows(spark, r2, "fine"))


@register("halving_search")
def halving_search(spark, sf):
    """50 draws from a space of 120, by successive halving on one fold table."""
    _, train, _ = prepared(spark, sf)
    est = md.estimator("dt", SEED)
    space = {"maxDepth": [2, 3, 4, 6, 8], "minInstancesPerNode": [1, 5, 20, 50], "maxBins": [16, 32, 64], "impurity": ["gini", "entropy"]}
    maps = md.sample_param_maps(est, space, 50, SEED)
    tried = md.successive_halving(est, maps, train, "sfold", CV_FOLDS)
    data = [(t["rung"], t["share"], json.dumps({p.name: v for p, v in maps[t["map"]].items()}, sort_keys=True),
             round(t["accuracy"], 6), round(t["std"], 6)) for t in tried]
    return spark.createDataFrame(data, "rung int, share double, params string, cv_accuracy double, cv_std double")


@register("screen_then_tune")
def screen_then_tune(spark, sf):
    """L15 + L16: screen nine models by CV accuracy, tune the top 3, keep a tuned
    result only when it beats the screened one (gate)."""
    _, train, _ = prepared(spark, sf)
    rows = md.screen_and_tune(train, len(FEATURES), N_CLASSES, "sfold", CV_FOLDS, 3, SEED)
    return spark.createDataFrame([(m, st, p, round(a, 6), round(sd, 6)) for m, st, p, a, sd in rows],
                                 "model string, stage string, params string, cv_accuracy double, cv_std double")


@register("tree_importance")
def tree_importance(spark, sf):
    """Random-forest importances (sum to 1) and the two selections: >= median, and the top three."""
    pm, train, test = prepared(spark, sf, hold=False)
    m = md.estimator("rf", SEED, numTrees=100).fit(train)
    t = md.select_by_importance(md.importance_table(m, FEATURES, spark))
    return t.select("feature", r6("importance").alias("importance"), "selected", "rank", (F.col("rank") <= TOP).alias("in_top"))


@register("coef_importance")
def coef_importance(spark, sf):
    """|coefficients| of the first class of a logistic model."""
    pm, train, test = prepared(spark, sf, hold=False)
    m = md.estimator("logreg", SEED).fit(train)
    return md.coef_importance(m, FEATURES, spark).select("feature", r6("importance").alias("importance"))


def _coded(rows, features=FEATURES):
    """The label code ``y`` and the features of the rows, persisted: what the forests of a selection read, several times each."""
    coded = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(rows).transform(rows)
    return md.held(coded.select("y", *features))


@register("rfe")
def rfe(spark, sf):
    """recursive feature elimination to 3 features."""
    b = model_base(spark, sf).where(F.col("split") == "train")
    b = _coded(b)
    keep = md.rfe(b, FEATURES, 3, SEED)
    return spark.createDataFrame([(f, i + 1) for i, f in enumerate(keep)], "feature string, position int")


@register("feature_funnel")
def feature_funnel(spark, sf):
    """variance filter -> F-test union MI -> importance >= median -> RFE.

    Every stage sees what the one before has left: the rankings compare the features that vary.  Their scores are rounded, so that
    the name decides between monotone forms of one column.
    """
    from assay.operators import select as se
    b = model_base(spark, sf).where(F.col("split") == "train").select("*", *[F.expr(e).alias(c) for c, e in FUNNEL.items()])
    var = se.variance_table(se.to_long(b, ["id", "label"], [*FEATURES, *FUNNEL]))
    vary = sorted(r[0] for r in var.where(F.col("variance") > 0.005).select("feature").collect())  # one row per feature
    if not vary:
        return spark.createDataFrame([], "feature string, stage string, importance_kept boolean, final boolean")
    lng = se.to_long(b, ["id", "label"], vary)
    a = se.top_k(se.anova_f(lng).select("feature", r6("f_score").alias("f_score")), "f_score", UNIVARIATE)
    m = se.top_k(se.mutual_information(lng).select("feature", r6("mi", 9).alias("mi")), "mi", UNIVARIATE)
    feats = sorted(r[0] for r in se.union_of([a, m]).collect())
    b = _coded(b, feats)
    va = VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep")
    rf = md.estimator("rf", SEED, numTrees=20).fit(va.transform(b))
    imp = rf.featureImportances.toArray()
    med = sorted(imp)[len(imp) // 2] if len(imp) % 2 else sum(sorted(imp)[len(imp) // 2 - 1:len(imp) // 2 + 1]) / 2
    stage3 = [f for f, v in zip(feats, imp) if v >= med]
    final = md.rfe(b, stage3, max(1, min(3, len(stage3))), SEED) if len(stage3) > 1 else stage3
    rows = [(f, "variance+univariate", f in stage3, f in final) for f in feats]
    return spark.createDataFrame(rows, "feature string, stage string, importance_kept boolean, final boolean")


@register("pca_variance")
def pca_variance(spark, sf):
    """Z3: centred PCA, 2 components, explained variance."""
    b = model_base(spark, sf)
    _, ev, _ = sc.pca(b, FEATURES, 2)
    return spark.createDataFrame([(i + 1, round(float(v), 6)) for i, v in enumerate(ev)],
                                 "component int, explained_variance double")


@register("decision_grid")
def decision_grid(spark, sf):
    """A 40 x 40 grid over (price_k, bal_k), other features at their train medians, scored by a model."""
    b = model_base(spark, sf)
    pm, train, test = prepared(spark, sf, b)
    m = md.estimator("dt", SEED, maxDepth=5).fit(train)
    base = b.where(F.col("split") == "train")
    ends = one_row(base, {"__plo": F.min("price_k"), "__phi": F.max("price_k"), "__blo": F.min("bal_k"), "__bhi": F.max("bal_k")})
    st = attach(quantile_row(base, {c: (c, 0.5) for c in FEATURES}), ends)
    g = st.select("*", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("gx")) \
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("gy"))
    g = g.select(F.lit(0).cast("long").alias("id"), F.lit("F").alias("label"), "gx", "gy",
                 *[c for c in FEATURES if c not in ("price_k", "bal_k")],
                 (F.col("__plo") + F.col("gx") * (F.col("__phi") - F.col("__plo")) / 39).alias("price_k"),
                 (F.col("__blo") + F.col("gy") * (F.col("__bhi") - F.col("__blo")) / 39).alias("bal_k"))
    p = m.transform(pm.transform(g))
    labels = pm.stages[0].labels
    p = IndexToString(inputCol="prediction", outputCol="pred", labels=labels).transform(p)
    return p.select("gx", "gy", r6("price_k").alias("price_k"), r6("bal_k").alias("bal_k"), "pred")
