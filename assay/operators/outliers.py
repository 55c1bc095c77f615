"""Isolation-forest outlier removal (C14).

*Sampling by skips.*  Every tree gets ``min(sample_size, n)`` rows.  Whether a row stands for a tree is an independent
coin with a chance of about ``2 * sample_size / n``; instead of one coin per (row, tree), a row draws the gaps between the trees
that it stands for, which are geometric.  Nearly all rows of a large table skip past the last tree with their first
hash, and only the others are expanded.  The tree keeps the ``sample_size`` smallest hashes among its few hundred candidates.

Trees are grown in ``applyInPandas`` (one task per tree) with numpy, seeded by (seed, tree): deterministic on any
cluster.

*Scoring.*  The forest is bounded (n_trees x < 2 * sample_size nodes).  It is packed into flat arrays over all trees and
broadcast; an Arrow-batched ``pandas_udf`` moves all rows of a batch down all trees one level at a time (leaves lead to
themselves, so there is no mask).  The cut is the (1 - contamination) quantile of the scores, like scikit-learn's offset.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.hashing import hash60, uniform
from assay.functions.stats import attach, quantile_row
from assay.session import write_scratch

#: Rows that move down the forest together.
SCORE_ROWS = 2048

TREE_SCHEMA = "tree long, feat array<int>, thr array<double>, left array<int>, right array<int>, size array<int>"


def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(features: Sequence[str], sample_size: int, seed: int):
    max_depth = int(math.ceil(math.log2(max(sample_size, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        X = pdf[list(features)].to_numpy(np.float64)
        rng = np.random.default_rng([seed, tree])
        feat, thr, left, right, size = [], [], [], [], []

        def node(idx, depth):
            me = len(feat)
            feat.append(-1)
            thr.append(0.0)
            left.append(-1)
            right.append(-1)
            size.append(len(idx))
            if depth >= max_depth or len(idx) <= 1:
                return me
            sub = X[idx]
            lo, hi = np.nanmin(sub, axis=0), np.nanmax(sub, axis=0)
            ok = np.where(hi > lo)[0]
            if len(ok) == 0:
                return me
            f = int(rng.choice(ok))
            t = float(rng.uniform(lo[f], hi[f]))
            feat[me], thr[me] = f, t
            go_left = sub[:, f] < t
            left[me] = node(idx[go_left], depth + 1)
            right[me] = node(idx[~go_left], depth + 1)
            return me
        node(np.arange(len(X)), 0)
        return pd.DataFrame({"tree": [tree], "feat": [feat], "thr": [thr], "left": [left], "right": [right],
                             "size": [size]})
    return build


def fit_isolation_forest(df: DataFrame, id_col: str, features: Sequence[str], n_trees: int = 100,
                         sample_size: int = 256, seed: int = 42) -> DataFrame:
    """Grow the forest; returns the tree table (n_trees rows)."""
    return _grow_forest(df, id_col, features, n_trees, sample_size, seed, df.count())


def tree_candidates(df: DataFrame, id_col: str, n_trees: int, share: float, seed: int) -> DataFrame:
    """``df`` with ``tree``: one row per tree that a row stands for, each with chance ``share`` independently."""
    if share >= 1:
        return df.withColumn("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_trees - 1).cast("long"))))
    miss = F.lit(math.log1p(-share))

    def gap(i: Column) -> Column:
        # trees that the row skips before the next one it stands for: floor(log(u) / log(1 - share)), u in (0, 1]
        u = 1.0 - uniform(F.col(id_col), seed, "if-gap", i)
        return F.least(F.floor(F.log(u) / miss), F.lit(n_trees).cast("long"))
    last = F.lit(n_trees - 1).cast("long")

    def step(acc: Column, i: Column) -> Column:
        at = acc["at"] + 1 + gap(i)
        return F.when(acc["at"] > last, acc).otherwise(
            F.struct(at.alias("at"), F.when(at <= last, F.concat(acc["trees"], F.array(at))).otherwise(acc["trees"]).alias("trees")))
    reached = df.withColumn("__first", gap(F.lit(0))).where(F.col("__first") <= last)
    zero = F.struct(F.col("__first").alias("at"), F.array("__first").alias("trees"))
    trees = F.aggregate(F.sequence(F.lit(1), F.lit(n_trees)), zero, step, lambda acc: acc["trees"])
    return reached.select(*df.columns, F.explode(trees).alias("tree"))


def _grow_forest(df, id_col, features, n_trees, sample_size, seed, n):
    psi = min(sample_size, n)
    # twice the wanted rows in expectation: fewer than psi come through with a chance below 1e-9 at psi = 256;
    # small samples get a wider margin, and below it every row stands for every tree
    share = (2.0 * psi + 64) / max(n, 1)
    cand = tree_candidates(df.select(id_col, *features), id_col, n_trees, share, seed)
    w = Window.partitionBy("tree").orderBy("__h", id_col)
    sample = cand.select("*", hash60(F.col(id_col), seed, "if-tree", F.col("tree")).alias("__h")).select(
        "*", F.row_number().over(w).alias("__r")).where(F.col("__r") <= psi)
    return sample.groupBy("tree").applyInPandas(_grow(features, psi, seed), TREE_SCHEMA)


def pack_forest(trees: list) -> dict[str, np.ndarray]:
    """Flat arrays over the nodes of all trees: ``feat, thr``, both children (a leaf leads to itself), the path length of a
    leaf with its correction, and the trees' roots."""
    roots, feat, thr, child, length, depth = [], [], [], [], [], 0
    base = 0
    for t in trees:
        own = np.array(t["feat"])
        level = np.zeros(len(own), np.int64)
        for i in np.flatnonzero(own >= 0):  # parents stand before their children
            level[[t["left"][i], t["right"][i]]] = level[i] + 1
        leaf = own < 0
        me = base + np.arange(len(own))
        child.append(np.stack([np.where(leaf, me, base + np.array(t["left"])), np.where(leaf, me, base + np.array(t["right"]))], 1))
        feat.append(np.maximum(own, 0))
        thr.append(np.array(t["thr"], np.float64))
        length.append(level + np.array([_c(x) for x in t["size"]]))
        roots.append(base)
        base += len(own)
        depth = max(depth, int(level.max()))
    return {"roots": np.array(roots), "feat": np.concatenate(feat), "thr": np.concatenate(thr),
            "child": np.concatenate(child), "length": np.concatenate(length), "depth": np.array(depth)}


def mean_path(x: np.ndarray, forest: dict[str, np.ndarray]) -> np.ndarray:
    """Mean path length of the rows of ``x`` over all trees."""
    out = np.empty(len(x))
    for lo in range(0, len(x), SCORE_ROWS):
        part = x[lo: lo + SCORE_ROWS]
        node = np.repeat(forest["roots"][:, None], len(part), axis=1)
        row = np.arange(len(part))
        for _ in range(int(forest["depth"])):
            left = part[row, forest["feat"][node]] < forest["thr"][node]
            node = forest["child"][node, 1 - left]
        out[lo: lo + SCORE_ROWS] = forest["length"][node].mean(0)
    return out


def score_isolation_forest(df: DataFrame, trees: DataFrame, features: Sequence[str],
                           sample_size: int) -> DataFrame:
    """Anomaly score 2^(-E[h(x)] / c(psi)) per row (higher = more anomalous)."""
    grown = trees.orderBy("tree").collect()   # bounded model, O(trees x nodes)
    if not grown:
        return df.select("*", F.lit(None).cast("double").alias("anomaly_score"))
    bc = df.sparkSession.sparkContext.broadcast(pack_forest(grown))
    cpsi = _c(sample_size)

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        h = mean_path(np.column_stack([c.to_numpy(np.float64) for c in cols]), bc.value)
        return pd.Series(np.power(2.0, -h / cpsi) if cpsi > 0 else np.zeros(len(h)))
    return df.select("*", score(*[F.col(f).cast("double") for f in features]).alias("anomaly_score"))


def isolation_forest(df: DataFrame, id_col: str, features: Sequence[str], contamination: float = 0.05,
                     n_trees: int = 100, sample_size: int = 256, seed: int = 42,
                     relative_error: float | None = 1e-4) -> DataFrame:
    """C14: score every row and flag the top ``contamination`` share as outliers.

    Nulls in the features are filled by the column median first.  The cut is a quantile of the scores (sketch-based by
    default: scores are continuous).  The filled rows and the scores are written to the shared checkpoint folder, since
    several passes read them and a lost executor must not grow another forest.
    """
    from assay.operators.clean import impute_median
    # dealt by key before they are written: hashing and scoring are CPU-bound, whatever the partitions of the input
    filled = write_scratch(impute_median(df, list(features)).repartition(F.col(id_col)), "forest-rows")
    n = filled.count()
    trees = _grow_forest(filled, id_col, features, n_trees, sample_size, seed, n)
    dealt = filled.repartition(F.col(id_col))
    s = write_scratch(score_isolation_forest(dealt, trees, features, min(sample_size, max(1, n))), "forest-scores")
    cut = quantile_row(s, {"__cut": ("anomaly_score", 1 - contamination)}, relative_error)
    return attach(s, cut).select(*df.columns, "anomaly_score",
                                 (F.col("anomaly_score") > F.col("__cut")).alias("is_outlier"))
