"""Class-wise boosting with a loss per iteration.

*Fit.*  One binary model per class, with the parameters, thresholds, loss, trees and model of Spark ML's ``GBTClassifier``.  Only the fit
reads the rows in its own way: their features are binned once and packed into numpy blocks that carry the margins of all classes, and
a level of the trees of all classes is one job, whose tasks return counts and sums per node, feature and bin.  A block's margins move on
by one tree per round.

*Loss.*  The trees are read from the model's own Parquet form (a few rows per tree) and packed into flat arrays over all classes and
trees.  A batch of rows moves down all trees one level at a time; cumulative sums of the weighted leaf values are the margins
after every iteration, so one pass over the rows gives the log loss of every iteration.  What leaves a task is one row per group
and iteration.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.session import ensure_checkpoint_dir, scratch_path

#: Rows that move down the trees together.
ROWS = 1024
#: Rows (about) that the thresholds are chosen from, and rounds after which the lineage of the margins is cut.
SAMPLE_ROWS, CUT_ROUNDS = 10_000, 10
#: Bin that no row exceeds: the cut of a leaf, whose rows all go on to the left.
LEAF = 255

BLOCK = "x binary, y binary, margin binary"


def thresholds(values: np.ndarray, most: int) -> np.ndarray:
    """Cuts of a feature into at most ``most`` bins, by the rule of Spark ML: midway between all values, or where bins of one size end."""
    v, n = np.unique(values[~np.isnan(values)], return_counts=True)
    if len(v) <= most:
        return (v[:-1] + v[1:]) / 2.0
    out, stride, seen = [], n.sum() / most, np.cumsum(n)
    want = stride
    for i in range(1, len(v)):
        if abs(seen[i - 1] - want) < abs(seen[i] - want):
            out.append((v[i - 1] + v[i]) / 2.0)
            want += stride
    return np.array(out)


def place(x: np.ndarray, feat: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Node of every row (a column of ``x``) after so many levels; the children of node ``i`` are ``2 i`` and ``2 i + 1``, the root is 1."""
    row = np.arange(x.shape[1])
    node = np.ones(len(row), np.int64)
    for _ in range(levels):
        node = 2 * node + (x[feat[node], row] > cut[node])
    return node


def best_split(h: np.ndarray, sizes: np.ndarray) -> tuple | None:
    """``(feature, bin, gain, left, right)`` of greatest variance gain (the first of equals); ``h``: (count, sum, squares) x features x bins,
    ``sizes``: cuts of every feature.  None if no split lessens the variance."""
    total = h[:, 0].sum(1)
    left = h.cumsum(2)[:, :, :-1]
    right = total[:, None, None] - left
    ok = (left[0] >= 1) & (right[0] >= 1) & (np.arange(left.shape[2]) < sizes[:, None])
    if not ok.any():
        return None
    a, b = (side[1] / np.maximum(side[0], 1.0) for side in (left, right))
    ok &= np.abs(a - b) > 1e-12 * np.maximum(np.abs(a), np.abs(b))
    gain = np.where(ok, left[0] * right[0] / total[0] ** 2 * (a - b) ** 2, 0.0)
    f, at = np.unravel_index(gain.argmax(), gain.shape)
    return (int(f), int(at), float(gain[f, at]), left[:, f, at], right[:, f, at]) if gain[f, at] > 0 else None


class Tree:
    """A regression tree as it grows: feature, cut (a bin), gain and (count, sum, squares) by node."""

    def __init__(self, depth: int):
        self.depth, nodes = depth, 2 << depth
        self.feat, self.cut = np.zeros(nodes, np.int64), np.full(nodes, LEAF)
        self.gain, self.stats, self.open = np.full(nodes, -1.0), np.zeros((nodes, 3)), [1]

    def grow(self, level: int, h: np.ndarray, sizes: np.ndarray) -> None:
        """Split the open nodes; ``h``: (count, sum, squares) x nodes of the level x features x bins."""
        opened = []
        for node in self.open:
            mine = h[:, node - (1 << level)]
            self.stats[node] = mine[:, 0].sum(1)
            found = best_split(mine, sizes)
            if found:
                self.feat[node], self.cut[node], self.gain[node], self.stats[2 * node], self.stats[2 * node + 1] = found
                opened += [2 * node, 2 * node + 1]
        self.open = opened

    def values(self) -> np.ndarray:
        """Prediction by node; what lies under a leaf has its value."""
        v = self.stats[:, 1] / np.maximum(self.stats[:, 0], 1.0)
        for node in range(1, 1 << self.depth):
            if self.cut[node] == LEAF:
                v[2 * node] = v[node]
        return v

    def rows(self, cuts: Sequence[np.ndarray]) -> list[tuple]:
        """The nodes in Spark ML's Parquet form, in preorder."""
        out: list = []

        def visit(node: int) -> int:
            me = len(out)
            out.append(None)
            n, total, squares = map(float, self.stats[node])
            left = right = -1
            split: tuple = (-1, [], -1)
            if self.cut[node] != LEAF:
                left, right = visit(2 * node), visit(2 * node + 1)
                split = (int(self.feat[node]), [float(cuts[self.feat[node]][self.cut[node]])], -1)
            out[me] = (me, total / n, max(squares / n - (total / n) ** 2, 0.0), [n, total, squares], int(n), float(self.gain[node]),
                       left, right, split)
            return me
        visit(1)
        return out


def _residual(sign: np.ndarray, margin: np.ndarray, first: bool) -> np.ndarray:
    """What a tree is fitted to: the labels (-1, 1) at first, then the negative gradient of 2 log(1 + exp(-2 sign margin))."""
    return sign if first else 4.0 * sign / (1.0 + np.exp(np.minimum(2.0 * sign * margin, 700.0)))


def _packed(x: np.ndarray, y: np.ndarray, margin: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: pa.array([v.tobytes()], pa.binary()) for c, v in (("x", x), ("y", y), ("margin", margin))})


def _unpacked(batches: Iterator[pa.RecordBatch], d: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for x, y, m in zip(b.column("x"), b.column("y"), b.column("margin")):
            yield (np.frombuffer(x.as_buffer(), np.uint8).reshape(d, -1), np.frombuffer(y.as_buffer()),
                   np.frombuffer(m.as_buffer()).reshape(k, -1))


def _binned(rows: DataFrame, cuts: Sequence[np.ndarray], k: int) -> DataFrame:
    """Blocks of the rows (``x, y``): bins of the features, labels and margins (0) of the classes."""
    d = len(cuts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y, x = b.column("y"), b.column("x").flatten().to_numpy(zero_copy_only=False)
            if y.null_count or len(x) != d * b.num_rows:
                raise ValueError(f"rows need a label and a vector of {d} features")
            x = x.reshape(-1, d)
            bins = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)]).astype(np.uint8)
            yield _packed(bins, y.to_numpy(zero_copy_only=False), np.zeros((k, len(x))))
    return rows.mapInArrow(pack, BLOCK)


def _level(blocks: DataFrame, trees: Sequence[Tree], level: int, sizes: np.ndarray, bins: int, first: bool) -> np.ndarray:
    """(count, sum, squares) of the residuals by class, node of the level, feature and bin: one pass over all rows.

    Only the last level needs the squares of all features, for its leaves; above it those of the first give the totals of the nodes.
    """
    k, d, nodes, last = len(trees), len(sizes), 1 << level, level + 1 == trees[0].depth
    feat, cut, size = [t.feat for t in trees], [t.cut for t in trees], (nodes, bins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = np.zeros((k, 3, nodes, d, bins))
        for x, y, margin in _unpacked(batches, d, k):
            for c in range(k):
                t = _residual(np.where(y == c, 1.0, -1.0), margin[c], first)
                weights, base = (None, t, t * t), (place(x, feat[c], cut[c], level) - nodes) * bins
                for j in range(d):
                    cell = base + x[j]
                    for i, w in enumerate(weights if last or not j else weights[:2]):
                        h[c, i, :, j] += np.bincount(cell, w, nodes * bins).reshape(size)
        yield pa.RecordBatch.from_pydict({"h": pa.array([h.tobytes()], pa.binary())})
    parts = blocks.mapInArrow(run, "h binary").collect()  # one row of the trees' size per task
    return sum(np.frombuffer(bytes(p["h"])) for p in parts).reshape(k, 3, nodes, d, bins)


def _moved(blocks: DataFrame, trees: Sequence[Tree], d: int, weight: float) -> DataFrame:
    """The blocks with the margins after one more tree per class."""
    depth, grown = trees[0].depth, [(t.feat, t.cut, t.values()) for t in trees]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, margin in _unpacked(batches, d, len(grown)):
            yield _packed(x, y, margin + weight * np.stack([v[place(x, f, c, depth)] for f, c, v in grown]))
    return blocks.mapInArrow(run, BLOCK)


def _models(spark: SparkSession, est: GBTClassifier, grown: Sequence[Sequence[Tree]], weights: Sequence[float],
            cuts: Sequence[np.ndarray]) -> list[GBTClassificationModel]:
    """Spark ML's models of the trees (rounds x classes), read from its Parquet form; a model of two rows gives that form."""
    d, form = len(cuts), scratch_path(spark, "gbt-form")
    two = spark.createDataFrame([(Vectors.dense([float(i)] * d), float(i)) for i in range(2)], [est.getFeaturesCol(), est.getLabelCol()])
    est.copy({est.maxIter: 1}).fit(two).write().save(form)
    about = json.loads(spark.read.text(f"{form}/metadata").first()[0])
    tree, data = spark.read.parquet(f"{form}/treesMetadata"), spark.read.parquet(f"{form}/data")
    of_tree = tree.first()[1]

    def one(c: int) -> GBTClassificationModel:
        path = scratch_path(spark, "gbt")
        mine = about | {"uid": f"{about['uid']}_{c}", "numTrees": len(grown), "paramMap": about["paramMap"] | {"maxIter": est.getMaxIter()}}
        spark.createDataFrame([(json.dumps(mine),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        spark.createDataFrame([(i, of_tree, float(w)) for i, w in enumerate(weights)], tree.schema).coalesce(1).write.parquet(
            f"{path}/treesMetadata")
        spark.createDataFrame([(i, n) for i, trees in enumerate(grown) for n in trees[c].rows(cuts)], data.schema).coalesce(1).write.parquet(
            f"{path}/data")
        return GBTClassificationModel.load(path)
    with ThreadPoolExecutor(4) as pool:
        return list(pool.map(one, range(len(grown[0]))))


def fit_one_vs_rest(train: DataFrame, n_classes: int, est: GBTClassifier, label: str = "y") -> list[GBTClassificationModel]:
    """``est`` fitted to class 0, 1, ... against the others, all classes in the same passes: one per level and round.

    Its features, rounds, depth, bins, step size and seed count; everything else must have its default (no row weights, subsamples,
    validation rows or least sizes of nodes).  The thresholds come from all rows, or from about 10,000 of a larger table.  The sums of a
    task have the size of a level of the trees, whatever the rows.
    """
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    rows = train.select(vector_to_array(est.getFeaturesCol()).alias("x"), F.col(label).cast("double").alias("y"))
    n = rows.count()
    bins, depth = min(est.getMaxBins(), n), est.getMaxDepth()
    if not n or depth < 1 or bins > LEAF:
        raise ValueError(f"boosting needs rows, trees of a level or more and at most {LEAF} bins")
    need = max(bins ** 2, SAMPLE_ROWS)
    some = np.stack((rows if n <= need else rows.sample(need / n, est.getSeed())).select("x").toPandas()["x"].to_numpy())
    cuts = [thresholds(some[:, j], bins) for j in range(some.shape[1])]
    sizes = np.array([len(c) for c in cuts])
    blocks = _binned(rows, cuts, n_classes).persist(StorageLevel.MEMORY_AND_DISK)
    before, grown, weights = None, [], []
    try:
        for i in range(est.getMaxIter()):
            trees = [Tree(depth) for _ in range(n_classes)]
            for level in range(depth):
                if any(t.open for t in trees):
                    h = _level(blocks, trees, level, sizes, bins, not i)
                    for t, mine in zip(trees, h):
                        t.grow(level, mine, sizes)
            if before is not None:
                before.unpersist()
            grown.append(trees)
            weights.append(est.getStepSize() if i else 1.0)
            if len(grown) < est.getMaxIter():
                moved = _moved(blocks, trees, len(cuts), weights[-1])
                moved = moved.checkpoint() if len(grown) % CUT_ROUNDS == 0 else moved
                before, blocks = blocks, moved.persist(StorageLevel.MEMORY_AND_DISK)
    finally:
        for b in (before, blocks):
            if b is not None:
                b.unpersist()
    return _models(spark, est, grown, weights, cuts)


def pack_trees(spark: SparkSession, models: Sequence[GBTClassificationModel]) -> dict[str, np.ndarray]:
    """Flat arrays over the nodes of all trees (continuous splits); ``roots`` and ``weights`` are classes x iterations."""
    feat, thr, child, value, roots, base, depth = [], [], [], [], [], 0, 0
    for m in models:
        path = scratch_path(spark, "gbt")
        m.write().save(path)
        nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").toPandas()
        mine = {}
        for tree, g in nodes.sort_values(["treeID", "id"]).groupby("treeID"):
            left, right = g["leftChild"].to_numpy(), g["rightChild"].to_numpy()
            at = np.arange(len(g))
            leaf = left < 0
            cut = [s["leftCategoriesOrThreshold"] for s in g["split"]]
            if any(s["numCategories"] >= 0 for s, x in zip(g["split"], leaf) if not x):
                raise ValueError("categorical splits are not supported: encode the column first")
            feat.append(np.where(leaf, 0, [s["featureIndex"] for s in g["split"]]))
            thr.append(np.array([0.0 if x else c[0] for x, c in zip(leaf, cut)]))
            child.append(base + np.stack([np.where(leaf, at, left), np.where(leaf, at, right)], 1))
            value.append(g["prediction"].to_numpy())
            mine[tree] = base
            base += len(g)
        roots.append([mine[t] for t in sorted(mine)])
        depth = max(depth, max(t.depth for t in m.trees))
    return {"roots": np.array(roots), "weights": np.array([m.treeWeights for m in models]), "feat": np.concatenate(feat),
            "thr": np.concatenate(thr), "child": np.concatenate(child), "value": np.concatenate(value), "depth": np.array(depth)}


def staged_margins(x: np.ndarray, trees: dict[str, np.ndarray]) -> np.ndarray:
    """Margins after every iteration, classes x iterations x rows (twice the sum of the trees, as Spark ML defines them)."""
    node = np.repeat(trees["roots"][:, :, None], len(x), axis=2)
    row = np.arange(len(x))
    for _ in range(int(trees["depth"])):
        right = x[row, trees["feat"][node]] > trees["thr"][node]
        node = trees["child"][node, right.astype(np.int64)]
    return 2.0 * np.cumsum(trees["value"][node] * trees["weights"][:, :, None], axis=1)


def staged_loss(models: Sequence[GBTClassificationModel], df: DataFrame, by: str = "split", label: str = "y",
                features: str = "features", eps: float = 1e-15) -> DataFrame:
    """``by, iteration, rows, loss, log_loss`` (iteration 1 is the first tree).

    ``loss`` is what the trees are fitted to, the mean over rows of the binary log losses of all classes; ``log_loss`` is the mean
    of -ln p of the true class, with the margins normalised by a softmax.  Rows with a null label take no part.
    """
    spark = df.sparkSession
    packed = spark.sparkContext.broadcast(pack_trees(spark, models))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = packed.value
        n_iter = trees["roots"].shape[1]
        for f in frames:
            for group, g in f.groupby("by"):
                total, soft = np.zeros(n_iter), np.zeros(n_iter)
                for lo in range(0, len(g), ROWS):
                    part = g.iloc[lo: lo + ROWS]
                    m = staged_margins(np.stack(part["x"].to_numpy()), trees)
                    truth = part["y"].to_numpy(np.int64)
                    sign = np.where(truth[None, :] == np.arange(len(m))[:, None], 1.0, -1.0)
                    total += np.logaddexp(0, -sign[:, None, :] * m).sum((0, 2))
                    # the softmax of the margins (half the log odds), as the predictions use them
                    half = m / 2.0
                    top = half.max(0)
                    logp = half[truth, :, np.arange(len(truth))].T - top - np.log(np.exp(half - top).sum(0))
                    soft += -np.maximum(logp, np.log(eps)).sum(1)
                yield pd.DataFrame({"by": group, "iteration": np.arange(1, n_iter + 1), "rows": len(g), "loss": total, "log_loss": soft})
    rows = df.where(F.col(label).isNotNull() & F.col(by).isNotNull()).select(
        F.col(by).cast("string").alias("by"), F.col(label).alias("y"), vector_to_array(features).alias("x"))
    sums = rows.mapInPandas(run, "by string, iteration int, rows long, loss double, log_loss double")
    out = sums.groupBy("by", "iteration").agg(*[F.sum(c).alias(c) for c in ("rows", "loss", "log_loss")])
    return out.select(F.col("by").alias(by), "iteration", "rows", (F.col("loss") / F.col("rows")).alias("loss"),
                      (F.col("log_loss") / F.col("rows")).alias("log_loss"))
