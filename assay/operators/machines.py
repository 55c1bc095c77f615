"""One-vs-rest linear SVMs and factorization machines, fitted for all classes in the same passes over the rows.

Estimators, losses and models are Spark ML's, and so are the steps of the factorization machines.  Only the fit reads the rows in its
own way: they are packed once into numpy blocks, and an evaluation of the losses of all classes is one job, whose tasks return gradients
of the size of the models.  The driver holds the weights.  A fit over wide vectors that are computed from narrow rows packs the narrow ones and computes the others block by block.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Generator, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import FMClassificationModel, FMClassifier, LinearSVC, LinearSVCModel, OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Matrices, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.session import scratch_path

#: Rows that a task computes together.
ROWS = 1024
#: Steps that the quasi-Newton method remembers, and tries of its line search.
MEMORY, TRIES = 10, 20


def packed(rows: DataFrame, features: str, label: str) -> DataFrame:
    """Blocks of the rows: their vectors and labels as bytes."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (c.to_numpy(zero_copy_only=False).astype(np.float64) for c in (b.column("x").flatten(), b.column("y")))
                if b.column("x").null_count or len(x) % len(y) or not np.isfinite(y).all():
                    raise ValueError("rows need a label and vectors of one size")
                yield pa.RecordBatch.from_pydict({"x": pa.array([x.tobytes()], pa.binary()), "y": pa.array([y.tobytes()], pa.binary())})
    return rows.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y")).mapInArrow(pack, "x binary, y binary")


def summed(blocks: DataFrame, size: int, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over the rows of ``of(vectors, labels)``, an array of so many numbers: one pass, one row per task to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for b in batches:
            for xb, yb in zip(b.column("x"), b.column("y")):
                y = np.frombuffer(yb.as_buffer())
                x = np.frombuffer(xb.as_buffer()).reshape(len(y), -1)
                for lo in range(0, len(y), ROWS):
                    out += of(x[lo: lo + ROWS], y[lo: lo + ROWS])
        yield pa.RecordBatch.from_pydict({"s": pa.array([out.tobytes()], pa.binary())})
    return sum((np.frombuffer(bytes(r["s"])) for r in blocks.mapInArrow(run, "s binary").collect()), np.zeros(size))


def _direction(g: np.ndarray, pairs: list) -> np.ndarray | None:
    """The quasi-Newton direction, newest pair first; None if the last pair bends the wrong way."""
    step, used, scale = g.copy(), [], 1.0
    if pairs:
        s, d = pairs[0]
        if not s @ d > 1e-12 * (d @ d):
            return None
        scale = (s @ d) / (d @ d)
    for s, d in pairs:
        used.append((s @ step) / (s @ d))
        step = step - used[-1] * d
    step = step * scale
    for (s, d), a in zip(reversed(pairs), reversed(used)):
        step = step + (a - (d @ step) / (s @ d)) * s
    return -step if np.isfinite(step).all() else None


def lbfgs(w: np.ndarray, steps: int, tol: float) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Quasi-Newton steps: yields points, takes their loss and gradient, returns the last.

    A step meets the Wolfe conditions, if some tries of its length find one that does; a step that lessens nothing is tried once more
    without memory.
    """
    value, g = yield w
    start, seen, pairs, done, fresh = value, [], [], 0, False
    while done < steps and np.linalg.norm(g) > max(tol * abs(value), 1e-8):
        step = _direction(g, pairs)
        if step is None:
            step, pairs = -g, []
        slope, t, lo, hi, best = g @ step, 1.0 if pairs else 0.5 / np.linalg.norm(g), 0.0, np.inf, None
        for _ in range(TRIES):
            at = w + t * step
            new, there = yield at
            if new > value + 1e-4 * t * slope:
                hi = t
            else:
                best = (at, new, there) if best is None or new < best[1] else best
                if there @ step >= 0.9 * slope:
                    break
                lo = t
            t = 2.0 * t if hi == np.inf else (lo + hi) / 2.0
        if best is None:
            if fresh or not pairs:
                break
            fresh, pairs = True, []
            continue
        at, new, there = best
        pairs = [(at - w, there - g), *pairs][:MEMORY]
        w, value, g, done, fresh = at, new, there, done + 1, False
        seen = [*seen, new][-MEMORY:]
        if len(seen) == MEMORY and abs(new - max(seen)) <= tol * abs(start):
            break
    return w


def adam(w: np.ndarray, steps: int, rate: float, shrink: float, tol: float) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Spark ML's ``adamW`` steps over all rows: yields points, takes their gradient, returns the last."""
    m, v = np.zeros_like(w), np.zeros_like(w)
    for i in range(1, steps + 1):
        _, g = yield w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        before, w = w, w - rate * (m / (1 - 0.9 ** i)) / (np.sqrt(v / (1 - 0.999 ** i)) + 1e-8) - shrink * w
        if i > 1 and np.linalg.norm(before - w) < tol * max(np.linalg.norm(w), 1.0):
            break
    return w


def descended(searches: Sequence[Generator], losses: Callable[[list[int], np.ndarray], list[tuple[float, np.ndarray]]]) -> list[np.ndarray]:
    """What the searches (one a class) return; the points that they ask for together are evaluated together."""
    asked, out = {}, [None] * len(searches)

    def go(c: int, send: Callable) -> None:
        try:
            asked[c] = send()
        except StopIteration as e:
            asked.pop(c, None)
            out[c] = e.value
    for c, s in enumerate(searches):
        go(c, lambda: next(s))
    while asked:
        classes = sorted(asked)
        for c, found in zip(classes, losses(classes, np.stack([asked[c] for c in classes]))):
            go(c, lambda: searches[c].send(found))
    return out


def _models(rows: DataFrame, est, load: Callable, features: str, label: str, width: int, values: Sequence[tuple]) -> list:
    """Spark ML's models with these values, read from its Parquet form; a model of two rows gives that form."""
    spark, form, out = rows.sparkSession, scratch_path(rows.sparkSession, "machine-form"), []
    two = spark.createDataFrame([(Vectors.dense([float(i)] * width), float(i)) for i in range(2)], [features, label])
    est.copy({est.maxIter: 1, est.featuresCol: features, est.labelCol: label}).fit(two).write().save(form)
    about, schema = json.loads(spark.read.text(f"{form}/metadata").first()[0]), spark.read.parquet(f"{form}/data").schema
    for c, value in enumerate(values):
        path = scratch_path(spark, "machine")
        mine = about | {"uid": f"{about['uid']}_{c}", "paramMap": about["paramMap"] | {"maxIter": est.getMaxIter()}}
        spark.createDataFrame([(json.dumps(mine),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        spark.createDataFrame([value], schema).coalesce(1).write.parquet(f"{path}/data")
        out.append(load(path))
    return out


class Margins:
    """One model per class: ``transform`` adds their margins (``rawPrediction``) and the class of the greatest, the first of equals."""

    def __init__(self, models: Sequence):
        self.models = list(models)

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c, m in enumerate(self.models):
            raw, extra = f"__raw{c}", [f"__pred{c}"]
            m = m.setRawPredictionCol(raw).setPredictionCol(extra[0])
            if m.hasParam("probabilityCol"):
                extra.append(f"__prob{c}")
                m = m.setProbabilityCol(extra[1])
            out = m.transform(out).drop(*extra)
        raws = F.array(*[vector_to_array(f"__raw{c}")[1] for c in range(len(self.models))])
        out = out.select(*df.columns, raws.alias("__margins"))
        best = F.array_position("__margins", F.array_max("__margins")) - 1
        return out.select(*df.columns, array_to_vector("__margins").alias("rawPrediction"), best.cast("double").alias("prediction"))


def _classes(rows: DataFrame, label: str) -> int:
    return int(rows.agg(F.max(label)).first()[0]) + 1


def fit_svms(rows: DataFrame, est: LinearSVC, features: str = "features", label: str = "y",
             lift: Callable[[np.ndarray], np.ndarray] | None = None, lifted: str = "features") -> Margins:
    """``est`` (its steps, regularisation and tolerance; standardised, with intercept) fitted to every class against the others.

    ``lift`` turns a block of vectors into the ones that are fitted, which the model finds in the column ``lifted``.
    """
    lift, k = lift or (lambda x: x), _classes(rows, label)
    width = lift(np.stack([rows.select(vector_to_array(features)).first()[0]]).astype(np.float64)).shape[1]
    blocks = packed(rows, features, label).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        s = summed(blocks, width + 1, lambda x, y: np.append(lift(x).sum(0), len(x)))
        n, mean = s[-1], s[:-1] / s[-1]
        std = np.sqrt(summed(blocks, width, lambda x, y: ((lift(x) - mean) ** 2).sum(0)) / max(n - 1, 1))
        inverse = np.divide(1.0, std, out=np.zeros(width), where=std != 0)
        centre, reg = mean * inverse, est.getRegParam()

        def losses(classes: list[int], w: np.ndarray) -> list[tuple[float, np.ndarray]]:
            scaled, offset = (w[:, :-1] * inverse).T, w[:, -1] - w[:, :-1] @ centre

            def of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                z = lift(x)
                sign = np.where(y[:, None] == np.array(classes), 1.0, -1.0)
                short = 1.0 - sign * (z @ scaled + offset)
                pull = np.where(short > 0, -sign, 0.0)
                return np.concatenate([np.maximum(short, 0.0).sum(0), pull.sum(0), (pull.T @ z).ravel()])
            c = len(classes)
            got = summed(blocks, c * (width + 2), of) / n
            pull, g = got[c: 2 * c], got[2 * c:].reshape(c, width)
            return [(float(got[i] + 0.5 * reg * (w[i, :-1] @ w[i, :-1])),
                     np.append(g[i] * inverse - pull[i] * centre + reg * w[i, :-1], pull[i])) for i in range(c)]
        found = descended([lbfgs(np.zeros(width + 1), est.getMaxIter(), est.getTol()) for _ in range(k)], losses)
    finally:
        blocks.unpersist()
    # the form of a saved linear SVM: coefficients, intercept
    return Margins(_models(rows, est, LinearSVCModel.load, lifted, "yc", width,
                           [(Vectors.dense(w[:-1] * inverse), float(w[-1] - w[:-1] @ centre)) for w in found]))


class FactorMachines(OneVsRest):
    """One-vs-rest factorization machines (``adamW`` over all rows, with linear terms and intercept), fitted together."""

    def _fit(self, dataset: DataFrame) -> Margins:
        est, features, label = self.getClassifier(), self.getFeaturesCol(), self.getLabelCol()
        if est.getSolver() != "adamW" or est.getMiniBatchFraction() != 1.0 or not est.getFitLinear() or not est.getFitIntercept():
            return super()._fit(dataset)
        k, f = _classes(dataset, label), est.getFactorSize()
        one = dataset.sparkSession.createDataFrame([(Vectors.dense(dataset.select(vector_to_array(features)).first()[0]), 0.0)], ["x", "y"])
        start = est.copy({est.maxIter: 0, est.featuresCol: "x", est.labelCol: "y"}).fit(one).factors.toArray()
        d = len(start)
        blocks = packed(dataset, features, label).persist(StorageLevel.MEMORY_AND_DISK)

        def losses(classes: list[int], w: np.ndarray) -> list[tuple[float, np.ndarray]]:
            parts = [(u[: d * f].reshape(d, f), u[d * f: -1], u[-1]) for u in w]

            def of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                out, squares = [float(len(x))], x * x
                for c, (factors, linear, bias) in zip(classes, parts):
                    s = x @ factors
                    raw = bias + x @ linear + 0.5 * ((s * s).sum(1) - (squares @ (factors * factors)).sum(1))
                    r = 1.0 / (1.0 + np.exp(np.minimum(-raw, 700.0))) - (y == c)
                    out += [((x * r[:, None]).T @ s - (squares.T @ r)[:, None] * factors).ravel(), x.T @ r, r.sum()]
                return np.hstack(out)
            size = w.shape[1]
            got = summed(blocks, 1 + len(classes) * size, of)
            return [(0.0, g / got[0]) for g in got[1:].reshape(len(classes), size)]
        try:
            first = np.append(start.ravel(), np.zeros(d + 1))
            found = descended([adam(first, est.getMaxIter(), est.getStepSize(), est.getRegParam(), est.getTol()) for _ in range(k)], losses)
        finally:
            blocks.unpersist()
        # the form of a saved machine: intercept, linear terms, factors
        return Margins(_models(dataset, est, FMClassificationModel.load, features, "yc", d, [
            (float(w[-1]), Vectors.dense(w[d * f: -1]), Matrices.dense(d, f, w[: d * f].reshape(d, f).ravel(order="F"))) for w in found]))
