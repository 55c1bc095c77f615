"""Multi-layer perceptron whose passes over the rows are matrix products of numpy blocks.

The estimator is Spark ML's: its parameters, first weights, layers (sigmoid, softmax at the end), cross entropy and model.  Only the fit
reads the rows in its own way: they are packed once into blocks, and every evaluation of the loss is one job whose tasks return a
gradient of the size of the model.  The driver holds the weights and takes the L-BFGS steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that pass through the layers together.
ROWS = 1024
#: Steps that L-BFGS remembers, and the most evaluations of one step.
MEMORY, TRIES = 10, 10


def unpacked(w: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(weights, bias)`` per layer of Spark ML's flat vector: inputs x outputs, then the bias."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((w[at: at + a * b].reshape(a, b), w[at + a * b: at + a * b + b]))
        at += a * b + b
    return out


def gradient(w: np.ndarray, layers: list[int], x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Sums over the rows: cross entropy, and its gradient laid out like ``w``."""
    parts, acts = unpacked(w, layers), [x]
    for i, (m, b) in enumerate(parts):
        z = acts[-1] @ m + b
        if i + 1 < len(parts):
            z = 1.0 / (1.0 + np.exp(np.minimum(-z, 700.0)))
        else:
            z = z - z.max(1, keepdims=True)
            loss = (np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).sum()
            z = np.exp(z)
            z /= z.sum(1, keepdims=True)
        acts.append(z)
    delta = acts.pop()
    delta[np.arange(len(y)), y] -= 1.0
    out: list[np.ndarray] = []
    for i in range(len(parts) - 1, -1, -1):
        out = [(acts[i].T @ delta).ravel(), delta.sum(0), *out]
        if i:
            delta = (delta @ parts[i][0].T) * (acts[i] * (1.0 - acts[i]))
    return float(loss), np.concatenate(out)


def minimised(f: Callable, w: np.ndarray, steps: int, tol: float) -> np.ndarray:
    """``w`` after up to ``steps`` of L-BFGS with a backtracking line search; ends where the loss or its gradient no longer moves by ``tol``."""
    value, g = f(w)
    seen, pairs = [value], []
    for _ in range(steps):
        if not np.isfinite(value) or np.linalg.norm(g) <= max(tol * abs(value), 1e-8):
            break
        step, used = -g, []
        for s, d, r in reversed(pairs):
            used.append(r * (s @ step))
            step = step - used[-1] * d
        if pairs:
            s, d, r = pairs[-1]
            step = step / (r * (d @ d))
        for (s, d, r), a in zip(pairs, reversed(used)):
            step = step + (a - r * (d @ step)) * s
        slope, t = g @ step, 1.0 if pairs else 1.0 / np.linalg.norm(g)
        for _ in range(TRIES):
            new, at = f(w + t * step)
            if new <= value + 1e-4 * t * slope:
                break
            # the minimum of the parabola through both values and the slope
            bend = 2.0 * (new - value - t * slope)
            t *= float(np.clip(-t * slope / bend, 0.1, 0.5)) if np.isfinite(new) else 0.1
        else:
            if not pairs:
                break
            pairs = []  # once more, along the gradient
            continue
        s, d = t * step, at - g
        if s @ d > 1e-12 * (d @ d):
            pairs = [*pairs, (s, d, 1.0 / (s @ d))][-MEMORY:]
        w, value, g = w + s, new, at
        if abs(np.mean(seen[-MEMORY:]) - value) <= tol * abs(seen[0]):
            break
        seen.append(value)
    return w


class Perceptron(MultilayerPerceptronClassifier):
    """Spark ML's perceptron classifier, fitted by passes over packed blocks (L-BFGS only)."""

    def _fit(self, dataset: DataFrame):
        if self.getSolver() != "l-bfgs":
            return super()._fit(dataset)
        some = dataset.limit(1).persist()

        def model(**fixed):
            est = self.copy({getattr(self, p): v for p, v in (fixed | {"maxIter": 0}).items()})
            return super(Perceptron, est)._fit(some)
        try:
            layers, start = self.getLayers(), model().weights.toArray()
            found = self._descend(dataset, layers, start)
            return self._copyValues(model(initialWeights=Vectors.dense(found)))
        finally:
            some.unpersist()

    def _descend(self, dataset: DataFrame, layers: list[int], start: np.ndarray) -> np.ndarray:
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                y = b.column("y").to_numpy(zero_copy_only=False)
                if not ((y >= 0) & (y < layers[-1]) & (y == np.floor(y))).all():
                    raise ValueError(f"labels must be whole numbers from 0 to {layers[-1] - 1}")
                x = b.column("x").flatten().to_numpy(zero_copy_only=False)
                if len(x) != len(y) * layers[0] or not np.isfinite(x).all():
                    raise ValueError(f"features must be vectors of {layers[0]} finite numbers")
                yield pa.RecordBatch.from_pydict({"x": pa.array([x.astype(np.float64).tobytes()], pa.binary()),
                                                  "y": pa.array([y.astype(np.int32).tobytes()], pa.binary())})
        rows = dataset.select(vector_to_array(F.col(self.getFeaturesCol())).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"))
        blocks = rows.mapInArrow(pack, "x binary, y binary").persist(StorageLevel.MEMORY_AND_DISK)

        def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                value, g, n = 0.0, np.zeros(len(w)), 0
                for b in batches:
                    for xb, yb in zip(b.column("x"), b.column("y")):
                        x = np.frombuffer(xb.as_buffer()).reshape(-1, layers[0])
                        y = np.frombuffer(yb.as_buffer(), np.int32)
                        for lo in range(0, len(y), ROWS):
                            v, part = gradient(w, layers, x[lo: lo + ROWS], y[lo: lo + ROWS])
                            value, g = value + v, g + part
                        n += len(y)
                yield pa.RecordBatch.from_pydict({"value": [value], "n": [n], "g": pa.array([g.tobytes()], pa.binary())})
            parts = blocks.mapInArrow(run, "value double, n long, g binary").collect()  # one row of the model's size per task
            n = sum(p["n"] for p in parts)
            return sum(p["value"] for p in parts) / n, sum(np.frombuffer(bytes(p["g"])) for p in parts) / n
        try:
            return minimised(loss, start, self.getMaxIter(), self.getTol())
        finally:
            blocks.unpersist()
