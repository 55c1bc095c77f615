"""Quality classifier by importance resampling (operator 1).

Two bag-of-n-gram models over hashed words and word pairs (Xie et al., "Data selection for language models via importance
resampling"): the target model is learned from documents labelled as good, the raw model from every document.  The
log ratios of a document's n-grams are averaged (over ``SHRINK`` more of ratio 0, so that a few words weigh little) and
scaled to a passage of ``PASSAGE`` n-grams, so that a weight tells the kind of text and not its length.  Adding Gumbel noise to
this log weight and keeping the ``k`` highest draws ``k`` documents without replacement in proportion to their weights.

The target documents may be a bounded sample (``target_rows``, lowest key hashes first); their keys alone are broadcast.  The
raw counts, the weights and the draw cover all rows.  The cut of the draw is found by counting keys in ever narrower
ranges, so no task and no driver holds the keys of all rows.

Edge cases: a null or empty text has log weight 0; without target documents every log weight is 0 and the draw is uniform;
rows that repeat a key and a text get the same noise and stand or fall together (the draw then exceeds ``k`` by them); ties of
different rows are broken by the key; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import settle, text_or_empty, words_of

#: Rows in one counting round of the cut: bounds what the driver receives.
CUT_BUCKETS = 4096
#: Length of the passage that a log weight stands for, and n-grams of ratio 0 added to every document, in n-grams.
PASSAGE, SHRINK = 100, 20


def _buckets(w, buckets: int):
    """Bucket and row of every word and word pair; the two kinds share the buckets."""
    for n in (1, 2):
        h, row = w.ngrams(n)
        yield (h % np.uint64(buckets)).astype(np.int64), row


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            chosen = b.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, w in words_of(b.column(0)):
                for bucket, row in _buckets(w, buckets):
                    raw += np.bincount(bucket, minlength=buckets)
                    target += np.bincount(bucket[chosen[lo:hi][row]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])],
                                         names=["bucket", "raw", "target"])
    return run


def _weigh(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weight, grams = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            for lo, hi, w in words_of(b.column(1)):
                for bucket, row in _buckets(w, len(ratio)):
                    weight[lo:hi] += np.bincount(row, ratio[bucket], minlength=hi - lo)
                    grams[lo:hi] += np.bincount(row, minlength=hi - lo)
            weight *= PASSAGE / (grams + SHRINK)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weight), pa.array(grams), b.column(2)],
                                             names=["key", "log_weight", "n_grams", "tie"])
    return run


def fit_log_ratio(docs: DataFrame, target: DataFrame, buckets: int = 10_000, smoothing: float = 1.0,
                  target_rows: int = 20_000, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """log(target probability / raw probability) of every bucket.  ``target`` holds the keys of the target documents."""
    sample = target.select(F.col(key).alias("target_key")).where("target_key is not null").distinct().orderBy(
        F.xxhash64("target_key"), "target_key").limit(target_rows)
    flagged = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).join(
        F.broadcast(sample.withColumn("hit", F.lit(True))), F.col("key") == F.col("target_key"), "left")
    counts = flagged.select("text", F.coalesce("hit", F.lit(False)).alias("hit")).mapInArrow(
        _count(buckets), "bucket long, raw long, target long")
    raw, good = np.zeros(buckets), np.zeros(buckets)
    for r in counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r.bucket], good[r.bucket] = r.raw, r.target
    if not good.any():
        return np.zeros(buckets)
    return (np.log((good + smoothing) / (good.sum() + smoothing * buckets))
            - np.log((raw + smoothing) / (raw.sum() + smoothing * buckets)))


def top_k(df: DataFrame, order: str, tie: str, k: int) -> Column:
    """Condition that holds for the ``k`` rows of highest ``order`` (a double without nulls), ties by lowest ``tie``.

    Rows equal in both are kept or left together.
    """
    n, lo, hi = df.agg(F.count(F.lit(1)), F.min(order), F.max(order)).first()
    if k <= 0 or not n:
        return F.lit(False)
    if k >= n:
        return F.lit(True)
    need = k
    while lo < hi:
        width = (hi - lo) / CUT_BUCKETS
        if not lo + width > lo:
            break
        bucket = F.least(F.floor((F.col(order) - lo) / width), F.lit(CUT_BUCKETS - 1))
        seen = df.where(F.col(order).between(lo, hi)).groupBy(bucket.alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min(order).alias("lo"), F.max(order).alias("hi")).collect()
        for r in sorted(seen, key=lambda r: -r.b):
            if r.n >= need:
                lo, hi, left = r.lo, r.hi, r.n
                break
            need -= r.n
        if left == need:
            return F.col(order) >= lo
        if left <= CUT_BUCKETS:
            break
    edge = df.where(F.col(order).between(lo, hi)).select(order, tie).orderBy(F.desc(order), tie).limit(need)
    last = edge.orderBy(order, F.desc(tie)).first()
    return (F.col(order) > last[0]) | ((F.col(order) == last[0]) & (F.col(tie) <= last[1]))


def gumbel(seed: int, *cols: str) -> Column:
    """Standard Gumbel noise that depends on the columns alone."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) + F.lit(0.5)) * F.lit(2.0 ** -53)
    return -F.log(-F.log(u))


def importance_resample(docs: DataFrame, target: DataFrame, keep: float = 0.88, seed: int = 17, buckets: int = 10_000,
                        target_rows: int = 20_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_grams, log_weight, draw_key, kept`` for every document; ``kept`` marks ``ceil(keep * rows)`` of them."""
    ratio = fit_log_ratio(docs, target, buckets, target_rows=target_rows, key=key, text=text)
    key_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"),
                       F.xxhash64(key, text_or_empty(text)).alias("tie"))
    weighed = settle(rows.mapInArrow(_weigh(ratio), f"key {key_type}, log_weight double, n_grams long, tie long")
                     .withColumn("draw_key", F.col("log_weight") + gumbel(seed, "key", "tie")), "weights")
    chosen = top_k(weighed, "draw_key", "tie", math.ceil(keep * weighed.count()))
    return weighed.select(F.col("key").alias(key), "n_grams", "log_weight", "draw_key", chosen.alias("kept"))
