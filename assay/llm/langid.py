"""Language identification by nearest centroid (operator 6).

A text becomes a vector of hashed byte n-grams (2 and 3 bytes of the lower-cased text, letters only, other characters
count as one space), log term counts times inverse document frequency, of length 1.  Each language has several centroids, from
spherical k-means over a bounded sample of its documents; a text takes the language of the centroid with the highest
cosine, and is rejected if that cosine is far below what the centroid's own documents reach.

The document frequencies cover all learnable rows.  The k-means sample holds about ``sample_rows`` documents per language (those
of lowest hash); the model is ``languages * centroids`` vectors of ``DIM`` floats.

Edge cases: a null text and a text without any letter give ``und``, score 0, rejected; a null language is never learned; without
learnable rows every text is ``und``; ties of cosines go to the language first in order; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import mix, text_chunks

DIM = 4096
UNKNOWN = "und"

_FOLD = np.full(256, 0x20, np.uint64)
for _c in [*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]:
    _FOLD[_c] = _c


def gram_counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of rows and their matrix of n-gram counts."""
    lower = pc.utf8_lower(column)
    for lo, hi, data, edges in text_chunks(lower, 1 << 19):
        rows, n = hi - lo, len(data)
        x = _FOLD[data]
        row = np.repeat(np.arange(rows), np.diff(edges))
        total = np.zeros(rows * DIM)
        for k in (2, 3):
            if n < k:
                continue
            code = x[: n - k + 1].copy()
            blank = (x[: n - k + 1] == 0x20) & (x[1: n - k + 2] == 0x20)
            for j in range(1, k):
                code = code * np.uint64(257) + x[j: n - k + 1 + j]
            ok = (row[: n - k + 1] == row[k - 1:]) & ~blank
            cell = row[: n - k + 1][ok] * DIM + (mix(code[ok] + np.uint64(k << 40)) % np.uint64(DIM)).astype(np.int64)
            total += np.bincount(cell, minlength=rows * DIM)
        yield lo, hi, total.reshape(rows, DIM)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIM, np.int64), 0
    for b in batches:
        for lo, hi, counts in gram_counts(b.column(0)):
            df += (counts > 0).sum(0)
            n += hi - lo
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIM)), pa.array(np.r_[n, df])], names=["bucket", "n"])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and the centroid of each row; starts from rows far apart, in the order given."""
    centers = unit(x.mean(0, keepdims=True))
    while len(centers) < min(k, len(x)):
        near = (x @ centers.T).max(1)
        centers = np.vstack([centers, x[int(near.argmin())]])
    for _ in range(rounds):
        own = (x @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        used = np.bincount(own, minlength=len(centers)) > 0
        centers[used] = unit(sums[used])
    return centers, (x @ centers.T).argmax(1)


def _cluster(idf: np.ndarray, k: int, floor: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "text"])
        vectors = np.vstack([c for _, _, c in gram_counts(pa.array(pdf["text"], pa.string()))])
        x = unit(np.log1p(vectors) * idf).astype(np.float32)
        centers, own = spherical_kmeans(x, k)
        cos = (x * centers[own]).sum(1)
        return pd.DataFrame([{"lang": pdf["lang"].iloc[0], "centroid": j, "vector": centers[j].astype(float).tolist(),
                              "floor": float(floor * np.quantile(cos[own == j], 0.01))}
                             for j in range(len(centers)) if (own == j).any()])
    return run


def fit(learn: DataFrame, key: str, text: str = "text", lang: str = "lang", centroids: int = 4, sample_rows: int = 1500,
        floor: float = 0.2) -> dict | None:
    """Model from labelled rows: ``idf``, ``langs`` (one per centroid), ``centers``, ``floors``; None without rows."""
    rows = learn.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        F.col("lang").isNotNull() & has_letter(F.col("text")))
    counted = rows.select("text").mapInArrow(_frequency, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    n = {r.bucket: r.n for r in counted.collect()}
    if not n.get(-1):
        return None
    idf = np.log((1 + n[-1]) / (1 + np.array([n.get(b, 0) for b in range(DIM)])))  + 1
    h = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, int(min(1.0, sample_rows / v) * (1 << 30)))])
    sample = rows.withColumn("h", h).where(F.col("h") < share[F.col("lang")])
    model = sample.groupBy("lang").applyInPandas(
        _cluster(idf, centroids, floor), "lang string, centroid int, vector array<double>, floor double").collect()
    model.sort(key=lambda r: (r.lang, r.centroid))
    return {"idf": idf, "langs": [r.lang for r in model], "centers": np.array([r.vector for r in model], np.float32),
            "floors": np.array([r.floor for r in model])}


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _nearest(model: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = np.full(b.num_rows, UNKNOWN, object)
            score, rejected = np.zeros(b.num_rows), np.ones(b.num_rows, bool)
            if model is not None:
                for lo, hi, counts in gram_counts(b.column(1)):
                    cos = unit(np.log1p(counts) * model["idf"]).astype(np.float32) @ model["centers"].T
                    best = cos.argmax(1)
                    lang[lo:hi] = np.array(model["langs"], object)[best]
                    score[lo:hi] = np.clip(cos[np.arange(hi - lo), best], 0, 1)
                    rejected[lo:hi] = score[lo:hi] < model["floors"][best]
            blank = ~b.column(2).to_numpy(zero_copy_only=False)
            lang[blank], score[blank], rejected[blank] = UNKNOWN, 0.0, True
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                                             names=["key", "lang_pred", "score", "rejected"])
    return run


def predict(docs: DataFrame, model: dict | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score, rejected``: the nearest centroid's language, its cosine, and whether it is too far."""
    key_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
                       has_letter(F.col(text)).alias("letter"))
    return rows.mapInArrow(_nearest(model), f"key {key_type}, lang_pred string, score double, rejected boolean"
                           ).withColumnRenamed("key", key)
