"""Benchmark decontamination by latent semantic retrieval (operator 9).

Passages are windows of ``WINDOW`` words of documents and of benchmark items.  They are TF-IDF vectors over the words of the
benchmark (no other word can match an item); a randomised SVD of the passages of all documents gives ``RANK`` latent dimensions, and
passages are compared by cosine after scaling every dimension by its singular value.  The SVD is distributed: tasks sum what their
passages add to a sketch of ``vocabulary x (RANK + EXTRA)`` numbers, the sketches are added up in levels, and the small
factorisation of their sum (Nyström, one pass) is done once.

Candidates are checked on words: the longest common subsequence of the item and the words around the passage, for verbatim
copies, copies of a window of the item, and paraphrases; a paraphrase must hold the answer (the item's last sentence) as well.

The benchmark is taken in blocks of ``BLOCK_ITEMS`` items, each with its own vocabulary and model, so that what a block broadcasts
is bounded for a benchmark of any size.  Documents never leave their task: a search emits only hits.

Edge cases: null and empty texts and items match nothing; an empty benchmark or an empty table gives no hits; repeated
documents are hit alike; items that are equal are hit alike; ties of a document's windows go to the first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import settle, text_or_empty, words_of

WINDOW, STRIDE = 24, 12
RANK, EXTRA = 128, 16
BLOCK_ITEMS = 2000
#: Least cosine of a candidate, and least share of an item window's IDF weight that the passage must hold.
COSINE, CONTAINED = 0.42, 0.4
#: Least share of the item in a verbatim copy; of an item window in a partial copy; of the item, and of its answer, in a paraphrase.
VERBATIM, PARTIAL, PARAPHRASE, ANSWER = 0.8, 0.9, 0.55, 0.6
#: Least IDF: a word that stands in nearly every document still weighs something, so copies of an item are found in a
#: table that consists of them.
LEAST_IDF = 0.1
#: Vocabulary rows of the sketch that travel together, and partial sketches of a slab that one task adds up.
SLAB = 512
ADD_AT_ONCE = 64

HITS = "item_index int, cosine double, lcs double, answer double, first_word long, last_word long"


def windows(first: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the windows of every row that has words; ``first`` are the rows' first word indexes."""
    n = np.diff(first)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // stride)), 0)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = first[:-1][row] + k * stride
    return row, start, np.minimum(start + WINDOW, first[1:][row])


class Vocabulary:
    """Codes of the words of a block of items; other words are -1."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(words & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def __len__(self):
        return len(self.words)

    def code(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        at = np.flatnonzero(self.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        p = np.minimum(np.searchsorted(self.words, h[at]), len(self.words) - 1)
        out[at] = np.where(self.words[p] == h[at], p, -1)
        return out


def _frequency(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(vocabulary), np.int64), 0
        for b in batches:
            n += b.num_rows
            for lo, hi, w in words_of(b.column(0)):
                code = vocabulary.code(w.hash)
                ok = code >= 0
                seen = np.unique(w.row[ok] * len(vocabulary) + code[ok])
                df += np.bincount(seen % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(df))), pa.array(np.r_[n, df])], names=["code", "n"])
    return run


def _sum_words(vectors: np.ndarray, code: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sum of the vectors of each passage's words: first words of all passages, then second words, and so on."""
    first = np.cumsum(size) - size
    out = np.zeros((len(size), vectors.shape[1]), np.float32)
    for k in range(int(size.max(initial=0))):
        at = np.flatnonzero(size > k)
        out[at] += vectors[code[first[at] + k]]
    return out


def _add_passages(total: np.ndarray, y: np.ndarray, code: np.ndarray, passage: np.ndarray, few: int = 16):
    """Add to each word's row of ``total`` the vectors of the passages it stands in; frequent words one by one."""
    order = np.argsort(code, kind="stable")
    code, passage = code[order], passage[order]
    first = np.r_[0, np.flatnonzero(code[1:] != code[:-1]) + 1]
    count = np.diff(np.r_[first, len(code)])
    for lo, n in zip(first[count > few].tolist(), count[count > few].tolist()):
        total[code[lo]] += y[passage[lo: lo + n]].sum(0)
    first, count = first[count <= few], count[count <= few]
    for k in range(few):
        at = first[count > k] + k
        total[code[at]] += y[passage[at]]


def _sketch(vocabulary: Vocabulary, idf: np.ndarray, probe: np.ndarray):
    """What the passages of a task add to ``A' A probe`` (A: passages by vocabulary), in slabs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighed = (probe * idf[:, None]).astype(np.float32)
        total = np.zeros(probe.shape)
        for b in batches:
            for lo, hi, w in words_of(b.column(0), max_bytes=1 << 18):
                code = vocabulary.code(w.hash)
                row, start, end = windows(w.first, WINDOW)
                if not len(row):
                    continue
                known = np.r_[0, np.cumsum(code >= 0)]
                code = code[code >= 0]
                size = known[end] - known[start]
                if not len(code):
                    continue
                y = _sum_words(weighed, code, size)
                _add_passages(total, y, code, np.repeat(np.arange(len(size)), size))
        total *= idf[:, None]
        slabs = range(0, len(vocabulary), SLAB)
        yield pa.RecordBatch.from_arrays(
            [pa.array([s // SLAB for s in slabs], pa.int32()),
             pa.array([total[s: s + SLAB].astype(np.float32).tobytes() for s in slabs], pa.binary())], names=["slab", "sums"])
    return run


def _add_slabs(pdf: pd.DataFrame) -> pd.DataFrame:
    total = reduce(np.add, (np.frombuffer(x, np.float32).astype(float) for x in pdf["sums"]))
    return pd.DataFrame({"slab": [pdf["slab"].iloc[0]], "part": [pdf["part"].iloc[0] // ADD_AT_ONCE],
                         "sums": [total.astype(np.float32).tobytes()]})


def add_sketches(partial: DataFrame, tasks: int) -> DataFrame:
    """``slab, sums`` from the ``slab, part, sums`` of ``tasks`` tasks, added up in levels: no task holds more than
    ``ADD_AT_ONCE`` sketches of a slab."""
    while True:
        partial = partial.groupBy("slab", F.floor(F.col("part") / ADD_AT_ONCE)).applyInPandas(
            _add_slabs, "slab int, part long, sums binary")
        if tasks <= ADD_AT_ONCE:
            return partial.select("slab", "sums")
        tasks = -(-tasks // ADD_AT_ONCE)


def lcs_length(item: list[int], words: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel rows over big integers."""
    masks: dict[int, int] = {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | (1 << k)
    full = (1 << len(item)) - 1
    v = full
    for c in words.tolist():
        m = masks.get(c)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


class Model:
    """A block of items with its vocabulary, weights and latent space."""

    def __init__(self, items: list[tuple[int, str]]):
        self.index, texts = [i for i, _ in items], [t for _, t in items]
        runs = [w for _, _, w in words_of(pa.array(texts, pa.string()))]
        hashes = [w.hash[w.first[r]: w.first[r + 1]] for w in runs for r in range(w.rows)]
        self.vocabulary = Vocabulary(np.unique(np.concatenate(hashes)))
        self.items = [self.vocabulary.code(h) for h in hashes]
        self.answers = []
        for t, codes in zip(texts, self.items):
            last = re.split(r"(?<=[.!?])\s+|\n", t.strip())[-1]
            self.answers.append(codes[len(codes) - max(1, min(len(codes), len(last.split()))):].tolist())
        first = np.r_[0, np.cumsum([len(c) for c in self.items])]
        self.window_item, self.window_start, end = windows(first)
        at = self.window_start[:, None] + np.arange(WINDOW)
        flat = np.concatenate(self.items)
        self.window_codes = np.where(at < end[:, None], flat[np.minimum(at, len(flat) - 1)], -1)
        self.window_start -= first[self.window_item]

    def set_idf(self, n: int, df: np.ndarray):
        self.idf = np.maximum(np.log((1 + n) / (1 + df)), LEAST_IDF)
        codes = np.sort(self.window_codes, axis=1)
        once = np.c_[codes[:, :1] >= 0, (codes[:, 1:] != codes[:, :-1]) & (codes[:, 1:] >= 0)]
        self.window_distinct = np.where(once, codes, -1)
        self.window_weight = np.where(once, self.idf[codes], 0).sum(1)

    def set_space(self, probe: np.ndarray, sketch: np.ndarray):
        """Latent axes from ``sketch = A' A probe``, scaled by the inverse singular values."""
        shift = 1e-6 * np.linalg.norm(sketch) + 1e-12
        shifted = sketch + shift * probe
        core = probe.T @ shifted
        half = np.linalg.solve(np.linalg.cholesky((core + core.T) / 2), shifted.T).T
        axes, s, _ = np.linalg.svd(half, full_matrices=False)
        axes, s = axes[:, :RANK], s[:RANK]
        scaled = axes * self.idf[:, None] / np.maximum(s, 0.02 * s[0])
        self.project = np.vstack([scaled, np.zeros((1, scaled.shape[1]))]).astype(np.float32)  # the last row is code -1
        self.window_vectors = self.latent(self.window_codes)

    def latent(self, codes: np.ndarray) -> np.ndarray:
        x = self.project[codes[:, 0]]
        for k in range(1, codes.shape[1]):
            x += self.project[codes[:, k]]
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def candidates(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray):
        """Passage, item window and cosine of what is close enough, in slices of passages."""
        weight = np.r_[0, np.cumsum(np.where(codes >= 0, self.idf[codes], 0))]
        least = CONTAINED * self.window_weight.min()
        able = np.flatnonzero(weight[end] - weight[start] >= max(least, 1e-9))
        for lo in range(0, len(able), 1024):
            p = able[lo: lo + 1024]
            at = start[p][:, None] + np.arange(WINDOW)
            c = np.where(at < end[p][:, None], codes[np.minimum(at, len(codes) - 1)], -1)
            cos = self.latent(c) @ self.window_vectors.T
            i, w = np.nonzero(cos >= COSINE)
            for s in range(0, len(i), 1 << 14):
                i1, w1 = i[s: s + (1 << 14)], w[s: s + (1 << 14)]
                own = self.window_distinct[w1]
                held = (own[:, :, None] == c[i1][:, None, :]).any(2) & (own >= 0)
                enough = np.where(held, self.idf[own], 0).sum(1) >= CONTAINED * self.window_weight[w1]
                yield from zip(p[i1[enough]], w1[enough], cos[i1[enough], w1[enough]])

    def judge(self, codes: np.ndarray, start: int, end: int, first: int, last: int, window: int):
        """Shares of the item and of its answer around a passage, and whether this is a leak."""
        item = self.items[self.window_item[window]]
        k = int(self.window_start[window])
        around = codes[max(first, start - k - WINDOW): min(last, end + len(item) - k)]
        share = lcs_length(item.tolist(), around) / len(item)
        answer_words = self.answers[self.window_item[window]]
        answer = lcs_length(answer_words, around) / len(answer_words)
        leak = share >= VERBATIM or (share >= PARAPHRASE and answer >= ANSWER)
        if not leak:
            part = item[k: k + WINDOW]
            near = codes[max(first, start - STRIDE): min(last, end + STRIDE)]
            leak = len(part) == WINDOW and lcs_length(part.tolist(), near) >= PARTIAL * WINDOW
        return share, answer, leak


def _search(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, out = [], []
            for lo, hi, w in words_of(b.column(1)):
                codes = model.vocabulary.code(w.hash)
                row, start, end = windows(w.first)
                best: dict[tuple[int, int], tuple] = {}
                for p, window, cos in model.candidates(codes, start, end):
                    r, item = int(row[p]), int(model.window_item[window])
                    if (r, item) in best and best[r, item][0] >= 0.95:
                        continue
                    first, last = int(w.first[r]), int(w.first[r + 1])
                    share, answer, leak = model.judge(codes, int(start[p]), int(end[p]), first, last, window)
                    if leak and share > best.get((r, item), (-1,))[0]:
                        best[r, item] = (share, answer, float(cos), int(start[p]) - first, int(end[p]) - first)
                for (r, item), (share, answer, cos, a, z) in sorted(best.items()):
                    keys.append(lo + r)
                    out.append((model.index[item], cos, share, answer, a, z))
            cols = list(zip(*out)) or [()] * 6
            types = [pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keys, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, types)]],
                names=["key", "item_index", "cosine", "lcs", "answer", "first_word", "last_word"])
    return run


def fit(texts: DataFrame, items: list[tuple[int, str]]) -> Model | None:
    """Model of a block of items over the passages of ``texts`` (one column, ``text``); None if no document shares a word."""
    model = Model(items)
    n = {r.code: r.n for r in texts.mapInArrow(_frequency(model.vocabulary), "code long, n long").groupBy("code").agg(
        F.sum("n").alias("n")).collect()}
    df = np.array([n.get(c, 0) for c in range(len(model.vocabulary))])
    if not df.any():
        return None
    model.set_idf(n[-1], df)
    size = len(model.vocabulary)
    probe, _ = np.linalg.qr(np.random.default_rng(9).standard_normal((size, min(RANK + EXTRA, size))))
    partial = texts.mapInArrow(_sketch(model.vocabulary, model.idf, probe), "slab int, sums binary").select(
        "slab", F.spark_partition_id().cast("long").alias("part"), "sums")
    slabs = add_sketches(partial, texts.rdd.getNumPartitions()).collect()
    sketch = np.concatenate([np.frombuffer(r.sums, np.float32) for r in sorted(slabs, key=lambda r: r.slab)])
    model.set_space(probe, sketch.reshape(probe.shape).astype(float))
    return model


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
               item_text: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """A row for every document and benchmark item that it leaks: ``key, item_key, cosine, lcs, answer, first_word, last_word``."""
    spark = docs.sparkSession
    key_type, item_type = docs.schema[key].dataType, benchmark.schema[item_key].dataType
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    wanted = settle(benchmark.select(F.col(item_key).alias("item"), F.col(item_text).cast("string").alias("text")).where(
        r"text rlike '[^\\x20\\x09-\\x0D]'"), "items")
    blocks = -(-wanted.count() // block_items)
    found = []
    for block in range(blocks):
        mine = wanted.where(F.pmod(F.xxhash64("text", "item"), F.lit(blocks)) == block).orderBy("item", "text").collect()
        if not mine:
            continue
        model = fit(rows.select("text"), [(i, r.text) for i, r in enumerate(mine)])
        if model is None:
            continue
        hits = rows.mapInArrow(_search(model), f"key {key_type.simpleString()}, {HITS}")
        names = spark.createDataFrame([(i, r.item) for i, r in enumerate(mine)],
                                      f"item_index int, item {item_type.simpleString()}")
        found.append(settle(hits, "hits").join(names, "item_index").select(
            F.col("key").alias(key), F.col("item").alias(item_key), "cosine", "lcs", "answer", "first_word", "last_word"))
    if not found:
        return rows.limit(0).select(
            F.col("key").alias(key), F.lit(None).cast(item_type).alias(item_key), *[
                F.lit(None).cast("double").alias(c) for c in ("cosine", "lcs", "answer")], *[
                F.lit(None).cast("long").alias(c) for c in ("first_word", "last_word")])
    return reduce(DataFrame.unionByName, found)
