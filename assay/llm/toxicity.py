"""Toxicity: boosted trees over dense features, isotonic calibration (operator 4).

The lexicon is a fixed list of words and, for languages and inflections that no list covers, the word stems (first 4 to 7
bytes) that labelled toxic texts hold far more often than clean ones.  Every text becomes a dozen figures: density of
lexicon words, plain and with look-alike characters undone, how near they stand to a second-person word,
capitals, punctuation, and letters masked by digits or symbols.  Labelled rows are dealt into two halves by a hash; a
gradient-boosted classifier is fitted on each, every labelled row is scored by the half it was not in, and an isotonic
regression maps these margins to probabilities.  A document's score is the calibrated mean margin of the two.

The fit takes at most ``max_rows`` labelled rows (lowest hashes first) and at most ``MAX_STEMS`` stems, so what is broadcast is
bounded.  Figures and scores cover every row, and only figures leave a task.

Edge cases: a null or empty text has the figures of no words and gets a score; documents with several labels are toxic if one
of them says so; null labels are not learned; without both classes among the labels the score is their mean (0 without
any); repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import ByteTable, Words, hash_of, settle, text_chunks, text_or_empty

#: Words of abuse, by language.
LEXICON = """
idiot idiots stupid moron morons loser losers scum clown trash garbage worthless pathetic disgusting dumb fool jerk creep
freak pig bastard bitch asshole shit fuck fucking retard retarded imbecile cretin vermin filth hate kill ugly liar
dummkopf trottel arschloch scheisse scheiße blödmann abschaum versager widerlich wertlos
imbécile crétin connard salaud merde débile ordure minable dégoûtant
estúpido imbécil basura asqueroso patético gilipollas cabrón mierda inútil
""".split()
#: Words that address the reader, by language.
SECOND_PERSON = """
you your yours yourself u ur du dich dir dein deine ihr euch tu toi te ton ta tes vous votre tú ti tus usted eres
""".split()
#: Characters that stand for letters in disguised words.
LOOK_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Words between a lexicon word and a second-person word that still count as near.
NEAR = 5

#: Stem lengths in bytes, most stems kept, and the least association (likelihood ratio statistic) of a stem.
STEMS, MAX_STEMS, LEAST_G2 = (4, 5, 6, 7), 2000, 30.0

FIGURES = ("hits", "hit_density", "hit_kinds", "hits_in_50", "disguised_density", "near_you", "you_density", "capitals",
           "capital_words", "punctuation", "exclamations", "masked", "log_words", "word_bytes")

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_MASK = np.zeros(256, bool)
_MASK[[ord(c) for c in "*@$#0123456789"]] = True

PLAIN = ByteTable([c for c in range(128) if not _LETTER[c]])
UNMASKED = ByteTable([c for c in range(128) if not _LETTER[c] and chr(c) not in LOOK_ALIKE], LOOK_ALIKE)


def _among(h: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which hashes are among a few wanted ones."""
    seen = np.zeros(1 << 16, bool)
    seen[(wanted & np.uint64(0xFFFF)).astype(np.int64)] = True
    out = seen[(h & np.uint64(0xFFFF)).astype(np.int64)]
    at = np.flatnonzero(out)
    out[at] = np.isin(h[at], wanted)
    return out


def figures(data: np.ndarray, edges: np.ndarray, lexicon: np.ndarray, stems: np.ndarray, you: np.ndarray) -> np.ndarray:
    """Matrix of :data:`FIGURES` for the rows of one chunk; hashes of whole words, of stems, and of addressing words."""
    rows, n = len(edges) - 1, len(data)
    byte_row = np.repeat(np.arange(rows), np.diff(edges))

    def per_row(mask, row=byte_row):
        return np.bincount(row[mask], minlength=rows).astype(float)

    w = Words(data, edges, PLAIN)
    words = np.maximum(np.bincount(w.row, minlength=rows), 1).astype(float)
    hit, second = _among(w.hash, lexicon), _among(w.hash, you)
    if len(stems):
        for k in STEMS:
            h, at = w.prefixes(k)
            hit[at[_among(h, stems)]] = True
    hits = per_row(hit, w.row)
    at, kind = np.flatnonzero(hit), w.hash[hit]
    kinds = np.bincount(np.unique(np.stack([w.row[at].astype(np.uint64), kind]), axis=1)[0].astype(np.int64),
                        minlength=rows) if len(at) else np.zeros(rows)
    # hits of the same row within the 50 words up to each hit
    best = np.zeros(rows)
    if len(at):
        since = np.maximum(np.searchsorted(at, at - 49), np.searchsorted(at, w.first[w.row[at]]))
        np.maximum.at(best, w.row[at], np.arange(1, len(at) + 1) - since)
    yous = np.flatnonzero(second)
    near = np.zeros(len(at), bool)
    if len(at) and len(yous):
        k = np.searchsorted(yous, at)
        for c in (np.clip(k - 1, 0, len(yous) - 1), np.clip(k, 0, len(yous) - 1)):
            near |= (np.abs(yous[c] - at) <= NEAR) & (w.row[yous[c]] == w.row[at])
    u = Words(data, edges, UNMASKED)
    disguised = np.maximum(per_row(_among(u.hash, lexicon), u.row) - per_row(_among(w.hash, lexicon), w.row), 0)
    letter, capital = _LETTER[data], _CAPITAL[data]
    masked = np.zeros(n, bool)
    if n > 2:
        masked[1:-1] = _MASK[data[1:-1]] & letter[:-2] & letter[2:]
    starts = w.start[w.end - w.start > 1]
    return np.column_stack([
        hits, hits / words, kinds, best, disguised / words, np.bincount(w.row[at][near], minlength=rows) / words,
        per_row(second, w.row) / words, per_row(capital) / np.maximum(per_row(letter), 1),
        np.bincount(byte_row[starts], capital[starts + 1], minlength=rows) / words if len(starts) else np.zeros(rows),
        per_row(_PUNCT[data]) / words, per_row(data == ord("!")) / words, per_row(masked) / words,
        np.log1p(np.bincount(w.row, minlength=rows)), per_row(letter) / words])


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Toxic and clean documents that hold each stem, summed within the task."""
    keys, toxic, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        label = b.column(1).to_numpy(zero_copy_only=False) > 0
        for lo, hi, data, edges in text_chunks(b.column(0)):
            w = Words(data, edges, PLAIN)
            found = [(h, w.row[at]) for h, at in (w.prefixes(k) for k in STEMS)]
            pair = np.unique(np.stack([np.concatenate([h for h, _ in found]),
                                       np.concatenate([r for _, r in found]).astype(np.uint64)]), axis=1)
            yes = label[lo:hi][pair[1].astype(np.int64)]
            keys, where = np.unique(np.concatenate([keys, pair[0]]), return_inverse=True)
            toxic = np.bincount(where, np.concatenate([toxic, yes]), minlength=len(keys)).astype(np.int64)
            total = np.bincount(where, np.concatenate([total, np.ones(len(yes))]), minlength=len(keys)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(toxic), pa.array(total - toxic)],
                                     names=["stem", "toxic", "clean"])


def learn_stems(docs: DataFrame, sample: DataFrame, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """Hashes of the stems most tied to toxic labels.  ``sample``: bounded rows of ``key, label`` (broadcast)."""
    n1, n = sample.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count(F.lit(1)).cast("double")).first()
    if n1 in (0, n):
        return np.zeros(0, np.uint64)
    texts = docs.select(key, text_or_empty(text).alias("text")).join(F.broadcast(sample.select(key, "label")), key)
    counts = texts.select("text", "label").mapInArrow(_stem_counts, "stem long, toxic long, clean long").groupBy(
        "stem").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")).where("a >= 3")
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    seen = a + b

    def part(observed, expected):
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    g2 = 2 * (part(a, seen * n1 / n) + part(b, seen * (n - n1) / n)
              + part(n1 - a, (n - seen) * n1 / n) + part(n - n1 - b, (n - seen) * (n - n1) / n))
    tied = (a / n1 > 4 * b / (n - n1)) & (g2 >= LEAST_G2)
    rows = counts.where(tied).select("stem", g2.alias("g2")).orderBy(F.desc("g2"), "stem").limit(MAX_STEMS).collect()
    return np.array([r.stem for r in rows], np.int64).view(np.uint64)


def _measure(stems: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, you = hash_of(LEXICON, PLAIN), hash_of(SECOND_PERSON, PLAIN)
        for b in batches:
            out = np.zeros((b.num_rows, len(FIGURES)))
            for lo, hi, data, edges in text_chunks(b.column(1)):
                out[lo:hi] = figures(data, edges, lexicon, stems, you)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in out.T]], names=["key", *FIGURES])
    return run


def measure(docs: DataFrame, stems: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the figures of every row."""
    key_type = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).mapInArrow(
        _measure(stems), f"key {key_type}, " + ", ".join(f"{f} double" for f in FIGURES)).withColumnRenamed("key", key)


def _margin(models, df: DataFrame) -> DataFrame:
    """Adds ``margin``: mean raw margin of the models."""
    cols = []
    for i, m in enumerate(models):
        m = m.copy().setRawPredictionCol(f"__raw{i}").setProbabilityCol("").setPredictionCol("")
        df = m.transform(df)
        cols.append(vector_to_array(F.col(f"__raw{i}"))[1])
    return df.withColumn("margin", sum(cols[1:], cols[0]) / len(cols)).drop(*[f"__raw{i}" for i in range(len(models))])


class ToxicityModel:
    """``score(measured)`` adds a column ``score`` to the rows of :func:`measure`."""

    def __init__(self, halves, calibration, constant: float):
        self.halves, self.calibration, self.constant = halves, calibration, constant

    def score(self, measured: DataFrame) -> DataFrame:
        if not self.halves:
            return measured.withColumn("score", F.lit(self.constant))
        marked = _margin(self.halves, VectorAssembler(inputCols=list(FIGURES), outputCol="features").transform(measured))
        scored = self.calibration.setPredictionCol("score").transform(marked)
        return scored.withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, max_rows: int) -> DataFrame:
    """``key, label, half`` of at most ``max_rows`` labelled documents, lowest hashes first."""
    truth = labels.where("toxic is not null").groupBy(key).agg(F.max(F.col("toxic").cast("double")).alias("label"))
    order = F.xxhash64(F.lit(4), F.col(key))
    rows = truth.join(docs.select(key), key, "left_semi").withColumn("__order", order)
    return settle(rows.orderBy("__order", key).limit(max_rows).select(
        key, "label", F.pmod(F.shiftrightunsigned("__order", 8), F.lit(2)).cast("int").alias("half")), "toxic-sample")


def fit(measured: DataFrame, sample: DataFrame, key: str = "doc_id", rounds: int = 12, depth: int = 3,
        parts: int = 4) -> ToxicityModel:
    """Learn from the figures of the sampled rows."""
    count, positive = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not count or positive in (0, count):
        return ToxicityModel([], None, float(positive) / max(count, 1))
    rows = settle(measured.join(F.broadcast(sample), key), "toxic-learn")
    data = VectorAssembler(inputCols=list(FIGURES), outputCol="features").transform(rows).select(
        "features", "label", "half").coalesce(parts).cache()
    try:
        both = data.select("half", "label").distinct().count() == 4
        gbt = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, minInstancesPerNode=3, seed=4)
        halves = [gbt.fit(data.where(F.col("half") == h)) for h in (0, 1)] if both else [gbt.fit(data)]
        held = _margin([halves[1]], data.where("half = 0")).unionByName(
            _margin([halves[0]], data.where("half = 1"))) if both else _margin(halves, data)
        calibration = IsotonicRegression(featuresCol="margin", labelCol="label").fit(held.select("margin", "label"))
    finally:
        data.unpersist()
    return ToxicityModel(halves, calibration, float(positive) / count)


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", cutoff: float = 0.7,
                   max_rows: int = 20_000) -> DataFrame:
    """``key, score, predicted`` and the figures of every document; ``labels`` are those that may be learned."""
    sample = labelled_sample(docs, labels, key, max_rows)
    measured = settle(measure(docs, learn_stems(docs, sample, key, text), key, text), "toxic-figures")
    return fit(measured, sample, key).score(measured).select(
        key, "score", (F.col("score") >= cutoff).cast("int").alias("predicted"), *FIGURES)
