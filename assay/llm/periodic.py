"""Periodic runs of words (operator 13).

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are identical) that no neighbouring
word extends, of at least ``max(MIN_WORDS, MIN_POWER * q)`` words.

*Recursive frequency splitting.*  In a run every word occurs ``MIN_POWER`` times or more (six times if ``q`` is 1), so a word
that occurs less often within its segment cannot belong to a run and splits the segment.  The parts are new, shorter
segments with new frequencies; this goes on until no word is too rare in any segment.  Ordinary prose falls apart at once.

*Lag scan.*  What survives is scanned by lag, one octave ``[s, 2s)`` of lags at a time and only in segments long enough for it.
Windows of ``2s`` words are numbered exactly (equal windows, equal numbers; each octave joins two numbers of the one
before).  The lag of a position is the distance to the next equal window.  A window is as long as the period at least, so
inside a run it can recur only after whole periods: all positions of a run, and no position next to it, have exactly the
lag ``q``, and a stretch of positions with one lag in the octave is a maximal repetition.  So nothing is tried twice, and a
segment of ``L`` words costs ``O(L log L)`` per octave at any length: texts are scanned whole.

All documents of an Arrow batch are scanned together in numpy, in chunks of about 1 MB of text (a longer text stands alone).

Edge cases: a null text has no words; words are compared case-sensitively, by 64-bit hashes; null and repeated keys are
judged row by row, in no order; an empty table gives no row.  Columns other than key and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import ByteTable, text_or_empty, words_of

MIN_WORDS, MIN_POWER = 6, 4


class _ExactCase(ByteTable):
    """Bytes as they are: A-Z differ from a-z."""

    def __init__(self):
        super().__init__()
        lower = self.code[ord("a"): ord("z") + 1]
        self.code[ord("A"): ord("Z") + 1] = lower * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2)


CASED = _ExactCase()


def split_by_frequency(word: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions that survive the splitting and their segments, numbered so that neighbouring segments differ.

    ``seg`` gives each position's segment (a document, to begin with) in ascending order.
    """
    at = np.arange(len(word))
    while len(at):
        order = np.lexsort((word, seg))
        s, w = seg[order], word[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (w[1:] != w[:-1])
        group = np.cumsum(new) - 1
        often = np.empty(len(s), bool)
        often[order] = np.bincount(group)[group] >= MIN_POWER
        _, first, size = np.unique(seg, return_index=True, return_counts=True)
        often &= np.repeat(size >= MIN_WORDS, size)
        if often.all():
            break
        at, word = at[often], word[often]
        apart = np.ones(len(at), bool)
        apart[1:] = (np.diff(at) > 1) | (seg[often][1:] != seg[often][:-1])
        seg = np.cumsum(apart)
    return at, seg


def _numbered(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


def lag_scan(word: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, length, period`` of all runs; starts index ``word``, whose segments ``seg`` are consecutive there."""
    starts, lengths, periods = [], [], []
    at = np.arange(len(word))
    number, step = _numbered(word), 1
    while True:
        # positions in segments that can hold a run with a period of this octave
        first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]]) if len(seg) else np.zeros(0, int)
        size = np.diff(np.r_[first, len(seg)])
        wide = np.repeat(size >= max(MIN_WORDS, MIN_POWER * step), size)
        at, seg, number = at[wide], seg[wide], number[wide]
        if not len(at):
            break
        # windows of 2 * step words, numbered by the numbers of their halves
        whole = np.zeros(len(at), bool)
        whole[:-step] = (seg[step:] == seg[:-step]) & (number[step:] >= 0) & (number[:-step] >= 0)
        here = np.flatnonzero(whole)
        window = np.full(len(at), -1, np.int64)
        window[here] = _numbered(number[here] * (number.max() + 1) + number[here + step])
        order = here[np.lexsort((here, window[here], seg[here]))]
        again = (window[order[1:]] == window[order[:-1]]) & (seg[order[1:]] == seg[order[:-1]])
        lag = np.zeros(len(at), np.int64)
        lag[order[:-1][again]] = (order[1:] - order[:-1])[again]
        lag[(lag < step) | (lag >= 2 * step)] = 0
        # stretches of consecutive positions with one lag
        edge = np.ones(len(at), bool)
        edge[1:] = (lag[1:] != lag[:-1]) | (seg[1:] != seg[:-1])
        begin = np.flatnonzero(edge)
        count = np.diff(np.r_[begin, len(at)])
        begin, count = begin[lag[begin] > 0], count[lag[begin] > 0]
        q = lag[begin]
        length = count - 1 + q + 2 * step
        run = length >= np.maximum(MIN_WORDS, MIN_POWER * q)
        starts.append(at[begin[run]])
        lengths.append(length[run])
        periods.append(q[run])
        number, step = window, 2 * step
    empty = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(x + empty) for x in (starts, lengths, periods))


def find_runs(word: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, length, period`` (starts index ``word``) of the runs of consecutive documents, by start, then period."""
    at, seg = split_by_frequency(word, doc)
    start, length, period = lag_scan(word[at], seg)
    start = at[start]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """False for words that a run contains after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    return np.cumsum(depth)[:n] == 0


RUNS = "runs array<struct<start:long,length:long,period:long>>, collapsed string, n_words long"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0)
        for lo, hi, words in words_of(batch.column(1), CASED):
            start, length, period = find_runs(words.hash, words.row)
            kept = kept_words(len(words.hash), start, length, period)
            first_run = np.searchsorted(start, words.first)
            texts = []
            for d in range(hi - lo):
                a, b = words.first[d], words.first[d + 1]
                parts = words.data[words.edges[d]: words.edges[d + 1]].tobytes().split()
                if first_run[d] < first_run[d + 1]:
                    parts = compress(parts, kept[a:b].tolist())
                texts.append(b" ".join(parts))
            own = words.first[words.row[start]] if len(start) else start
            runs = pa.StructArray.from_arrays([pa.array(x) for x in (start - own, length, period)],
                                              names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [keys.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(first_run, pa.int32()), runs).cast(_RUN_TYPE),
                 pa.array(texts, pa.binary()).cast(pa.string()), pa.array(np.diff(words.first), pa.int64())],
                names=["key", "runs", "collapsed", "n_words"])


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, runs, collapsed, n_words`` per row: all runs by start, then period (starts are word numbers), and the text's
    words joined by one space, without the words that a run contains after its first period."""
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_scan, f"key {kind}, {RUNS}").withColumnRenamed("key", key)
