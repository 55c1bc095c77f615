"""Shared helpers: written intermediate tables, digests and vectorised word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.session import ensure_checkpoint_dir

#: ASCII white space of the word pattern ``[^\x20\x09-\x0D]+``.
WHITE_SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path in the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    # rows may hold long texts or sets: small Arrow batches keep JVM buffers and Python workers small
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(int(before), 1000)))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


#: A key is heavy if more than 1 / HEAVY_PARTS of the rows have it, so there are fewer heavy keys than this.
HEAVY_PARTS = 1000


def join_spread(rows: DataFrame, named: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` left joined to ``named``, a written table with one row per value of ``key`` and, as ``weight``, how many of
    ``rows`` have that value.

    The few rows of ``named`` for heavy keys are broadcast, and rows with a null key join nothing, so that no task of the
    shuffled join meets a key with more than one in ``HEAVY_PARTS`` of the rows.  ``weight`` is not returned.
    """
    total = named.agg(F.sum(weight)).first()[0] or 0
    found = named.select(*[c for c in named.columns if c != weight])
    heavy = named.where(F.col(weight) * HEAVY_PARTS > total).select(*found.columns)
    hot = rows.join(F.broadcast(heavy), key)
    rare = rows.where(F.col(key).isNotNull()).join(F.broadcast(heavy.select(key)), key, "left_anti").join(found, key, "left")
    none = rows.where(F.col(key).isNull()).select("*", *[
        F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema.fields if f.name != key])
    return hot.unionByName(rare).unionByName(none)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def remainder(col: str, mod: int) -> Column:
    """``crc32`` of the column's text, modulo ``mod``; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


# --- word hashing ---------------------------------------------------------------------------------------------------

_RNG = np.random.default_rng(20240229)
_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[key] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit keys (numpy wraps on overflow)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


class ByteTable:
    """What each byte means to a tokenisation: its hash code, and whether it separates words."""

    def __init__(self, separators=WHITE_SPACE, same: dict[str, str] | None = None):
        """``same`` maps ASCII characters to those that they count as; A-Z count as a-z."""
        self.code = _CODE.copy()
        for c in range(ord("A"), ord("Z") + 1):
            self.code[c] = self.code[c + 32]
        for a, b in (same or {}).items():
            self.code[ord(a)] = self.code[ord(b)]
        self.word = np.ones(256, bool)
        self.word[list(separators)] = False


WORDS = ByteTable()


class Words:
    """Words of consecutive rows: ``hash``, ``row`` (from 0 in this chunk), ``start`` and ``end`` (bytes in ``data``)."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, table: ByteTable):
        n = len(data)
        inside = table.word[data] if n else np.zeros(0, bool)
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            cut = edges[1:-1][(edges[1:-1] > 0) & (edges[1:-1] < n)]
            first[cut] = inside[cut]
            last[cut - 1] = inside[cut - 1]
        self.data, self.edges = data, edges
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _powers(n + 1)
        self._total = total = np.zeros(n + 1, np.uint64)
        if n:
            np.cumsum(table.code[data] * up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])
        self.row = np.searchsorted(edges, self.start, side="right") - 1
        self.rows = len(edges) - 1
        # the first word of each row, and the end of the last row's words
        self.first = np.searchsorted(self.row, np.arange(self.rows + 1))

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first ``size`` bytes of the words that have as many, and the indexes of these words."""
        at = np.flatnonzero(self.end - self.start >= size)
        start = self.start[at]
        return mix((self._total[start + size] - self._total[start]) * _POWERS["down"][start]), at

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``n`` consecutive words of a row, and their rows."""
        if n == 1:
            return self.hash, self.row
        if len(self.hash) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        whole = self.row[n - 1:] == self.row[: len(self.row) - n + 1]
        return ngram_hashes(self.hash, n)[whole], self.row[: len(whole)][whole]


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + h[k: len(h) - n + 1 + k])
    return out


def text_chunks(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split a string column into runs of rows of about ``max_bytes`` (a longer row stands alone, whole).

    Yields ``(lo, hi, data, edges)``: the rows' UTF-8 bytes and the row boundaries in them.  Nulls are empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return
    off = np.frombuffer(offsets, width)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1)
        yield lo, hi, raw[off[lo]: off[hi]], off[lo: hi + 1] - off[lo]
        lo = hi


def words_of(column: pa.Array, table: ByteTable = WORDS, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, Words]]:
    for lo, hi, data, edges in text_chunks(column, max_bytes):
        yield lo, hi, Words(data, edges, table)


def hash_of(words: list[str], table: ByteTable = WORDS) -> np.ndarray:
    """Hashes that :class:`Words` gives these words."""
    return np.array([Words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), table).hash[0]
                     for w in words], np.uint64)
