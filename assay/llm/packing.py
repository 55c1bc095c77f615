"""Sum-of-squares packing of documents into sequences of a fixed number of tokens (operator 2).

A document's ids are its tokens and one end id.  Only documents longer than a sequence are cut: all pieces but the first
are whole sequences.  Every piece is placed where the squared counts of open bins per residual gap become smallest (Csirik
et al., "On the sum-of-squares algorithm for bin packing"), longest pieces first.  The pieces are dealt over shards by
a hash, each shard is packed by one task that holds piece lengths only, and the bins that shards leave unfilled are
opened and packed again in fewer shards, until one task has them all or ``rounds`` rounds are over.

Edge cases: a null or empty text is the end id alone (one piece of length 1); rows that repeat a key are packed each on
its own; an empty table gives no rows; columns other than ``key`` and ``text`` are never looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm import bpe
from assay.llm.common import settle, text_or_empty

PIECES = "key long, piece int, start long, length long, ids_crc32 long"
#: Pieces that one packing task takes (it holds about 40 bytes for each).
PER_SHARD = 50_000
#: A bin filled beyond this share of its capacity is not opened again.
FULL = 0.999


def _cut(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(path)
        for b in batches:
            out: list[tuple] = []
            for key, text in zip(b.column(0), b.column(1)):
                ids = np.append(enc.ids(text.as_py()), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
                    part = ids[lo:hi]
                    out.append((key.as_py(), k, lo, hi - lo, zlib.crc32(part.tobytes()))
                               + ((part.astype(np.int64).tolist(),) if with_ids else ()))
            cols = list(zip(*out)) or [()] * (5 + with_ids)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            names = ["key", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
    return run


def cut_pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = 2048, end_id: int = 0,
               key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of every document (``key`` an integer), with their ids if asked for."""
    return docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text")).mapInArrow(
        _cut(bpe.resolve(tokenizer), capacity, end_id, with_ids), PIECES + (", ids array<long>" if with_ids else ""))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, items taken in the order given.

    ``n[g]`` counts the open bins filled to level ``g``.  An item goes to the open bin with room for it whose choice
    leaves the smallest sum of ``n[g] ** 2`` over ``0 < g < capacity`` (ties: the emptiest), and to a new bin only if
    it fits into none: with the longest first this closes nearly all bins, where the rule with free new bins leaves
    about one in a hundred open.
    """
    n = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    never = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        level = 0
        if s < capacity:
            # by how much the sum changes at each level: the bin leaves level g and reaches level g + s
            change = 2 * (n[s: capacity + 1] - n[: capacity + 1 - s]) + 2
            change[-1] = 1 - 2 * n[capacity - s]  # a bin that closes leaves the sum
            change[n[: capacity + 1 - s] == 0] = never
            if change.min() < never:
                level = int(change.argmin())
        if level:
            b = open_at[level].pop()
            n[level] -= 1
        else:
            b = len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, level
        fill[b] = level + s
        if level + s < capacity:
            n[level + s] += 1
            open_at[level + s].append(b)
    return bins, offsets


def _pack(capacity: int, round_no: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "key", "piece", "ids_crc32"], ascending=[False, True, True, True])
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), capacity)
        used = np.bincount(bins, weights=pdf["length"].to_numpy(), minlength=1)
        return pdf.assign(sequence_id=(np.int64(round_no) << 56) + (pdf["shard"].to_numpy() << 32) + bins,
                          offset=offsets, used=used[bins].astype(np.int64))
    return run


def pack_pieces(pieces: DataFrame, capacity: int = 2048, per_shard: int = PER_SHARD, rounds: int = 8) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (columns of :data:`PIECES`)."""
    schema = PIECES + ", salt long, shard long, sequence_id long, offset long, used long"
    done = None
    # the salt deals rows that repeat key and text, or share a null key, over the shards as well
    salted = settle(pieces.select("*", F.monotonically_increasing_id().alias("salt")), "salted-pieces")
    left, n = salted, salted.count()
    for r in range(rounds):
        shards = max(1, -(-n // per_shard))
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("key", "piece", "ids_crc32", "salt", F.lit(r)), F.lit(shards)))
        packed = settle(dealt.groupBy("shard").applyInPandas(_pack(capacity, r), schema), "packed")
        if shards == 1 or r == rounds - 1:
            return packed if done is None else done.unionByName(packed)
        kept = packed.where(F.col("used") >= FULL * capacity)
        done = kept if done is None else done.unionByName(kept)
        left = packed.where(F.col("used") < FULL * capacity).select(*salted.columns)
        n = left.count()
    raise AssertionError("rounds must be at least 1")


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = 2048, end_id: int = 0,
                   key: str = "doc_id", text: str = "text", per_shard: int = PER_SHARD) -> DataFrame:
    """``key, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of ``docs``."""
    return pack_pieces(cut_pieces(docs, tokenizer, capacity, end_id, key, text), capacity, per_shard).select(
        F.col("key").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def assemble(docs: DataFrame, packed: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = 2048,
             end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The training sequences themselves: ``sequence_id, ids`` (array of token ids), one row per sequence.

    ``key`` must be unique in ``docs``.
    """
    ids = cut_pieces(docs, tokenizer, capacity, end_id, key, text, True).select(F.col("key").alias(key), "piece", "ids")
    placed = packed.select(key, "piece", "sequence_id", "offset").join(ids, [key, "piece"])
    ordered = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return ordered.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
