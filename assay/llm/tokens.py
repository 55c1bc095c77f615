"""Token counts through a digest cache (operator 5).

Texts are normalised as the tokenizer itself normalises them (nothing, for byte-level BPE; null is the empty text) and
named by a SHA-256 digest.  Digests join the stored counts of the same tokenizer version; only distinct misses are
encoded, and their counts are appended to the cache, a Parquet table any later run can use.  Counts of texts that very
many rows share reach these rows by a broadcast, so a hot text is no hot join key.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); copies share one cache row; an empty table appends nothing
and returns no rows; columns other than ``key`` and ``text`` are never looked at.  A cache that holds a digest more than
once (two runs appended it at the same time) gives the same counts, since equal digests have equal counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import bpe
from assay.llm.common import join_spread, scratch, settle, text_or_empty

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def read_cache(spark: SparkSession, cache_dir: str, tokenizer: str) -> DataFrame:
    """Stored counts of one tokenizer version, one row per digest; an absent cache is empty."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_dir)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    return stored.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(path)
        for b in batches:
            counts = [len(enc.ids(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])
    return run


def count_tokens(docs: DataFrame, cache_dir: str, tokenizer: str = "byte_bpe_50k.json", key: str = "doc_id",
                 text: str = "text", limit: int = 512) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` for every row of ``docs``; appends the misses to ``cache_dir``."""
    spark = docs.sparkSession
    path = bpe.resolve(tokenizer)
    version = bpe.version(path)
    keyed = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).withColumn(
        "digest", F.unhex(F.sha2("text", 256)))
    known = read_cache(spark, cache_dir, version)
    # dropDuplicates combines copies before the shuffle, so that a hot text reaches its task once per map task
    misses = keyed.select("digest", "text").dropDuplicates(["digest"]).join(known, "digest", "left_anti")
    fresh = misses.select("digest", "text").mapInArrow(_encode(path), "digest binary, n_tokens long")
    fresh.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_dir)
    rows = settle(keyed.select("key", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    copies = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    counts = settle(copies.join(read_cache(spark, cache_dir, version), "digest"), "token-counts")
    return join_spread(rows, counts, "digest", "copies").select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def token_counts(docs: DataFrame, **kw) -> DataFrame:
    """:func:`count_tokens` over a cache of its own, so that every distinct text is encoded once in this call."""
    return count_tokens(docs, scratch(docs.sparkSession, "token-cache"), **kw)
