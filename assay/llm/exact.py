"""Exact duplicates through a persistent digest index (operator 12).

The index is a Spark table ``(digest, keep_id, n, batch)``, bucketed and sorted by ``digest``: one row per distinct text that
was ever seen.  A batch of new rows is reduced to one row per digest before anything is shuffled by it (map-side combined),
so a text that a third of the rows share is one row.  A sort-merge anti-join against the index, which reads the index
bucket by bucket without shuffling it, leaves the digests that are new; these are appended.

Every row of the batch then learns its verdict.  Digests that many rows share ("heavy") are at most ``HEAVY_PARTS`` by count, as
each stands for more than one in ``HEAVY_PARTS`` of the rows; they are broadcast.  All others join by digest, where no key
holds more rows than that share.

Appending is repeatable: a batch has a name, index rows of the batch's own name never count as known, and digests
that stand in the index are not appended again.  So a batch that failed half-way is simply run again under its name.

Edge cases: a null text is the empty text.  A null key counts as smaller than any other.  Rows that repeat both key and text
cannot be told apart and share one verdict.  Texts of any length are digested whole.  An empty batch returns no row and
leaves the index as it is.  Columns other than key and text are ignored, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.common import settle, text_or_empty

INDEX_COLUMNS = "digest binary, keep_id bigint, n bigint, batch string"
#: A digest is heavy if more than 1 / HEAVY_PARTS of a batch's rows have it, so there are fewer heavy ones than this.
HEAVY_PARTS = 1000


def digest_of(text: Column) -> Column:
    """The 32 bytes of SHA-256 over the text's UTF-8 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def open_index(spark: SparkSession, table: str, buckets: int, path: str | None = None) -> str:
    """Declare the index ``table``, empty unless it exists.  With ``path`` (a shared folder) its files outlive the session:
    a later session opens them under the same path and bucket count."""
    where = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({INDEX_COLUMNS}) USING parquet "
              f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS{where}")
    return table


def _append(fresh: DataFrame, table: str, buckets: int) -> None:
    """One task per bucket and one file per bucket and batch, sorted by digest."""
    fresh.repartition(buckets, "digest").sortWithinPartitions("digest").select(
        "digest", "keep_id", "n", "batch").write.insertInto(table)
    fresh.sparkSession.catalog.refreshTable(table)


def buckets_of(spark: SparkSession, table: str) -> int:
    found = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").first()
    return int(found["data_type"])


def deduplicate(docs: DataFrame, index: str, batch: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Judge the rows of ``docs`` against the index and each other, and append the new digests to the index.

    Returns ``key, digest, keep_id, group_size, known, kept`` per row: of equal texts in a batch the row with the largest
    ``key`` stays, unless the text is ``known`` from an earlier batch (then none does, and ``keep_id`` is the earlier
    row).  ``group_size`` counts the batch's rows of that text.
    """
    spark = docs.sparkSession
    buckets = buckets_of(spark, index)
    rows = settle(docs.select(F.col(key).cast("bigint").alias("key"), digest_of(text_or_empty(text)).alias("digest")), "digests")
    groups = settle(rows.groupBy("digest").agg(F.max("key").alias("keep_id"), F.count(F.lit(1)).alias("n"))
                    .withColumn("batch", F.lit(batch)), "digest-groups")
    seen = spark.table(index)
    fresh = groups.hint("merge").join(seen.select("digest"), "digest", "left_anti")
    _append(fresh, index, buckets)
    known = spark.table(index).where(F.col("batch") != batch).select("digest", F.col("keep_id").alias("__earlier"),
                                                                     F.lit(True).alias("__known"))
    judged = settle(groups.hint("merge").join(known, "digest", "left").select(
        "digest", F.when(F.col("__known"), F.col("__earlier")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.col("n").alias("group_size"), F.coalesce("__known", F.lit(False)).alias("known")), "digest-verdicts")
    least = groups.agg((F.coalesce(F.sum("n"), F.lit(0)) / HEAVY_PARTS).alias("least")).first()["least"]
    heavy = judged.where(F.col("group_size") > least)
    hot = rows.join(F.broadcast(heavy), "digest")
    rare = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").join(
        judged.where(F.col("group_size") <= least).hint("merge"), "digest")
    return hot.unionByName(rare).select(
        F.col("key").alias(key), "digest", "keep_id", "group_size", "known",
        (~F.col("known") & F.col("key").eqNullSafe(F.col("keep_id"))).alias("kept"))
