import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from assay.llm import langid
from tests.conftest import SF_CHECK


def test_gram_counts_equal_brute_force():
    texts = ["Abc  d", "é!x", "", "ab"]
    out = np.vstack([c for _, _, c in langid.gram_counts(pa.array(texts))])
    for t, row in zip(texts, out):
        b = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in t.lower().encode())
        n = 0
        for k in (2, 3):
            n += sum(b[i: i + 2] != b"  " for i in range(len(b) - k + 1))
        assert row.sum() == n


def test_kmeans_centroids_are_unit_means_of_their_rows():
    rng = np.random.default_rng(0)
    x = langid.unit(np.abs(rng.normal(size=(60, 8))) + 4 * np.eye(8)[rng.integers(0, 3, 60)])
    centers, own = langid.spherical_kmeans(x, 3)
    assert np.allclose(np.linalg.norm(centers, axis=1), 1)
    assert (own == (x @ centers.T).argmax(1)).all() and len(set(own)) == 3


def test_held_out_accuracy(spark):
    out = entry.queries()["op6_langid"](spark, SF_CHECK).join(
        spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    n, right, rejected = out.agg(F.count(F.lit(1)), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")),
                                 F.sum(F.col("rejected").cast("int"))).first()
    assert right >= 0.99 * n and rejected <= 0.005 * n


def test_held_out_rows_are_not_learned(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    spoilt = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang")))
    out = langid.predict(spoilt, langid.fit(spoilt.where(~held), "doc_id"))
    assert out.where("lang_pred = 'xx'").count() == 0


def test_foreign_script_is_rejected_and_known_text_is_not(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    model = langid.fit(docs, "doc_id")
    rows = spark.createDataFrame([(1, "这是一个完全不同的语言的文本 没有拉丁字母"), (2, "Это текст на другом языке"), (3, "The and that.")],
                                 "doc_id long, text string")
    got = {r.doc_id: r.rejected for r in langid.predict(rows, model).collect()}
    assert got == {1: True, 2: True, 3: False}


def test_edges(spark, nasty, empty):
    model = langid.fit(nasty, "doc_id")
    out = langid.predict(nasty, model).collect()
    assert len(out) == nasty.count()
    und = {r.doc_id for r in out if r.lang_pred == langid.UNKNOWN}
    assert und == {3, 4, 5, 7, None} and all(0 <= r.score <= 1 for r in out)
    assert sum(r.lang_pred == langid.UNKNOWN for r in out) == 5
    assert all(r.rejected and r.score == 0 for r in out if r.lang_pred == langid.UNKNOWN)
    assert langid.fit(empty, "doc_id") is None and langid.predict(empty, model).count() == 0
    assert {r.lang_pred for r in langid.predict(nasty, None).collect()} == {langid.UNKNOWN}
