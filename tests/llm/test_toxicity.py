import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from assay.llm import toxicity
from assay.llm.common import hash_of, remainder, text_chunks
from tests.llm.conftest import PROSE, frame

SF = "/root/testdata/sf0.1"


def _figures(texts, stems=()):
    lexicon, you = hash_of(toxicity.LEXICON, toxicity.PLAIN), hash_of(toxicity.SECOND_PERSON, toxicity.PLAIN)
    rows = [toxicity.figures(d, e, lexicon, hash_of(list(stems), toxicity.PLAIN) if stems else np.zeros(0, np.uint64), you)
            for _, _, d, e in text_chunks(pa.array(texts))]
    return [dict(zip(toxicity.FIGURES, r)) for r in np.vstack(rows)]


def test_figures():
    a, b, c, d, e = _figures(["You are an IDIOT, idiot! moron", "1d10t m0ron here", "", None, "s*it happens"])
    assert (a["hits"], a["hit_kinds"], a["hits_in_50"]) == (3, 2, 3)
    assert a["hit_density"] == 3 / 6 and a["you_density"] == 1 / 6 and a["near_you"] == 3 / 6
    assert a["capitals"] == 6 / 23 and a["capital_words"] == 1 / 6 and a["exclamations"] == 1 / 6
    assert b["disguised_density"] > 0 and b["hits"] == 0
    assert not any(c.values()) and not any(d.values())
    assert e["masked"] > 0
    near, far = _figures(["you x x x x idiot", "you x x x x x idiot"])
    assert near["near_you"] > 0 and far["near_you"] == 0
    long, = _figures([" ".join(["idiot"] + ["x"] * 60 + ["idiot", "idiot"])])
    assert long["hits"] == 3 and long["hits_in_50"] == 2
    stem, = _figures(["blorghe blorgs fine"], ["blor"])
    assert stem["hits"] == 2


def test_stems_of_toxic_texts_are_learned(spark):
    rows = [(i, ("zorkling gleb " if i % 4 == 0 else "") + PROSE, "en") for i in range(80)]
    docs = frame(spark, rows)
    sample = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, 1.0).otherwise(0.0).alias("label"))
    got = set(toxicity.learn_stems(docs, sample).tolist())
    assert got == set(hash_of(["zork", "zorkl", "zorkli", "zorklin", "gleb"], toxicity.PLAIN).tolist())


def test_held_out_accuracy(spark):
    out = entry.queries()["op4_toxicity"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    n = {(r.toxic, r.predicted): r["count"] for r in
         out.where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.85 and n[1, 1] / (n[1, 1] + n.get((0, 1), 0)) > 0.95
    assert out.where("score < 0 or score > 1 or score is null or predicted <> (score >= 0.7)::int").count() == 0
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_held_out_labels_do_not_matter(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(remainder("doc_id", 3) != 1)
    got = toxicity.score_toxicity(docs, labels).select("doc_id", F.round("score", 9).alias("s"))
    want = entry.queries()["op4_toxicity"](spark, sf).select("doc_id", F.round("score", 9).alias("s"))
    assert got.exceptAll(want).count() == 0


def test_edges(spark, nasty, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (6, 0), (None, 1), (8, None), (99, 1)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(nasty, labels)
    assert out.count() == nasty.count() and out.where("score is null").count() == 0
    assert toxicity.score_toxicity(empty, labels).count() == 0
    none = toxicity.score_toxicity(nasty, labels.limit(0))
    assert none.agg(F.max("score")).first()[0] == 0
    only = toxicity.score_toxicity(nasty, labels.where("toxic = 1"))
    assert only.agg(F.min("score")).first()[0] == pytest.approx(1)
