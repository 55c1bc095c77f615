from pyspark.sql import functions as F

import corpus_pipeline
from assay.llm import langid, toxicity
from assay.llm.decontam import find_leaks
from tests.conftest import SF_CHECK
from tests.llm import brute


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "language_id", "near_duplicate", "decontamination", "packing"]

    def keys(df):
        assert df.columns == docs.columns
        out = [r.doc_id for r in df.select("doc_id").collect()]
        assert len(out) == len(set(out))
        return set(out)

    every = keys(docs)
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet").select("doc_id", "toxic")
    scored = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    clean = corpus_pipeline.settle(stage["toxicity"](spark, docs, SF_CHECK), "t")
    assert keys(clean) == {k for k in every if scored[k] < 0.7} and len(every) - clean.count() > 20
    known = corpus_pipeline.settle(stage["language_id"](spark, clean, SF_CHECK), "t")
    judged = langid.predict(clean, langid.fit(clean, "doc_id"))
    assert keys(known) == {r.doc_id for r in judged.where("not rejected").collect()}
    assert known.count() >= 0.99 * clean.count()
    single = corpus_pipeline.settle(stage["near_duplicate"](spark, known, SF_CHECK), "t")
    want = brute.near_duplicates([(r.doc_id, r.text) for r in known.collect()], 5, 80)
    assert keys(single) == {k for k, (_, c) in want.items() if k == c}
    fresh = corpus_pipeline.settle(stage["decontamination"](spark, single, SF_CHECK), "t")
    leaked = {r.doc_id for r in find_leaks(single, spark.read.parquet(f"{SF_CHECK}/benchmark.parquet")).collect()}
    assert leaked and keys(fresh) == keys(single) - leaked
    packed = stage["packing"](spark, fresh, SF_CHECK)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == keys(fresh)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_edges(spark, nasty, empty):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, nasty, SF_CHECK)
        if name != "packing":
            assert out.columns == nasty.columns
            assert out.count() <= nasty.count()
        assert stage(spark, empty, SF_CHECK).count() == 0
    assert corpus_pipeline.near_duplicate(spark, nasty, SF_CHECK).where("doc_id in (1, 2)").count() == 1
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, nasty, SF_CHECK).collect()}.isdisjoint({3, 4, 5, 7})
