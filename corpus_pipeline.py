"""Corpus preparation: filter, deduplicate, decontaminate and pack the documents of a folder of tables.

``STAGES`` lists the stages in order.  A stage is a function ``(spark, docs, sf_dir) -> DataFrame`` that calls one operator on
all rows that the stage before it kept; all stages but the last return rows and columns of ``docs`` as they are.

Rows are judged by ``doc_id``: rows that share one are kept or dropped together, and rows whose ``doc_id`` is null pass the
filters unless their own text is refused for its language.  A null text is an empty text: it is not toxic by its words, has no
language (dropped), no shingles and no benchmark passage.  Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import langid
from assay.llm.common import settle, table
from assay.llm.decontam import find_leaks
from assay.llm.neardup import near_duplicates
from assay.llm.packing import pack_documents
from assay.llm.toxicity import score_toxicity


def _without(docs: DataFrame, refused: DataFrame, name: str) -> DataFrame:
    """``docs`` less the keys in ``refused``; Spark broadcasts the keys only while they are few."""
    return docs.join(settle(refused.select("doc_id").distinct(), name), "doc_id", "left_anti").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = score_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return _without(docs, scored.where("predicted = 1"), "toxic")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    predicted = langid.predict(docs, langid.fit(docs, "doc_id"))
    kept = docs.where(langid.has_letter(F.col("text")))
    return _without(kept, predicted.where("rejected"), "no-language")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = near_duplicates(docs)
    return _without(docs, judged.where("not kept"), "copies").dropDuplicates(["doc_id", "text"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, find_leaks(docs, table(spark, sf_dir, "benchmark")), "leaks")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("language_id", language_id), ("near_duplicate", near_duplicate),
          ("decontamination", decontamination), ("packing", packing)]

#: No SQL: trained models and packing decide the rows; tests hold each stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
