import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from assay.llm import rules
from tests.conftest import SF_SMALL
from tests.llm.conftest import NASTY, frame


def _brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i in range(len(words) - 2) if grams[tuple(words[i: i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(covered))


def test_figures_equal_brute_force(spark):
    texts = [t for _, t, _ in NASTY] + [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    texts += ["a b c a b c", "a b c x a b c", "a a a", "a a a a", "a b a b a b a", "x\nx\n x\nx", "# $ %|<>&* z"]
    out = rules.text_figures(frame(spark, [(i, t, "en") for i, t in enumerate(texts)]), keep=("doc_id",)).collect()
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _brute(texts[r.doc_id])


def test_binomial_tail(spark):
    cases = [(n, k, p) for p in (0.01, 0.2) for n in (1, 5, 100, 3000) for k in (0, 1, 3, 29, 90) if k <= n]
    for p in (0.01, 0.2):
        mine = [(n, k) for n, k, q in cases if q == p]
        df = spark.createDataFrame(mine, "n long, k long").withColumn("t", rules.binomial_tail(F.col("n"), F.col("k"), p))
        for r in df.collect():
            exact = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(p)
                                 + (r.n - i) * math.log(1 - p)) for i in range(r.k + 1))
            assert r.t == (1.0 if r.k >= r.n * p else pytest.approx(exact, rel=1e-9))


def test_cut_tail_is_bounded_from_above(spark, monkeypatch):
    df = spark.createDataFrame([(100_000, 900)], "n long, k long")
    full = df.select(rules.binomial_tail(F.col("n"), F.col("k"), 0.01)).first()[0]
    monkeypatch.setattr(rules, "TAIL_TERMS", 40)
    cut = df.select(rules.binomial_tail(F.col("n"), F.col("k"), 0.01)).first()[0]
    assert full <= cut <= 1.05 * full


def test_cutoffs_guard_good_documents_per_stratum(spark):
    # stratum a: symbols only in bad texts; stratum b: many good texts hold them, so no cutoff may reject them
    word = " ".join(f"w{i}x" for i in range(60))
    rows = [(i, word + (" ## ## ## ## ## ##" if i % 10 == 0 else ""), "a" if i < 3000 else "b") for i in range(6000)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, not (i < 3000 and i % 10 == 0)) for i in range(6000)], "doc_id long, good boolean")
    out = rules.judge(docs, labels).join(docs.select("doc_id", "lang"), "doc_id")
    n = {(r.lang, r.kept): r["count"] for r in out.groupBy("lang", "kept").count().collect()}
    assert n == {("a", True): 2700, ("a", False): 300, ("b", True): 3000}
    few = rules.judge(docs, labels.where("doc_id < 50"))
    assert few.where("not kept").count() == 0


def test_edges(spark, nasty, empty):
    labels = spark.createDataFrame([(1, True), (1, False), (None, True), (6, None)], "doc_id long, good boolean")
    out = rules.judge(nasty, labels).collect()
    assert len(out) == nasty.count()
    assert {r.doc_id for r in out if r.kept} <= {6} and not any(r.kept is None or r.base_failed is None for r in out)
    assert rules.judge(empty, labels).count() == 0
    assert rules.judge(nasty, labels.limit(0)).count() == nasty.count()


def test_no_python_in_the_plan(spark):
    plan = entry.queries()["op10_quality_rules"](spark, SF_SMALL)._jdf.queryExecution().toString()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    plan += rules.text_figures(docs, keep=("doc_id", "lang"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian"))
