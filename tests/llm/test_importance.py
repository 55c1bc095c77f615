import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from assay.llm import importance
from assay.llm.common import hash_of, mix
from tests.conftest import SF_CHECK, SF_SMALL
from tests.llm.conftest import frame


def _grams(text, buckets):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = hash_of(words) if words else np.zeros(0, np.uint64)
    pairs = mix(h[:-1] * np.uint64(0x2545F4914F6CDD1D) + h[1:]) if len(h) > 1 else h[:0]
    return (np.concatenate([h, pairs]) % np.uint64(buckets)).astype(int)


def test_log_ratio_and_weights_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    good = spark.read.parquet(f"{SF_SMALL}/labels.parquet").where("quality = 1").select("doc_id")
    ratio = importance.fit_log_ratio(docs, good, 500)
    ids = {r[0] for r in good.collect()}
    raw, target = np.zeros(500), np.zeros(500)
    grams = {r.doc_id: _grams(r.text, 500) for r in docs.collect()}
    for k, g in grams.items():
        np.add.at(raw, g, 1)
        if k in ids:
            np.add.at(target, g, 1)
    want = np.log((target + 1) / (target.sum() + 500)) - np.log((raw + 1) / (raw.sum() + 500))
    assert np.allclose(ratio, want)
    out = importance.importance_resample(docs, good, buckets=500).collect()
    for r in out:
        g = grams[r.doc_id]
        assert r.n_grams == len(g)
        assert r.log_weight == pytest.approx(want[g].sum() * importance.PASSAGE / (len(g) + importance.SHRINK), abs=1e-9)


def test_top_k_is_exact_with_ties(spark, monkeypatch):
    monkeypatch.setattr(importance, "CUT_BUCKETS", 8)
    rng = np.random.default_rng(1)
    for values in (rng.normal(size=500), np.round(rng.normal(size=500), 1), np.zeros(300),
                   np.r_[np.full(200, 5.0), 1e9, -1e9, rng.random(100) * 1e-9]):
        rows = [(float(v), i) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "o double, t long")
        for k in (0, 1, 7, 150, len(rows)):
            got = {r.t for r in df.where(importance.top_k(df, "o", "t", k)).collect()}
            assert got == {t for _, t in sorted(rows, key=lambda r: (-r[0], r[1]))[:k]}


def test_draw_keeps_the_asked_share_and_prefers_good_text(spark):
    out = entry.queries()["op1_importance"](spark, SF_CHECK).toPandas()
    assert out["kept"].sum() == math.ceil(0.88 * len(out))
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet").toPandas()
    share = out.merge(labels).groupby("quality")["kept"].mean()
    assert share[1] > 0.97 and share[0] < 0.5


def test_edges(spark, nasty, empty):
    good = spark.createDataFrame([(1,), (None,), (99,)], "doc_id long")
    out = importance.importance_resample(nasty, good, keep=0.5).collect()
    assert len(out) == nasty.count() and 8 <= sum(r.kept for r in out) <= 9
    assert all(r.log_weight == 0 for r in out if r.n_grams == 0)
    assert importance.importance_resample(empty, good).count() == 0
    none = importance.importance_resample(nasty, good.limit(0))
    assert none.agg(F.max(F.abs("log_weight"))).first()[0] == 0
    again = importance.importance_resample(frame(spark, [(1, "same", "en")] * 5), good, keep=0.2).collect()
    assert len({r.kept for r in again}) == 1
