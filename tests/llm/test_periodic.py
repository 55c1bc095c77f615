import hashlib
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from assay.llm import periodic
from assay.llm.queries import planted_runs
from tests.conftest import SF_SMALL
from tests.llm.conftest import NASTY, frame


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(w):
    """All lags, all stretches; a stretch that also has a smaller period is found at that one."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def _find(w):
    ids = np.array([hash(x) % 2**63 for x in w], np.uint64)
    return [tuple(map(int, r)) for r in zip(*periodic.find_runs(ids, np.zeros(len(w), np.int64)))]


def test_runs_equal_brute_force_on_random_words():
    rng = np.random.default_rng(3)
    seen = 0
    for _ in range(400):
        parts = []
        for _ in range(rng.integers(1, 6)):
            root = list(rng.integers(0, rng.integers(1, 5), rng.integers(1, 24)))
            parts += (root * int(rng.integers(1, 9)))[: int(rng.integers(1, 120))]
        runs = brute_runs(parts)
        seen += len(runs)
        assert _find(parts) == runs
    assert seen > 500


def test_periods_at_octave_edges_and_documents_apart():
    for q in [1, 2, 3, 4, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 127, 128]:
        for n in (4 * q - 1, 4 * q, 4 * q + 1, 9 * q):
            w = ["x"] + [f"r{i % q}" for i in range(n)] + ["y"]
            assert _find(w) == brute_runs(w) == ([(1, n, q)] if n >= max(6, 4 * q) else [])
    same = np.zeros(8, np.uint64)
    start, length, period = periodic.find_runs(same, np.array([0, 0, 0, 0, 1, 1, 1, 1]))
    assert len(start) == 0  # four and four words of two documents make no run of eight
    a, n, q = periodic.find_runs(np.zeros(12, np.uint64), np.repeat([0, 1], 6))
    assert list(zip(a, n, q)) == [(0, 6, 1), (6, 6, 1)]


def test_splitting_keeps_every_run_and_breaks_prose():
    prose = [f"w{i}" for i in range(300)]
    ids = np.array([hash(x) % 2**63 for x in prose + ["a", "b"] * 5 + prose], np.uint64)
    at, seg = periodic.split_by_frequency(ids, np.zeros(len(ids), np.int64))
    assert list(at) == list(range(300, 310)) and len(set(seg)) == 1


def test_long_text_is_scanned_whole():
    n = 200_000
    w = np.arange(n).astype(np.uint64) % np.uint64(n // 5)  # period 40,000
    start, length, period = periodic.find_runs(w, np.zeros(n, np.int64))
    assert list(zip(start, length, period)) == [(0, n, n // 5)]


def _check(rows, texts):
    assert len(rows) == len(texts)
    for r, t in zip(rows, texts):
        w = _words(t)
        runs = brute_runs(w)
        assert [(x.start, x.length, x.period) for x in r.runs] == runs
        assert r.collapsed == brute_collapsed(w, runs) and r.n_words == len(w)


def test_edges(spark, nasty, empty):
    long = [t for _, t, _ in NASTY if t and len(t) > 50_000 and " " in t]
    rows = periodic.periodic_runs(nasty.where("length(text) < 50000 or text is null or not text like '% %'")).collect()
    _check(rows, [t for _, t, _ in NASTY if t not in long])
    assert periodic.periodic_runs(empty).count() == 0
    cased = periodic.periodic_runs(frame(spark, [(1, "A a " * 6, "en"), (2, "a " * 6, "en"), (None, "b " * 5, "en")])).collect()
    assert [[tuple(x) for x in r.runs] for r in cased] == [[(0, 12, 2)], [(0, 6, 1)], []]


def test_long_nasty_text(spark, nasty):
    row = periodic.periodic_runs(nasty.where("doc_id = 6")).first()
    n = 60_000
    assert row.n_words == n and [tuple(x) for x in row.runs] == []  # its period of 30,287 words does not fit four times


def _expected(doc_id, text):
    w = _words(text)
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    best = min(((-n, s, q) for s, n, q in runs), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *((None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])),
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(brute_collapsed(w, runs)))


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    docs = {k: _expected(k, t) for k, t in docs if len(_words(t)) < 3000}
    out = entry.queries()["op13_periodic_runs"](spark, SF_SMALL).collect()
    checked = [tuple(r) for r in out if r.doc_id in docs]
    assert len(checked) == len(docs) and all(r == docs[r[0]] for r in checked)
    assert sum(r[1] > 0 for r in checked) >= 10


def test_planting_leaves_null_keys_and_empty_texts(spark, nasty):
    before = {(r.doc_id, r.text) for r in nasty.collect()}
    out = planted_runs(nasty).collect()
    assert len(out) == len(NASTY)
    for r in out:
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        if h % 10 or not _words(r.text):
            assert (r.doc_id, r.text) in before


@pytest.mark.parametrize("size", [5, 6])
def test_shortest_run(size):
    assert _find(["z"] * size) == ([(0, 6, 1)] if size == 6 else [])
