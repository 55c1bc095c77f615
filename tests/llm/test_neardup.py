import random

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from assay.llm import neardup
from assay.llm.common import words_of
from assay.llm.components import components
from tests.conftest import SF_CHECK, SF_SMALL
from tests.llm import brute
from tests.llm.conftest import frame


def _got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("n", [2, 5])
def test_tables_equal_brute_force(spark, n):
    sf = SF_CHECK if n == 2 else SF_SMALL
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute.near_duplicates([(r.doc_id, r.text) for r in docs.collect()], n, 80)
    out = entry.queries()["op8_neardup"](spark, sf) if n == 2 else neardup.near_duplicates(docs)
    out = out.cache()
    assert _got(out) == want
    assert out.where("kept <> (doc_id = component_id)").count() == 0


def test_trees_follow_depth(spark, monkeypatch):
    rng = np.random.default_rng(3)
    for depth in (3, 5, 8):
        # pairs at the threshold, each child of a node shared with the chance of their similarity
        left = np.ones((20_000, 1), int)
        for _ in range(depth):
            kids = rng.binomial(left, 0.8) + rng.binomial(rng.binomial(left, 0.25), 0.8)
            left = kids
        missed = (left[:, 0] == 0).mean() ** neardup.trees_for(depth, 0.8)
        assert missed < 1.2 * neardup.MISS
    counts = [neardup.trees_for(d, 0.8) for d in range(0, 61)]
    assert counts == sorted(counts) and counts[5] == neardup.TREES < counts[8] < counts[60] < 200
    # too few trees at first: the rest is grown, and what earlier trees found is kept
    monkeypatch.setattr(neardup, "TREES", 2)
    monkeypatch.setattr(neardup, "SMALL", 4)
    monkeypatch.setattr(neardup, "DENSE", 8)
    r = random.Random(11)
    rows = [_edited(r, [f"g{g}w{i}" for i in range(80)], 0.03) for g in range(6) for _ in range(25)]
    docs = list(enumerate(rows))
    want = brute.near_duplicates(docs, 2, 80)
    assert _got(neardup.near_duplicates(frame(spark, [(k, t, "en") for k, t in docs]), shingle=2)) == want


def _edited(rng, words, share):
    return " ".join(f"z{rng.randrange(10**9)}" if rng.random() < share else w for w in words)


def test_dense_groups_and_links_near_the_threshold(spark):
    """Groups far larger than a node that is compared exhaustively, at every closeness, and chains between them."""
    rng = random.Random(5)
    rows = []
    for group, share in enumerate((0.005, 0.02, 0.05, 0.1, 0.15)):
        base = [f"g{group}w{i}" for i in range(120)]
        rows += [_edited(rng, base, share) for _ in range(150)]
    chain = [f"c{i}" for i in range(100)]
    for i in range(60):
        rows.append(" ".join(chain))
        chain = chain[5:] + [f"c{100 + 5 * i + j}" for j in range(5)]
    rng.shuffle(rows)
    docs = list(enumerate(rows))
    want = brute.near_duplicates(docs, 2, 80)
    assert len({c for _, c in want.values()}) < len(docs) - 300
    assert _got(neardup.near_duplicates(frame(spark, [(k, t, "en") for k, t in docs]), shingle=2)) == want


def test_signatures_estimate_similarity():
    rng = random.Random(2)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base), _edited(rng, base, 0.1)]
    (_, _, w), = words_of(pa.array(texts))
    h, first = neardup.shingle_sets(w, 2)
    sig = neardup.signatures(h, first)
    a, b = (brute.shingles(t, 2) for t in texts)
    assert abs((sig[0] == sig[1]).mean() - len(a & b) / len(a | b)) < 0.15


def test_stars_connect_what_candidates_connect():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (12, neardup.K)).astype(np.uint8)
    for rows in (30, 300):  # both ways of comparing a cell
        sig = base[rng.integers(0, 12, rows)]
        noise = rng.random(sig.shape) < rng.choice([0.02, 0.1, 0.3], (rows, 1))
        sig = np.where(noise, rng.integers(0, 256, sig.shape), sig).astype(np.uint8)
        cell = np.repeat([5, 9], [rows - 3, 3])
        want, got = neardup._Forest(rows), neardup._Forest(rows)
        for i in range(rows):
            for j in range(i):
                if cell[i] == cell[j] and neardup.agreement(sig[i], sig[j]) >= 0.66:
                    want.join(i, j)
        pairs = neardup.spanning_stars(cell, sig, 0.66)
        assert all(got.join(a, b) for a, b in pairs)
        assert [got.find(i) for i in range(rows)] == [want.find(i) for i in range(rows)]


def test_giant_families_are_resolved_in_their_nodes(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(80)]
    docs = [(k, _edited(rng, base, rng.choice((0.01, 0.05, 0.1)))) for k in range(200)]
    docs += [(1000 + k, " ".join(f"r{k}x{i}" for i in range(30))) for k in range(50)]
    want = brute.near_duplicates(docs, 2, 80)
    frames = frame(spark, [(k, t, "en") for k, t in docs])
    monkeypatch.setattr(neardup, "FAMILY", 20)
    assert _got(neardup.near_duplicates(frames, shingle=2)) == want
    # and where rows nearly equal to a node's first member stay behind
    monkeypatch.setattr(neardup, "DENSE", 20)
    monkeypatch.setattr(neardup, "DENSE_LEVEL", 4)
    assert _got(neardup.near_duplicates(frames, shingle=2)) == want


@pytest.mark.parametrize("edited, links_left", [(0.02, False), (0.035, True)])
def test_groups_of_medium_near_copies_finish(spark, monkeypatch, edited, links_left):
    """Copies at similarities about 0.85, and about 0.75 with few links, in a group 30 times as large as a node or a family."""
    rng = random.Random(11)
    base = [f"m{i}" for i in range(100)]
    docs = [(k, _edited(rng, base, edited)) for k in range(1200)]
    docs += [(5000 + k, " ".join(f"r{k}x{i}" for i in range(30))) for k in range(50)]
    want = brute.near_duplicates(docs, 2, 80)
    parts = len({c for k, (_, c) in want.items() if k < 5000})
    assert parts > 5 if links_left else parts < 60
    monkeypatch.setattr(neardup, "FAMILY", 40)
    monkeypatch.setattr(neardup, "DENSE", 40)
    levels, grow = [], neardup._grow
    monkeypatch.setattr(neardup, "_grow", lambda threshold: levels.append(1) or grow(threshold))
    assert _got(neardup.near_duplicates(frame(spark, [(k, t, "en") for k, t in docs]), shingle=2)) == want
    assert len(levels) <= 12


def test_exact_links_connect_what_links_connect():
    rng = np.random.default_rng(6)
    base = np.sort(rng.integers(0, 2**63, (4, 80), dtype=np.uint64), axis=1)
    sets = []
    for g in rng.integers(0, 4, 120):
        keep = rng.random(80) > 0.08
        sets.append(np.sort(np.r_[base[g][keep], rng.integers(0, 2**63, int((~keep).sum()), dtype=np.uint64)]))
    want, got = neardup._Forest(len(sets)), neardup._Forest(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if neardup._linked(sets[i], sets[j], 80):
                want.join(i, j)
    assert all(got.join(a, b) for a, b in neardup.exact_links(sets, 80))
    assert [got.find(i) for i in range(len(sets))] == [want.find(i) for i in range(len(sets))]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    pairs += [(1000 + i, 1001 + i) for i in range(64)] + [(2000, 2000 + i) for i in range(1, 50)] + [(5, 5), (None, 3)]
    parent = {x: x for p in pairs for x in p if x is not None}

    def find(x):
        return x if parent[x] == x else find(parent[x])
    for a, b in pairs:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges(spark, nasty, empty):
    out = neardup.near_duplicates(nasty).collect()
    assert len(out) == nasty.count()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id is not None}
    want = brute.near_duplicates([(r.doc_id, r.text) for r in nasty.collect() if r.doc_id is not None], 5, 80)
    assert got == want
    assert got[3] == (0, 3) and got[5] == (0, 5) and got[10] == (1, 8)
    assert all(r.kept and r.component_id is None for r in out if r.doc_id is None)
    assert neardup.near_duplicates(empty).count() == 0
    assert neardup.near_duplicates(nasty.where("doc_id = 4")).count() == 1
