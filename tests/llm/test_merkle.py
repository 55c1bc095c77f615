import hashlib
import random

from pyspark.sql import functions as F

from assay.llm import merkle
from tests.llm.conftest import NASTY, frame

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_tree(nodes):
    """All levels of a tree, and per leaf its siblings, level by level, as lists of (before, after)."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        n = levels[-1]
        levels.append([H(*n[i: i + 16]) for i in range(0, len(n), 16)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for n in levels[:-1]:
            run = n[i // 16 * 16: i // 16 * 16 + 16]
            path.append((run[: i % 16], run[i % 16 + 1:]))
            i //= 16
        paths.append(path)
    return levels[-1][0], paths


def fold(leaf, path):
    for before, after in path:
        leaf = H(*before, leaf, *after)
    return leaf


def brute(rows, claims):
    """``rows``: (group, key, leaf); returns sorted (key, leaf, subroot, root, proof, folded)."""
    groups = {}
    for j, (g, k, leaf) in enumerate(rows):
        groups.setdefault(g, []).append((k is not None, k or 0, leaf, j))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([x[2] for x in sorted(groups[g])]) for g in names}
    root, tops = brute_tree([trees[g][0] for g in names])
    out = []
    for at, g in enumerate(names):
        subroot, paths = trees[g]
        for (_, _, leaf, j), path in zip(sorted(groups[g]), paths):
            whole = path + tops[at]
            proof = "".join("".join(b) + "".join(a) for b, a in whole)
            out.append((rows[j][1], leaf, subroot, root, proof, fold(claims[j] or leaf, whole)))
    return sorted(out, key=repr)


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, tree string, number int")


def _rows(df):
    out = df.collect()
    assert all(r.verified == (r.folded_root == r.root) and r.proof_sha256 == H(r.proof) for r in out)
    return sorted(((r.key, r.leaf, r.subroot, r.root, r.proof, r.folded_root) for r in out), key=repr)


def test_equals_brute_force_over_many_sizes(spark):
    rng = random.Random(1)
    sizes = {None: 1, "": 2, "a": 15, "b": 16, "c": 17, "B": 255, "é": 257, "zz": 4100, **{f"s{i}": 1 + i % 3 for i in range(20)}}
    rows = [(g, n) for g, n in sizes.items() for _ in range(n)]
    rng.shuffle(rows)
    rows = [(j * 7 - 900, g, None if j % 5 == 0 else "en", None if j % 3 == 0 else j, f"Text {j} é" if j % 11 else None, "x", 0)
            for j, (g, _) in enumerate(rows)]
    changed = F.when(F.col("doc_id") % 4 == 0, merkle.digest([F.col(c) for c in COLUMNS[:-1]] + [F.lower("text")]))
    manifest = merkle.build(_docs(spark, rows), "doc_id", "source", COLUMNS, changed)
    leaves = [(g, k, H(*map(_enc, (k, g, lang, n, t)))) for k, g, lang, n, t, *_ in rows]
    claims = [H(*map(_enc, (k, g, lang, n, t and t.lower()))) if k % 4 == 0 else None for k, g, lang, n, t, *_ in rows]
    want = brute(leaves, claims)
    assert _rows(merkle.prove(manifest, proofs=True)) == want
    # a few leaves only: their partitions fetch what else they need, leaves included
    some = manifest.leaves.where("key % 13 = 0")
    assert _rows(merkle.prove(manifest, some, proofs=True)) == [r for r in want if r[0] % 13 == 0]
    bad = {k for k, _, _, root, _, folded in want if folded != root}
    assert bad and {r.key for r in merkle.prove(manifest).where("not verified").collect()} == bad


def test_missing_is_minimal():
    rng = random.Random(2)
    for size in (1, 2, 16, 17, 100, 300, 5000):
        for share in (1, 0.5, 0.05):
            known = [i for i in range(size) if rng.random() < share] or [0]
            asked = merkle.missing(known, size)
            counts = merkle.counts_above(size)
            below, have = set(known), set()
            for level, n in enumerate(counts[:-1]):
                here = {i for lv, i in asked if lv == level}
                parents = {i // 16 for i in below}
                # every child of a parent on a path is known or fetched, none twice, and nothing else is fetched
                assert here | below == {c for p in parents for c in range(16 * p, min(16 * p + 16, n))} and not here & below
                below = parents
                have |= here
            assert len(asked) == len(set(asked))
    assert merkle.missing(range(4096), 4096) == [] and len(merkle.missing([0], 4096)) == 45


def test_edges(spark, nasty, empty):
    manifest = merkle.build(nasty, "doc_id", "lang", ("doc_id", "text"))
    leaves = [(lang, k, H(_enc(k), _enc(t))) for k, t, lang in NASTY]
    assert _rows(merkle.prove(manifest, proofs=True)) == brute(leaves, [None] * len(leaves))
    nothing = merkle.build(empty, "doc_id", "source", COLUMNS)
    assert nothing.root is None and merkle.prove(nothing).count() == 0


def test_lone_row_is_its_own_root(spark):
    manifest = merkle.build(frame(spark, [(2**62 + 1, "x", "en")]), "doc_id", "source", ("doc_id", "text"))
    r = merkle.prove(manifest).first()
    assert r.key == 2**62 + 1 and r.root == r.subroot == r.leaf == r.folded_root and r.proof_sha256 == H("") and r.verified


def test_large_keys_beside_nulls_keep_their_value(spark):
    keys = [2**53 + i for i in range(20)] + [None]
    manifest = merkle.build(frame(spark, [(k, "t", "en") for k in keys]), "doc_id", "lang", ("doc_id", "text"))
    assert {r.key for r in merkle.prove(manifest).collect()} == set(keys)
