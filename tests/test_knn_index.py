"""The cluster-pruned index returns exactly the neighbours of a full search, and prunes where vectors cluster."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.operators import knn_index as ki
from assay.operators import neighbors as nb


def _frame(spark, x, part=None):
    rows = [(i, v.tolist(), part[i] if part is not None else None) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, vec array<double>, part string")


def _sides(df):
    return (df.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), "part"),
            df.select(F.col("id").alias("rid"), F.col("vec").alias("rvec"), "part"))


def _brute(x, k, part=None, rows=None):
    out = {}
    for i in rows if rows is not None else range(len(x)):
        if part is not None and part[i] is None:
            continue
        d = ((x[i] - x) ** 2).sum(1)
        ok = [j for j in range(len(x)) if j != i and (part is None or part[j] == part[i])]
        out[i] = sorted(ok, key=lambda j: (d[j], j))[:k]
    return out


def _got(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append(r.rid)
    return out


@pytest.mark.parametrize("kind", ["clusters", "copies", "isotropic", "one_cell"])
def test_equals_full_search(spark, kind):
    rng = np.random.default_rng(5)
    n, dim = 700, 6
    x = {"clusters": lambda: rng.normal(size=(12, dim))[rng.integers(0, 12, n)] * 8 + rng.normal(size=(n, dim)) * 0.3,
         # a third of all vectors are equal, and all coordinates lie on a coarse grid: many ties
         "copies": lambda: np.where((np.arange(n) % 3 == 0)[:, None], 1.0, rng.integers(0, 3, (n, dim)).astype(float)),
         "isotropic": lambda: rng.normal(size=(n, dim)),
         "one_cell": lambda: np.full((n, dim), 2.5)}[kind]()
    q, r = _sides(_frame(spark, x))
    nn = nb.knn(q, r, 4, exclude_self=True, block_rows=40, index_blocks=0)
    assert _got(nn) == _brute(x, 4)
    plain = nb.knn(q, r, 4, exclude_self=True, block_rows=100, index_blocks=10**6)
    assert _got(plain) == _brute(x, 4)


def test_parts_small_groups_and_null_vectors(spark):
    rng = np.random.default_rng(6)
    n = 300
    x = rng.normal(size=(n, 3))
    part = [None if i < 3 else "tiny" if i < 6 else "pair" if i < 8 else "lone" if i == 8 else f"p{i % 3}" for i in range(n)]
    df = _frame(spark, x, part)
    q, r = _sides(df.unionByName(spark.createDataFrame([(1000, None, "p1")], df.schema)))
    nn = nb.knn(q, r, 4, part="part", exclude_self=True, block_rows=16, index_blocks=0)
    want = {i: v for i, v in _brute(x, 4, part).items() if v}
    assert _got(nn) == want


def test_visits_are_a_small_share_on_clustered_vectors(spark):
    rng = np.random.default_rng(0)
    n, dim, k = 20_000, 32, 7
    centres = rng.normal(size=(60, dim)) * 3
    x = centres[rng.integers(0, 60, n)] + rng.normal(size=(n, dim)) * 0.5
    q, r = _sides(_frame(spark, x).repartition(4))
    index = ki.build_index(r, n, ring_rows=128)
    nn, visits = ki.search(q, index, k, exclude_self=True)
    sizes = spark.createDataFrame(index.rings[["ring", "n"]])
    share = visits.join(sizes, "ring").agg(F.sum("n")).first()[0] / n ** 2
    assert share < 0.2
    some = sorted(rng.choice(n, 40, replace=False).tolist())
    assert _got(nn.where(F.col("qid").isin(some))) == _brute(x, k, rows=some)


def test_queries_beside_the_references(spark):
    """Queries far from all references, and more of them in one ring than a chunk holds."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 4))
    y = np.concatenate([rng.normal(size=(5, 4)) * 50, np.repeat(x[:1] + 0.01, 6000, axis=0)])
    r = _sides(_frame(spark, x))[1]
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "qid long, qvec array<double>")
    got = _got(nb.knn(q, r, 3, block_rows=32, index_blocks=0))
    assert len(got) == len(y)
    for i in [*range(6), 3000, 6004]:
        d = ((y[i] - x) ** 2).sum(1)
        assert got[i] == sorted(range(400), key=lambda j: (d[j], j))[:3]


def test_copies_beyond_k_leave_the_index(spark):
    n = 5000
    x = np.zeros((n, 3))
    x[::50] = np.random.default_rng(1).normal(size=(n // 50, 3))
    q, r = _sides(_frame(spark, x))
    index = ki.build_index(r, n, ring_rows=64, copies=5)
    assert index.rows.count() == n // 50 + 5
    plan = r.selectExpr("rid", "row_number() over (partition by rvec order by rid) as c").where("c <= 5")
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()  # limited before the shuffle
    nn = ki.search(q, index, 4, exclude_self=True)[0]
    some = [0, 1, 2, 3, 4, 5, 6, 50, 51, 4999]
    assert _got(nn.where(F.col("qid").isin(some))) == _brute(x, 4, rows=some)


def test_edges(spark):
    df = _frame(spark, np.zeros((3, 2)))
    q, r = _sides(df)
    assert nb.knn(q, r.limit(0), 2, index_blocks=0).count() == 0
    assert _got(nb.knn(q, r, 5, exclude_self=True, index_blocks=0)) == {0: [1, 2], 1: [0, 2], 2: [0, 1]}
    assert nb.knn(q.limit(0), r, 2, block_rows=1, index_blocks=0).count() == 0


def test_a_query_travels_once_per_group_whatever_the_rings(spark):
    """Isotropic vectors: every query visits almost every ring, and reaches each group of rings in one row."""
    row, group, lo, hi = ki._by_group(np.array([1, 0, 0, 0]), np.array([0, 4, 2, 8]), np.array([9, 8, 4, 9]),
                                      np.array([0, 0, 0, 1, 1, 1, 1, 2, 2]))
    assert row.tolist() == [0, 0, 0, 1, 1, 1] and group.tolist() == [0, 1, 2, 0, 1, 2]
    assert [x.tolist() for x in lo] == [[2], [3], [7], [0], [3], [7]] and [x.tolist() for x in hi] == [[3], [7], [9], [3], [7], [9]]
    n = 6000
    q, r = _sides(_frame(spark, np.random.default_rng(8).normal(size=(n, 24))))
    index = ki.build_index(r, n, ring_rows=16)
    assert len(index.rings) > 200
    groups = index.rings["group"].nunique()
    assert groups <= 6 and index.rows.select("group").distinct().count() == groups
    nn, visits = ki.search(q, index, 3, exclude_self=True)
    assert visits.count() > 50 * n  # as many (query, ring) pairs, which are not shuffled
    stages = nn._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in stages.split("FlatMapCoGroupsInPandas")[0]
    some = [0, 17, 5999]
    x = np.random.default_rng(8).normal(size=(n, 24))
    assert _got(nn.where(F.col("qid").isin(some))) == _brute(x, 3, rows=some)
