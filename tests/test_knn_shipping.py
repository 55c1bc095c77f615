"""What the neighbour searches ship: floats stay floats, a reference travels once to the first search, ADASYN searches only what it uses."""

import numpy as np
from pyspark.sql import functions as F

from assay.operators import knn_index as ki
from assay.operators import neighbors as nb


def _vectors(spark, n, kind, dim=8, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    return x, spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], f"id long, vec array<{kind}>, label int")


def _pairs(df):
    return sorted(map(tuple, df.select("qid", "rid", "dist2", "rank").collect()))


def _sides(df):
    return df.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), df.select(F.col("id").alias("rid"), F.col("vec").alias("rvec"))


def test_floats_travel_as_floats_with_the_same_neighbours(spark):
    x, floats = _vectors(spark, 600, "float")
    doubles = floats.withColumn("vec", F.col("vec").cast("array<double>"))
    q, r = _sides(floats)
    index = ki.build_index(r, 600, ring_rows=32)
    assert index.rows.schema["rvec"].dataType.simpleString() == "array<float>"
    for blocks in (0, 10**6):
        got = _pairs(nb.knn(q, r, 4, exclude_self=True, block_rows=64, index_blocks=blocks))
        assert got == _pairs(nb.knn(*_sides(doubles), 4, exclude_self=True, block_rows=64, index_blocks=blocks))
        x64 = x.astype(np.float64)
        for i in (0, 17, 599):
            d = ((x64 - x64[i]) ** 2).sum(1)
            assert [p[1] for p in sorted(got, key=lambda p: (p[0], p[3])) if p[0] == i] == sorted(
                (j for j in range(600) if j != i), key=lambda j: (d[j], j))[:4]


def test_a_reference_travels_about_once_to_the_first_search(spark, monkeypatch):
    monkeypatch.setattr(ki, "task_rows", lambda *a: 100)
    shipped = []
    sides = ki._sides

    def seen(asked, chunks, index):
        out = sides(asked, chunks, index)
        shipped.append(out[1].count())
        return out
    monkeypatch.setattr(ki, "_sides", seen)
    x, df = _vectors(spark, 1000, "float")
    q, r = _sides(df)
    nn = ki.search(q, ki.build_index(r, 1000, ring_rows=16), 3, exclude_self=True)[0]
    assert shipped[0] < 3 * 1000 and shipped[1] == 10 * 1000
    assert _pairs(nn) == _pairs(nb.knn(q, r, 3, exclude_self=True, index_blocks=10**6))


def test_adasyn_searches_only_rows_with_points(spark, monkeypatch):
    x, df = _vectors(spark, 400, "float")
    df = df.withColumn("label", F.when(F.col("id") < 300, "big").when(F.col("id") < 399, "small").otherwise("lone"))
    asked, whole = [], nb.knn

    def counted(query, *args, **kwargs):
        asked.append(query.count())
        return whole(query, *args, **kwargs)
    monkeypatch.setattr(nb, "knn", counted)
    out = nb.adasyn(df, "label", 5).where("synthetic").collect()
    assert asked[0] == 400 and asked[1] <= 99
    x64, ids = x.astype(np.float64), np.arange(300, 399)
    assert out and all(r.label == "small" for r in out)
    for r in out[:30]:
        d = ((x64[ids] - x64[r.base_id]) ** 2).sum(1)
        near = [j for j in ids[np.lexsort((ids, d))] if j != r.base_id][:5]
        assert r.neighbor_id in near
        assert np.allclose(r.vec, x64[r.base_id] + r.gap * (x64[r.neighbor_id] - x64[r.base_id]))
