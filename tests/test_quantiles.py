"""Exact quantiles: ties at bracket ends, discrete columns, and brackets that miss and are widened."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.functions import stats

PS = [0.0, 0.001, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    n = 30_000
    cols = {"smooth": rng.normal(size=n), "ties": rng.integers(0, 3, n).astype(float), "heavy": np.where(rng.random(n) < 0.5, 7.0, rng.random(n) * 14),
            "one": np.full(n, 2.0)}
    rows = [(i, f"g{i % 3}", *(None if i % 17 == 0 else float(c[i]) for c in cols.values())) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, g string, " + ", ".join(f"{c} double" for c in cols)).repartition(6).cache()
    return df, list(cols), rows


def _want(rows, at, lower=False):
    return np.quantile([r[at] for r in rows if r[at] is not None], PS, method="lower" if lower else "linear")


@pytest.mark.parametrize("reach,sketch", [(2.0, 10_000), (0.0, 20), (0.01, 50)])
def test_equal_numpy_also_when_brackets_miss(table, monkeypatch, reach, sketch):
    df, cols, rows = table
    monkeypatch.setattr(stats, "SKETCH", sketch)
    monkeypatch.setattr(stats, "REACH", max(reach, 1e-9))
    monkeypatch.setattr(stats, "WIDEN", 1e6 if reach == 0 else 16.0)
    rounds = []
    first = stats._bounds
    monkeypatch.setattr(stats, "_bounds", lambda *a: rounds.append(1) or first(*a))
    out = stats.quantile_row(df, {c: (c, PS) for c in cols}, extra={"n": F.count(F.lit(1))}).first()
    for j, c in enumerate(cols):
        assert np.allclose(out[c], _want(rows, 2 + j), rtol=1e-12)
    assert out["n"] == len(rows) and (len(rounds) > 1) == (reach < 1)


def test_groups_lower_and_empty(table):
    df, cols, rows = table
    out = {r.g: r for r in stats.quantile_row(df, {"q": ("smooth", PS), "m": ("ties", 0.5)}, by="g", lower=True).collect()}
    for g in ("g0", "g1", "g2"):
        mine = [r for r in rows if r[1] == g]
        assert np.allclose(out[g]["q"], _want(mine, 2, lower=True)) and out[g]["m"] == 1.0
    none = stats.quantile_row(df.limit(0), {"q": ("smooth", PS), "m": ("ties", 0.5)}, extra={"n": F.count(F.lit(1))}).first()
    assert none["q"] == [None] * len(PS) and none["m"] is None and none["n"] == 0
    assert stats.quantile_row(df.where("ties is null"), {"m": ("ties", 0.5)}, by="g").where("m is not null").count() == 0
