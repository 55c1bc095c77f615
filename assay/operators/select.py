"""Feature scoring and selection on long tables.

Features are handled in long form ``(id, label, feature, value)`` so any
number of columns is scored by the same group-by; per-feature results are
small tables (one row per feature) that the set operations combine.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.stats import attach_by, quantile_row


def to_long(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Wide -> long (unpivot) with a generator: no shuffle, no join."""
    arr = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keys, F.inline(arr))


def anova_f(long: DataFrame, label: str = "label") -> DataFrame:
    """one-way ANOVA F per feature (f_classif), nulls ignored.

    SSB = sum n_c (mean_c - mean)^2, SSW = sum n_c var_pop_c,
    F = (SSB / (k - 1)) / (SSW / (N - k)).
    """
    g = (long.where(F.col("value").isNotNull()).groupBy("feature", label)
         .agg(F.count("value").alias("n"), F.avg("value").alias("mu"), F.var_pop("value").alias("vp")))
    w = Window.partitionBy("feature")
    tot_n = F.sum("n").over(w)
    grand = F.sum(F.col("n") * F.col("mu")).over(w) / tot_n
    g = g.select("feature", "n", "mu", "vp", grand.alias("gm"), tot_n.alias("n_total"),
                 F.count(F.lit(1)).over(w).alias("k"))
    s = g.groupBy("feature", "n_total", "k").agg(
        F.sum(F.col("n") * (F.col("mu") - F.col("gm")) * (F.col("mu") - F.col("gm"))).alias("ssb"),
        F.sum(F.col("n") * F.col("vp")).alias("ssw"))
    f = F.try_divide(F.col("ssb") / (F.col("k") - 1), F.col("ssw") / (F.col("n_total") - F.col("k")))
    return s.select("feature", f.alias("f_score"))


def mutual_information(long: DataFrame, label: str = "label", q: int = 5,
                       relative_error: float | None = None) -> DataFrame:
    """F2 (re-aimed): MI between the quintile bin of each feature and the label.

    Bins follow M14 (right-closed, duplicate edges collapse); the contingency
    table is a group-by on (feature, bin, label).  The edges (one row per feature) reach the rows as a map.
    """
    ps = [i / q for i in range(1, q)]
    edges = quantile_row(long, {"__q": ("value", ps)}, relative_error, "feature").select(
        "feature", F.array_distinct("__q").alias("__e"))
    j = attach_by(long.where(F.col("value").isNotNull()), edges, "feature")
    # edges beyond the distinct ones are null and count as not passed
    b = reduce(lambda x, y: x + y, [F.coalesce((F.get("__e", F.lit(i)) < F.col("value")).cast("int"), F.lit(0)) for i in range(q - 1)])
    ct = j.groupBy("feature", b.alias("bin"), label).agg(F.count(F.lit(1)).alias("n"))
    wf = Window.partitionBy("feature")
    nb = F.sum("n").over(Window.partitionBy("feature", "bin"))
    nc = F.sum("n").over(Window.partitionBy("feature", label))
    nt = F.sum("n").over(wf)
    n, nt, nb, nc = (x.cast("double") for x in (F.col("n"), nt, nb, nc))
    t = ct.select("feature", (n / nt * F.log((n * nt) / (nb * nc))).alias("term"))
    return t.groupBy("feature").agg(F.sum("term").alias("mi"))


def variance_table(long: DataFrame) -> DataFrame:
    """population variance per feature."""
    return long.groupBy("feature").agg(F.var_pop("value").alias("variance"))


def top_k(scores: DataFrame, score: str, k: int) -> DataFrame:
    """Top-k rows by score (ties: feature name), ranked; runs on the per-feature table."""
    w = Window.orderBy(F.desc(score), F.asc("feature"))
    return scores.select("*", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def intersect_or_union(a: DataFrame, b: DataFrame, min_size: int) -> DataFrame:
    """The intersection of two feature sets, or their union when it has
    fewer than ``min_size`` members; decided inside the plan."""
    fa = a.select("feature", F.lit(True).alias("in_a"))
    fb = b.select("feature", F.lit(True).alias("in_b"))
    j = fa.join(fb, "feature", "full")
    both = F.coalesce(F.col("in_a"), F.lit(False)) & F.coalesce(F.col("in_b"), F.lit(False))
    n_both = F.sum(both.cast("int")).over(Window.partitionBy())
    return (j.select("feature", both.alias("both"), n_both.alias("n_both"))
            .where((F.col("n_both") >= min_size) & F.col("both") | (F.col("n_both") < min_size))
            .select("feature"))


def consensus(sets: Sequence[DataFrame], importance: DataFrame, min_size: int, cap: int) -> DataFrame:
    """Features in every set; if fewer than ``min_size``, the union capped at
    ``cap`` by importance (ties: name)."""
    tagged = None
    for i, s in enumerate(sets):
        t = s.select("feature", F.lit(1).alias("hit")).distinct()
        tagged = t if tagged is None else tagged.unionByName(t)
    c = tagged.groupBy("feature").agg(F.sum("hit").alias("hits"))
    c = c.join(importance.select("feature", F.col(importance.columns[1]).alias("importance")), "feature", "left")
    all_ = F.col("hits") == len(sets)
    w = Window.partitionBy()
    n_all = F.sum(all_.cast("int")).over(w)
    rk = F.row_number().over(Window.orderBy(F.desc_nulls_last("importance"), F.asc("feature")))
    x = c.select("feature", all_.alias("in_all"), n_all.alias("n_all"), rk.alias("rk"))
    return x.where((F.col("n_all") >= min_size) & F.col("in_all") |
                   (F.col("n_all") < min_size) & (F.col("rk") <= cap)).select("feature")


def union_of(sets: Sequence[DataFrame]) -> DataFrame:
    """Distinct union of feature sets."""
    u = sets[0].select("feature")
    for s in sets[1:]:
        u = u.union(s.select("feature"))
    return u.distinct()
