"""k-nearest neighbours and the operators built on them.

Exact k-NN over a few blocks of references is a blocked nested loop: both
sides are split into hash blocks, every (query block, reference block) pair
meets in one ``cogroup`` task where numpy computes the distance block and
keeps only the top k per query.  The candidate lists (at most k per query
and reference block) are then reduced per query.  No pair table is ever
materialised: the rows that leave a task are k per query.  Larger tables go
through the cluster-pruned exact index of ``knn_index``; ``knn_lsh`` is the
approximate path.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.hashing import hash60, uniform
from assay.functions.stats import attach, attach_by, one_row
from assay.operators.knn_index import PAIRS, Nearest, build_index, search, stacked, task_rows, top_pairs, vectors
from assay.session import write_scratch

BLOCK_ROWS = 2048
#: Reference blocks up to which all pairs are cheaper than an index.
INDEX_BLOCKS = 8


def _topk_block(k: int, exclude_self: bool):
    def run(key, q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        return top_pairs(q["qid"].to_numpy(np.int64), stacked(q["qvec"]), r["rid"].to_numpy(np.int64), stacked(r["rvec"]), k,
                         exclude_self)
    return run


def knn(query: DataFrame, ref: DataFrame, k: int, part: str | None = None, exclude_self: bool = False,
        block_rows: int = BLOCK_ROWS, index_blocks: int = INDEX_BLOCKS) -> DataFrame:
    """Exact k nearest references per query by Euclidean distance.

    ``query`` has ``qid, qvec`` and ``ref`` has ``rid, rvec`` (array columns),
    both optionally with a ``part`` column that restricts neighbours to the
    same partition (e.g. the class, for SMOTE).  Returns
    ``(qid, rid, dist2, rank)`` with rank 1..k; ties go to the smaller rid.
    References of more than ``index_blocks`` blocks are searched through the
    pruned index, with the same result.
    """
    nq, nr = query.count(), ref.count()
    if nr > index_blocks * block_rows:
        return search(query, build_index(ref, nr, part, block_rows, copies=k + int(exclude_self)), k, part, exclude_self)[0]
    bq = max(1, math.ceil(nq / block_rows))
    br = max(1, math.ceil(nr / block_rows))
    keys = (["__p"] if part else []) + ["qb", "rb"]
    pq = [F.col(part).alias("__p")] if part else []
    pr = [F.col(part).alias("__p")] if part else []
    q = query.where(F.col("qvec").isNotNull()).select(
        *pq, "qid", vectors(query, "qvec"), (hash60(F.col("qid"), "knn-q") % bq).alias("qb"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(br - 1).cast("bigint"))).alias("rb"))
    r = ref.where(F.col("rvec").isNotNull()).select(
        *pr, "rid", vectors(ref, "rvec"), (hash60(F.col("rid"), "knn-r") % br).alias("rb"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bq - 1).cast("bigint"))).alias("qb"))
    cand = (q.groupBy(*keys).cogroup(r.groupBy(*keys))
            .applyInPandas(_topk_block(k, exclude_self), "qid long, rid long, dist2 double"))
    w = Window.partitionBy("qid").orderBy("dist2", "rid")
    return cand.select("*", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def _bucket_mates(q: DataFrame, r: DataFrame, k: int) -> DataFrame:
    """The k nearest of every query in each bucket (``table, bucket``), ``qid, rid, dist2``.  No pair of a bucket is written: a bucket is cut
    into chunks on both sides, and a task compares one of each."""
    sizes = q.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("nq")).join(
        r.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("nr"), F.max(F.size("rvec")).alias("dim")), ["table", "bucket"])
    most = sizes.agg(F.max("nq"), F.max("nr"), F.max("dim")).first()
    rows = task_rows(q, *most) if most[0] else 1
    cut = write_scratch(sizes.select("table", "bucket", F.ceil(F.col("nq") / rows).alias("bq"), F.ceil(F.col("nr") / rows).alias("br")),
                        "lsh-chunks")
    keys = ["table", "bucket", "qc", "rc"]

    def every(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = q.join(cut, ["table", "bucket"]).select("table", "bucket", "qid", "qvec", F.pmod(F.xxhash64("qid"), F.col("bq")).alias("qc"),
                                                   every("br").alias("rc"))
    right = r.join(cut, ["table", "bucket"]).select("table", "bucket", "rid", "rvec", F.pmod(F.xxhash64("rid"), F.col("br")).alias("rc"),
                                                    every("bq").alias("qc"))

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        best = Nearest(a["qid"].to_numpy(np.int64), stacked(a["qvec"]), k, True)
        if len(a) and len(b):
            best.visit(np.arange(len(a)), b["rid"].to_numpy(np.int64), stacked(b["rvec"]))
        return best.frame()
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block, PAIRS)


def knn_lsh(query: DataFrame, ref: DataFrame, k: int, bucket_length: float, num_tables: int = 4,
            max_distance: float = float("inf")) -> DataFrame:
    """Approximate k-NN: a join by the buckets of ``BucketedRandomProjectionLSH`` that keeps the top k per query and bucket, then
    the same per-query top-k reduction.

    A query that shares buckets with fewer than k references is answered by the exact search instead (``exact`` is
    true on its rows), so every query gets k neighbours where there are as many.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array
    # rows that come twice count once
    qv = query.where(F.col("qvec").isNotNull()).select("qid", F.col("qvec").cast("array<double>").alias("qvec")).distinct()
    rv = ref.where(F.col("rvec").isNotNull()).select("rid", F.col("rvec").cast("array<double>").alias("rvec")).distinct()
    rv = write_scratch(rv, "lsh-references")
    lsh = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket_length, numHashTables=num_tables,
                                      seed=42).fit(rv.select(array_to_vector("rvec").alias("v")))

    def dealt(df, vec):
        tables = F.array(*[vector_to_array(F.col("h")[t])[0] for t in range(num_tables)])
        hashed = lsh.transform(df.withColumn("v", array_to_vector(vec))).select(*df.columns, tables.alias("h"))
        return hashed.select(*df.columns, F.posexplode("h").alias("table", "bucket"))
    q, r = write_scratch(dealt(qv, "qvec"), "lsh-queries"), write_scratch(dealt(rv, "rvec"), "lsh-buckets")
    c = _bucket_mates(q, r, k).distinct()
    if max_distance != float("inf"):
        c = c.where(F.sqrt("dist2") < max_distance)
    w = Window.partitionBy("qid").orderBy("dist2", "rid")
    top = write_scratch(c.select("*", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k), "lsh-neighbours")
    full = top.groupBy("qid").count().where(F.col("count") >= k)
    found = top.join(full.select("qid"), "qid").withColumn("exact", F.lit(False))
    rest = query.join(full.select("qid"), "qid", "left_anti")
    if max_distance != float("inf") or rest.isEmpty():
        return top.withColumn("exact", F.lit(False))
    return found.unionByName(knn(rest, ref, k, exclude_self=True).withColumn("exact", F.lit(True)))


def knn_classify(train: DataFrame, test: DataFrame, k: int = 7, weighted: bool = True) -> DataFrame:
    """Distance-weighted k-NN vote (weight 1/d; exact matches win outright).

    ``train``: (id, vec, label), ``test``: (id, vec).  Ties: smaller label.
    """
    nn = knn(test.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")),
             train.select(F.col("id").alias("rid"), F.col("vec").alias("rvec")), k)
    lab = train.select(F.col("id").alias("rid"), F.col("label").alias("nlabel"))
    j = nn.join(lab, "rid")
    d = F.sqrt("dist2")
    any_zero = F.max((F.col("dist2") == 0).cast("int")).over(Window.partitionBy("qid"))
    wgt = (F.when(any_zero == 1, (F.col("dist2") == 0).cast("double")).otherwise(1.0 / d) if weighted
           else F.lit(1.0))
    votes = j.select("qid", "nlabel", wgt.alias("w")).groupBy("qid", "nlabel").agg(F.sum("w").alias("score"))
    best = votes.groupBy("qid").agg(F.min_by("nlabel", F.struct(-F.col("score"), F.col("nlabel"))).alias("pred"))
    return best.select(F.col("qid").alias("id"), "pred")


# ---------------------------------------------------------------- naive Bayes
def fit_gaussian_nb(train_long: DataFrame, label: str = "label", var_smoothing: float = 1e-9) -> DataFrame:
    """L8 fit: per (class, dim) mean and population variance + epsilon, and log priors.

    ``train_long``: (id, label, dim, x).  epsilon = var_smoothing * max over
    dims of the overall population variance (as GaussianNB).
    """
    st = train_long.groupBy(label, "dim").agg(F.avg("x").alias("mu"), F.var_pop("x").alias("var"),
                                              F.count("x").alias("n"))
    eps = one_row(train_long.groupBy("dim").agg(F.var_pop("x").alias("v")),
                  {"__eps": F.max("v") * var_smoothing})
    prior = train_long.groupBy(label).agg(F.countDistinct("id").alias("nc"))
    prior = prior.select(label, F.log(F.col("nc") / F.sum("nc").over(Window.partitionBy())).alias("log_prior"))
    st = attach(st, eps).select(label, "dim", "mu", (F.col("var") + F.col("__eps")).alias("var"))
    return st.join(prior, label)


def predict_gaussian_nb(test: DataFrame, model: DataFrame, label: str = "label") -> DataFrame:
    """L8 predict: arg-max of log prior + sum of Gaussian log densities (ties: smaller class).

    ``test``: (id, vec).  The model (classes x dims numbers) is packed into one array per class and travels as a scalar
    subquery; every row sums its own log densities, so test rows are neither expanded nor shuffled.  A class that lacks a
    dimension of the model's, and a value that is null, add nothing.
    """
    dims = F.array_sort(F.collect_list(F.struct("dim", "mu", "var")))
    packed = model.groupBy(label).agg(F.max("log_prior").alias("prior"), dims.alias("dims")).select(F.struct(
        F.col(label).alias("cls"), "prior", "dims").alias("c")).agg(F.array_sort(F.collect_list("c")).alias("classes")).scalar()

    def density(v, d):
        x = F.get(v, d["dim"])
        return F.coalesce(-0.5 * F.log(2 * math.pi * d["var"]) - (x - d["mu"]) * (x - d["mu"]) / (2 * d["var"]), F.lit(0.0))
    rows = test.select("id", F.col("vec").cast("array<double>").alias("__v"), packed.alias("__classes"))
    scored = F.transform("__classes", lambda c: F.struct(
        (-F.aggregate(c["dims"], c["prior"], lambda acc, d: acc + density(F.col("__v"), d))).alias("order"), c["cls"].alias("cls")))
    return rows.select("id", F.array_min(scored)["cls"].alias("pred"))


# ---------------------------------------------------------------- resampling by neighbours
def smote(df: DataFrame, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """SMOTE.  Every class below the largest gets (n_max - n_c) synthetic
    points x + u * (neighbour - x), the base chosen by hash among the class rows,
    the neighbour among its k = min(k, n_c - 1) nearest same-class rows.  A class of one
    row has no neighbour and stays as it is.

    ``df``: (id, vec, label).  Output: the input rows (synthetic = false) and
    the synthetic rows (new negative ids, synthetic = true, base and neighbour ids).
    """
    from assay.operators.sampling import rank_within
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    tgt = one_row(sizes, {"__t": F.max("__n")})
    ranked = attach(rank_within(df, [label], hash60(F.col("id"), seed, "smote"), "id"), tgt)
    need = ranked.where((F.col("__n") < F.col("__t")) & (F.col("__n") > 1))
    nn = knn(need.select(label, F.col("id").alias("qid"), F.col("vec").alias("qvec")),
             need.select(label, F.col("id").alias("rid"), F.col("vec").alias("rvec")), k,
             part=label, exclude_self=True)
    # synthetic slot j of class c (0 <= j < t - n_c) is generated by the row of rank j mod n_c
    from assay.operators.sampling import SLOT_CHUNK
    n, t, rk = F.col("__n"), F.col("__t"), F.col("__rk")
    per_row = F.ceil((t - n - rk) / n).cast("bigint")
    # slots are generated in bounded chunks so a tiny class with a large deficit
    # never materialises one huge array
    chunks = F.sequence(F.lit(0).cast("bigint"), F.ceil(per_row / SLOT_CHUNK).cast("bigint") - 1)
    s = need.where(rk < t - n).select(label, "__n", "__rk", per_row.alias("__m"), F.explode(chunks).alias("__c"))
    inner = F.sequence(F.lit(0).cast("bigint"),
                       F.least(F.lit(SLOT_CHUNK).cast("bigint"), F.col("__m") - F.col("__c") * SLOT_CHUNK) - 1)
    s = s.select(label, "__n", "__rk", "__c", F.explode(inner).alias("__i"))
    j = F.col("__rk") + (F.col("__c") * SLOT_CHUNK + F.col("__i")) * F.col("__n")
    slots = s.select(label, "__n", j.alias("slot"))
    kc = F.greatest(F.least(F.lit(k), F.col("__n") - 1), F.lit(1))
    slots = slots.select(label, "slot", (hash60(F.col(label), seed, F.col("slot"), "base") % F.col("__n")).alias("__base"),
                         (hash60(F.col(label), seed, F.col("slot"), "nn") % kc + 1).alias("__nnr"),
                         uniform(F.col(label), seed, F.col("slot"), "gap").alias("__u"))
    base = ranked.select(label, F.col("__rk").alias("__base"), F.col("id").alias("base_id"),
                         F.col("vec").cast("array<double>").alias("__bv"))
    nbr = nn.select(F.col("qid").alias("base_id"), F.col("rank").alias("__nnr"), F.col("rid").alias("neighbor_id"))
    vec = df.select(F.col("id").alias("neighbor_id"), F.col("vec").cast("array<double>").alias("__nv"))
    x = slots.join(base, [label, "__base"]).join(nbr, ["base_id", "__nnr"]).join(vec, "neighbor_id")
    new = F.zip_with("__bv", "__nv", lambda a, b: a + F.col("__u") * (b - a))
    syn = x.select((-hash60(F.col(label), seed, F.col("slot"), "id") - 1).alias("id"),
                   new.alias("vec"), label, F.lit(True).alias("synthetic"), "base_id", "neighbor_id",
                   F.col("__u").alias("gap"))
    orig = df.select("id", F.col("vec").cast("array<double>").alias("vec"), label, F.lit(False).alias("synthetic"),
                     F.lit(None).cast("bigint").alias("base_id"), F.lit(None).cast("bigint").alias("neighbor_id"),
                     F.lit(None).cast("double").alias("gap"))
    return orig.unionByName(syn)


def adasyn_allocation(df: DataFrame, label: str, k: int = 5) -> DataFrame:
    """ADASYN weights.  For rows of classes below the largest, r_i = share of
    the k nearest neighbours (any class) with another label, normalised within
    the class; g_i = r_i / sum(r) * (n_max - n_c) synthetic points (float)."""
    nn = knn(df.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")),
             df.select(F.col("id").alias("rid"), F.col("vec").alias("rvec")), k, exclude_self=True)
    lab = df.select("id", label)
    j = (nn.join(lab.withColumnsRenamed({"id": "qid"}), "qid")
         .join(lab.select(F.col("id").alias("rid"), F.col(label).alias("__nl")), "rid"))
    r = j.groupBy("qid", label).agg((F.sum((F.col("__nl") != F.col(label)).cast("double")) / k).alias("r"))
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    tgt = one_row(sizes, {"__t": F.max("__n")})
    s = attach(sizes, tgt)
    w = Window.partitionBy(label)
    x = r.join(s, label).where(F.col("__n") < F.col("__t"))
    share = F.try_divide(F.col("r"), F.sum("r").over(w))
    return x.select(F.col("qid").alias("id"), label, "r", share.alias("share"),
                    (F.coalesce(share, F.lit(0.0)) * (F.col("__t") - F.col("__n"))).alias("g"))


def adasyn(df: DataFrame, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """ADASYN.  Every row gets round(g) synthetic points (:func:`adasyn_allocation`) towards neighbours of its own
    class, chosen by hash among the min(k, n_c - 1) nearest.

    ``df`` and the output are those of :func:`smote`.  Rows of a class of one row, and rows whose neighbours all share
    their class, get none.
    """
    from assay.operators.sampling import SLOT_CHUNK
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    # read by the search and by the points: the neighbours of rows without a point are not searched
    alloc = write_scratch(adasyn_allocation(df, label, k).select("id", F.round("g").cast("bigint").alias("__m")).where("__m > 0"),
                          "adasyn-allocation")
    rows = attach_by(df.select("id", "vec", label), sizes, label).where(F.col("__n") > 1)
    nn = knn(rows.join(alloc, "id", "left_semi").select(label, F.col("id").alias("qid"), F.col("vec").alias("qvec")),
             rows.select(label, F.col("id").alias("rid"), F.col("vec").alias("rvec")), k, part=label, exclude_self=True)
    base = rows.join(alloc, "id").select(
        F.col("id").alias("base_id"), F.col("vec").cast("array<double>").alias("__bv"), label, "__n", "__m",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__m") - 1) / SLOT_CHUNK))).alias("__c"))
    first = F.col("__c") * SLOT_CHUNK
    slots = base.repartition("base_id", "__c").select(
        "base_id", "__bv", label, "__n",
        F.explode(F.sequence(first, F.least(F.col("__m"), first + SLOT_CHUNK) - 1)).alias("slot"))
    kc = F.least(F.lit(k), F.col("__n") - 1)
    slots = slots.select("*", (hash60(F.col("base_id"), seed, F.col("slot"), "ada-nn") % kc + 1).alias("__nnr"),
                         uniform(F.col("base_id"), seed, F.col("slot"), "ada-gap").alias("__u"))
    nbr = nn.select(F.col("qid").alias("base_id"), F.col("rank").alias("__nnr"), F.col("rid").alias("neighbor_id"))
    vec = df.select(F.col("id").alias("neighbor_id"), F.col("vec").cast("array<double>").alias("__nv"))
    new = F.zip_with("__bv", "__nv", lambda a, b: a + F.col("__u") * (b - a))
    syn = slots.join(nbr, ["base_id", "__nnr"]).join(vec, "neighbor_id").select(
        (-hash60(F.col("base_id"), seed, F.col("slot"), "ada-id") - 1).alias("id"), new.alias("vec"), label,
        F.lit(True).alias("synthetic"), "base_id", "neighbor_id", F.col("__u").alias("gap"))
    none = F.lit(None).cast("bigint")
    orig = df.select("id", F.col("vec").cast("array<double>").alias("vec"), label, F.lit(False).alias("synthetic"),
                     none.alias("base_id"), none.alias("neighbor_id"), F.lit(None).cast("double").alias("gap"))
    return orig.unionByName(syn)


def tomek_links(df: DataFrame, label: str) -> DataFrame:
    """Pairs that are each other's nearest neighbour and differ in label (a < b)."""
    nn = knn(df.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")),
             df.select(F.col("id").alias("rid"), F.col("vec").alias("rvec")), 1, exclude_self=True)
    a = nn.select(F.col("qid").alias("a"), F.col("rid").alias("b"))
    b = nn.select(F.col("qid").alias("b"), F.col("rid").alias("a"))
    mutual = a.join(b, ["a", "b"]).where(F.col("a") < F.col("b"))
    lab = df.select("id", label)
    m = (mutual.join(lab.select(F.col("id").alias("a"), F.col(label).alias("label_a")), "a")
         .join(lab.select(F.col("id").alias("b"), F.col(label).alias("label_b")), "b"))
    return m.where(F.col("label_a") != F.col("label_b")).select("a", "b", "label_a", "label_b")


def remove_tomek(df: DataFrame, label: str) -> DataFrame:
    """R7 cleaning step: drop both ends of every Tomek link (anti join)."""
    t = tomek_links(df, label)
    ends = t.select(F.col("a").alias("id")).union(t.select(F.col("b").alias("id"))).distinct()
    return df.join(ends, "id", "left_anti")


def rebalance_if_needed(df: DataFrame, label: str, threshold: float = 0.7,
                        methods: Sequence[str] = ("smote", "adasyn", "smote_tomek"), k: int = 5,
                        seed: int = 42) -> tuple[DataFrame, str]:
    """Rebalance only if min/max class ratio < threshold, by the first of ``methods`` that the class sizes allow.

    The choice is made before anything is built, from one row of class sizes: SMOTE and SMOTE + Tomek removal need a
    class below the largest with two rows or more; ADASYN as well, and more than one class.  Returns (table, method used
    or 'none').  A failure while the table is computed is not caught.
    """
    plain = df.select("id", "vec", label)
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.agg(F.max("n").alias("__max"), F.min("n").alias("__min"), F.count(F.lit(1)).alias("__k"))
    s = attach(sizes, top).agg(F.max("__max").alias("max"), F.max("__min").alias("min"), F.max("__k").alias("k"),
                               F.count_if((F.col("n") < F.col("__max")) & (F.col("n") > 1)).alias("growable")).first()
    if not s["max"] or s["min"] / s["max"] >= threshold or not s["growable"]:
        return plain, "none"
    build = {"smote": lambda: smote(df, label, k, seed), "adasyn": lambda: adasyn(df, label, k, seed),
             "smote_tomek": lambda: remove_tomek(smote(df, label, k, seed).select("id", "vec", label), label)}
    for m in methods:
        if m in build and (m != "adasyn" or s["k"] > 1):
            return build[m]().select("id", "vec", label), m
    return plain, "none"
