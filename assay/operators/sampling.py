"""Deterministic sampling, splitting and class rebalancing (R*, W6, W7).

Randomness is a hash of (id, seed, tag) (see ``functions.hashing``), so
every result is reproducible, partition-independent and survives task
retries.

Exact per-class ranks are the backbone (splits, folds, resampling).  A plain
``row_number() over (partition by class ...)`` would put a whole class in
one task, and a class may hold a third of all rows.  ``rank_within`` gives
the same ranks from many small windows: rows are salted by the top bits of
their own order hash, each (class, salt) window is ranked locally, and the
offset of every salt bucket comes from a small count table (classes x
buckets rows).  Because the salt is a prefix of the order key, the result
equals the unsalted rank exactly.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.hashing import hash60, uniform
from assay.functions.stats import attach, attach_by, one_row

SALT_BITS = 16          # 65,536 salt buckets per class
SLOT_CHUNK = 4096       # bound on the array a generator materialises
MAX_SALTS = 1024        # copies of a row that is picked very often


def rank_within(df: DataFrame, keys: Sequence[str], order_key: Column, tiebreak: str,
                salt_bits: int = SALT_BITS, parts: int | None = None) -> DataFrame:
    """Add ``__rk`` (0-based rank by (order_key, tiebreak) within ``keys``), ``__n``, ``__h`` (the order key) and ``__b`` (its salt).

    ``order_key`` must be a non-negative 60-bit hash (``hash60``).  With ``parts`` the rows are dealt by salt alone over so many
    partitions: rows of one order key lie together whatever their ``keys``, so a later window over ``__b`` and a column that
    decides the order key needs no other shuffle.
    """
    keys = list(keys)
    d = df.select("*", order_key.alias("__h"))
    d = d.select("*", F.shiftright("__h", 60 - salt_bits).alias("__b"))
    cnt = d.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__bn"))
    wk = Window.partitionBy(*keys)
    off = cnt.select(*keys, "__b",
                     F.coalesce(F.sum("__bn").over(wk.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)),
                                F.lit(0)).alias("__off"),
                     F.sum("__bn").over(wk).alias("__n"))
    if parts:
        # a salt has one row with the offsets of all its keys, so that the join needs the rows dealt by salt only, and that is
        # hashed, so that they are sorted once; rows with a null key are left out, as by a join on it
        key = F.struct(*[F.col(k) for k in keys])
        off = off.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))).repartition(parts, "__b")
        packed = off.groupBy("__b").agg(F.map_from_entries(F.collect_list(
            F.struct(key.alias("k"), F.struct("__off", "__n").alias("v")))).alias("__offs"))
        j = d.repartition(parts, "__b").join(packed.hint("shuffle_hash"), "__b").select(
            *d.columns, F.try_element_at("__offs", key).alias("__at")).where(F.col("__at").isNotNull())
        j = j.select(*d.columns, "__at.__off", "__at.__n")
    else:
        j = d.join(off, keys + ["__b"])
    # a salt has few rows, so it leads the sort: rows of a class tie in that
    w = Window.partitionBy(*(["__b", *keys] if parts else [*keys, "__b"])).orderBy("__h", tiebreak)
    return j.select(*df.columns, "__b", "__h", "__n",
                    (F.col("__off") + F.row_number().over(w) - 1).cast("bigint").alias("__rk"))


def seeded_shuffle(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """A seeded permutation, returned as an explicit position column."""
    r = rank_within(df, [], hash60(F.col(id_col), seed), id_col)
    return r.select(*df.columns, F.col("__rk").alias("position"))


def split_stratified(df: DataFrame, label: str, id_col: str, test_fraction: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Exact stratified split; the first ceil(f * n_c) rows of each class
    in hash order go to test.  Adds ``split`` ('train' / 'test')."""
    r = rank_within(df, [label], hash60(F.col(id_col), seed), id_col)
    is_test = F.col("__rk") < F.ceil(F.col("__n") * test_fraction)
    return r.select(*df.columns, F.when(is_test, "test").otherwise("train").alias("split"))


def split_random(df: DataFrame, id_col: str, test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Plain exact-size split: ceil(f * n) rows in hash order go to test."""
    r = rank_within(df, [], hash60(F.col(id_col), seed), id_col)
    is_test = F.col("__rk") < F.ceil(F.col("__n") * test_fraction)
    return r.select(*df.columns, F.when(is_test, "test").otherwise("train").alias("split"))


def split_hash(df: DataFrame, id_col: str, test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Scale variant of R9/R10: Bernoulli split by hash threshold (no shuffle)."""
    return df.select("*", F.when(uniform(F.col(id_col), seed, "split") < test_fraction, "test")
                     .otherwise("train").alias("split"))


def split_safe(df: DataFrame, label: str, id_col: str, test_fraction: float = 0.2,
               seed: int = 42) -> DataFrame:
    """Stratified when the smallest class has >= int(1/f) + 1 rows, else plain.

    The branch is decided from the class-count table (one value to the driver).
    """
    need = int(1 / test_fraction) + 1
    smallest = df.groupBy(label).count().agg(F.min("count")).first()[0]
    if smallest is not None and smallest >= need:
        return split_stratified(df, label, id_col, test_fraction, seed)
    return split_random(df, id_col, test_fraction, seed)


def folds_stratified(df: DataFrame, label: str, id_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """fold = class rank mod k (usable as ``CrossValidator(foldCol=...)``)."""
    r = rank_within(df, [label], hash60(F.col(id_col), seed), id_col)
    return r.select(*df.columns, (F.col("__rk") % k).cast("int").alias("fold"))


def split_and_folds(df: DataFrame, label: str, id_col: str, test_fraction: float = 0.2, k: int = 5, seed: int = 42) -> DataFrame:
    """R9 + R11 by one ranking: ``split`` of :func:`split_stratified` and ``fold`` of :func:`folds_stratified`, both over all rows."""
    r = rank_within(df, [label], hash60(F.col(id_col), seed), id_col)
    is_test = F.col("__rk") < F.ceil(F.col("__n") * test_fraction)
    return r.select(*df.columns, F.when(is_test, "test").otherwise("train").alias("split"), (F.col("__rk") % k).cast("int").alias("fold"))


def split_with_folds(df: DataFrame, label: str, id_col: str, test_fraction: float = 0.2, k: int = 5, seed: int = 42,
                     order_key: Column | None = None, parts: int | None = None) -> DataFrame:
    """R9 + R11 by one ranking: ``split`` of :func:`split_stratified` and ``fold`` of :func:`folds_stratified` over its train rows.

    Both rank a class in the same order, so the train rows of a class are its rows from some rank on, and a train row's place
    among them is its rank less that one.  The folds belong to ids: a row has the fold of the train row of its id (null without
    one) and, where an id comes repeatedly, comes once per train row of the id, numbered by ``copy`` from 0.  ``order_key``:
    :func:`hash60` of id and seed, if a column holds it.  The rows end up dealt by id, over ``parts`` partitions if given: then by
    the salt of its hash, so that one shuffle serves the ranks and the ids.
    """
    r = rank_within(df, [label], hash60(F.col(id_col), seed) if order_key is None else order_key, id_col, parts=parts)
    place = F.col("__rk") - F.ceil(F.col("__n") * test_fraction)
    r = r.select(*df.columns, "__b", F.when(place < 0, "test").otherwise("train").alias("split"),
                 F.when(place >= 0, place % k).cast("int").alias("__fold"))
    same_id = Window.partitionBy(id_col, "__b") if parts else Window.partitionBy(id_col)
    mine = F.when(F.col(id_col).isNotNull(), F.collect_list("__fold").over(same_id))
    return r.select(*df.columns, "split", mine.alias("__folds")).select(
        *df.columns, "split", F.posexplode_outer("__folds").alias("copy", "fold")).withColumn("copy", F.coalesce("copy", F.lit(0)))


def _class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))


def _draws(ranked: DataFrame, label: str, seed: int, cols: Sequence[str]) -> DataFrame:
    """Rows drawn with replacement: class c gets ``__target`` draws k = 0..target-1,
    draw k takes the row of rank hash60(c, seed, k) mod n_c.

    The draw slots are generated where the data is (row of rank r emits the
    slots k = r, r + n, r + 2n, ... < target, in chunks), then each slot is
    routed to its picked row with an equi-join on (class, rank).
    """
    n, t, rk = F.col("__n"), F.col("__target"), F.col("__rk")
    src = ranked.where(rk < t)
    per_row = F.ceil((t - rk) / n).cast("bigint")
    chunks = F.sequence(F.lit(0).cast("bigint"), F.ceil(per_row / SLOT_CHUNK).cast("bigint") - 1)
    # a row of a tiny class is picked very often: its slots carry a salt, and it has a copy for each salt.  The salts
    # of a class grow with its draws per row, so classes that are drawn a few times per row have one
    salts = F.least(F.greatest(F.ceil(t / n / SLOT_CHUNK), F.lit(1)), F.lit(MAX_SALTS)).cast("int")
    s = src.select(label, "__n", "__rk", salts.alias("__salts"), per_row.alias("__m"), F.explode(chunks).alias("__c"))
    # a row of a tiny class has many chunks: deal them over all tasks before they are expanded
    s = s.repartition(F.col("__rk"), F.col("__c"))
    inner = F.sequence(F.lit(0).cast("bigint"),
                       F.least(F.lit(SLOT_CHUNK).cast("bigint"), F.col("__m") - F.col("__c") * SLOT_CHUNK) - 1)
    s = s.select(label, "__n", "__rk", "__salts", "__c", F.explode(inner).alias("__i"))
    k = F.col("__rk") + (F.col("__c") * SLOT_CHUNK + F.col("__i")) * F.col("__n")
    slots = s.select(label, k.alias("draw"), (hash60(F.col(label), seed, k) % F.col("__n")).alias("__pick"),
                     F.pmod(F.xxhash64(k), F.col("__salts")).cast("int").alias("__salt"))
    rows = ranked.select(*cols, rk.alias("__pick"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("__salt"))
    return slots.join(rows, [label, "__pick", "__salt"]).select(*cols, "draw")


def resample_to(df: DataFrame, label: str, id_col: str, target: DataFrame, seed: int = 42,
                undersample_above: float | None = None) -> DataFrame:
    """Shared core of R1-R4.

    ``target`` is a one-row table with column ``__target``.  Classes with fewer
    rows are replaced by ``__target`` draws with replacement; classes with
    more than ``undersample_above * target`` rows (when given) keep the first
    ``__target`` rows in hash order (draws without replacement); the rest are
    kept whole.  Output adds ``draw`` (null for rows kept as they are).
    """
    cols = list(df.columns)
    r = rank_within(df, [label], hash60(F.col(id_col), seed), id_col)
    r = attach(r, target)
    small = r.where(F.col("__n") < F.col("__target"))
    over = _draws(small, label, seed, cols)
    if undersample_above is None:
        keep = r.where(F.col("__n") >= F.col("__target")).select(*cols, F.lit(None).cast("bigint").alias("draw"))
        return over.unionByName(keep)
    big = F.col("__n") > F.col("__target") * undersample_above
    under = r.where(big & (F.col("__rk") < F.col("__target"))).select(*cols, F.col("__rk").alias("draw"))
    keep = r.where((F.col("__n") >= F.col("__target")) & ~big).select(*cols, F.lit(None).cast("bigint").alias("draw"))
    return over.unionByName(under).unionByName(keep)


def balance_max(df: DataFrame, label: str, id_col: str, seed: int = 42) -> DataFrame:
    """Every class resampled with replacement to the largest class size."""
    t = one_row(_class_sizes(df, label), {"__target": F.max("__n")})
    return resample_to(df, label, id_col, t, seed)


def median_target(df: DataFrame, label: str, factor: float) -> DataFrame:
    """int(factor * median(class sizes)) as a one-row table."""
    return one_row(_class_sizes(df, label),
                   {"__target": F.floor(F.median("__n") * factor).cast("bigint")})


def balance_median_band(df: DataFrame, label: str, id_col: str, seed: int = 42) -> DataFrame:
    """R2: target int(1.2 * median); oversample below, undersample above 1.5 * target."""
    return resample_to(df, label, id_col, median_target(df, label, 1.2), seed, undersample_above=1.5)


def gaussian(*parts) -> Column:
    """Standard normal from two hashes (Box-Muller)."""
    u1 = (hash60(*parts, "n1") + 1) / F.lit(float((1 << 60) + 1))
    u2 = uniform(*parts, "n2")
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * 3.141592653589793 * u2)


def add_noise(df: DataFrame, label: str, id_col: str, cols: Sequence[str], scale: float,
              seed: int = 42) -> DataFrame:
    """Gaussian noise N(0, scale * std_c) on ``cols`` of the drawn rows only.

    std_c is the sample std of the column over the drawn rows of class c
    (a per-class aggregate that reaches the rows as a map).  Continuous columns only: flags and
    codes must not be passed here.
    """
    drawn = df.where(F.col("draw").isNotNull())
    sd = drawn.groupBy(label).agg(*[F.stddev_samp(c).alias(f"__sd_{c}") for c in cols])
    j = attach_by(df, sd, label)
    out = []
    for c in df.columns:
        if c in cols:
            z = gaussian(F.col(id_col), seed, F.col("draw"), c)
            out.append(F.when(F.col("draw").isNotNull(),
                              F.col(c) + z * F.coalesce(F.col(f"__sd_{c}"), F.lit(0.0)) * scale)
                       .otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def balance_noise(df: DataFrame, label: str, id_col: str, cols: Sequence[str], factor: float = 1.3,
                  scale: float = 0.01, use_max: bool = False, seed: int = 42) -> DataFrame:
    """R3 (int(1.3 * median), noise 0.01 std) / R4 (max, noise 0.005 std)."""
    t = (one_row(_class_sizes(df, label), {"__target": F.max("__n")}) if use_max
         else median_target(df, label, factor))
    return add_noise(resample_to(df, label, id_col, t, seed), label, id_col, cols, scale, seed)


POISSON_PIECE = 256.0   # largest rate drawn by one inverse-CDF search (exp(-256) is far from underflow)


def _poisson(lam: Column, *key) -> Column:
    """Poisson draw of rate ``lam`` as a sum of draws of at most ``POISSON_PIECE`` each, every one with a hash of its own."""
    pieces = F.greatest(F.ceil(lam / POISSON_PIECE), F.lit(1)).cast("int")
    part = lam / pieces

    def draw(i):
        u = uniform(*key, "poisson", i)
        p0 = F.exp(-part)
        steps = F.sequence(F.lit(1), F.ceil(part + 12 * F.sqrt(part) + 24).cast("int"))
        zero = F.struct(p0.alias("pm"), p0.alias("cdf"), F.when(p0 >= u, 0).otherwise(-1).alias("ans"))

        def step(acc, m):
            pm = acc["pm"] * part / m
            cdf = acc["cdf"] + pm
            ans = F.when((acc["ans"] < 0) & (cdf >= u), m).otherwise(acc["ans"])
            return F.struct(pm.alias("pm"), cdf.alias("cdf"), ans.alias("ans"))

        # beyond 12 standard deviations the CDF is 1 to the last bit
        found = F.aggregate(steps, zero, step, lambda acc: acc["ans"])
        return F.when(found < 0, F.ceil(part + 12 * F.sqrt(part) + 24).cast("int")).otherwise(found).cast("bigint")

    return F.aggregate(F.sequence(F.lit(1), pieces), F.lit(0).cast("bigint"), lambda acc, i: acc + draw(i))


def poisson_oversample(df: DataFrame, label: str, id_col: str, seed: int = 42) -> DataFrame:
    """Scale variant of R1 without ranks: each row of class c is copied Poisson(target / n_c) times, so the class size is
    target in expectation; no sort, and the class rates reach the rows as a map.

    Copies are emitted in chunks of ``SLOT_CHUNK`` that are spread over tasks before they are expanded, so that a row of
    a tiny class neither holds all its copies at once nor fills one task.  Rows of a null class are left out.
    """
    sizes = _class_sizes(df, label)
    rate = attach(sizes, one_row(sizes, {"__target": F.max("__n")})).select(
        label, (F.col("__target") / F.col("__n")).alias("__lam"))
    j = attach_by(df, rate, label).where(F.col("__lam").isNotNull())
    out = j.select(*df.columns, _poisson(F.col("__lam"), F.col(id_col), seed).alias("__m")).where(F.col("__m") > 0)
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__m") - 1) / SLOT_CHUNK))).alias("__c")
    spread = out.select("*", chunk).repartition(F.col(id_col), F.col("__c"))
    first = F.col("__c") * SLOT_CHUNK + 1
    return spread.select(*df.columns, F.explode(F.sequence(
        first, F.least(F.col("__m"), first + (SLOT_CHUNK - 1)))).alias("draw"))
