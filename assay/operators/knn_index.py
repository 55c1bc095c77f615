"""Exact k-nearest neighbours through a cluster-pruned index (J4 beyond a few blocks).

*Index.*  Centroids come from k-means on a bounded sample; they decide only how much is pruned, never the result.  Every
reference row belongs to the cell of its nearest centroid.  A cell's rows, in order of their distance to the centroid,
are cut into rings of ``ring_rows`` to twice as many rows, so a cell that holds most of the table is simply many rings.  A
ring knows its least and greatest distance to the centroid.

*Search.*  A query first searches one ring of its nearest cell, which bounds the distance of its k-th neighbour by ``tau``.
It then visits only rings that may hold a nearer row.  Two bounds say so, with ``d`` the distances of the query to the
centroids: the triangle inequality, ``d[c] - far`` and ``near - d[c]``, and the half-space of a cell, whose rows are nearer to
its centroid ``c`` than to any other centroid ``o``: ``(d[c]^2 - d[o]^2) / (2 |c - o|)``, for the query's own ``o``.

Consecutive rings form groups and queries form chunks, both of as many rows as the cores call for and a bounded number of values;
a task holds one group and one chunk.  A query travels once to each group that it visits, with the ranges of rings it visits there, and a row
once to each chunk, so what is shuffled does not depend on the size of the rings.  The first search asks one group per query, so its
chunks are counted by group and a row travels about once.  Vectors of floats travel as floats; tasks widen them.  Inside a task rings are
compared one by one, or many at a time where most of them are visited anyway.  What leaves a task is ``k`` rows per query.  On
vectors without any structure no ring can be excluded and the work is that of all pairs; on clustered vectors it is a small share
(``visits`` tells).

With ``part``, neighbours are searched in the query's own part only (null parts have none); cells and rings are then kept
apart by part.  Ties in distance go to the smaller ``rid``; rows with a null vector take no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from assay.functions.hashing import hash60
from assay.functions.numbering import number_rows
from assay.session import write_scratch

#: Rows that the centroids are fitted on (a bounded sample by hash), and the most cells.
SAMPLE_ROWS, MAX_CELLS = 20_000, 1024
#: Least rows of a ring, and the most rings: their table is held by every task, so rings grow beyond that number.
RING_ROWS, MAX_RINGS = 2048, 500_000
#: Most values (rows times dimensions) of either side that one task holds, and tasks that a search has per core.
TASK_VALUES, TASKS = 1 << 23, 4
#: Rows of a group that are compared at once, and the least share of them that must be asked for.
BLOCK_ROWS, BLOCK_SHARE = 2048, 0.25

PAIRS = "qid long, rid long, dist2 double"


class Index(NamedTuple):
    """``rows``: group, block, ring, rid, rvec; ``centroids``; ``rings``: part, cell, ring, near, far, n, block, group by ring."""

    rows: DataFrame
    centroids: np.ndarray
    rings: pd.DataFrame


def vectors(df: DataFrame, col: str) -> Column:
    """The array column as it is where it holds floats (half the room, and nothing is lost when they are widened), else as doubles."""
    kind = df.schema[col].dataType
    narrow = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    return (F.col(col) if narrow else F.col(col).cast("array<double>")).alias(col)


def stacked(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64) if len(col) else np.zeros((0, 1))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by the dot-product form: quick, with an error that :func:`slack` bounds."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0))


def slack(a: np.ndarray, b: np.ndarray) -> float:
    """More than the error of :func:`distances`."""
    size = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0)) * np.sqrt(a.shape[1])
    return 1e-6 * (size + 1e-30)


def top_pairs(qid: np.ndarray, q: np.ndarray, rid: np.ndarray, r: np.ndarray, k: int, exclude_self: bool) -> pd.DataFrame:
    """The k nearest ``r`` of every ``q``: screened by the dot-product form, decided by exact distances, ties by ``rid``."""
    if not len(q) or not len(r):
        return pd.DataFrame({"qid": qid[:0], "rid": rid[:0], "dist2": np.zeros(0)})
    d = distances(q, r)
    if exclude_self:
        d[qid[:, None] == rid[None, :]] = np.inf
    kk = min(k, len(r))
    kth = np.partition(d, kk - 1, axis=1)[:, kk - 1]
    # all that may tie with the k-th are decided exactly
    at, of = np.nonzero((d <= kth[:, None] + 2 * slack(q, r)) & np.isfinite(d))
    exact = np.empty(len(at))
    for lo in range(0, len(at), 1 << 18):
        part = slice(lo, lo + (1 << 18))
        exact[part] = ((q[at[part]] - r[of[part]]) ** 2).sum(1)
    order = np.lexsort((rid[of], exact, at))
    at, of, exact = at[order], of[order], exact[order]
    first = np.searchsorted(at, np.arange(len(q)))
    keep = np.arange(len(at)) - first[at] < k
    return pd.DataFrame({"qid": qid[at[keep]], "rid": rid[of[keep]], "dist2": exact[keep]})


class Nearest:
    """The k nearest rows so far of the queries of a task: screened by the dot-product form, decided by exact distances, ties by ``rid``."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, k: int, exclude_self: bool, bound: np.ndarray | None = None):
        self.qid, self.q, self.k, self.exclude_self = qid, q, k, exclude_self
        self.norm = (q * q).sum(1)
        self.bound = np.full(len(q), np.inf) if bound is None else bound.copy()
        self.dist2, self.rid = np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64)

    def visit(self, rows: np.ndarray, rid: np.ndarray, r: np.ndarray) -> None:
        """Compare the queries ``rows`` (their places, distinct) with the references ``r``."""
        for a in range(0, len(r), BLOCK_ROWS):
            block, ids = r[a: a + BLOCK_ROWS], rid[a: a + BLOCK_ROWS]
            norm = (block * block).sum(1)
            for lo in range(0, len(rows), BLOCK_ROWS):
                self._compare(rows[lo: lo + BLOCK_ROWS], ids, block, norm)

    def _compare(self, rows: np.ndarray, rid: np.ndarray, r: np.ndarray, norm: np.ndarray) -> None:
        q, eps, bound = self.q[rows], 2 * slack(self.q[rows], r), self.bound[rows]
        # q.r - |r|^2 / 2, in place: the squared distance is |q|^2 less twice as much
        s = q @ r.T
        s -= norm[None, :] / 2.0
        free = np.flatnonzero(np.isinf(bound))
        if len(free):
            mine = np.maximum(self.norm[rows[free]][:, None] - 2.0 * s[free], 0.0)
            if self.exclude_self:
                mine[self.qid[rows[free]][:, None] == rid[None, :]] = np.inf
            kk = min(self.k, len(r))
            if kk == self.k:
                bound[free] = np.sqrt(np.partition(mine, kk - 1, axis=1)[:, kk - 1]) + eps
        at, of = np.divmod(np.flatnonzero(s >= ((self.norm[rows] - (bound + eps) ** 2) / 2.0)[:, None]), len(r))
        if self.exclude_self:
            other = self.qid[rows[at]] != rid[of]
            at, of = at[other], of[other]
        if not len(at):
            return
        exact = np.empty(len(at))
        for lo in range(0, len(at), 1 << 18):
            part = slice(lo, lo + (1 << 18))
            exact[part] = ((q[at[part]] - r[of[part]]) ** 2).sum(1)
        some = np.unique(at)
        place = rows[some]
        every = np.r_[at, np.repeat(some, self.k)]
        dist2, ids = np.r_[exact, self.dist2[place].ravel()], np.r_[rid[of], self.rid[place].ravel()]
        order = np.lexsort((ids, dist2, every))
        first = np.searchsorted(every[order], some)
        keep = order[first[:, None] + np.arange(self.k)[None, :]]
        self.dist2[place], self.rid[place] = dist2[keep], ids[keep]
        self.bound[place] = np.minimum(self.bound[place], np.sqrt(self.dist2[place][:, -1]))

    def frame(self) -> pd.DataFrame:
        at, of = np.nonzero(np.isfinite(self.dist2))
        return pd.DataFrame({"qid": self.qid[at], "rid": self.rid[at, of], "dist2": self.dist2[at, of]})


def task_rows(df: DataFrame, n: int, m: int, dim: int) -> int:
    """Rows of either side that a task holds when ``n`` rows meet ``m``: as few as give every core ``TASKS`` tasks."""
    even = int(np.sqrt(n * m / (TASKS * df.sparkSession.sparkContext.defaultParallelism)))
    return int(np.clip(even, min(BLOCK_ROWS, TASK_VALUES // max(dim, 1)) or 1, max(TASK_VALUES // max(dim, 1), 1)))


def cut(rings: pd.DataFrame, block_rows: int, group_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and group of every ring: consecutive rings of up to so many rows; a block keeps to one part and one group."""
    block, group = np.zeros(len(rings), np.int64), np.zeros(len(rings), np.int64)
    b, g, in_block, in_group, last = -1, 0, 0, 0, None
    for i, (part, n) in enumerate(zip(rings["part"], rings["n"])):
        if in_group and in_group + n > group_rows:
            g, in_group, last = g + 1, 0, None
        if b < 0 or part != last or in_block + n > block_rows:
            b, in_block = b + 1, 0
        block[i], group[i], last = b, g, part
        in_block, in_group = in_block + n, in_group + n
    return block, group


def fit_centroids(ref: DataFrame, n: int, cells: int, rounds: int = 8) -> np.ndarray:
    """k-means centroids from about ``SAMPLE_ROWS`` of the ``n`` rows, chosen by hash."""
    share = int(min(1.0, SAMPLE_ROWS / max(n, 1)) * (1 << 60))
    sample = ref.where(hash60(F.col("rid"), "knn-sample") < F.lit(share)).select("rid", "rvec").limit(2 * SAMPLE_ROWS).toPandas()
    sample = sample.sort_values("rid")
    x = stacked(sample["rvec"]) if len(sample) else stacked(ref.select("rvec").limit(1).toPandas()["rvec"])
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([distances(x[lo: lo + 4096], c).argmin(1) for lo in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        count = np.bincount(own, minlength=len(c))
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c


def build_index(ref: DataFrame, n: int, part: str | None = None, ring_rows: int = RING_ROWS, cells: int | None = None,
                copies: int | None = None) -> Index:
    """Index of ``ref`` (``rid, rvec`` and the column ``part``), which has ``n`` rows.

    With ``copies``, of equal vectors only the ``copies`` smallest ``rid`` are kept: with ``k``, and one more if a row is not its own
    neighbour, no other copy can be among the ``k`` nearest of any query.  Spark limits each copy group before it
    shuffles, so a vector that a third of the rows share costs little.
    """
    spark = ref.sparkSession
    ring_rows = max(ring_rows, -(-2 * n // MAX_RINGS))
    cells = cells or int(np.clip(n // (2 * ring_rows), 1, MAX_CELLS))
    ref = ref.where(F.col("rvec").isNotNull()).select(
        (F.col(part) if part else F.lit("")).cast("string").alias("part"), "rid", vectors(ref, "rvec"))
    if part:
        ref = ref.where(F.col("part").isNotNull())
    if copies:
        w = Window.partitionBy("part", "rvec").orderBy("rid")
        ref = write_scratch(ref.select("*", F.row_number().over(w).alias("__copy")).where(F.col("__copy") <= copies).drop("__copy"),
                            "knn-distinct")
    centroids = spark.sparkContext.broadcast(fit_centroids(ref, n, cells))

    def locate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            d = distances(stacked(f["rvec"]), centroids.value)
            f["cell"] = d.argmin(1).astype("int32")
            f["dist"] = d.min(1)
            yield f
    placed = ref.mapInPandas(locate, f"part string, rid long, rvec {ref.schema['rvec'].dataType.simpleString()}, cell int, dist double")
    ranked = number_rows(write_scratch(placed, "knn-cells"), ["dist", "rid"], ["part", "cell"], "knn-rings")
    in_cell = F.greatest(F.floor(F.col("total") / ring_rows), F.lit(1))
    ranked = ranked.select("part", "cell", F.floor(F.col("number") * in_cell / F.col("total")).cast("int").alias("at"),
                           "rid", "rvec", "dist")
    ranked = write_scratch(ranked, "knn-rows")
    rings = ranked.groupBy("part", "cell", "at").agg(F.min("dist").alias("near"), F.max("dist").alias("far"),
                                                     F.count(F.lit(1)).alias("n")).toPandas()
    rings = rings.sort_values(["part", "cell", "at"], ignore_index=True)
    rings["ring"] = np.arange(len(rings))
    rings["block"], rings["group"] = cut(rings, BLOCK_ROWS, task_rows(ref, n, n, centroids.value.shape[1]))
    names = spark.createDataFrame(rings[["part", "cell", "at", "ring", "block", "group"]],
                                  "part string, cell int, at int, ring long, block long, group long")
    rows = ranked.join(F.broadcast(names), ["part", "cell", "at"]).select("group", "block", "ring", "rid", "rvec")
    return Index(rows, centroids.value, rings)


class _Rings:
    """The rings of one part, cell by cell."""

    def __init__(self, rings: pd.DataFrame, centroids: np.ndarray):
        self.cells = rings["cell"].unique()
        bounds = np.searchsorted(rings["cell"].to_numpy(), self.cells)
        ends = np.r_[bounds[1:], len(rings)]
        self.ring, self.near, self.far = (rings[c].to_numpy() for c in ("ring", "near", "far"))
        self.n = rings["n"].to_numpy()
        self.of = list(zip(self.cells, bounds, ends))
        self.rows = np.array([self.n[a:b].sum() for _, a, b in self.of])
        self.centroids = centroids

    def home(self, d: np.ndarray, least: int) -> np.ndarray:
        """Per query, the ring to search first (-1 if no cell has ``least`` rows)."""
        mine = d[:, self.cells].copy()
        mine[:, self.rows < least] = np.inf
        nearest = mine.argmin(1)
        out = np.full(len(d), -1, np.int64)
        for j in np.unique(nearest):
            rows = np.flatnonzero((nearest == j) & np.isfinite(mine[np.arange(len(d)), nearest]))
            _, a, b = self.of[j]
            x = d[rows, self.cells[j]]
            at = np.minimum(np.searchsorted(self.far[a:b], x), b - a - 1)
            out[rows] = self.ring[a + at]
        return out

    def visits(self, d: np.ndarray, tau: np.ndarray, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(queries, first, end)``: rings that may hold a row within ``tau`` of the query, a cell at a time."""
        own = d.argmin(1)
        nearest = d[np.arange(len(d)), own]
        reach = tau + eps
        for cell, a, b in self.of:
            apart = np.sqrt(((self.centroids[own] - self.centroids[cell]) ** 2).sum(1))
            half = np.where(apart > 0, (d[:, cell] ** 2 - nearest ** 2) / (2 * np.maximum(apart, 1e-300)), 0.0)
            near = d[:, cell]
            rows = np.flatnonzero((half <= reach) & (near - self.far[b - 1] <= reach) & (self.near[a] - near <= reach))
            if not len(rows):
                continue
            lo = np.searchsorted(self.far[a:b], near[rows] - reach[rows])
            hi = np.searchsorted(self.near[a:b], near[rows] + reach[rows], side="right")
            some = hi > lo
            yield rows[some], self.ring[a] + lo[some], self.ring[a] + hi[some]


def _by_group(row: np.ndarray, lo: np.ndarray, hi: np.ndarray, group: np.ndarray) -> tuple:
    """Ranges of rings per row, joined where they touch and cut where the groups end: ``row, group`` and their lists of ends."""
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (lo[1:] != hi[:-1])]
    start = np.flatnonzero(new)
    row, lo, hi = row[start], lo[start], hi[np.r_[start[1:], len(new)] - 1]
    pieces = group[hi - 1] - group[lo] + 1
    of = np.repeat(np.arange(len(row)), pieces)
    g = group[lo][of] + np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lo, hi = np.maximum(lo[of], np.searchsorted(group, g)), np.minimum(hi[of], np.searchsorted(group, g, side="right"))
    first = np.flatnonzero(np.r_[True, (row[of][1:] != row[of][:-1]) | (g[1:] != g[:-1])])
    return row[of][first], g[first], np.split(lo, first[1:]), np.split(hi, first[1:])


def _asked(queries: DataFrame, plan) -> DataFrame:
    kind = queries.schema["qvec"].dataType.simpleString()
    return queries.mapInPandas(plan, f"qid long, qvec {kind}, bound double, group long, lo array<long>, hi array<long>")


def _planner(model, least: int, tau: bool):
    """Home rings, or the rings to visit within ``bound``, by group; ``model`` is the broadcast ``(centroids, rings)``."""
    def plan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, table = model.value
        rings, group = {p: _Rings(g, centroids) for p, g in table.groupby("part")}, table["group"].to_numpy()
        for f in frames:
            for part, g in f.groupby("part"):
                if part not in rings:
                    continue
                for at in range(0, len(g), 1024):
                    some = g.iloc[at: at + 1024]
                    x = stacked(some["qvec"])
                    d = distances(x, centroids)
                    bound = some["tau"].to_numpy(np.float64) if tau else np.full(len(x), np.inf)
                    if tau:
                        found = list(rings[part].visits(d, bound, 4 * slack(x, centroids)))
                    else:
                        home = rings[part].home(d, least)
                        has = np.flatnonzero(home >= 0)
                        found = [(has, home[has], home[has] + 1)]
                    row, lo, hi = (np.concatenate([c[i] for c in found]) if found else np.zeros(0, np.int64) for i in range(3))
                    if not len(row):
                        continue
                    row, of, lo, hi = _by_group(row, lo, hi, group)
                    yield pd.DataFrame({"qid": some["qid"].to_numpy()[row], "qvec": some["qvec"].to_numpy()[row], "bound": bound[row],
                                        "group": of, "lo": lo, "hi": hi})
    return plan


def _chunks(spark: SparkSession, sizes: Iterable[tuple[int, int]], rows: int) -> DataFrame:
    """``group, chunks`` from groups and their queries: chunks of about ``rows`` queries."""
    return spark.createDataFrame([(int(g), max(1, -(-int(n) // rows))) for g, n in sizes], "group long, chunks long")


def _sides(asked: DataFrame, chunks: DataFrame, index: Index) -> tuple[DataFrame, DataFrame]:
    """Queries and references by ``group, chunk``; a reference comes once per chunk of its group."""
    left, right = (df.join(F.broadcast(chunks), "group") for df in (asked, index.rows))
    return (left.select(*asked.columns, F.pmod(F.xxhash64("qid"), F.col("chunks")).alias("chunk")),
            right.select(*index.rows.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")))


def _search(asked: DataFrame, chunks: DataFrame, index: Index, k: int, exclude_self: bool) -> DataFrame:
    """Up to k nearest of every row of ``asked`` in the rings of its ranges."""
    left, right = _sides(asked, chunks, index)

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        best = Nearest(a["qid"].to_numpy(np.int64), stacked(a["qvec"]), k, exclude_self, a["bound"].to_numpy(np.float64))
        if not len(a) or not len(b):
            return best.frame()
        b = b.sort_values("ring", ignore_index=True)
        r, rid, ring = stacked(b["rvec"]), b["rid"].to_numpy(np.int64), b["ring"].to_numpy()
        of = np.repeat(np.arange(len(a)), a["lo"].map(len))
        lo, hi = np.concatenate(a["lo"].to_numpy()), np.concatenate(a["hi"].to_numpy())
        # the rows of a range are consecutive
        lo, hi = np.searchsorted(ring, lo), np.searchsorted(ring, hi)
        ends = np.r_[np.flatnonzero(np.diff(b["block"].to_numpy())) + 1, len(b)]
        begin = 0
        for end in ends:
            meet = np.flatnonzero((lo < end) & (hi > begin))
            some = np.unique(of[meet])
            wanted = (np.minimum(hi[meet], end) - np.maximum(lo[meet], begin)).sum()
            if wanted >= BLOCK_SHARE * len(some) * (end - begin):
                best.visit(some, rid[begin: end], r[begin: end])
            else:
                inner = np.r_[begin, begin + np.flatnonzero(np.diff(ring[begin: end])) + 1, end]
                for x, y in zip(inner[:-1], inner[1:]):
                    best.visit(np.unique(of[meet[(lo[meet] <= x) & (hi[meet] >= y)]]), rid[x: y], r[x: y])
            begin = end
        return best.frame()
    return left.groupBy("group", "chunk").cogroup(right.groupBy("group", "chunk")).applyInPandas(block, PAIRS)


def search(query: DataFrame, index: Index, k: int, part: str | None = None, exclude_self: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(neighbours, visits)``: ``qid, rid, dist2, rank`` with rank 1..k, and the ``(qid, ring)`` that were searched.

    ``query`` has distinct ``qid``, ``qvec`` and the column ``part``.
    """
    queries = query.where(F.col("qvec").isNotNull()).select(
        (F.col(part) if part else F.lit("")).cast("string").alias("part"), "qid", vectors(query, "qvec"))
    queries = write_scratch(queries, "knn-queries")
    spark, least, n = query.sparkSession, k + int(exclude_self), queries.count()
    rows = task_rows(query, n, int(index.rings["n"].sum()), index.centroids.shape[1])
    model = spark.sparkContext.broadcast((index.centroids, index.rings))
    home = _asked(queries, _planner(model, least, tau=False))
    near = _search(home, _chunks(spark, home.groupBy("group").count().collect(), rows), index, k, exclude_self)
    bound = write_scratch(near.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.sqrt(F.max("dist2"))).alias("tau")), "knn-bounds")
    known = queries.join(bound, "qid", "left").withColumn("tau", F.coalesce("tau", F.lit(float("inf"))))
    asked = _asked(known, _planner(model, least, tau=True))
    found = _search(asked, _chunks(spark, [(g, n) for g in index.rings["group"].unique()], rows), index, k, exclude_self)
    w = Window.partitionBy("qid").orderBy("dist2", "rid")
    out = found.select("*", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)
    visits = asked.select("qid", F.explode(F.arrays_zip("lo", "hi")).alias("r")).select(
        "qid", F.explode(F.sequence(F.col("r.lo"), F.col("r.hi") - 1)).alias("ring"))
    return out, visits
