"""Near duplicates by a chosen-path set similarity join (operator 8).

A document is its set of distinct word shingles.  Documents with equal sets form a class, found by a digest, and only one row
per class goes on.  Each class has a signature of ``K`` minwise hashes.  Independent trees then split all classes recursively
(Christiani, Pagh and Sivertsen, "Scalable and robust set similarity join"): a node picks, by its own hash, 1 / threshold
positions of the signature on average, and a class moves to one child for each of them, named by its minwise token there.  Two sets at
the threshold stay together in one child on average, others part quickly.  A node with few classes is compared exhaustively by
signatures, a larger one goes on.  ``TREES`` trees are grown first and, since a pair's chance falls with every level, further ones until a
pair at the threshold is parted in all of them with a chance below ``MISS`` at the deepest level (``trees_for``).

Groups of thousands of near copies part slowly or never, and a list of their pairs would grow with the square of their size.
So a node names no pairs but connects what its pairs that may be linked connect, in stars, and a large node links its
members to one of them.  The stars of all nodes, joined by connected components, are *families*: every link lies inside a
family.  Families that still fill large nodes at ``DENSE_LEVEL`` are resolved on the full shingle sets before the trees go
on: dealt at random into chunks of bounded size, every chunk with the same ``PIVOTS`` members, so that whatever is densely linked
is connected by confirmed links.  From then on a node whose members are already connected is done, a node with
few members (``DENSE``) outside its largest connected set compares those with all others, again in chunks, and only the
remaining nodes split on, at the end into pairs of chunks.  The other families are resolved on their full sets, which are
shipped once: pairs are tested exactly, those already connected are skipped.  A family too large for one task is resolved in the
nodes that its classes met in, each again of bounded size.

Tables of entries, families and links stay distributed; the driver sees counts.  Edge cases: a null, empty or blank text has
an empty set, no links, and is its own component; a text shorter than a shingle is one shingle of all its words; rows that
repeat a key count as one document, linked by any of its texts; ties go to the smallest key; an empty table gives no
rows; keys must be integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import Words, join_spread, mix, ngram_hashes, settle, text_or_empty, words_of
from assay.llm.components import components

K = 128
#: Trees that are grown first, and the chance to miss a pair at the threshold that the trees grown in the end stay below.
TREES, MISS = 10, 1e-3
#: Levels that every tree takes before node sizes are counted.
FIRST_LEVELS = 3
#: Classes that a node compared exhaustively may hold: at first, and once unrelated sets have parted (from this level on).
SMALL, DENSE, DENSE_LEVEL = 64, 2048, 4
#: How far below the threshold a pair still is a candidate.
SLACK = 0.12
#: Classes, and shingles in all, of a family that one task resolves.
FAMILY, FAMILY_ITEMS = 4096, 8_000_000
#: Members (on average) that all chunks of a larger family share, and levels from one attempt to connect families to the next.
PIVOTS, CONNECT_EVERY = 64, 4
#: From ``PAIR_LEVEL`` on, nodes of at most ``PAIR_CHUNKS`` chunks are compared chunk by chunk; after ``LAST_LEVEL`` all are.
PAIR_LEVEL, PAIR_CHUNKS, LAST_LEVEL = 12, 8, 60

_RNG = np.random.default_rng(8)
_A = _RNG.integers(1, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, K, dtype=np.uint64)


# --- sets and signatures --------------------------------------------------------------------------------------------

def shingle_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending within a row, and the rows' first indexes (``rows + 1``)."""
    h, row = w.ngrams(n)
    counts = np.diff(w.first)
    for r in np.flatnonzero((counts > 0) & (counts < n)):
        whole = ngram_hashes(w.hash[w.first[r]: w.first[r + 1]], int(counts[r]))
        h, row = np.append(h, whole), np.append(row, r)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]
        h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(w.rows + 1))


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minwise hashes (uint32, ``K`` columns) of the sets that are not empty."""
    starts = first[:-1][np.diff(first) > 0]
    out = np.empty((len(starts), K), np.uint32)
    for k in range(K):
        out[:, k] = np.minimum.reduceat((h * _A[k] + _B[k]) >> np.uint64(32), starts)
    return out


def _sign(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, digests, sigs = np.zeros(b.num_rows, np.int64), [None] * b.num_rows, [None] * b.num_rows
            for lo, hi, w in words_of(b.column(1)):
                h, first = shingle_sets(w, n)
                sizes[lo:hi] = np.diff(first)
                if not len(h):
                    continue
                sig = signatures(h, first)
                for j, r in enumerate(np.flatnonzero(np.diff(first))):
                    digests[lo + r] = hashlib.blake2b(h[first[r]: first[r + 1]].tobytes(), digest_size=16).digest()
                    sigs[lo + r] = sig[j].tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())],
                names=["doc", "n", "digest", "sig"])
    return run


def _full_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in words_of(b.column(1)):
                h, first = shingle_sets(w, n)
                sets = [h[first[r]: first[r + 1]].tobytes() for r in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())],
                                                 names=["doc", "items"])
    return run


# --- trees ----------------------------------------------------------------------------------------------------------

def _matrix(col: pa.Array, width: int, kind) -> np.ndarray:
    """The rows of a binary column of fixed width."""
    _, offsets, data = col.buffers()
    if not len(col):
        return np.zeros((0, width), kind)
    lo = np.frombuffer(offsets, np.int32)[col.offset]
    size = width * np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8)[lo: lo + size * len(col)].view(kind).reshape(len(col), width)


def children(node: np.ndarray, row: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Child nodes of entries (``node``, ``row`` into ``sig``), and their rows."""
    nodes, rows = [], []
    at = mix(node ^ np.uint64(0xA24BAED4963EE407))
    for j in range(int(np.ceil(1 / threshold))):
        draw = mix(at + np.uint64(j))
        chance = min(1.0, 1 / threshold - j)
        pick = np.flatnonzero((draw >> np.uint64(11)).astype(float) * 2.0 ** -53 < chance)
        # distinct positions for the picks of one node
        pos = ((at[pick] >> np.uint64(7)) + np.uint64(j * 37)) % np.uint64(K)
        value = sig[row[pick], pos.astype(np.int64)].astype(np.uint64)
        nodes.append(mix(mix(node[pick] + (pos << np.uint64(33))) + value))
        rows.append(row[pick])
    return np.concatenate(nodes), np.concatenate(rows)


def _entries(keys: pa.Array, node: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), keys.take(pa.array(row))], names=["node", "cls"])


def trees_for(depth: int, threshold: float) -> int:
    """Trees after which a pair at ``threshold`` has been parted in all of them, ``depth`` levels down, with a chance below ``MISS``.

    The pair goes on in each child of a node with the chance of its similarity, independently: a branching process.
    """
    parted = 0.0
    for _ in range(depth):
        parted = float(np.prod([1 - threshold * min(1.0, 1 / threshold - j) * (1 - parted)
                                for j in range(int(np.ceil(1 / threshold)))]))
    return max(TREES, int(np.ceil(np.log(MISS) / np.log(parted)))) if parted > 0 else TREES


def _plant(threshold: float, trees: range):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = _matrix(b.column(1), K, np.uint32)
            node = np.repeat(mix(np.arange(trees.start + 1, trees.stop + 1).astype(np.uint64)), b.num_rows)
            row = np.tile(np.arange(b.num_rows), len(trees))
            for _ in range(FIRST_LEVELS):
                node, row = children(node, row, sig, threshold)
            yield _entries(b.column(0), node, row)
    return run


def _grow(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            node = lists.flatten().to_numpy().astype(np.int64).view(np.uint64)
            row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            node, row = children(node, row, _matrix(b.column(1), K, np.uint32), threshold)
            yield _entries(b.column(0), node, row)
    return run


# --- comparison of nodes --------------------------------------------------------------------------------------------

def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarity from signatures cut to one byte a position (equal by chance once in 256)."""
    return ((x == y).mean(-1) - 1 / 256) / (1 - 1 / 256)


class _Forest:
    """Union-find over the rows of a batch."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b

    def parent_to(self, rows: list[int], root: int):
        for r in rows:
            self.parent[r] = root

    def stars(self) -> list[tuple[int, int]]:
        """Every row but the first of its component, with that first one."""
        return [(r, x) for x in range(len(self.parent)) if (r := self.find(x)) != x]


def _runs(cell: np.ndarray) -> np.ndarray:
    """First indexes of runs of equal values, and the length."""
    return np.r_[0, np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell)]


def spanning_stars(cell: np.ndarray, sig: np.ndarray, low: float) -> list[tuple[int, int]]:
    """Pairs of rows that connect what candidate pairs (agreement at least ``low``, same cell) connect: every row with the first
    one it is connected to.  Input sorted by cell."""
    edge = _runs(cell)
    size = np.diff(edge)
    forest = _Forest(len(cell))
    spread = np.repeat(size, size)
    for d in range(1, int(min(size.max(initial=0), SMALL + 1))):
        i = np.flatnonzero((cell[:-d] == cell[d:]) & (spread[:-d] <= SMALL)) if d < len(cell) else np.zeros(0, np.int64)
        for at in range(0, len(i), 1 << 15):
            part = i[at: at + (1 << 15)]
            for a in part[agreement(sig[part], sig[part + d]) >= low].tolist():
                forest.join(a, a + d)
    for c in np.flatnonzero(size > SMALL):
        # breadth first: a row reached is compared once with all rows not reached yet
        left = np.arange(edge[c], edge[c + 1])
        while len(left):
            root, left = int(left[0]), left[1:]
            front = [root]
            while front and len(left):
                near = agreement(sig[left], sig[front.pop()]) >= low
                forest.parent_to(left[near].tolist(), root)
                front += left[near].tolist()
                left = left[~near]
    return forest.stars()


def _by_cell(flush):
    """Run ``flush`` on whole cells of input sorted by its first column; a cell may span batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            cell = b.column(0).to_numpy()
            cut = int(_runs(cell)[-2])  # the last cell may go on
            if cut or held and held[-1].column(0)[-1].as_py() != cell[0]:
                yield from flush(held + [b.slice(0, cut)] if cut else held)
                held = []
            held.append(b.slice(cut))
        if held:
            yield from flush(held)
    return run


def _joined(parts: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(parts).combine_chunks()


def _pair_batch(cls: np.ndarray, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    x = cls[np.array(pairs, np.int64).reshape(-1, 2)]
    x = x[x[:, 0] != x[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(x.min(1)), pa.array(x.max(1))], names=["a", "b"])


def _candidates(low: float):
    def flush(parts):
        t = _joined(parts)
        sig = _matrix(t.column(2).combine_chunks(), K, np.uint8)
        yield _pair_batch(t.column(1).to_numpy(), spanning_stars(t.column(0).to_numpy(), sig, low))
    return _by_cell(flush)


def _near_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        close = agreement(_matrix(b.column(3), K, np.uint8), _matrix(b.column(4), K, np.uint8))
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(close)], names=["node", "cls", "pivot", "close"])


# --- exact check and result -----------------------------------------------------------------------------------------

def _linked(x: np.ndarray, y: np.ndarray, pct: int) -> bool:
    if 100 * min(len(x), len(y)) < pct * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= pct * (len(both) - inter)


def exact_links(sets: list[np.ndarray], pct: int) -> list[tuple[int, int]]:
    """Pairs that connect what links connect: every set with the first one it is connected to.

    Links are tested on the sets; pairs already connected are skipped.
    """
    n = len(sets)
    part = np.arange(n)  # the first set each is connected to
    sig = None
    if n > 8:
        first = np.r_[0, np.cumsum([len(s) for s in sets])]
        sig = (signatures(np.concatenate(sets), first) & np.uint32(0xFF)).astype(np.uint8)
    for i in range(n - 1):
        rest = i + 1 + np.flatnonzero(part[i + 1:] != part[i])
        if sig is not None and len(rest):
            close = agreement(sig[rest], sig[i])
            near = close >= pct / 100 - SLACK
            rest = rest[near][np.argsort(-close[near], kind="stable")]
        for j in rest.tolist():
            if part[i] != part[j] and _linked(sets[i], sets[j], pct):
                lo, hi = sorted((part[i], part[j]))
                part[part == hi] = lo
    return [(r, x) for x, r in enumerate(part.tolist()) if r != x]


def _resolve(pct: int):
    """Links of each cell: columns ``cell, cls, items``, sorted by cell."""
    def flush(parts):
        t = _joined(parts)
        cls, items = t.column(1).to_numpy(), t.column(2).combine_chunks()
        edge = _runs(t.column(0).to_numpy())
        pairs = []
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            sets = [np.frombuffer(items[k].as_buffer(), np.uint64) for k in range(lo, hi)]
            pairs += [(lo + i, lo + j) for i, j in exact_links(sets, pct)]
        yield _pair_batch(cls, pairs)
    return _by_cell(flush)


def _members(classes: DataFrame, edges: list[DataFrame]) -> DataFrame:
    """Families (``cell, cls, n``) that the edges connect, ``cell`` being the smallest member."""
    families = components(reduce(DataFrame.unionByName, edges).distinct())
    roots = families.select(F.col("component").alias("cls"), F.col("component").alias("cell")).distinct()
    return settle(families.select(F.col("node").alias("cls"), F.col("component").alias("cell")).unionByName(roots).join(
        classes.select("cls", "n"), "cls"), "families")


def _confirmed(docs: DataFrame, rows: DataFrame, n: int, pct: int) -> DataFrame:
    """Links (``a, b``) that connect what confirmed links connect within each cell (``cell, cls``)."""
    texts = docs.join(rows.select(F.col("cls").alias("doc")).distinct(), "doc", "left_semi")
    sets = settle(texts.mapInArrow(_full_sets(n), "doc long, items binary").where("octet_length(items) > 0")
                  .dropDuplicates(["doc", "items"]), "sets")
    dealt = rows.join(sets, F.col("cls") == F.col("doc")).select("cell", "cls", "items").repartition("cell")
    return settle(dealt.sortWithinPartitions("cell", "cls").mapInArrow(_resolve(pct), "a long, b long"), "links")


def _chunk(level: int):
    return F.pmod(F.xxhash64("cls", F.lit(level)), F.col("chunks")).cast("int")


def _every_chunk():
    return F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))


def _connect(docs: DataFrame, classes: DataFrame, edges: list[DataFrame], large: DataFrame, n: int, pct: int,
             level: int) -> tuple[DataFrame, DataFrame]:
    """Confirmed links (``a, b``) of the families in large nodes, and those of them compared whole (``cls, family``).

    A family of one chunk is compared whole.  Of a larger one every chunk is, with the members that all chunks share.
    """
    member = _members(classes, edges)
    dense = member.join(large.select("cls").distinct(), "cls", "left_semi").select("cell").distinct()
    sizes = member.join(dense, "cell", "left_semi").groupBy("cell").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n").alias("items"))
    chunks = settle(sizes.select("cell", "size", F.ceil(F.greatest(
        F.col("size") / FAMILY, F.col("items") / FAMILY_ITEMS)).cast("int").alias("chunks")), "chunks")
    rows = member.join(chunks, "cell")
    own = rows.select("cell", _chunk(level).alias("chunk"), "cls")
    # a draw by hash, so that no task ranks a family
    drawn = F.pmod(F.xxhash64("cls", F.lit(-1 - level)), F.col("size")) < PIVOTS
    shared = rows.where((F.col("chunks") > 1) & drawn).select("cell", _every_chunk().alias("chunk"), "cls")
    dealt = own.unionByName(shared).distinct().select(F.xxhash64("cell", "chunk").alias("cell"), "cls")
    return _confirmed(docs, dealt, n, pct), rows.where("chunks = 1").select("cls", F.col("cell").alias("family"))


def _last_cells(large: DataFrame, label: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """What large nodes (``node, cls``) still have to compare: cells of bounded size, and entries that split on.

    Classes with one label (``cls, label``) need no comparison among themselves.
    """
    named = settle(large.select("node", "cls").join(label, "cls", "left").select(
        "node", "cls", F.coalesce("label", "cls").alias("label")), "named")
    tally = named.groupBy("node", "label").agg(F.count(F.lit(1)).alias("votes")).groupBy("node").agg(
        F.max_by("label", "votes").alias("major"), F.max("votes").alias("most"), F.sum("votes").alias("size"))
    few = F.col("size") - F.col("most") <= DENSE
    pairs = F.lit(True) if level >= LAST_LEVEL else (F.col("size") <= PAIR_CHUNKS * DENSE) & F.lit(level >= PAIR_LEVEL)
    how = F.when(few, "few").when(pairs, "pairs").otherwise("split")
    tally = tally.where("most < size").select("node", "major", how.alias("how"), F.ceil(
        F.when(few, F.col("most")).otherwise(F.col("size")) / DENSE).cast("int").alias("chunks"))
    rows = settle(named.join(tally, "node"), "open")
    few, pairs = rows.where("how = 'few'"), rows.where("how = 'pairs'")
    own = few.where("label = major").select("node", _chunk(level).alias("chunk"), "cls")
    other = few.where("label <> major").select("node", _every_chunk().alias("chunk"), "cls")
    met = own.unionByName(other).select(F.xxhash64("node", "chunk").alias("cell"), "cls")
    with_all = pairs.select("node", "cls", _chunk(level).alias("i"), _every_chunk().alias("j"))
    met = met.unionByName(with_all.select(F.xxhash64("node", F.least("i", "j"), F.greatest("i", "j")).alias("cell"), "cls"))
    return met, rows.where("how = 'split'").select("node", "cls")


def _grow_cells(docs: DataFrame, classes: DataFrame, n: int, pct: int, trees: range, cells: list, edges: list, links: list,
                label: DataFrame | None) -> tuple[DataFrame | None, int]:
    """Grow ``trees`` over ``classes`` (``cls, n, sig, sig8``) and append to what earlier trees found: cells (``cell, cls``),
    family edges and confirmed links (``a, b``).  Returns the label of classes that need no comparison among themselves
    (``cls, label``; None if there are none), and the deepest level."""
    sig8 = classes.select("cls", "sig8")
    threshold = pct / 100
    low = threshold - SLACK
    entries = settle(classes.select("cls", "sig").mapInArrow(_plant(threshold, trees), "node long, cls long"), "entries")
    for level in range(FIRST_LEVELS, LAST_LEVEL + 1):
        most = SMALL if level < DENSE_LEVEL else DENSE
        # other pivots in other nodes, so that no odd one out stands for a group everywhere
        sizes = settle(entries.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min_by(
            "cls", F.xxhash64("cls", "node")).alias("pivot")).where("size > 1"), "nodes")
        largest = sizes.agg(F.max("size")).first()[0]
        if largest is None:
            break
        shared = settle(entries.join(sizes, "node"), "shared")
        met = shared.where(f"size <= {most}").select(F.col("node").alias("cell"), "cls")
        large = going = shared.where(f"size > {most}")
        # further trees start from the labels that are known
        connect = level >= DENSE_LEVEL and (level - DENSE_LEVEL) % CONNECT_EVERY == 0 and (level > DENSE_LEVEL or label is None)
        if largest > most and (connect or level < DENSE_LEVEL):
            pivots = settle(large.select("pivot").distinct().join(
                sig8.select(F.col("cls").alias("pivot"), F.col("sig8").alias("pivot_sig")), "pivot"), "pivots")
            near = settle(large.select("node", "cls", "pivot").join(sig8, "cls").join(pivots, "pivot").select(
                "node", "cls", "pivot", "sig8", "pivot_sig").mapInArrow(
                _near_pivot, "node long, cls long, pivot long, close double"), "near-pivot")
            edges.append(near.where(f"close >= {low} and cls <> pivot").select(
                F.col("pivot").alias("a"), F.col("cls").alias("b")).distinct())
        if largest > most and level >= DENSE_LEVEL:
            if connect:
                found, whole = _connect(docs, classes, edges, large, n, pct, level)
                links.append(found)
                # links never leave a family, and families only grow
                known = components(reduce(DataFrame.unionByName, links)).withColumnRenamed("node", "cls")
                label = settle(known.join(whole, "cls", "full").select(
                    "cls", F.coalesce("family", "component").alias("label")), "label")
            chunked, going = _last_cells(large, label, level)
            met = met.unionByName(chunked)
        cells.append(met)
        dealt = met.join(sig8, "cls").select("cell", "cls", "sig8").repartition("cell").sortWithinPartitions(
            "cell", "cls")
        edges.append(settle(dealt.mapInArrow(_candidates(low), "a long, b long"), "edges"))
        if largest <= most:
            break
        lists = going.groupBy("cls").agg(F.collect_list("node").alias("nodes"))
        entries = settle(classes.select("cls", "sig").join(lists, "cls").select("cls", "sig", "nodes").mapInArrow(
            _grow(threshold), "node long, cls long"), "entries")
    return label, level


def similar_pairs(docs: DataFrame, classes: DataFrame, n: int, pct: int) -> DataFrame:
    """Pairs ``a < b`` of classes (``cls, n, sig, sig8``) that connect exactly what confirmed links connect."""
    cells, edges, links, label = [], [], [], None
    grown, wanted = 0, TREES
    while grown < wanted:
        label, depth = _grow_cells(docs, classes, n, pct, range(grown, wanted), cells, edges, links, label)
        grown, wanted = wanted, max(wanted, trees_for(depth, pct / 100))
    if not cells:
        return classes.limit(0).select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    member = _members(classes, edges + links)
    sizes = member.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("items"))
    giant = settle(sizes.where(f"size > {FAMILY} or items > {FAMILY_ITEMS}").select("cell"), "giants")
    rows = member.join(giant, "cell", "left_anti").select("cell", "cls")
    if giant.take(1):
        met = member.join(giant, "cell", "left_semi").select("cls")
        rows = rows.unionByName(reduce(DataFrame.unionByName, cells).join(met, "cls", "left_semi"))
    if label is not None:
        # cells with one label are settled
        rows = settle(rows.join(label, "cls", "left").select("cell", "cls", F.coalesce("label", "cls").alias("label")), "rows")
        mixed = rows.groupBy("cell").agg((F.min("label") < F.max("label")).alias("mixed")).where("mixed").select("cell")
        rows = rows.join(mixed, "cell", "left_semi").select("cell", "cls")
    return reduce(DataFrame.unionByName, [*links, _confirmed(docs, rows, n, pct)])


def near_duplicates(docs: DataFrame, shingle: int = 5, pct: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row.

    Documents with ``100 * intersection >= pct * union`` of their shingle sets are linked; a component is named by its smallest
    key, which is the one kept.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc"), text_or_empty(text).alias("text"))
    signed = settle(rows.mapInArrow(_sign(shingle), "doc long, n long, digest binary, sig binary"), "signed")
    # the partial aggregate leaves one row per class and map task, however many copies there are
    low_bytes = F.expr("unhex(array_join(transform(sequence(1, %d, 4), i -> hex(substring(sig, i, 1))), ''))" % (4 * K))
    tally = settle(signed.where("n > 0").groupBy("digest").agg(
        F.min("doc").alias("cls"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("copies")), "tally")
    classes = settle(tally.where("cls is not null").select("cls", "n", "sig", low_bytes.alias("sig8")), "classes")
    found = components(similar_pairs(rows, classes, shingle, pct))
    named = settle(tally.select("digest", "cls", "copies").join(found, F.col("cls") == F.col("node"), "left").select(
        "digest", F.coalesce("component", "cls").alias("component_id"), "copies"), "named")
    out = join_spread(signed.select("doc", "n", "digest"), named, "digest", "copies")
    component = F.coalesce("component_id", "doc")
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"))
