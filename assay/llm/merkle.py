"""Merkle manifest of a dataset, with proofs by octopus multiproofs (operator 11).

*Tree.*  A row's leaf is the SHA-256 (lower-case hex text) over its columns, each ``-`` if null and else its UTF-8 length, ``:``
and value.  The leaves of a group (the ``tree`` column) ascend by key.  While a tree has several nodes, every ``FAN``
consecutive ones (the last run: fewer, even one) become the hash of their concatenated hex texts.  What remains is the
group's subroot (a lone leaf is its own); the subroots, by group (null first, bytewise), give the root in the same way.

*Building.*  Leaves are numbered by range partitions and offsets, so a group may hold any share of the rows.  Rounds of
``HEIGHT`` levels follow: aligned blocks of ``FAN ** HEIGHT`` nodes become the nodes above them, each block in one task, until every
tree has one node.

*Proofs.*  A leaf partition is a block of leaves to be proved, all of it or any part.  It computes the union of the node
coordinates that its proofs miss: level by level, the children of the parents of what is known, less what is known
(:func:`missing`).  This minimal union is fetched by one join, in which the nodes of a level have as many copies as
thousands of blocks ask for them.  With it the partition derives the interior nodes that its proofs share and expands
every single proof locally.  What a partition holds is bounded: its block, and ``FAN - 1`` nodes a level at most besides.

Edge cases: null values are ``-``; a null group is a group of its own, before all others; null keys come first; rows that tie
in group and key are ordered by their leaves.  Repeated rows have equal leaves, each with its own place and proof.  Empty
tables have no root and give no row.  Texts of any length are hashed whole.  Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from hashlib import sha256
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.numbering import number_rows
from assay.llm.common import settle

FAN = 16
#: Levels of a block: blocks have FAN ** HEIGHT nodes.
HEIGHT = 3
#: Blocks that may ask for the same copy of a node.
ASKERS = 4096

NODES = "tree string, size long, level int, idx long, hash string"


class Manifest(NamedTuple):
    """``leaves``: key, tree, leaf, presented, number, total; ``nodes``: both kinds of trees above their leaves; ``groups``:
    one row per group with its subroot, place and size; ``root``."""

    leaves: DataFrame
    nodes: DataFrame
    groups: DataFrame
    root: str | None


def digest(values: Sequence[Column]) -> Column:
    """Hex SHA-256 over the values' encodings."""
    def encode(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(
            F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    return F.sha2(F.concat(*[encode(c) for c in values]).cast("binary"), 256)


def tree_key(c: Column) -> Column:
    """A text that is never null and sorts like the value, null first."""
    return F.when(c.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), c.cast("string")))


def _hash(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def counts_above(size: int) -> list[int]:
    """Nodes per level of a tree of ``size`` leaves, from its leaves up to one node."""
    out = [size]
    while out[-1] > 1:
        out.append(-(-out[-1] // FAN))
    return out


def lift(nodes: dict[int, str], base: int, sizes: Sequence[int], height: int) -> dict[tuple[int, int], str]:
    """Nodes at up to ``height`` levels above ``nodes``, which are whole runs of level ``base``."""
    out, level = {}, base
    while level < min(base + height, len(sizes) - 1):
        above = {}
        for parent in sorted({i // FAN for i in nodes}):
            run = range(parent * FAN, min((parent + 1) * FAN, sizes[level]))
            above[parent] = _hash("".join(nodes[i] for i in run))
        level += 1
        out |= {(level, i): h for i, h in above.items()}
        nodes = above
    return out


def missing(known: Iterable[int], size: int) -> list[tuple[int, int]]:
    """The coordinates that proofs of the leaves ``known`` need and that cannot be derived from these leaves and from
    each other: an octopus with one arm per level."""
    sizes, known, out = counts_above(size), set(known), []
    for level in range(len(sizes) - 1):
        parents = {i // FAN for i in known}
        out += sorted((level, i) for p in parents for i in range(p * FAN, min((p + 1) * FAN, sizes[level])) if i not in known)
        known = parents
    return out


# --- building --------------------------------------------------------------------------------------------------------

def _lift_from(base: int):
    def lift_block(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, size = pdf["tree"].iat[0], int(pdf["size"].iat[0])
        nodes = dict(zip(pdf["idx"].tolist(), pdf["hash"].tolist()))
        above = lift(nodes, base, counts_above(size), HEIGHT)
        return pd.DataFrame([(tree, size, lv, i, h) for (lv, i), h in above.items()],
                            columns=["tree", "size", "level", "idx", "hash"])
    return lift_block


def _levels(leaves: DataFrame, name: str) -> DataFrame | None:
    """All nodes above ``leaves`` (tree, size, idx, hash), or None if every tree has only one."""
    base, nodes, layer = 0, None, leaves.where("size > 1")
    while (top := layer.agg(F.max("size")).first()[0]) and len(counts_above(top)) > base + 1:
        block = F.floor(F.col("idx") / FAN ** HEIGHT)
        lifted = layer.select("tree", "size", "idx", "hash", block.alias("block")).groupBy("tree", "block").applyInPandas(
            _lift_from(base), NODES)
        lifted = settle(lifted, f"{name}-{base}")
        base += HEIGHT
        nodes = lifted if nodes is None else nodes.unionByName(lifted)
        layer = lifted.where((F.col("level") == base) & (F.col("size") > F.lit(FAN ** base)))
    return nodes


def build(docs: DataFrame, key: str, tree: str, columns: Sequence[str], presented: Column | None = None) -> Manifest:
    """Hash every row over ``columns`` and build the trees, one per value of ``tree``.

    ``presented`` is a leaf hash that a row claims when it is verified later (see :func:`prove`); null, or none: its own.
    """
    own = digest([F.col(c) for c in columns])
    claimed = F.lit(None).cast("string") if presented is None else presented
    leaves = settle(docs.select(F.col(key).alias("key"), tree_key(F.col(tree)).alias("tree"), own.alias("leaf"),
                                claimed.alias("presented")), "leaves")
    leaves = settle(number_rows(leaves, ["key", "leaf"], ["tree"], "leaf-order"), "numbered-leaves")
    nodes = _levels(leaves.select("tree", F.col("total").alias("size"), F.col("number").alias("idx"),
                                  F.col("leaf").alias("hash")), "nodes")
    # a node is a subroot if its level has no other: it is the only one at index 0 of the highest level of its tree
    lone = leaves.where("total = 1").select("tree", F.col("total").alias("size"), F.col("leaf").alias("subroot"))
    subroots = lone if nodes is None else lone.unionByName(
        nodes.where("idx = 0").groupBy("tree", "size").agg(F.max_by("hash", "level").alias("subroot")))
    groups = settle(number_rows(settle(subroots, "subroots"), ["tree"], (), "subroot-order", "place"), "groups")
    n = groups.count()
    kinds = [] if nodes is None else [nodes.withColumn("top", F.lit(False))]
    root = groups.first()["subroot"] if n else None
    if n > 1:
        upper = _levels(groups.select(F.lit("").alias("tree"), F.lit(n).cast("long").alias("size"),
                                      F.col("place").alias("idx"), F.col("subroot").alias("hash")), "top-nodes")
        root = upper.orderBy(F.desc("level")).first()["hash"]
        kinds.append(upper.withColumn("top", F.lit(True)))
    empty = leaves.sparkSession.createDataFrame([], NODES + ", top boolean")
    every = empty
    for k in kinds:
        every = every.unionByName(k)
    return Manifest(leaves, every, groups, root)


# --- proving ---------------------------------------------------------------------------------------------------------

_ASKED = "tree string, block long, top boolean, level int, idx long"


def _ask(pdf: pd.DataFrame) -> pd.DataFrame:
    """The missing coordinates of one leaf partition, in its own tree and, from its subroot on, in the top tree."""
    tree, block = pdf["tree"].iat[0], int(pdf["block"].iat[0])
    out = [(tree, block, False, lv, i) for lv, i in missing(pdf["number"].tolist(), int(pdf["total"].iat[0]))]
    out += [(tree, block, True, lv, i) for lv, i in missing([int(pdf["place"].iat[0])], int(pdf["n_groups"].iat[0]))]
    return pd.DataFrame(out, columns=["tree", "block", "top", "level", "idx"])


def _climb(known: dict[int, str], fetched: dict[tuple[int, int], str], size: int) -> list[dict[int, str]]:
    """Per level, the nodes that are known, fetched or derived from these: all that the proofs of ``known`` touch."""
    sizes = counts_above(size)
    levels = [dict(known)]
    for level in range(len(sizes)):
        levels[level] |= {i: h for (lv, i), h in fetched.items() if lv == level}
        if level + 1 < len(sizes):
            levels.append({p: _hash("".join(levels[level][i] for i in range(p * FAN, min((p + 1) * FAN, sizes[level]))))
                           for p in {i // FAN for i in known}})
            known = levels[-1].copy()
    return levels


def _runs(levels: list[dict[int, str]], size: int, paths: Iterable[int]) -> list[dict[int, str]]:
    """Per level and parent on a path, the concatenated hashes of the parent's children."""
    sizes, out, on = counts_above(size), [], set(paths)
    for level in range(len(sizes) - 1):
        on = {i // FAN for i in on}
        out.append({p: "".join(levels[level][i] for i in range(p * FAN, min((p + 1) * FAN, sizes[level]))) for p in on})
    return out


def _fold(leaf: str, idx: int, runs: list[dict[int, str]]) -> str:
    """The root that a leaf hash gives in place ``idx``, with its siblings from ``runs``."""
    for level in runs:
        idx, at = divmod(idx, FAN)
        run = level[idx]
        leaf = _hash(run[: 64 * at] + leaf + run[64 * at + 64:])
    return leaf


def _siblings(idx: int, runs: list[dict[int, str]], above: str) -> str:
    """Hashes of the others in the run at each level, up to the root of the tree, then ``above``."""
    parts = []
    for level in runs:
        idx, at = divmod(idx, FAN)
        run = level[idx]
        parts += [run[: 64 * at], run[64 * at + 64:]]
    return "".join(parts) + above


def _prove_block(rows: pd.DataFrame, nodes: pd.DataFrame, proofs: bool) -> pd.DataFrame:
    if not len(rows):
        return pd.DataFrame(columns=["key", "leaf", "subroot", "derived_root", "proof_sha256", "proof", "folded_root"])
    size, place, n_groups = (int(rows[c].iat[0]) for c in ("total", "place", "n_groups"))
    got = {top: {(lv, i): h for lv, i, h in part[["level", "idx", "hash"]].itertuples(index=False)}
           for top, part in nodes.groupby("top")}
    numbers, leaves = rows["number"].tolist(), rows["leaf"].tolist()
    levels = _climb(dict(zip(numbers, leaves)), got.get(False, {}), size)
    subroot = levels[-1][0]
    upper = _climb({place: subroot}, got.get(True, {}), n_groups)
    runs, top_runs = _runs(levels, size, numbers), _runs(upper, n_groups, [place])
    above, root = _siblings(place, top_runs, ""), upper[-1][0]
    hashes, texts = [], []
    for i in numbers:
        text = _siblings(i, runs, above)
        hashes.append(_hash(text))
        texts.append(text if proofs else None)
    folded = [root if claim == leaf else _fold(_fold(claim, i, runs), place, top_runs)
              for i, leaf, claim in zip(numbers, leaves, rows["presented"].tolist())]
    return pd.DataFrame({"key": rows["key"], "leaf": leaves, "subroot": subroot, "derived_root": root,
                         "proof_sha256": hashes, "proof": texts, "folded_root": folded})


def prove(manifest: Manifest, rows: DataFrame | None = None, proofs: bool = False) -> DataFrame:
    """Prove ``rows`` of the manifest's leaves (default: all) against its root.

    Returns ``key, leaf, subroot, root, proof_sha256, proof, folded_root, verified`` per row.  The proof is the hashes of the
    siblings, run by run from the leaf to the root and left to right, 64 hex digits each (null unless ``proofs``), and
    ``proof_sha256`` its hash.  ``folded_root`` is what the presented leaf gives with these siblings; a leaf presented
    unchanged folds to the very nodes that its partition derives.  ``verified`` compares it with the root.
    """
    leaves = manifest.leaves if rows is None else rows
    n_groups = manifest.groups.count()
    block = F.floor(F.col("number") / FAN ** HEIGHT)
    # keys travel as text: whole numbers beside a null would become floating-point in a pandas frame
    parts = leaves.select(F.col("key").cast("string").alias("key"), "tree", "leaf", F.coalesce("presented", "leaf").alias(
        "presented"), "number", "total", block.alias("block"))
    places = manifest.groups.select("tree", "place", F.lit(n_groups).cast("long").alias("n_groups"))
    # each block asks once; of the group table, only one row a block is needed
    blocks = parts.groupBy("tree", "block").agg(F.count(F.lit(1)).alias("n_rows")).join(places, "tree").drop("n_rows")
    known = settle(parts.join(blocks, ["tree", "block"]), "leaf-partitions")
    asked = settle(known.select("tree", "block", "number", "total", "place", "n_groups").groupBy("tree", "block").applyInPandas(
        _ask, _ASKED), "asked")
    n_blocks = asked.select("tree", "block").distinct().count()
    # how many blocks may ask for a node of a level: those below its parent, or for the top tree all
    below = F.pow(F.lit(float(FAN)), F.greatest(F.col("level") + 1 - HEIGHT, F.lit(0)))
    askers = F.when(F.col("top"), F.lit(float(n_blocks))).otherwise(F.least(below, F.lit(float(n_blocks))))
    copies = F.greatest(F.ceil(askers / ASKERS).cast("long"), F.lit(1).cast("long"))
    source = manifest.nodes.select("top", "tree", "level", "idx", "hash").unionByName(manifest.groups.select(
        F.lit(True).alias("top"), F.lit("").alias("tree"), F.lit(0).alias("level"), F.col("place").alias("idx"),
        F.col("subroot").alias("hash")))
    if not asked.where("level = 0 and not top").isEmpty():  # a partition proves a part of its block
        source = source.unionByName(manifest.leaves.select(
            F.lit(False).alias("top"), "tree", F.lit(0).alias("level"), F.col("number").alias("idx"), F.col("leaf").alias("hash")))
    spread = source.select("*", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy")).select(
        "top", F.col("tree").alias("of"), "level", "idx", "copy", "hash")
    wanted = asked.select("*", F.when(F.col("top"), F.lit("")).otherwise(F.col("tree")).alias("of"),
                          F.pmod(F.xxhash64("tree", "block"), copies).alias("copy"))
    fetched = wanted.join(spread, ["top", "of", "level", "idx", "copy"]).select("tree", "block", "top", "level", "idx", "hash")
    kind = leaves.schema["key"].dataType
    out = known.groupBy("tree", "block").cogroup(fetched.groupBy("tree", "block")).applyInPandas(
        lambda a, b: _prove_block(a, b, proofs),
        "key string, leaf string, subroot string, derived_root string, proof_sha256 string, proof string, folded_root string")
    root = F.lit(manifest.root).cast("string")
    return out.select(F.col("key").cast(kind).alias("key"), "leaf", "subroot", root.alias("root"), "proof_sha256", "proof", "folded_root",
                      (F.col("folded_root") == root).alias("verified"))
