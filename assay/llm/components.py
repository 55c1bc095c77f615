"""Connected components of a link table by alternating large and small stars (Kiveris et al.)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import join_spread, settle


def _large_star(links: DataFrame) -> DataFrame:
    # links run from the greater to the smaller end; a hub has most of its links at its smaller end
    up = links.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = settle(links.select("u", "v").unionByName(up).groupBy("u").agg(
        F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("links")), "star")
    return join_spread(up, least, "u", "links").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    # after a large star the many links of a hub are spread over their other ends, so ``u`` has few rows
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` (its smallest member) for every node of ``links`` (``a``, ``b``) but the smallest ones.

    Links live in tables and a round is a few joins, so neither driver nor task holds a component.  Self links, repeats
    and nulls do not matter; an empty table gives no rows.
    """
    u, v = F.greatest("a", "b"), F.least("a", "b")
    now = settle(links.where("a is not null and b is not null and a <> b").select(u.alias("u"), v.alias("v")).distinct(),
                 "links")
    state = _state(now)
    for _ in range(rounds):
        now = settle(_small_star(settle(_large_star(now), "large-star")), "small-star")
        after = _state(now)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
