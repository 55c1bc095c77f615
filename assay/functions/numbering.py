"""Consecutive numbers in sort order without a window over a whole table or group.

The rows are range-partitioned and sorted, so that every partition holds one stretch of the order.  A row's number is its
place in the partition plus the rows of its group in earlier partitions, and these offsets come from one count per
(group, partition).  A group may hold any share of the rows: it spreads over as many partitions as it fills.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.session import write_scratch

#: Rows that tie in all sort keys are dealt to so many range keys, so that no partition must hold all of them.
TIES = 1024


def running_sum(df: DataFrame, order: str, value: str, within: Sequence[str], name: str = "running", out: str = "before") -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of the group ``within`` that stand before, by ascending ``order``.

    ``order`` is unique within a group.  The rows are cut into ranges that hold about as many rows each, wherever the
    values of ``order`` lie; each (group, range) is summed on its own and gets the sums of the ranges before it.
    """
    within = list(within)
    placed = write_scratch(df.repartitionByRange(*within, order).select("*", F.spark_partition_id().alias("__part")), name)
    w = Window.partitionBy(*within)
    ahead = Window.unboundedPreceding, -1
    sums = placed.groupBy(*within, "__part").agg(F.sum(value).alias("__sum"))
    offsets = sums.select(*within, "__part", F.coalesce(F.sum("__sum").over(w.orderBy("__part").rowsBetween(*ahead)), F.lit(0)).alias("__off"))
    local = F.coalesce(F.sum(value).over(Window.partitionBy(*within, "__part").orderBy(order).rowsBetween(*ahead)), F.lit(0))
    return placed.join(offsets, [*within, "__part"]).select(*df.columns, (F.col("__off") + local).alias(out))


def number_rows(df: DataFrame, order: Sequence[str], within: Sequence[str] = (), name: str = "numbers",
                number: str = "number", total: str = "total") -> DataFrame:
    """``df`` with ``number``: 0, 1, ... in ascending ``order`` (nulls first) within each group of the columns ``within``,
    and, for groups, ``total``: the rows of the group.  A null group is a group.

    Rows that tie are numbered in any order, so ``order`` should end in a unique column unless tied rows are alike.  The
    sorted rows are written to the shared scratch folder first: a lost executor cannot change places already given.
    """
    keys, within = [*within, *order], list(within)
    tie = F.pmod(F.monotonically_increasing_id(), F.lit(TIES)).cast("int")
    dealt = df.select("*", tie.alias("__tie")).repartitionByRange(*keys, "__tie").sortWithinPartitions(*keys, "__tie")
    placed = dealt.select(*df.columns, F.spark_partition_id().alias("__part"),
                          F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"))
    placed = write_scratch(placed, name)
    counts = placed.groupBy(*within, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__lo"))
    if not within:
        # one row per partition, so the table is bounded by the number of partitions
        parts = sorted(counts.select("__part", "__n").collect())
        if len(parts) < 2:
            return placed.select(*df.columns, F.col("__at").alias(number))
        before = [0, *accumulate(n for _, n in parts)][:-1]
        offsets = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(parts, before)], "__part int, __before long")
        return placed.join(F.broadcast(offsets), "__part").select(
            *df.columns, (F.col("__before") + F.col("__at")).alias(number))
    w = Window.partitionBy(*within)
    before = F.sum("__n").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*[F.col(c).alias(f"__w{i}") for i, c in enumerate(within)], F.col("__part").alias("__p"),
                            (F.coalesce(before, F.lit(0)) - F.col("__lo")).alias("__shift"),
                            F.sum("__n").over(w).alias("__total"))
    same = [F.col(c).eqNullSafe(F.col(f"__w{i}")) for i, c in enumerate(within)]
    joined = placed.join(offsets, [F.col("__part") == F.col("__p"), *same])
    return joined.select(*df.columns, (F.col("__shift") + F.col("__at")).alias(number), F.col("__total").alias(total))
