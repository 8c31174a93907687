"""Positions within groups, and sums over them, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

PART_BITS = 33  # monotonically_increasing_id: the partition above this bit, the row below


def numbered(rows: DataFrame, group: str, order: list[Column], label: str) -> DataFrame:
    """``rows`` with ``place``: 0, 1, 2, … within each value of ``group``, in ``order``, and ``total``, its rows.

    The rows are sorted by ranges of (group, order), so one group may span any number of tasks,
    and written; a place is the row's number in its range plus the group's rows in the ranges
    before. NULL is a group of its own. Rows equal in ``order`` take any order among themselves,
    and a key of their own spreads many equal rows over ranges.
    """
    keys = [F.col(group).asc_nulls_first(), *order, F.col("spread")]
    ranges = (
        rows.withColumn("spread", F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("spread", F.monotonically_increasing_id())
    )
    lined = staged(ranges, label).withColumn("part", F.shiftright("spread", PART_BITS))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each group and range it lies in.
    starts = (
        lined.groupBy(group, "part")
        .agg(F.min("spread").alias("first"), F.count("*").alias("n"))
        .select(
            F.col(group).alias("of"),
            F.col("part").alias("at"),
            (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
            F.sum("n").over(Window.partitionBy(group)).alias("total"),
        )
    )
    here = F.col(group).eqNullSafe(F.col("of")) & (F.col("part") == F.col("at"))
    return lined.join(starts, here).withColumn("place", F.col("spread") + F.col("shift")).select(*rows.columns, "place", "total")


def running_sums(rows: DataFrame, group: str, place: str, sums: dict[str, str], block: int = 4096) -> DataFrame:
    """``rows`` with running sums within ``group`` by ascending ``place``: ``{new column: summed column}``.

    ``place`` holds distinct integers, each group's in a dense run. Sums are made within blocks of
    ``block`` places, then over the blocks, so a long group is dealt over tasks.
    """
    cut = rows.withColumn("block", F.floor(F.col(place) / block))
    within = Window.partitionBy(group, "block").orderBy(place)
    over = Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        cut.groupBy(F.col(group).alias("of"), F.col("block").alias("at"))
        .agg(*[F.sum(source).alias(f"{new}_sum") for new, source in sums.items()])
        .select("of", "at", *[F.coalesce(F.sum(f"{new}_sum").over(over), F.lit(0)).alias(f"{new}_before") for new in sums])
    )
    here = F.col(group).eqNullSafe(F.col("of")) & (F.col("block") == F.col("at"))
    return (
        cut.withColumns({f"{new}_within": F.sum(source).over(within) for new, source in sums.items()})
        .join(totals, here)
        .select(*rows.columns, *[(F.col(f"{new}_within") + F.col(f"{new}_before")).alias(new) for new in sums])
    )
