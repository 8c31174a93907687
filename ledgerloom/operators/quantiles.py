"""Exact quantiles per group whose state stays small, however large a group is.

Spark's ``percentile`` keeps every distinct value of a group in one task. Here a group that fits
a task is sorted in one. In larger ones each wanted rank is closed in on by rounds:

1. mergeable sketches, made per task, merged per lane and then per group, cut the values around the
   rank into cells of equal depth,
2. the cells' rows are counted, one row per cell and task, which tells exactly which cell holds the
   rank, whatever the sketch was worth,
3. that cell is cut again, and the different values of the last ones are put in order.

Each step uses the one before once, so the plan grows with the rounds only, and where no group is large
AQE drops all of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import c

ONE_TASK = 1_000_000  # values that are sorted in one task without more ado
# Groups beyond that size and this share of all rows, hence fewer than so many, are cut into cells.
HOT_SHARES = 10_000
ACCURACY = 2048  # of a sketch, which errs by about a quarter of a percent of the ranks
LANES = 64  # partial merges of a group's sketches
CELL = 0.002  # share of a group's ranks in a cell of the first round
CELLS = 8  # such cells on each side of a rank
PARTS = 64  # cells that a cell is cut into afterwards
ROUNDS = 2  # the last leaves about CELL / PARTS of a group in a cell


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """One row per group of ``by``: ``q0``, ``q1``, ... for the probabilities ``probs``.

    ``value`` must be a double column; NULL is ignored and linear interpolation is used.
    """
    groups = [f"__g{i}" for i in range(len(by))]
    data = df.select(*[c(k).alias(g) for k, g in zip(by, groups)], c(value).alias("__v"))
    data = data.filter("__v IS NOT NULL")
    ordered = sorted(set(probs))
    ranks = _ranks(ordered)
    # Fewer than HOT_SHARES rows, so everything made from them may be broadcast.
    hot = _hot_groups(data, groups)
    united = _sorted_groups(data, hot, groups).unionByName(_cut_groups(data, hot, groups, ordered))
    picks = [_value_at(rank).alias(f"__r{i}") for i, rank in enumerate(ranks)]
    found = united.groupBy(*groups).agg(F.max("__n").alias("__n"), *picks)
    return found.select(
        *[F.col(g).alias(k) for g, k in zip(groups, by)],
        *[_interpolated(ordered.index(p), p).alias(f"q{i}") for i, p in enumerate(probs)],
    )


def _position(p: float) -> Column:
    return (F.col("__n") - 1) * F.lit(float(p))


def _rank(p: float) -> Column:
    return F.floor(_position(p))


def _ranks(probs: Sequence[float]) -> list[Column]:
    """The two ranks around each probability."""
    return [rank for p in probs for rank in (_rank(p), F.least(_rank(p) + 1, F.col("__n") - 1))]


def _interpolated(i: int, p: float) -> Column:
    a, b = F.col(f"__r{2 * i}"), F.col(f"__r{2 * i + 1}")
    part = _position(p) - _rank(p)
    # A part of 0 times an infinite neighbour would be no number.
    return F.when((a == b) | (part == 0), a).otherwise(a * (1 - part) + b * part)


def _value_at(rank: Column) -> Column:
    """Aggregate: the value at a rank, from rows that hold the ranks ``__begin`` up to ``__end``."""
    return F.max(F.when((rank >= F.col("__begin")) & (rank < F.col("__end")), F.col("__v")))


def _same(names: Sequence[str], suffix: str) -> Column:
    return reduce(and_, [F.col(n).eqNullSafe(F.col(n + suffix)) for n in names])


def _hot_groups(data: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(groups, __n) of those that are handled apart."""
    sizes = data.groupBy(*groups).agg(F.count("*").alias("__n"))
    rows = sizes.agg(F.sum("__n")).scalar()
    return sizes.filter((F.col("__n") > ONE_TASK) & (F.col("__n") * HOT_SHARES > rows))


def _sorted_groups(data: DataFrame, hot: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Every value of the other groups with its rank."""
    names = hot.select(*[F.col(g).alias(g + "h") for g in groups])
    others = data.join(F.broadcast(names), _same(groups, "h"), "left_anti")
    group = Window.partitionBy(*groups)
    # In this order one sort serves both windows.
    ranked = others.withColumn("__end", F.row_number().over(group.orderBy("__v")).cast("bigint"))
    return ranked.select(
        *groups, F.count("*").over(group).alias("__n"), "__end", "__v", (F.col("__end") - 1).alias("__begin")
    )


def _cut_groups(data: DataFrame, hot: DataFrame, groups: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """The different values, with their ranks, of the cells that hold a wanted one."""
    everything = [F.lit(x).cast("double").alias(n) for n, x in (("__low", "-inf"), ("__high", "inf"))]
    cells = hot.select(*groups, "__n", F.lit(0).cast("bigint").alias("__begin"), F.col("__n").alias("__rows"), *everything)
    shares = sorted({min(max(p + step * CELL, 0.0), 1.0) for p in probs for step in range(-CELLS, CELLS + 1)})
    for _ in range(ROUNDS):
        cells = _holding(_cut(data, cells, groups, shares), _ranks(probs))
        shares = [part / PARTS for part in range(1, PARTS)]
    values = _within(data, cells, groups).groupBy(*groups, "__n", "__begin", "__v").agg(F.count("*").alias("__rows"))
    upwards = Window.partitionBy(*groups, "__begin").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("__begin") + F.sum("__rows").over(upwards)
    return values.select(*groups, "__n", end.alias("__end"), "__v", (end - F.col("__rows")).alias("__begin"))


def _within(data: DataFrame, cells: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The rows of ``data`` in a cell, with the cell's columns. Cells are disjoint."""
    named = cells.withColumnsRenamed({g: g + "c" for g in groups})
    bounds = (F.col("__v") >= F.col("__low")) & (F.col("__v") <= F.col("__high"))
    return data.join(F.broadcast(named), _same(groups, "c") & bounds).drop(*[g + "c" for g in groups])


def _cut(data: DataFrame, cells: DataFrame, groups: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """The cells cut at ``shares`` of their values; bounds are values, lowest and highest of a cell."""
    cell = [*groups, "__n", "__begin", "__low", "__high"]
    sketches = (
        _within(data, cells, groups)
        .withColumn("__lane", F.pmod(F.spark_partition_id(), F.lit(LANES)))
        .groupBy(*cell, "__lane")
        .agg(F.kll_sketch_agg_double("__v", F.lit(ACCURACY)).alias("__sketch"))
        .groupBy(*cell)
        .agg(F.kll_merge_agg_double("__sketch", F.lit(ACCURACY)).alias("__sketch"))
    )
    # As SQL text, which is quicker to build than as many columns.
    depths = F.expr(f"array({', '.join(f'{share!r}D' for share in shares)})")
    passed = F.expr(" + ".join(f"int(__v > __cuts[{i}])" for i in range(len(shares))))
    cuts = sketches.select(*cell, F.kll_sketch_get_quantile_double("__sketch", depths).alias("__cuts"))
    counted = (
        _within(data, cuts, groups)
        .select(*groups, "__n", "__begin", "__v", passed.alias("__cell"))
        .groupBy(*groups, "__n", "__begin", "__cell")
        .agg(F.count("*").alias("__rows"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    )
    before = Window.partitionBy(*groups, "__begin").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__rows").over(before), F.lit(0))
    return counted.select(*groups, "__n", (F.col("__begin") + shift).alias("__begin"), "__rows", "__low", "__high")


def _holding(cells: DataFrame, ranks: Sequence[Column]) -> DataFrame:
    begin, end = F.col("__begin"), F.col("__begin") + F.col("__rows")
    return cells.filter(reduce(or_, [(rank >= begin) & (rank < end) for rank in ranks]))
