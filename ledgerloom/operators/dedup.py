"""Duplicate removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import c, require, visible
from ..functions.ordering import RowOrder, row_order

KEEP_NONE = (False, None, "False", "false", "none")


def drop_duplicates(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    keep: str | bool = "first",
    order_by: Sequence[str] | RowOrder | None = None,
) -> DataFrame:
    """Keep the first, the last or (``False``) no copy of rows equal in ``subset``.

    However often one key occurs, a map task sends at most one row of it through the
    shuffle: by the window's group limit (first, last) or by partial aggregation (False).
    Nulls are equal to each other.
    """
    keys = require(df, subset or visible(df))
    if keep in KEEP_NONE:
        return _only_unique(df, keys)
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be 'first', 'last' or False, not {keep!r}")
    if set(keys) == set(df.columns):
        return df.dropDuplicates()  # the copies are identical
    if set(keys) == set(visible(df)) and not order_by:
        return df.dropDuplicates(keys) if keep == "first" else _pick(df, keys, keep, order_by)
    return _pick(df, keys, keep, order_by)


def _pick(df: DataFrame, keys, keep, order_by) -> DataFrame:
    order = row_order(df, order_by).columns(backwards=keep == "last")
    window = Window.partitionBy(*[c(k) for k in keys]).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(window)).filter("__rn = 1").drop("__rn")


def _only_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    # A group of one row is that row, so any_value restores each of its cells; larger
    # groups are dropped. Fixed-width cells keep this a hash aggregate.
    rest = {name: f"__cell{i}" for i, name in enumerate(df.columns) if name not in keys}
    cells = [F.any_value(c(name)).alias(token) for name, token in rest.items()]
    groups = df.groupBy(*[c(k) for k in keys]).agg(F.count("*").alias("__n"), *cells)
    return groups.filter("__n = 1").select(
        *[F.col(rest[name]).alias(name) if name in rest else c(name) for name in df.columns]
    )
