"""Explicit row order: Spark tables have none, so order-sensitive steps take one."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import ROW_ID, SORT_KEY, c, require


@dataclass(frozen=True)
class RowOrder:
    """Columns that order the rows, all in one direction, nulls last."""

    keys: tuple[str, ...]
    descending: bool = False

    def columns(self, backwards: bool = False) -> list[Column]:
        out = []
        for key in self.keys:
            # Rows that tie keep their position, in a descending order too.
            down = self.descending and key != ROW_ID
            if backwards:
                out.append(c(key).asc_nulls_first() if down else c(key).desc_nulls_first())
            else:
                out.append(c(key).desc_nulls_last() if down else c(key).asc_nulls_last())
        return out

    def rank_key(self) -> Column:
        """One comparable value per row; see :meth:`first` for its direction."""
        flag = F.isnotnull if self.descending else F.isnull
        return F.struct(*[part for k in self.keys for part in (flag(c(k)), c(k))])

    def first(self, value: Column, last: bool = False) -> Column:
        """Aggregate: the first (or last) non-null value in this order."""
        key = F.when(value.isNotNull(), self.rank_key())
        pick = F.min_by if self.descending == last else F.max_by
        return pick(value, key)


def row_order(df: DataFrame, order_by: Sequence[str] | RowOrder | None) -> RowOrder:
    """The given order, else the hidden file position; without either, refuse to guess."""
    if isinstance(order_by, RowOrder):
        require(df, order_by.keys)
        return order_by
    if order_by:
        return RowOrder(tuple(require(df, [order_by] if isinstance(order_by, str) else order_by)))
    keys = tuple(name for name in (SORT_KEY, ROW_ID) if name in df.columns)
    if keys:
        return RowOrder(keys)
    raise ValueError(
        "this step depends on row order: name the columns in order_by, or read the table "
        "with ordinal=True"
    )
