"""Unions: tables of one schema, and month-end tables of differing columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.dates import parse_dates, period_start
from ..functions.names import c, drop_hidden


def schema_key(df: DataFrame) -> tuple[str, ...]:
    return tuple(name.strip().lower() for name in drop_hidden(df).columns)


def identical_groups(tables: Mapping[str, DataFrame]) -> dict[tuple[str, ...], list[str]]:
    """Table names by their trimmed, lower-cased column names, in order."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for name, table in tables.items():
        groups.setdefault(schema_key(table), []).append(name)
    return groups


def union_identical(
    tables: Mapping[str, DataFrame], merge_identical: bool = False
) -> DataFrame:
    """Stack the tables that share a schema.

    With ``merge_identical`` the largest such group (the first, on a tie), else all tables
    if they agree, else the first table alone. Columns are matched by position.
    """
    if not tables:
        raise ValueError("no tables to unite")
    groups = identical_groups(tables)
    if merge_identical or len(groups) == 1:
        chosen = max(groups.values(), key=len)
    else:
        chosen = [next(iter(tables))]
    return reduce(DataFrame.unionAll, [drop_hidden(tables[name]) for name in chosen])


def consolidate_periods(
    tables: Sequence[DataFrame],
    date: str,
    add_period: bool = True,
    period: str = "Period",
    freq: str = "M",
    sort: bool = True,
) -> DataFrame:
    """Stack tables by column name, parse their dates, add the period start and sort."""
    from .dates import tie_breakers

    if not tables:
        return SparkSession.active().createDataFrame([], T.StructType([]))
    parsed = [parse_dates(drop_hidden(t), [date]) for t in tables]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parsed)
    if add_period:
        out = out.withColumn(period, period_start(c(date), freq))
    if not sort:
        return out
    # Sorting by period and date is sorting by date: a period is a function of the date.
    return out.orderBy(c(date).asc_nulls_last(), *tie_breakers(out))
