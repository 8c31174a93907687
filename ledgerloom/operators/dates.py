"""Date steps: standardise, range filter, sort, weekend flag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULTS
from ..functions.dates import DATE_FORMATS, parse_dates, timestamp_literal
from ..functions.names import ROW_ID, c, require


def standardize_date(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    formats: Sequence[str] = DATE_FORMATS,
    dayfirst: bool | None = None,
) -> DataFrame:
    """Parse date columns; by default the ``Date`` column if the table has one.

    Each column is read day first or month first as most of its texts ask for, or as ``dayfirst`` says.
    """
    if not columns:
        columns = [DEFAULTS.date] if DEFAULTS.date in df.columns else []
    return parse_dates(df, columns, formats, dayfirst)


def filter_date_range(
    df: DataFrame,
    column: str = DEFAULTS.date,
    start=None,
    end=None,
    formats: Sequence[str] = DATE_FORMATS,
    dayfirst: bool | None = None,
) -> DataFrame:
    """Keep rows between both bounds, inclusive; an ``end`` day means its midnight."""
    out = parse_dates(df, [column], formats, dayfirst)
    if start:
        out = out.filter(c(column) >= timestamp_literal(start))
    if end:
        out = out.filter(c(column) <= timestamp_literal(end))
    return out


def tie_breakers(df: DataFrame) -> list[Column]:
    """Sort keys behind the user's own, which let equal user keys spread over tasks.

    A range-partitioned sort keeps equal keys in one task. The file position splits even
    exact copies; without it a hash of the row splits all but those.
    """
    if ROW_ID in df.columns:
        return [c(ROW_ID)]
    hashable = [f.name for f in df.schema.fields if not _holds_map(f.dataType)]
    return [F.xxhash64(*[c(name) for name in hashable])] if hashable else []


def _holds_map(kind: T.DataType) -> bool:
    return "map<" in kind.simpleString() or "variant" in kind.simpleString()


def sort_by_date(df: DataFrame, column: str = DEFAULTS.date, order: str = "asc") -> DataFrame:
    """Sort by the column as it is, nulls last; any order but ``desc`` is ascending."""
    require(df, [column])
    key = c(column).desc_nulls_last() if order == "desc" else c(column).asc_nulls_last()
    return df.orderBy(key, *tie_breakers(df))


def flag_weekend(df: DataFrame, column: str | None = None, dest: str = "Weekend") -> DataFrame:
    """Mark Saturdays and Sundays of ``column``, or of the first column named like a date."""
    column = column or next((n for n in df.columns if "date" in n.lower()), None)
    if column is None:
        raise ValueError("no column whose name contains 'date'")
    day = F.dayofweek(_as_dates(df, column))
    return df.withColumn(dest, F.coalesce(day.isin(1, 7), F.lit(False)))


def _as_dates(df: DataFrame, column: str) -> Column:
    require(df, [column])
    if isinstance(df.schema[column].dataType, T.StringType):
        return c(column).try_cast("timestamp_ntz")
    return c(column)
