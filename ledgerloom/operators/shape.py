"""Row filters, computed columns and renames."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULTS
from ..functions.ansi import null_on_error
from ..functions.names import c, dtype, require, visible
from ..functions.text import as_text, blank_to_null, ws_trim


def filter_expr(df: DataFrame, expr: str) -> DataFrame:
    """Keep rows for which a Spark SQL condition holds; bad casts count as NULL."""
    if not (expr or "").strip():
        raise ValueError("filter_expr needs an expression")
    with null_on_error(df.sparkSession):
        return df.filter(F.expr(expr))


def add_formula(df: DataFrame, dest: str, expr: str) -> DataFrame:
    """Add a column computed by a Spark SQL expression; division by zero gives NULL."""
    if not (expr or "").strip():
        raise ValueError("add_formula needs an expression")
    with null_on_error(df.sparkSession):
        return df.withColumn(dest, F.expr(expr))


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def filter_types(
    df: DataFrame, column: str = DEFAULTS.type, include: Iterable[str] | None = None
) -> DataFrame:
    """Keep the named transaction types, whatever their case and outer white space.

    ``None`` keeps all non-null types; an empty list keeps nothing.
    """
    require(df, [column])
    if include is None:
        return df.filter(c(column).isNotNull())
    wanted = sorted({str(value).strip().lower() for value in include})
    if not wanted:
        return df.filter(F.lit(False))
    return df.filter(F.lower(ws_trim(as_text(df, column))).isin(*wanted))


def delete_blank_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows that are NULL everywhere, or NULL or blank in all ``subset`` columns."""
    if not subset:
        names = visible(df)
        filled = [c(name).isNotNull() & ~_is_nan(df, name) for name in names]
    else:
        filled = [
            blank_to_null(c(name)).isNotNull()
            if isinstance(dtype(df, name), T.StringType)
            else c(name).isNotNull() & ~_is_nan(df, name)
            for name in require(df, subset)
        ]
    return df.filter(reduce(or_, filled))


def _is_nan(df: DataFrame, name: str):
    if isinstance(dtype(df, name), (T.DoubleType, T.FloatType)):
        return F.isnan(c(name))
    return F.lit(False)
