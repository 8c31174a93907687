"""Text clean-up steps: trim, lowercase, strip symbols, replace, split, merge, currency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.money import currency_number
from ..functions.names import c, dtype, require, visible
from ..functions.text import (
    as_double,
    as_text,
    spark_pattern,
    spark_replacement,
    ws_trim,
)

# Fixed value: characters that survive remove_symbols unless the caller names others.
KEEP_CHARS = r"0-9A-Za-z\s\.\-\_\/"


def trim_whitespace(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Strip white space at both ends; by default in every text column."""
    names = require(df, columns or []) or [
        name for name in visible(df) if isinstance(dtype(df, name), T.StringType)
    ]
    return df.withColumns({name: ws_trim(as_text(df, name)) for name in names})


def lowercase_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({name: F.lower(as_text(df, name)) for name in require(df, columns)})


def remove_symbols(
    df: DataFrame, columns: Sequence[str], keep_chars: str = KEEP_CHARS
) -> DataFrame:
    """Delete every character outside the class ``keep_chars``."""
    unwanted = spark_pattern(f"[^{keep_chars}]+")
    return df.withColumns(
        {
            name: F.regexp_replace(as_text(df, name), unwanted, "")
            for name in require(df, columns)
        }
    )


def replace_values(
    df: DataFrame,
    columns: Sequence[str],
    find,
    value,
    regex: bool = False,
    case_sensitive: bool = True,
) -> DataFrame:
    """Replace whole cells equal to ``find``, or with ``regex`` every match inside a cell.

    A text ``find`` compares and yields text. Any other ``find`` keeps the column type;
    ``None`` stands for missing cells.
    """
    replaced = {}
    for name in require(df, columns):
        text = as_text(df, name)
        if regex:
            pattern = ("" if case_sensitive else "(?iu)") + spark_pattern(str(find))
            replaced[name] = F.regexp_replace(text, pattern, spark_replacement(str(value)))
        elif isinstance(find, str):
            hit = text == find if case_sensitive else F.lower(text) == find.lower()
            new = None if value is None else str(value)
            replaced[name] = F.when(hit, F.lit(new)).otherwise(text)
        else:
            kind, new = dtype(df, name), F.lit(value)
            if find is None:
                hit = c(name).isNull()
            elif isinstance(find, bool) == isinstance(kind, T.BooleanType) and not isinstance(
                kind, T.StringType
            ):
                hit = c(name) == F.lit(find)
            else:
                continue  # a value of another kind equals no cell
            if isinstance(kind, T.IntegralType) and isinstance(value, int):
                new = new.cast(kind)
            replaced[name] = F.when(hit, new).otherwise(c(name))
    return df.withColumns(replaced) if replaced else df


def split_field(
    df: DataFrame,
    source: str,
    into: Sequence[str],
    delimiter: str,
    maxsplit: int = -1,
    strip_parts: bool = True,
) -> DataFrame:
    """Split text at a regular expression into new columns; missing parts are NULL."""
    require(df, [source])
    limit = maxsplit + 1 if maxsplit > 0 else -1
    parts = F.split(as_text(df, source), spark_pattern(delimiter), limit)
    new = {}
    for position, name in enumerate(into):
        part = F.get(parts, F.lit(position))
        new[name] = ws_trim(part) if strip_parts else part
    return df.withColumns(new)


def merge_columns(
    df: DataFrame,
    columns: Sequence[str],
    dest: str,
    sep: str = " ",
    drop_source: bool = False,
) -> DataFrame:
    """Join the non-empty parts of each row with ``sep``; nothing to join gives NULL.

    NULL, empty text and the text ``nan`` count as empty.
    """
    if not columns:
        raise ValueError("merge_columns needs at least one column")
    parts = []
    for name in require(df, columns):
        text = as_text(df, name)
        parts.append(F.when(~text.isin("", "nan"), text))
    merged = F.nullif(ws_trim(F.concat_ws(sep, *parts)), F.lit(""))
    out = df.withColumn(dest, merged)
    return out.drop(*[name for name in columns if name != dest]) if drop_source else out


def currency_to_float(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Parse amounts such as ``$1,200`` or ``(1,200)``; numeric columns are only cast."""
    return df.withColumns(
        {
            name: currency_number(c(name))
            if isinstance(dtype(df, name), T.StringType)
            else as_double(df, name)
            for name in require(df, columns)
        }
    )
