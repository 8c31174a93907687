"""Column name handling: free-text names, hidden columns, existence checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hidden columns: position of a row in its file, and the key of the last sort step.
ROW_ID = "__row_id"
SORT_KEY = "__sort_key"
HIDDEN = (ROW_ID, SORT_KEY)


def quoted(name: str) -> str:
    """Backtick-quote a name so that dots, spaces and backticks are taken literally."""
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    return F.col(quoted(name))


def visible(df: DataFrame) -> list[str]:
    """Column names without the engine's hidden ones."""
    return [name for name in df.columns if name not in HIDDEN]


def drop_hidden(df: DataFrame) -> DataFrame:
    return df.drop(*[name for name in HIDDEN if name in df.columns])


def require(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Return ``names`` as a list, or raise if the table lacks one of them."""
    names = list(names)
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {missing}; it has {visible(df)}")
    return names


def dtype(df: DataFrame, name: str):
    return df.schema[name].dataType
