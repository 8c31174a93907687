"""Small looks at a table: samples, pages, shape."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import c, drop_hidden, dtype
from ..functions.ordering import RowOrder, row_order
from ..operators.union import identical_groups, schema_key, union_identical

PAGE_ROWS = 20


def _nan_to_null(df: DataFrame) -> DataFrame:
    floats = [n for n in df.columns if isinstance(dtype(df, n), (T.DoubleType, T.FloatType))]
    return df.withColumns({n: F.when(~F.isnan(c(n)), c(n)) for n in floats}) if floats else df


def sample_records(df: DataFrame, limit: int = PAGE_ROWS) -> list[dict]:
    """The first rows as dicts, NaN as None."""
    return [row.asDict() for row in _nan_to_null(drop_hidden(df)).limit(limit).collect()]


def preview(
    df: DataFrame,
    limit: int | None = PAGE_ROWS,
    offset: int | None = 0,
    order_by: Sequence[str] | RowOrder | None = None,
) -> DataFrame:
    """One page of rows in a stated order; a limit of 0 or None means the default page.

    Sorting and cutting become one top-k per task, so no global sort takes place.
    """
    start, rows = max(int(offset or 0), 0), max(int(limit or PAGE_ROWS), 1)
    page = df.orderBy(*row_order(df, order_by).columns()).offset(start).limit(rows)
    return drop_hidden(page)


def describe(df: DataFrame, limit: int = PAGE_ROWS) -> dict:
    table = drop_hidden(df)
    return {
        "merged": False,
        "columns": table.columns,
        "shape": [table.count(), len(table.columns)],
        "sample": sample_records(table, limit),
    }


def select_tables(
    tables: Mapping[str, DataFrame], names: Sequence[str | int] | None = None
) -> dict[str, DataFrame]:
    """Pick tables by name or by position; unknown ones are skipped, none left is an error."""
    if not names:
        return dict(tables)
    order = list(tables)
    chosen = {}
    for name in names:
        if name in tables:
            chosen[name] = tables[name]
        elif str(name).isdigit() and int(name) < len(order):
            chosen[order[int(name)]] = tables[order[int(name)]]
    if not chosen:
        raise ValueError(f"no table matches {list(names)}; there are {order}")
    return chosen


def describe_tables(
    tables: Mapping[str, DataFrame],
    names: Sequence[str | int] | None = None,
    merge_identical: bool = False,
) -> dict:
    """Describe several named tables, stacked where their schemas are identical."""
    chosen = select_tables(tables, names)
    groups = identical_groups(chosen)
    if merge_identical or (len(chosen) > 1 and len(groups) == 1):
        united = union_identical(chosen, merge_identical)
        members = groups[schema_key(united)]
        return {**describe(united), "merged": True, "merged_sheets": members}
    if len(chosen) == 1:
        return describe(next(iter(chosen.values())))
    parts = {name: describe(table) for name, table in chosen.items()}
    for part in parts.values():
        part.pop("merged")
    return {"merged": False, "sheets": parts}
