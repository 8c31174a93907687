"""Compare a Spark result with DuckDB's on the same tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if value is None or isinstance(value, (str, bool)):
        return str(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value)


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str) -> str | None:
    """None if equal, else the first difference in words."""
    result = con.execute(sql)
    sql_names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(sql_names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(sql_names)}"
    got = _sorted_rows(df.columns, df.collect())
    want = _sorted_rows(sql_names, expected)
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows differ, first: {bad[0][0]} != {bad[0][1]}" if bad else None
