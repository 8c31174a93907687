"""Recipes and aggregates on streams, fed from files."""

from datetime import datetime

import pytest

from ledgerloom.streaming.tables import (
    read_stream,
    stream_drop_duplicates,
    stream_pl_by_period,
    stream_recipe,
    upsert_stream,
    write_stream,
)

DDL = "Date timestamp_ntz, Revenue double, COGS double, Type string, id int"
ROWS = [
    (datetime(2024, 1, 5), 10.0, 4.0, " Debit", 1),
    (datetime(2024, 1, 9), 5.0, 1.0, "Credit", 2),
    (datetime(2024, 3, 2), 7.0, 2.0, "debit ", 3),
    (datetime(2024, 1, 5), 10.0, 4.0, " Debit", 1),
]


@pytest.fixture
def stream(table, spark, tmp_path):
    source = str(tmp_path / "in")
    for row in ROWS:
        table(DDL, row).coalesce(1).write.mode("append").parquet(source)
    return read_stream(spark, source, "parquet", DDL, files_per_trigger=2)


def rows(spark, path):
    return sorted((tuple(r) for r in spark.read.parquet(path).collect()), key=repr)


def test_recipe_on_a_stream(spark, stream, table, tmp_path):
    names = table("id int, Name string", (1, "one"), (3, "three"))
    recipe = [
        {"type": "trimWhitespace"},
        {"type": "filterDebitCredit", "config": {"include": ["debit"]}},
        {"type": "filterDateRange", "config": {"from": "2024-01-01"}},
        {"type": "calculateNetProfit"},
        {"type": "joinWithFile", "config": {"key": "id"}},
    ]
    out = stream_recipe(stream, recipe, join_table=names).select("id", "Net Profit", "Type", "Name")
    write_stream(out, str(tmp_path / "out"), checkpoint=str(tmp_path / "cp")).awaitTermination()
    assert rows(spark, str(tmp_path / "out")) == [
        (1, 6.0, "Debit", "one"),
        (1, 6.0, "Debit", "one"),
        (3, 5.0, "debit", "three"),
    ]


@pytest.mark.parametrize("kind", ["sortByDate", "dropDuplicates", "detectOutliers"])
def test_whole_table_steps_are_refused(stream, kind):
    with pytest.raises(ValueError, match="stream"):
        stream_recipe(stream, [{"type": kind}])


def test_running_profit(spark, stream, tmp_path):
    running = stream_pl_by_period(stream, "Date").select("Period", "Revenue", "Net Profit")
    upsert_stream(running, str(tmp_path / "out")).awaitTermination()
    assert rows(spark, str(tmp_path / "out")) == [
        (datetime(2024, 1, 1), 25.0, 16.0),
        (datetime(2024, 3, 1), 7.0, 5.0),
    ]


def test_final_profit_of_closed_periods(spark, stream, tmp_path):
    closed = stream_pl_by_period(stream, "Date", late="20 days").select("Period", "Revenue")
    write_stream(closed, str(tmp_path / "out")).awaitTermination()
    # March has not been followed by a later period yet.
    assert [r[0] for r in rows(spark, str(tmp_path / "out"))] == [datetime(2024, 1, 1)]


def test_repeats_are_dropped(spark, stream, tmp_path):
    once = stream_drop_duplicates(stream, ["id"], "Date", "365 days").select("id")
    write_stream(once, str(tmp_path / "out")).awaitTermination()
    assert rows(spark, str(tmp_path / "out")) == [(1,), (2,), (3,)]
