"""Recipes and aggregates on Structured Streaming tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULTS
from ..functions.dates import parse_dates, period_start
from ..functions.names import c, require
from ..operators.finance import PERIOD, sum_periods
from ..plans.recipe import run_recipe
from ..session import work_path


def read_stream(
    spark: SparkSession, path: str, kind: str, schema, files_per_trigger: int | None = None, **options
) -> DataFrame:
    """A growing folder (or glob) of files as a stream; streams need their schema stated."""
    reader = spark.readStream.format(kind).schema(schema).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def stream_recipe(stream: DataFrame, recipe, join_table: DataFrame | None = None) -> DataFrame:
    """The recipe on every micro-batch; steps that need the whole table raise here.

    In a batch run a failing step is skipped. A stream would then write half-prepared rows
    for good, so here the first failure is an error.
    """
    result = run_recipe(stream, recipe, join_table=join_table)
    failed = [entry for entry in result.log if "error" in entry]
    if failed:
        raise ValueError(f"step {failed[0]['type']!r} failed: {failed[0]['error']}")
    return result.df


def stream_pl_by_period(
    stream: DataFrame,
    date: str,
    freq: str = "M",
    revenue: str | None = None,
    cogs: str | None = None,
    expenses: str | None = None,
    late: str | None = None,
) -> DataFrame:
    """Running profit and loss per period; the state is one row per period.

    Without ``late`` use ``update`` or ``complete`` mode. With it, a period is final, and
    can be appended, once a row of a period starting more than ``late`` after it was seen;
    rows that come later still are dropped.
    """
    require(stream, [date])
    dated = parse_dates(stream, [date]).withColumn(PERIOD, period_start(c(date), freq))
    if late:
        # Watermarks need an instant; periods start on a day, so the way back is exact.
        dated = dated.withColumn(PERIOD, c(PERIOD).cast("timestamp")).withWatermark(PERIOD, late)
    sums = sum_periods(
        dated,
        revenue or DEFAULTS.revenue,
        cogs or DEFAULTS.cogs,
        DEFAULTS.expenses if expenses is None else expenses,
    )
    return sums.withColumn(PERIOD, c(PERIOD).cast("date").cast("timestamp_ntz")) if late else sums


def stream_drop_duplicates(
    stream: DataFrame, keys: Sequence[str], event_time: str, within: str
) -> DataFrame:
    """Drop repeats of the keys that arrive within the stated delay of each other."""
    require(stream, [*keys, event_time])
    typed = stream.withColumn(event_time, c(event_time).cast("timestamp"))
    return typed.withWatermark(event_time, within).dropDuplicatesWithinWatermark(list(keys))


def write_stream(
    stream: DataFrame, path: str, kind: str = "parquet", checkpoint: str | None = None
) -> StreamingQuery:
    """Append to files, exactly once; all files present now are processed, then it ends.

    The checkpoint lies in the cluster's shared folder unless a path is given, which a
    query that is to be resumed must do.
    """
    checkpoint = checkpoint or work_path(stream.sparkSession, "stream")
    return (
        stream.writeStream.format(kind)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .trigger(availableNow=True)
        .start()
    )


def upsert_stream(
    stream: DataFrame, path: str, kind: str = "parquet", checkpoint: str | None = None
) -> StreamingQuery:
    """Write a running aggregate: every trigger replaces the table with the full result."""
    checkpoint = checkpoint or work_path(stream.sparkSession, "stream")

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").format(kind).save(path)

    return (
        stream.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(replace)
        .start()
    )
