"""Shared helpers of the training-data operators."""

from __future__ import annotations

import pathlib
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_path

# White space of the word and line rules: space and \x09-\x0D, nothing else.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once below the shared work folder and read back.

    Cuts the lineage, so that a lost executor repeats a scan and not the work before it, and
    fixes whatever depends on the order of rows.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the workers' path.

    The driver sends its own copy once per context, so that executors need no installation.
    """
    context = df.sparkSession.sparkContext
    if not getattr(context, "_ledgerloom_sent", False):
        package = pathlib.Path(__file__).parent.parent
        folder = tempfile.mkdtemp(prefix="ledgerloom-code-")
        context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
        context._ledgerloom_sent = True
    return df.mapInArrow(function, schema)


def text_of(name: str = "text") -> Column:
    """The text column, NULL read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text; an empty array if it has none."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))
