"""Build-time switch from raising to null-giving evaluation."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def null_on_error(spark: SparkSession):
    """Analyse expressions so that bad casts and division by zero give NULL.

    The mode is fixed when Spark analyses an expression, so only building the step
    happens inside; the action may run later under any setting.
    """
    key = "spark.sql.ansi.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)
