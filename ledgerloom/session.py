"""Session settings the engine is designed for, and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE sizes shuffle partitions, splits skewed join partitions and turns sort-merge joins
# into broadcast joins from measured sizes, so no operator here hard-codes a strategy.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the recommended runtime settings to a session the caller owns."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the cluster's shared folder (``spark.checkpoint.dir``).

    A machine-local folder is used only where none is named and all runs on one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="ledgerloom-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def estimated_bytes(df: DataFrame) -> float:
    """Spark's own size estimate of a table; infinite where there is none.

    It comes from file sizes and rises through joins, so it errs on the high side.
    """
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except (AttributeError, ValueError):  # a remote session has no plan to ask
        return float("inf")


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark, going by its estimate, would broadcast this table."""
    limit = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    return estimated_bytes(df) <= _bytes(limit)


def _bytes(text: str) -> int:
    """Bytes of a Spark size setting such as ``10485760b`` or ``10MB``."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgt]?)b?\s*", text.lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]
