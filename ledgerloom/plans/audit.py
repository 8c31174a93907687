"""The step log: what each step did, and row counts when they are asked for."""

from __future__ import annotations

import json
import platform
import sys
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

import pyspark
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

AUDIT_MODES = ("off", "observe", "count")

LOG_SCHEMA = (
    "index int, type string, config string, rows_before bigint, rows_after bigint, "
    "error string, timestamp string, dataset_hash string, template_name string, "
    "py_version string, spark_version string, platform string"
)


class Entries(list):
    """Entries of a log, and the row counts that a later action will supply."""

    def __init__(self):
        super().__init__()
        self.pending: list[tuple[dict, str, Observation]] = []

    def resolve(self) -> Entries:
        """Fill in observed counts; call it after an action has read the whole result."""
        for entry, field, observation in self.pending:
            entry[field] = observation.get["rows"]
        self.pending = []
        return self


class StepLog:
    """Collects one entry per step.

    ``off`` records no row counts and costs nothing. ``observe`` attaches counters that
    fill in during the user's own full action; it keeps filters from being pushed below
    them, and a final sort gets a shuffle in front. ``count`` runs one job per step.
    """

    def __init__(self, mode: str, context: Mapping):
        if mode not in AUDIT_MODES:
            raise ValueError(f"audit must be one of {AUDIT_MODES}, not {mode!r}")
        self.mode = mode
        self.entries = Entries()
        self._context = context
        self._last: Observation | int | None = None

    def start(self, df: DataFrame) -> DataFrame:
        return self._measure(df)

    def _measure(self, df: DataFrame) -> DataFrame:
        if self.mode == "observe":
            self._last = Observation()
            return df.observe(self._last, F.count(F.lit(1)).alias("rows"))
        if self.mode == "count":
            self._last = df.count()
        return df

    def _entry(self, index: int, step: Mapping) -> dict:
        return {
            "index": index,
            "type": step.get("type"),
            "config": step.get("config") or {},
            "timestamp": datetime.now(timezone.utc).isoformat(),
            "dataset_hash": self._context.get("dataset_hash"),
            "template_name": self._context.get("template_name"),
            "py_version": sys.version.split()[0],
            "spark_version": pyspark.__version__,
            "platform": platform.platform(),
        }

    def _note(self, entry: dict, field: str) -> None:
        if isinstance(self._last, Observation):
            self.entries.pending.append((entry, field, self._last))
            entry[field] = None
        else:
            entry[field] = self._last

    def done(self, index: int, step: Mapping, df: DataFrame) -> DataFrame:
        entry = self._entry(index, step)
        self._note(entry, "rows_before")
        df = self._measure(df)
        self._note(entry, "rows_after")
        self.entries.append(entry)
        return df

    def failed(self, index: int, step: Mapping, error: Exception) -> None:
        self.entries.append({**self._entry(index, step), "error": str(error)})

    def resolve(self) -> list[dict]:
        return self.entries.resolve()


def log_table(spark: SparkSession, log: Sequence[Mapping]) -> DataFrame:
    """The log as a table; configurations as JSON text."""
    names = [field.split()[0] for field in LOG_SCHEMA.split(", ")]
    rows = [
        tuple(
            json.dumps(entry.get(n) or {}, sort_keys=True, default=str)
            if n == "config"
            else entry.get(n)
            for n in names
        )
        for entry in log
    ]
    return spark.createDataFrame(rows, LOG_SCHEMA)
