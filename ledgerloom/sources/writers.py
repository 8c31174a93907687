"""Writers, and the export bundle of data, summary and step log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ..functions.names import drop_hidden
from ..operators.finance import pl_summary
from ..plans.audit import Entries, log_table
from ..session import work_path

# Text files keep microseconds, which Spark's default layouts cut off.
EXACT_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    writer = drop_hidden(df).write.mode(mode).options(**EXACT_TIMES)
    # By default Spark's writer cuts white space off texts.
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object per line, NULL fields included."""
    writer = drop_hidden(df).write.mode(mode).options(**EXACT_TIMES)
    writer.option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    drop_hidden(df).write.mode(mode).parquet(path)


WRITERS = {"csv": write_csv, "json": write_json, "parquet": write_parquet}


def export_bundle(
    df: DataFrame,
    folder: str,
    log: Sequence[Mapping] = (),
    kind: str = "parquet",
    mode: str = "errorifexists",
) -> dict[str, str]:
    """Write ``data``, and where they exist ``pl_summary`` and ``transformation_log``.

    The recipe runs once, into Parquet: in the folder itself, or for a text format in the
    work folder. Text and summary are made from that, so a lost executor costs a re-read of
    files, not the recipe, and the summary does not depend on how text is read. Row counts
    that the log of this result still lacks are filled in. Returns the paths by name.
    """
    if kind not in WRITERS:
        raise ValueError(f"kind must be one of {sorted(WRITERS)}, not {kind!r}")
    spark, folder = df.sparkSession, folder.rstrip("/")
    paths = {"data": f"{folder}/data"}
    table = drop_hidden(df)
    if kind == "parquet":
        write_parquet(table, paths["data"], mode)
        table = spark.read.schema(table.schema).parquet(paths["data"])
    else:
        stage = work_path(spark, "export")
        write_parquet(table, stage)
        table = spark.read.schema(table.schema).parquet(stage)
        WRITERS[kind](table, paths["data"], mode)
    summary = pl_summary(table)
    if summary is not None:
        paths["pl_summary"] = f"{folder}/pl_summary"
        WRITERS[kind](summary, paths["pl_summary"], mode)
    if isinstance(log, Entries):
        log.resolve()
    if log:
        paths["transformation_log"] = f"{folder}/transformation_log"
        WRITERS[kind](log_table(spark, log), paths["transformation_log"], mode)
    return paths
