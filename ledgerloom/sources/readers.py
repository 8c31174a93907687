"""Readers: CSV with separator and encoding detection, JSON in three layouts, Parquet."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import ROW_ID, c, quoted
from ..functions.text import NUMBER_TEXT, ws_trim

# File endings and separators that are recognised.
FORMATS = {".csv": "csv", ".json": "json", ".parquet": "parquet"}
SEPARATORS = (",", ";", "\t", "|")

# Texts that mean "missing" in a file without a schema.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
WHOLE_NUMBER_TEXT = r"\A\s*[+-]?\d+\s*\z"

SNIFF_LINES = 20
SNIFF_CHARS = 1 << 16  # of each line, so that the driver never holds a long one
_EXTRA, _FITS = "__extra", "__fits"
_WHOLE, _NUMBER, _FLAG, _TEXT = 1, 2, 4, 8


def detect_format(name: str) -> str:
    """Format by file ending; compressed text files count by the ending before it."""
    lower = re.sub(r"\.(gz|bz2|zst|snappy|lz4|deflate)$", "", name.lower().rstrip("/"))
    for ending, kind in FORMATS.items():
        if lower.endswith(ending):
            return kind
    raise ValueError(f"unsupported file format: {name!r}; known endings: {sorted(FORMATS)}")


def read_table(
    spark: SparkSession, path: str, ordinal: bool = False, kind: str | None = None, **options
) -> DataFrame:
    """Read a CSV, JSON or Parquet table, by ending unless ``kind`` names the format.

    ``ordinal`` adds the hidden position column that order-sensitive steps use.
    """
    reader = {"csv": read_csv, "json": read_json, "parquet": read_parquet}
    return reader[kind or detect_format(path)](spark, path, ordinal=ordinal, **options)


def _with_position(df: DataFrame, *within_file) -> DataFrame:
    return df.withColumn(ROW_ID, F.struct(F.col("_metadata.file_path"), *within_file))


def read_parquet(spark: SparkSession, path: str, ordinal: bool = False) -> DataFrame:
    """Read Parquet. The position is file and row number, which the scan supplies itself:
    it survives retries and does not stop filters from reaching the files."""
    df = spark.read.parquet(path)
    return _with_position(df, F.col("_metadata.row_index")) if ordinal else df


def _text_position(df: DataFrame) -> DataFrame:
    # Text files have no row number; within one block, rows are numbered as they are read.
    return _with_position(
        df, F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row")
    )


def first_lines(spark: SparkSession, path: str, count: int = SNIFF_LINES) -> list[str]:
    """The first lines; of a long one the beginning and the last character."""
    value = F.col("value")
    ends = F.concat(F.left(value, F.lit(SNIFF_CHARS)), F.right(value, F.lit(1)))
    shown = F.when(F.length(value) > SNIFF_CHARS, ends).otherwise(value)
    return [row[0] for row in spark.read.text(path).limit(count).select(shown).collect()]


def text_traits(spark: SparkSession, path: str) -> tuple[bool, bool, bool]:
    """Whether any line of a text file holds a NUL, bytes that are no UTF-8, an open quote."""
    value = F.col("value")
    quotes = F.octet_length(value) - F.octet_length(F.replace(value, F.lit('"'), F.lit("")))
    found = spark.read.text(path).agg(
        F.bool_or(F.contains(value, F.lit("\x00"))),
        F.bool_or(~F.is_valid_utf8(value)),
        F.bool_or(quotes % 2 == 1),
    )
    return tuple(bool(hit) for hit in found.first())


def sniff_encoding(lines: Sequence[str]) -> str:
    """Guess the encoding from lines decoded as UTF-8, where bad bytes show as U+FFFD.

    Two-byte encodings show in the first lines; others need a look at every line.
    """
    head = "".join(lines[:2])
    if head.startswith("\ufffd\ufffd") and "\x00" in head:
        return "UTF-16"
    if len(head) > 1 and head.count("\x00") * 3 >= len(head):
        return "UTF-16BE" if head[0] == "\x00" else "UTF-16LE"
    return "ISO-8859-1" if any("\ufffd" in line for line in lines) else "UTF-8"


def sniff_separator(lines: Sequence[str]) -> str:
    """The separator that splits the most lines into the header's number of fields."""
    lines = [re.sub(r'"[^"]*"', "", line.replace("\x00", "")) for line in lines]
    lines = [line for line in lines if line.strip()]
    if not lines:
        return ","

    def fit(sep: str):
        fields = lines[0].count(sep)
        return (fields > 0) * sum(line.count(sep) == fields for line in lines), fields

    return max(SEPARATORS, key=fit)


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    encoding: str | None = None,
    schema: T.StructType | str | None = None,
    bad_lines: str | None = None,
    multi_line: bool | None = None,
    ordinal: bool = False,
) -> DataFrame:
    """Read CSV with a header.

    The separator is detected from the first lines unless given. Unless both ``encoding`` and
    ``multi_line`` are given, one pass over all lines finds out whether they are UTF-8 (else
    ISO-8859-1) and whether quoted values hold line breaks; such a file is read by one task.
    Without a ``schema``, another pass finds whole numbers, numbers and flags; everything
    else, dates included, stays text, and the usual spellings of "missing" become NULL.
    Large inputs should state all of them. NUL characters are removed from all text.

    Lines with too many fields are skipped (``bad_lines="skip"``), cut (``"cut"``) or an error
    (``"error"``); by default an error where a schema is given, else skipped. The pass that
    finds the types counts skipped lines and warns. Short lines are filled with NULL.
    """
    if bad_lines not in (None, "skip", "cut", "error"):
        raise ValueError(f"bad_lines must be 'skip', 'cut' or 'error', not {bad_lines!r}")
    bad_lines = bad_lines or ("skip" if schema is None else "error")
    if sep is None or encoding is None:
        lines = first_lines(spark, path)
        wide = sniff_encoding(lines)
        encoding = encoding or (wide if wide.startswith("UTF-16") else None)
        sep = sep or sniff_separator(lines)
    nul = True
    # Two-byte text is never read line by line.
    if not (encoding or "").upper().startswith("UTF-16") and (encoding is None or multi_line is None):
        nul, foreign, open_quote = text_traits(spark, path)
        encoding = encoding or ("ISO-8859-1" if foreign else "UTF-8")
        multi_line = open_quote if multi_line is None else multi_line
    reader = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("encoding", encoding)
        # Spark splits lines on single bytes; a two-byte encoding is read file by file.
        .option("multiLine", bool(multi_line) or encoding.upper().startswith("UTF-16"))
        .option("escape", '"')
    )
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if schema is not None:
        fields = [T.StructField(f.name, f.dataType) for f in schema.fields]
    else:
        header = [n.replace("\x00", "").replace("\ufeff", "") for n in reader.csv(path).columns]
        fields = [T.StructField(n, T.StringType()) for n in header]
    names = [f.name for f in fields]
    if bad_lines != "cut":
        fields = [*fields, T.StructField(_EXTRA, T.StringType())]
    df = reader.schema(T.StructType(fields)).csv(path)
    if ordinal:
        df = _text_position(df)
    if nul:
        texts = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
        df = df.withColumns({n: F.translate(c(n), "\x00", "") for n in texts})
    fits = F.lit(True) if bad_lines == "cut" else F.col(_EXTRA).isNull()
    if bad_lines == "error":
        fits = fits | F.raise_error(F.lit(f"a line of {path} has too many fields")).cast("boolean")
    return df.filter(fits).drop(_EXTRA) if schema is not None else _typed(df, names, fits)


def _typed(df: DataFrame, names: Sequence[str], fits: Column) -> DataFrame:
    """Rows that fit, their text columns cast to the narrowest kind that all values have."""
    df = df.withColumns({n: F.when(~c(n).isin(*MISSING_TEXTS), c(n)) for n in names})

    def kind(text: Column) -> Column:
        return (
            F.when(text.rlike(WHOLE_NUMBER_TEXT) & text.try_cast("bigint").isNotNull(), _WHOLE)
            .when(ws_trim(text).rlike(NUMBER_TEXT), _NUMBER)
            .when(F.lower(text).isin("true", "false"), _FLAG)
            .when(text.isNotNull(), _TEXT)
        )

    marked = df.withColumn(_FITS, fits).drop(_EXTRA)
    kinds_of = [F.bit_or(F.when(F.col(_FITS), kind(c(n)))) for n in names]
    skipped, *found = marked.agg(F.count_if(~F.col(_FITS)), *kinds_of).first()
    if skipped:
        warnings.warn(f"{skipped} lines with too many fields were skipped", stacklevel=3)
    df = df.filter(fits).drop(_EXTRA)
    casts = {}
    for name, kinds in zip(names, found):
        target = {_WHOLE: "bigint", _FLAG: "boolean"}.get(kinds)
        if kinds in (None, _NUMBER, _WHOLE | _NUMBER):
            target = "double"
        if target:
            casts[name] = ws_trim(c(name)).try_cast(target)
    return df.withColumns(casts) if casts else df


def read_json(
    spark: SparkSession,
    path: str,
    layout: str | None = None,
    schema: T.StructType | str | None = None,
    ordinal: bool = False,
) -> DataFrame:
    """Read JSON lines (splittable), an array of records, or an object of columns.

    ``layout`` is ``lines``, ``records`` or ``columns``; by default it is detected.
    """
    layout = layout or _sniff_json(first_lines(spark, path))
    if layout == "columns":
        return _read_columns(spark, path, schema, ordinal)
    reader = spark.read.option("multiLine", layout != "lines")
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.json(path)
    return _text_position(df) if ordinal else df


def _sniff_json(lines: Sequence[str]) -> str:
    text = [line.strip() for line in lines if line.strip()]
    if not text or text[0].startswith("["):
        return "records"
    if re.match(r'\{\s*"[^"]*"\s*:\s*\{\s*"\d+"\s*:', " ".join(text[:4])):
        return "columns"
    return "lines" if text[0].endswith("}") else "records"


def _read_columns(spark: SparkSession, path: str, schema: T.StructType | str | None, ordinal: bool) -> DataFrame:
    """Objects ``{column: {index: value}}``, one a file, as rows in the order of file and index.

    A file is parsed once into typed values; these are then rows (file, index, column, value) that meet by file and
    index like any grouped table, so the plan grows with the columns only. A missing cell is NULL.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^\ufeff", "").alias("text")
    )
    parsed = files.select("file", F.from_json("text", "map<string, map<string, variant>>").alias("columns"))
    cells = parsed.select("file", F.explode("columns").alias("column", "cells")).select(
        "file", "column", F.explode("cells").alias("at", "value")
    )
    cells = cells.withColumn("at", F.col("at").cast("bigint"))
    if schema is None:
        fields = _column_types(parsed, cells)
    else:
        given = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        fields = {f.name: f.dataType.simpleString() for f in given.fields}

    def value(kind: str) -> Column:
        typed = F.try_variant_get("value", "$", kind)
        if kind.lower() != "string":
            return typed
        return F.when(~F.is_variant_null("value"), F.coalesce(typed, F.to_json("value")))

    # At most one cell meets the condition in a group.
    found = [F.max_by(value(kind), F.when(F.col("column") == n, 1)).alias(n) for n, kind in fields.items()]
    rows = cells.groupBy("file", "at").agg(*found).orderBy("file", "at")
    position = [F.struct(F.col("file").alias("file_path"), F.col("at")).alias(ROW_ID)] if ordinal else []
    return rows.select(*[c(n) for n in fields], *position)


def _column_types(parsed: DataFrame, cells: DataFrame) -> dict[str, str]:
    """Column names in the order of the first file, with the narrowest type all their values have."""
    found = cells.groupBy("column").agg(F.schema_of_variant_agg("value").alias("kind"))
    kinds = {row["column"]: row["kind"] for row in found.collect()}
    first = parsed.select(F.map_keys("columns").alias("names")).orderBy("file").first()
    order = [n for n in (first["names"] or [] if first else []) if n in kinds]
    order += sorted(set(kinds) - set(order))
    return {n: _plain_type(kinds[n]) for n in order}


def _plain_type(kind: str) -> str:
    """The type of a variant's schema as the JSON reader would name it."""
    kind = re.sub(r"DECIMAL\(\d+,\s*\d+\)|FLOAT", "DOUBLE", kind)
    kind = re.sub(r"\b(VOID|VARIANT)\b", "STRING", kind)
    return kind.replace("OBJECT<", "STRUCT<") if "<" in kind else kind.lower()
