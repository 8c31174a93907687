"""Exact deduplication with a heavy-hitter split, in built-in functions only.

A Misra-Gries summary (Spark's ``approx_top_k`` keeps one per task, merges them and bounds its size)
names the digests that may be frequent. Their exact sizes and winners are computed with map-side
combining and broadcast, so frequent groups are decided where their rows lie. What is left has
no group above a known share of the rows and is shuffled as usual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANK_RUN, staged, table, text_of

HEAVY = 1000  # frequent digests handled on the map side; every group above a thousandth is one
TRACKED = 10_000  # entries of a summary


def text_digest(name: str = "text") -> Column:
    """SHA-256 (32 bytes) of the text with every run of blanks as one space; NULL as empty."""
    return F.unhex(F.sha2(F.regexp_replace(text_of(name), BLANK_RUN, " "), 256))


def frequent_digests(digests: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """Candidates for large groups: ``digest``, at most ``heavy`` rows.

    A summary of ``tracked`` entries misses no digest held by more than rows / (0.75 tracked).
    """
    named = digests.select(F.hex("digest").alias("name"))
    summary = named.agg(F.expr(f"approx_top_k(name, {heavy}, {tracked})").alias("top"))
    return summary.select(F.explode("top").alias("top")).where("top.count > 1").select(
        F.unhex("top.item").alias("digest")
    )


def _first(row_id: Column) -> Column:
    """Orders rows of a group: smallest doc_id first, NULL last, then the row id."""
    return F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id"), row_id.alias("row_id"))


def find_duplicates(docs: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, digest``: one row per row of ``docs``.

    Exactly one row of each group of equal texts is kept: the one with the smallest ``doc_id``
    (NULL ids come last; of repeated rows any one). NULL texts equal empty ones. Other columns are
    ignored; an empty table gives an empty table.
    """
    rows = staged(
        docs.select("doc_id", text_digest().alias("digest")).withColumn("row_id", F.monotonically_increasing_id()),
        "digests",
    )
    candidates = F.broadcast(frequent_digests(rows, heavy, tracked))
    winners = staged(
        rows.join(candidates, "digest")
        .groupBy("digest")
        .agg(F.min(_first(F.col("row_id"))).alias("first"), F.count("*").alias("group_size")),
        "heavy-digests",
    )
    # At most `heavy` rows of about 100 bytes.
    common = rows.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    other = (
        rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
        .withColumn("first", F.min(_first(F.col("row_id"))).over(group))
        .withColumn("group_size", F.count("*").over(group))
    )
    return common.unionByName(other).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("first.row_id")).alias("kept"),
        "digest",
    )


def drop_duplicates(docs: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, by the rule of ``find_duplicates``.

    Frequent texts are combined before the shuffle, so a task sends one row of each.
    """
    columns = docs.columns
    content = F.struct(*[F.col(f"`{c}`") for c in columns])
    rows = docs.select(content.alias("row")).select(
        "row", F.col("row.doc_id").alias("doc_id"), text_digest("row.text").alias("digest")
    )
    order = _first(F.xxhash64(F.to_json("row")))
    candidates = F.broadcast(staged(frequent_digests(rows, heavy, tracked), "heavy-digests"))
    common = (
        rows.join(candidates, "digest", "left_semi").groupBy("digest").agg(F.min_by("row", order).alias("row"))
    )
    other = (
        rows.join(candidates, "digest", "left_anti")
        .withColumn("place", F.row_number().over(Window.partitionBy("digest").orderBy(order)))
        .where("place = 1")
    )
    return common.select("row").unionByName(other.select("row")).select("row.*")


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return find_duplicates(table(spark, folder, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST)
"""
