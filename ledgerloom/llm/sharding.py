"""Sharding by extendible hashing, in built-in functions only.

Rows have a fixed hash key. A bucket is a prefix of its bits; it splits on the next bit only if it
holds more bytes than a shard may. All depths are decided from one histogram of key prefixes, and
rows find their bucket by an equality join with the directory, one entry per prefix of the
directory's depth. Entries still too large there are taken further by another, deeper round.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table, text_of

SHARD_BYTES = 64 << 20
KEY_BITS = 62
CONTENT_BITS = 40  # from the row's content; the other bits tell repeated rows apart
SPARE_BITS = 3  # directory bits beyond those an even split needs
ROUND_BITS = 6  # bits a further round adds


def _prefix(depth: int):
    return F.shiftright("key", KEY_BITS - depth)


def _buckets(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Buckets of depth ``low`` to ``high``: ``entry`` (prefix of ``high`` bits), ``depth, prefix,
    shard_bytes, shard_rows, fits``. Entries whose bucket does not fit are those to split further.
    """
    cells = rows.groupBy(_prefix(high).alias("entry")).agg(
        F.sum("n_bytes").alias("bytes"), F.count("*").alias("n")
    )
    cells = staged(cells, "shard-cells")
    depths = F.explode(F.sequence(F.lit(low), F.lit(high)))
    at = F.expr(f"shiftright(entry, cast({high} - depth as int))")
    nodes = (
        cells.select("entry", "bytes", "n", depths.alias("depth"))
        .groupBy("depth", at.alias("prefix"))
        .agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        .withColumn("fits", (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
    )
    # Bytes only fall from parent to child, so the bucket of an entry is the shallowest that fits.
    node = F.struct("depth", "prefix", "shard_bytes", "shard_rows")
    return (
        cells.select("entry", depths.alias("depth"))
        .withColumn("prefix", at)
        .join(nodes, ["depth", "prefix"])
        .groupBy("entry")
        .agg(F.min(F.when(F.col("fits"), node)).alias("bucket"))
    )


def assign_shards(docs: DataFrame, limit: int = SHARD_BYTES, carry: bool = False, size: Column | None = None) -> DataFrame:
    """``doc_id, n_bytes, shard_id, local_depth, shard_bytes, shard_rows``: one row per row of ``docs``.

    ``n_bytes`` are the UTF-8 bytes of the text (NULL: 0), or ``size`` where it is given. A shard holds at most ``limit`` bytes,
    unless a single row alone is larger: it has a shard to itself or shares one with empty texts.
    ``shard_id`` is a 1 bit followed by the bucket's prefix bits. A row's place follows from its
    doc_id and text; repeated rows are told apart by further bits, so that they can be split as well.
    ``carry`` adds the whole row as ``document``. An empty table gives an empty table.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    text = text_of()
    measure = F.octet_length(text) if size is None else size
    spare = KEY_BITS - CONTENT_BITS
    content = F.shiftleft(F.shiftrightunsigned(F.xxhash64("doc_id", text), 64 - CONTENT_BITS), spare)
    repeat = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - spare)
    columns = [F.col("doc_id"), measure.cast("long").alias("n_bytes"), content.bitwiseOR(repeat).alias("key")]
    if carry:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    pending = staged(docs.select(*columns), "shard-rows")
    total = pending.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, math.ceil(math.log2(max(1.0, total / limit))) + SPARE_BITS
    assigned = []
    while True:
        entries = staged(_buckets(pending, low, high, limit), "shard-directory")
        last = high == KEY_BITS
        directory = entries.where("bucket is not null").select("entry", "bucket.*")
        assigned.append(pending.withColumn("entry", _prefix(high)).join(directory, "entry"))
        over = entries.where("bucket is null").select("entry")
        if last or not over.take(1):
            break
        pending = staged(
            pending.withColumn("entry", _prefix(high)).join(over, "entry", "left_semi").drop("entry"), "shard-rest"
        )
        low, high = high + 1, min(KEY_BITS, high + ROUND_BITS)
    if last:  # rows that share all bits of the key
        deepest = over.select("entry", F.lit(KEY_BITS).alias("depth"), F.col("entry").alias("prefix"))
        assigned.append(
            pending.withColumn("entry", _prefix(high))
            .join(deepest, "entry")
            .select("*", F.lit(None).cast("long").alias("shard_bytes"), F.lit(None).cast("long").alias("shard_rows"))
        )
    out = assigned[0]
    for more in assigned[1:]:
        out = out.unionByName(more)
    return out.select(
        "doc_id",
        "n_bytes",
        F.expr("shiftleft(1L, depth) + prefix").alias("shard_id"),
        F.col("depth").alias("local_depth"),
        "shard_bytes",
        "shard_rows",
        *(["document"] if carry else []),
    )


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> None:
    """Writes ``docs`` as Parquet, a folder ``shard_id=…`` with one file per shard.

    All columns count towards the limit, by their length as JSON. A file's footer does not.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    size = F.octet_length(F.to_json(row, {"ignoreNullFields": "false"}))
    rows = assign_shards(docs, limit, carry=True, size=size).select("shard_id", "document")
    rows.repartition("shard_id").write.partitionBy("shard_id").parquet(path)


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return assign_shards(table(spark, folder, "documents"))
