"""Byte-level BPE encoding and decoding with overlapping chunks.

Long texts are cut into overlapping chunks that are pre-tokenised in parallel. Where the matches
of one chunk and of the next begin at the same place, both go on alike from there, because a match
depends only on what follows it; the text is cut at such a place. The pieces are encoded in
parallel and their ids put in order. Chunks that never resynchronise are encoded together.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import in_arrow, staged, table, text_of

RANKS = "byte_bpe_multi_50k.tiktoken"
CHUNK = 16_384  # characters; a longer text is cut
OVERLAP = 256  # characters read beyond a chunk's end to find a common boundary
LOOK_AHEAD = 3  # characters the split pattern may look at beyond a match
ROWS = 128  # rows of a batch that a task holds as Python objects at a time
IDS = 65_536  # ids that it holds as numbers


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def _chunks(batches: Iterator[pa.RecordBatch], size: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Every text as rows of (key, chunk number, last, characters with the overlap)."""
    for batch in batches:
        for key, text in zip(batch["key"], batch["text"]):
            key, text = key.as_py(), text.as_py()
            last = (len(text) - 1) // size
            for first in range(0, last + 1, 64):
                numbers = range(first, min(last + 1, first + 64))
                cut = [text[k * size : (k + 1) * size + overlap + LOOK_AHEAD] for k in numbers]
                yield pa.record_batch(
                    [[key] * len(cut), list(numbers), [k == last for k in numbers], cut],
                    schema=pa.schema([("key", pa.string()), ("chunk", pa.int64()), ("last", pa.bool_()), ("body", pa.string())]),
                )


def _boundaries(text: str, pattern, closed: bool) -> list[int]:
    """Where matches begin; without those that text beyond the end may change."""
    end = len(text) if closed else len(text) - LOOK_AHEAD
    found = []
    for match in pattern.finditer(text):
        found.append(match.start())
        if match.end() > end:
            break
    return found


def _pre_tokenise(batches: Iterator[pa.RecordBatch], size: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Adds the boundaries within the chunk's first ``overlap`` characters, and beyond its end.

    Only boundaries after a character that is not blank count: a piece that ends there has no
    blank at its end whose match could depend on the text cut off.
    """
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    kind = pa.list_(pa.int64())
    for batch in _slices(batches):
        head, tail = [], []
        bodies = batch["body"].to_pylist()
        for body, last in zip(bodies, batch["last"].to_pylist()):
            found = [p for p in _boundaries(body, pattern, last) if p and not body[p - 1].isspace()]
            head.append([p for p in found if p < overlap])
            tail.append([] if last else [p - size for p in found if 0 < p - size < overlap])
        blank = [[body[p] in " \n" for p in h] for body, h in zip(bodies, head)]
        columns = [*batch.columns, pa.array(head, kind), pa.array(tail, kind), pa.array(blank, pa.list_(pa.bool_()))]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "chunk", "last", "body", "head", "tail", "blank"])


def _encode(batches: Iterator[pa.RecordBatch], ranks: str) -> Iterator[pa.RecordBatch]:
    """(…, text) to (…, ids): packed little-endian unsigned 32-bit integers."""
    encoding = bpe.rank_encoding(ranks)
    for part in _slices(batches):
        names = [n for n in part.schema.names if n != "text"]
        ids = pa.array([bpe.packed(encoding.encode_ordinary(t)) for t in part["text"].to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*(part[n] for n in names), ids], names=[*names, "ids"])


def _decode(batches: Iterator[pa.RecordBatch], ranks: str) -> Iterator[pa.RecordBatch]:
    encoding = bpe.rank_encoding(ranks)

    def text_bytes(ids: bytes) -> bytes:
        return b"".join(encoding.decode_bytes(bpe.unpacked(ids[k : k + 4 * IDS])) for k in range(0, len(ids), 4 * IDS))

    for part in _slices(batches):
        raw = [None if x is None else text_bytes(x) for x in part["ids"].to_pylist()]
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=[*part.schema.names, "bytes"])


def encode_documents(
    docs: DataFrame, ranks: str = RANKS, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``doc_id, ids``: one row per row of ``docs``; ids as packed unsigned 32-bit integers.

    NULL and empty texts give empty ids; a NULL ``doc_id`` stays NULL; repeated rows are repeated;
    other columns are ignored. An empty table gives an empty table.
    """
    if not 0 < overlap <= chunk:
        raise ValueError("overlap must be positive and at most the chunk size")
    docs = docs.select(F.col("doc_id"), text_of().alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    is_long = F.char_length("text") > chunk
    short = in_arrow(docs.where(~is_long), lambda b: _encode(b, ranks), f"doc_id {id_type}, ids binary")

    # Equal rows are encoded once. The key stands for row content and so survives a recomputation.
    key = F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2("text", 256)), 256)
    long = docs.where(is_long).withColumn("key", key)
    rows = long.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    texts = long.groupBy("key").agg(F.first("text").alias("text"))
    body = "key string, chunk long, last boolean, body string"
    cut = in_arrow(texts, lambda b: _chunks(b, chunk, overlap), body).repartition("key", "chunk")
    notes = "head array<long>, tail array<long>, blank array<boolean>"
    read = staged(in_arrow(cut, lambda b: _pre_tokenise(b, chunk, overlap), f"{body}, {notes}"), "bpe-chunks")
    pieces = stitch(read, chunk)
    encoded = in_arrow(pieces, lambda b: _encode(b, ranks), "key string, first long, ids binary")
    joined = (
        encoded.groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("first", "ids"))).alias("parts"))
        .select("key", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids"))
    )
    whole = (
        joined.join(rows, "key")
        .select("doc_id", "ids", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        .select("doc_id", "ids")
    )
    return short.unionByName(whole)


def stitch(read: DataFrame, chunk: int) -> DataFrame:
    """Pre-tokenised chunks to pieces ``key, first, text`` that can be encoded one by one.

    A chunk begins a piece at the first boundary it shares with the chunk before it. As long as
    every chunk so far has resynchronised, any shared boundary will do. After one that has not,
    only a boundary before a blank does: a match can never reach over that one.
    """
    order = Window.partitionBy("key").orderBy("chunk")
    shared = F.array_intersect("head", F.lag("tail").over(order))
    notes = read.select("key", "chunk", "head", "blank", shared.alias("shared"))
    before_blank = F.filter(
        F.col("shared"),
        lambda p: F.element_at("blank", F.array_position("head", p).cast("int")),
    )
    notes = notes.select(
        "key",
        "chunk",
        F.when(F.col("chunk") == 0, 0).otherwise(F.array_min("shared")).alias("any_cut"),
        F.when(F.col("chunk") == 0, 0).otherwise(F.array_min(before_blank)).alias("blank_cut"),
    )
    broken = F.coalesce(
        F.max(F.col("any_cut").isNull()).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)
    )
    cuts = notes.select(
        "key",
        "chunk",
        F.when(broken, F.col("blank_cut")).otherwise(F.coalesce("blank_cut", "any_cut")).alias("cut"),
    )
    cuts = cuts.select(
        "key",
        "chunk",
        F.coalesce("cut", F.lit(0)).alias("begin"),
        (chunk + F.coalesce(F.lead("cut").over(order), F.lit(0))).alias("end"),
        F.max(F.when(F.col("cut").isNotNull(), F.col("chunk")))
        .over(order.rowsBetween(Window.unboundedPreceding, 0))
        .alias("first"),
    )
    part = F.when(F.col("last"), F.expr("substring(body, cast(begin + 1 as int))")).otherwise(
        F.expr("substring(body, cast(begin + 1 as int), cast(end - begin as int))")
    )
    return (
        read.select("key", "chunk", "last", "body")
        .join(cuts, ["key", "chunk"])
        .select("key", "first", "chunk", part.alias("part"))
        .groupBy("key", "first")
        .agg(F.array_sort(F.collect_list(F.struct("chunk", "part"))).alias("parts"))
        .select("key", "first", F.array_join("parts.part", "").alias("text"))
    )


def decode_documents(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Adds ``bytes``: the raw bytes of the ids one after another. NULL ids give NULL."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return in_arrow(encoded, lambda b: _decode(b, ranks), f"{kinds}, bytes binary")


def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document and what they decode to, as digests."""
    encoded = encode_documents(table(spark, folder, "documents"))
    return decode_documents(encoded).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
