"""Packing of token pieces into sequences: shortest pack first over the length histogram.

Documents are cut into full sequences and a rest. Only the histogram of lengths, at most one row
per possible length, reaches the driver. There the lengths are placed longest first, always into
the packs that are shortest so far; a pack pattern carries the number of sequences that follow it.
The patterns then say, for every length and rank, in which sequence and where a piece lies, and
pieces find their place by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import in_arrow, staged, table, text_of

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
SEQUENCE = 2048
END_ID = 1
RANK_BLOCK = 20_000  # pieces ranked by one window group


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str, ranks: str, size: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder = bpe.library_encoder(vocabulary, ranks)
    encoder.memo.taken()
    end, width = bpe.packed([end_id]), 4 * size
    for batch in batches:
        for begin in range(0, batch.num_rows, 512):
            part = batch.slice(begin, 512)
            rows: dict[str, list] = {n: [] for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                ids = encoder(text) + end
                for at in range(0, len(ids), width):
                    piece = ids[at : at + width]
                    rows["doc_id"].append(doc)
                    rows["start"].append(at // 4)
                    rows["length"].append(len(piece) // 4)
                    rows["ids_crc32"].append(zlib.crc32(piece))
                    rows["doc_tokens"].append(len(ids) // 4)
                    if with_ids:
                        rows["ids"].append(piece)
            arrays = [pa.array(rows["doc_id"], batch.schema.field("doc_id").type)]
            arrays += [pa.array(rows[n], pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens")]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                arrays, names = [*arrays, pa.array(rows["ids"], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def token_pieces(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    ranks: str = RANKS,
    size: int = SEQUENCE,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Documents as pieces of at most ``size`` ids, each document closed by ``end_id``.

    NULL and empty texts are one piece holding the end id alone.
    """
    docs = docs.select("doc_id", text_of().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return in_arrow(docs, lambda b: _pieces(b, vocabulary, ranks, size, end_id, with_ids), schema)


@dataclass(frozen=True)
class Pattern:
    """Lengths lying one after another, and how many sequences are filled so."""

    lengths: tuple[int, ...]
    count: int


def pack_lengths(histogram: dict[int, int], size: int) -> list[Pattern]:
    """Patterns that use every length as often as the histogram has it.

    Longest lengths first; each goes into the packs with the most room left that still hold it,
    so a new sequence is begun only if no open one has room. New ones take as many of the length as
    fit. The work depends on ``size``, not on the number of pieces.
    """
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}  # room left: (count, lengths)
    roomiest = 0
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= size:
            raise ValueError(f"length {length} does not fit a sequence of {size}")
        left = histogram[length]
        room = roomiest
        while left:
            while room >= length and not open_packs.get(room):
                room -= 1
            if room < length:
                # As many full new packs as there are pieces for, then one with what is left.
                copies = min(size // length, left)
                taken, lengths, rest = left // copies, (), size
            else:
                count, lengths = open_packs[room].pop()
                copies, taken, rest = 1, min(count, left), room
                if count > taken:
                    open_packs[room].append((count - taken, lengths))
            rest -= copies * length
            open_packs.setdefault(rest, []).append((taken, (*lengths, *[length] * copies)))
            roomiest = max(roomiest, rest)
            # The rest of this length goes into new packs as well, not on top of those just filled.
            room = 0 if copies > 1 else max(room, rest)
            left -= taken * copies
    return [Pattern(lengths, count) for packs in open_packs.values() for count, lengths in packs]


def placements(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset), sorted by length and rank.

    Ranks from one row's first up to the next row's follow each other in consecutive sequences.
    """
    rows, used, sequence = [], {}, 0
    for pattern in patterns:
        offset = 0
        for length in pattern.lengths:
            rank = used.get(length, 0)
            rows.append((length, rank, sequence, offset))
            used[length] = rank + pattern.count
            offset += length
        sequence += pattern.count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def ranked(pieces: DataFrame, block: int = RANK_BLOCK) -> DataFrame:
    """Adds ``rank``: 0, 1, 2, … among the pieces of a length.

    A length may be that of a third of all pieces, so pieces are dealt into blocks by a hash, ranked
    within (length, block), and moved on by the sizes of the blocks before.
    """
    total = pieces.count()
    identity = [F.col(c) for c in pieces.columns]
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64(*identity), F.lit(max(1, -(-total // block)))))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        dealt.groupBy("length", "block")
        .agg(F.count("*").alias("n"))
        .select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    )
    within = Window.partitionBy("length", "block").orderBy(*[c.asc_nulls_last() for c in identity])
    return (
        dealt.withColumn("place", F.row_number().over(within))
        .join(shifts, ["length", "block"])
        .withColumn("rank", F.col("shift") + F.col("place") - 1)
        .drop("block", "shift", "place")
    )


def _placed(batches: Iterator[pa.RecordBatch], rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Finds each piece's row by binary search on (length, rank)."""
    scale = 1 << 48
    keys = rows[:, 0] * scale + rows[:, 1]
    for batch in batches:
        rank = batch["rank"].to_numpy()
        at = np.searchsorted(keys, batch["length"].to_numpy() * scale + rank, side="right") - 1
        found = rows[at]
        columns = [batch[n] for n in batch.schema.names if n != "rank"]
        names = [n for n in batch.schema.names if n != "rank"]
        sequence = pa.array(found[:, 2] + rank - found[:, 1])
        yield pa.RecordBatch.from_arrays([*columns, sequence, pa.array(found[:, 3])], names=[*names, "sequence_id", "offset"])


def pack(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``size``.

    ``pieces`` must read the same rows each time (a written table): it is read for the histogram
    and again for the result. Equal rows may lie in different sequences; an empty table stays empty.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = placements(pack_lengths(histogram, size))
    if not len(rows):
        rows = np.zeros((1, 4), np.int64)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    known = ranked(pieces).select(*pieces.columns, "rank")
    return in_arrow(known, lambda b: _placed(b, rows), f"{kinds}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    ranks: str = RANKS,
    size: int = SEQUENCE,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Every document's pieces and where they lie: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``, and ``ids`` if asked for.

    Each id lies in exactly one piece. NULL texts are empty, a NULL ``doc_id`` stays NULL, repeated
    rows are packed as often as they occur, other columns are ignored. Texts are encoded once: the
    pieces are written below the shared work folder.
    """
    pieces = token_pieces(docs, vocabulary, ranks, size, end_id, with_ids)
    return pack(staged(pieces, "pack-pieces"), size)


def op2_pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"))
