"""Removal of byte strings that occur earlier in the corpus, by run-length indexes of its repetitive part.

Every window of ``length`` bytes belongs to its minimizer, the least hash of its k-byte strings; a stretch of
windows with one minimizer is kept as one string. Equal windows share the minimizer, so only stretches whose
minimizer occurs again can hold a repeat; whole copies of a document are put aside. The rest meet in buckets by minimizer. A bucket builds the
run-compressed Burrows-Wheeler transform of its stretches with suffix-array samples at the run ends. The
samples give the irreducible matches; streamed through the text they yield each position's longest match and
where it lies (matching statistics of the text against itself), and windows matched over their whole length are
chained to their earliest one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_arrow, staged, table, text_of

LENGTH = 100  # bytes
KMER = 32  # bytes hashed for a minimizer, a multiple of 8
PIECE = 1 << 20  # bytes hashed at once
BUCKET = 1 << 20  # bytes of stretches in a bucket, on average
CROWD = 2048  # stretches of a minimizer that a bucket takes as they are
WINDOWS = 1024  # of a stretch at most
SAMPLE = 64  # one document in so many is looked at for minimizers that hold over a thousandth of the stretches
FREQUENT = 1000
SEPARATOR, END = 0xFF, 0xFE  # bytes that UTF-8 has not


# Stretches of windows that share a minimizer.


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number."""
    words = data.astype(np.uint64)
    for width in (1, 2, 4):
        words = words[:-width] | (words[width:] << np.uint64(8 * width))
    return words


def _hashes(data: np.ndarray, kmer: int) -> np.ndarray:
    words = _words(data)
    size = len(data) - kmer + 1
    total = np.zeros(size, np.uint64)
    for at in range(0, kmer, 8):
        total += words[at : at + size]
        total *= np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(31)
    return total


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each position on."""
    span = 1
    while 2 * span <= width:
        values, span = np.minimum(values[:-span], values[span:]), 2 * span
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


def stretches(data: np.ndarray, length: int = LENGTH, kmer: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, windows, whether it may repeat itself) of the stretches in ``data``, one text's bytes.

    The windows of a stretch are all different unless the first place of its minimizer is left behind for another one.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
    for begin in range(0, max(len(data) - length + 1, 0), PIECE):
        hashes = _hashes(data[begin : begin + PIECE + length - 1], kmer)
        least = _least(hashes, length - kmer + 1)
        fresh = np.ones(len(least), bool)
        fresh[1:] = least[1:] != least[:-1]
        first = np.flatnonzero(fresh)
        if len(least) > WINDOWS:  # long ones, where a text is periodic, are cut
            at = np.arange(len(least))
            fresh |= (at - np.repeat(first, np.diff(np.append(first, len(least))))) % WINDOWS == 0
            first = np.flatnonzero(fresh)
        left = np.zeros(len(least), bool)
        left[1:] = ~fresh[1:] & (hashes[: len(least) - 1] == least[:-1])
        again = np.logical_or.reduceat(left, first)
        found.append((least[first].view(np.int64), first + begin, np.diff(np.append(first, len(least))), again))
    return tuple(np.concatenate(x) for x in zip(*found))


def _texts(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    column = batch["text"].cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    for begin, end in zip(ends[:-1], ends[1:]):
        yield data[begin:end]


def _minimizers(batches: Iterator[pa.RecordBatch], length: int, kmer: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, found = batch["row"].to_numpy(), []
        for data in _texts(batch):
            mz, _, _, again = stretches(data, length, kmer)
            found.append(np.concatenate([mz, mz[again]]))  # shared with itself
        of = np.repeat(rows, [len(x) for x in found])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.int64)])), pa.array(of)], names=["mz", "row"])


def _taken(batches: Iterator[pa.RecordBatch], length: int, kmer: int) -> Iterator[pa.RecordBatch]:
    """The stretches whose minimizer is among those asked for."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            parts: list[pa.RecordBatch] = []
            asked, held, ties = (batch[c].to_pylist() for c in ("mzs", "ns", "tie"))
            copies = batch["copies"].to_pylist()
            for i, data in enumerate(_texts(batch)):
                if not asked[i] or ties[i] in copies[i]:
                    continue
                mz, first, windows, again = stretches(data, length, kmer)
                known, where = np.unique(np.array(asked[i], np.int64), return_index=True)
                place = np.minimum(np.searchsorted(known, mz), len(known) - 1)
                keep = known[place] == mz
                counts = np.array(held[i], np.int64)[where][place[keep]]
                mz, first, windows, again = mz[keep], first[keep], windows[keep], again[keep]
                content = [data[a : a + n + length - 1].tobytes() for a, n in zip(first, windows)]
                fixed = [pa.repeat(batch[c][i], len(mz)) for c in ("row", "tie", "doc_id")]
                parts.append(
                    pa.RecordBatch.from_arrays(
                        [pa.array(mz), pa.array(counts), *fixed, pa.array(first), pa.array(content, pa.binary()), pa.array(again)],
                        names=["mz", "n", "row", "tie", "doc_id", "start", "content", "again"],
                    )
                )
            yield from pa.Table.from_batches(parts).combine_chunks().to_batches() if parts else ()


# The index of a bucket.


@dataclass(frozen=True)
class RunLengthIndex:
    """Run-length BWT: the runs' symbols and starts, and the suffix-array samples at each run's first and last place."""

    symbols: np.ndarray
    starts: np.ndarray
    first: np.ndarray
    last: np.ndarray


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, by doubling from eight bytes on. ``data`` ends with a byte found nowhere else."""
    size = len(data)
    keys = _words(np.concatenate([data, np.zeros(7, np.uint8)])).byteswap()  # compares as the bytes do
    order = np.argsort(keys)
    lined, places = keys[order], np.arange(size)  # places still open, and their keys in order
    fresh, rank, width = np.ones(size, bool), np.empty(size, np.uint64), 8
    while True:
        differ = np.append(True, lined[1:] != lined[:-1])
        fresh[places] = differ
        rank[order[places]] = np.maximum.accumulate(np.where(differ, places, 0)) + 1
        places = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
        if not len(places):
            return order
        at = order[places]
        behind = np.where(at + width < size, rank[np.minimum(at + width, size - 1)], 0).astype(np.uint64)
        keys = rank[at] * np.uint64(size + 1) + behind
        again = np.argsort(keys)
        order[places], lined = at[again], keys[again]
        width *= 2


def build_index(data: np.ndarray) -> RunLengthIndex:
    order = suffix_array(data)
    transform = data[order - 1]
    heads = np.ones(len(data), bool)
    heads[1:] = transform[1:] != transform[:-1]
    starts = np.flatnonzero(heads)
    return RunLengthIndex(transform[starts], starts, order[starts], order[np.append(starts[1:], len(data)) - 1])


def _common(data: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Bytes that agree from positions ``one`` and ``other`` on."""
    words = _words(np.concatenate([data, np.zeros(7, np.uint8)]))
    total = np.zeros(len(one), np.int64)
    live = np.arange(len(one))
    while len(live):
        a, b = one[live] + total[live], other[live] + total[live]
        inside = np.maximum(a, b) < len(data)
        differ = words[np.minimum(a, len(data) - 1)] ^ words[np.minimum(b, len(data) - 1)]
        lowest = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.log2(np.maximum(lowest, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        total[live] += np.where(inside, same, 0)
        live = live[inside & (differ == 0)]
    return total


def matching_statistics(data: np.ndarray, index: RunLengthIndex) -> tuple[np.ndarray, np.ndarray]:
    """For each position of ``data``: the length of its match with the suffix ordered just before it, and where that lies.

    At the first place of a run the match is compared, with the sample that ends the run before. At all others it is that of the
    position before, one byte shorter and one byte on.
    """
    sampled = index.first[1:]
    match = index.last[:-1]
    lengths = np.concatenate([[0], _common(data, sampled, match)])
    text_order = np.argsort(index.first, kind="stable")
    places, lengths, match = index.first[text_order], lengths[text_order], np.concatenate([[0], match])[text_order]
    at = np.arange(len(data))
    nearest = np.searchsorted(places, at, side="right") - 1
    gone = np.where(nearest >= 0, at - places[nearest], 0)
    known = nearest >= 0
    return np.where(known, lengths[nearest] - gone, 0), np.where(known, match[nearest] + gone, 0)


def repeated_windows(contents: list[bytes], length: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content, first byte, byte behind the last) of the runs of windows in distinct ``contents`` that occur earlier.

    ``order`` gives each content's first window a number; a window's is larger by its distance from the first.
    """
    data = np.frombuffer(b"".join(c + bytes([SEPARATOR]) for c in contents) + bytes([END]), np.uint8)
    lengths, match = matching_statistics(data, build_index(data))
    begins = np.cumsum([0] + [len(c) + 1 for c in contents[:-1]])
    windows = np.array([len(c) - length + 1 for c in contents])
    at = np.concatenate([b + np.arange(n) for b, n in zip(begins, windows)])
    number = np.full(len(data), np.iinfo(np.int64).max)
    number[at] = np.concatenate([o + np.arange(n) for o, n in zip(order, windows)])
    # Chains of whole matches lead to one suffix for each different window.
    leader = np.where(lengths >= length, match, np.arange(len(data)))
    while not np.array_equal(ahead := leader[leader], leader):
        leader = ahead
    earliest = np.full(len(data), np.iinfo(np.int64).max)
    np.minimum.at(earliest, leader[at], number[at])
    later = np.zeros(len(data) + 1, np.int8)
    later[at] = number[at] > earliest[leader[at]]
    edges = np.flatnonzero(np.diff(later, prepend=0))  # contents are apart, so no run crosses them
    begin, end = edges[::2], edges[1::2]
    of = np.searchsorted(begins, begin, side="right") - 1
    return of, begin - begins[of], end - begins[of] + length - 1


def _marked(bucket: pa.Table, length: int) -> pa.Table:
    """Spans of a bucket's stretches that occur earlier."""
    bucket = bucket.sort_by([("doc_id", "ascending"), ("tie", "ascending"), ("start", "ascending")])  # NULL last
    doc_ids, ties, starts = (bucket[c].to_pylist() for c in ("doc_id", "tie", "start"))
    rows, minimizers, contents, again = (bucket[c].to_pylist() for c in ("row", "mz", "content", "again"))
    marks: list[tuple[int, int, int, int]] = []
    first: dict[bytes, int] = {}
    for i, content in enumerate(contents):
        one = first.setdefault(content, i)
        if (doc_ids[one], ties[one], starts[one]) != (doc_ids[i], ties[i], starts[i]):
            marks.append((rows[i], ties[i], starts[i], starts[i] + len(content)))
    # Where a minimizer's stretches are all alike and do not repeat themselves, there is no more to compare.
    alike: dict[int, list[int]] = {}
    for i in first.values():
        alike.setdefault(minimizers[i], []).append(i)
    left = sorted(i for found in alike.values() for i in found if len(found) > 1 or again[i])
    if left:
        documents: dict[tuple, int] = {}
        order = np.array([(documents.setdefault((doc_ids[i], ties[i]), len(documents)) << 40) + starts[i] for i in left])
        for k, begin, end in zip(*(x.tolist() for x in repeated_windows([contents[i] for i in left], length, order))):
            i = left[k]
            marks.append((rows[i], ties[i], starts[i] + begin, starts[i] + end))
    columns = list(zip(*marks)) or [()] * 4
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["row", "tie", "begin", "end"])


# The corpus.


def _named(docs: DataFrame) -> DataFrame:
    """``row, tie`` name a document; rows alike in both are repeated rows. ``tie`` orders equal ids."""
    texts = docs.select("doc_id", text_of().alias("text")).withColumn("tie", F.xxhash64("text"))
    return texts.withColumn("row", F.xxhash64("doc_id", "tie"))


def whole_copies(named: DataFrame) -> DataFrame:
    """``row, tie, size`` of documents whose whole text is that of an earlier one; one row of each text goes on."""
    order = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "tie", "row")
    keyed = named.select(F.unhex(F.sha2("text", 256)).alias("name"), "row", "tie", order.alias("here"), F.octet_length("text").alias("size"))
    return keyed.join(keyed.groupBy("name").agg(F.min("here").alias("first")), "name").where("here != first").select("row", "tie", "size")


def shared_minimizers(named: DataFrame, copies: DataFrame, length: int = LENGTH, kmer: int = KMER) -> DataFrame:
    """``row, mzs, ns, copies``: the minimizers of rows that occur twice or more, how often, and the rows' ties in ``copies``."""

    def found(of: DataFrame) -> DataFrame:
        return in_arrow(of.select("row", "text"), lambda b: _minimizers(b, length, kmer), "mz long, row long")

    counts = found(named.where(F.pmod("row", F.lit(SAMPLE)) == 0)).groupBy("mz").agg(F.count("*").alias("n"))
    counts = staged(counts, "repeat-sample")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # Fewer than FREQUENT rows, for each holds more than that share of the sample.
    frequent = counts.where(F.col("n") > max(total / FREQUENT, 8)).select("mz", F.lit(1 << 40).alias("n"))
    rows = found(named).join(F.broadcast(frequent), "mz", "left")
    # The others are counted where they meet; frequent ones are known to be shared and are only spread.
    spread = F.when(F.col("n").isNotNull(), F.col("row") % 4096).otherwise(F.lit(0))
    counted = rows.withColumn("spread", spread).withColumn("met", F.count("*").over(Window.partitionBy("mz", "spread")))
    shared = counted.withColumn("n", F.coalesce("n", "met")).where("n > 1")
    found = shared.select("row", "mz", "n", F.lit(None).cast("long").alias("copy"))
    left_out = copies.select("row", F.lit(None).cast("long").alias("mz"), F.lit(None).cast("long").alias("n"), F.col("tie").alias("copy"))
    lists = [F.collect_list("mz").alias("mzs"), F.collect_list("n").alias("ns"), F.collect_set("copy").alias("copies")]
    return found.unionByName(left_out).groupBy("row").agg(*lists)


def _first(start: Column) -> Column:
    return F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "tie", start.alias("start"))


def _crowded(crowd: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(marks, stretches for the buckets) of minimizers with very many stretches.

    Equal stretches are reduced to their first before they meet. A minimizer with still too many different ones is
    settled window by window, each combined where it lies.
    """
    named = crowd.withColumn("name", F.unhex(F.sha2("content", 256)))
    here = _first(F.col("start"))
    carried = [F.min_by(c, here).alias(c) for c in ("content", "row", "again")]
    firsts = staged(named.groupBy("name", "mz").agg(F.min(here).alias("first"), *carried), "repeat-crowds")
    copies = (
        named.select("name", "row", "tie", "start", here.alias("here"), F.octet_length("content").alias("size"))
        .join(firsts.select("name", "first"), "name")
        .where("here != first")
        .select("row", "tie", F.col("start").alias("begin"), (F.col("start") + F.col("size")).alias("end"))
    )
    sizes = firsts.groupBy("mz").agg(F.count("*").alias("different"))
    kept = firsts.join(sizes, "mz").select("mz", "row", "first.doc_id", "first.tie", "first.start", "content", "again", "different")
    wide = kept.where(F.col("different") > CROWD)
    at = F.col("start") + F.col("offset")
    windows = (
        wide.withColumn("offset", F.explode(F.sequence(F.lit(0), F.octet_length("content") - length)))
        .withColumn("name", F.unhex(F.sha2(F.substring("content", F.col("offset") + 1, F.lit(length)), 256)))
        .select("name", "row", "tie", "doc_id", at.alias("start"))
    )
    earliest = windows.groupBy("name").agg(F.min(_first(F.col("start"))).alias("first"))
    later = (
        windows.withColumn("here", _first(F.col("start"))).join(earliest, "name").where("here != first")
        .select("row", "tie", F.col("start").alias("begin"), (F.col("start") + length).alias("end"))
    )
    return copies.unionByName(later), kept.where(F.col("different") <= CROWD).drop("different")


def repeated_spans(docs: DataFrame, length: int = LENGTH, kmer: int = KMER) -> DataFrame:
    """``row, tie, begin, end``: spans of bytes, possibly overlapping, that hold all repeats of ``length`` bytes."""
    if kmer % 8 or not 8 <= kmer <= length:
        raise ValueError("kmer must be a multiple of 8 and at most length")
    named = _named(docs)
    copies = staged(whole_copies(named).where(F.col("size") >= length), "repeat-copies")
    shared = shared_minimizers(named, copies, length, kmer)
    joined = named.join(shared, "row").select("row", "tie", "doc_id", "text", "mzs", "ns", "copies")
    kind = named.schema["doc_id"].dataType.simpleString()
    fields = f"mz long, n long, row long, tie long, doc_id {kind}, start long, content binary, again boolean"
    taken = staged(in_arrow(joined, lambda b: _taken(b, length, kmer), fields), "repeat-stretches")
    marks, few = _crowded(taken.where(F.col("n") > CROWD).drop("n"), length)
    gathered = taken.where(F.col("n") <= CROWD).drop("n").unionByName(few)
    size = taken.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    buckets = gathered.withColumn("bucket", F.pmod(F.xxhash64("mz"), F.lit(max(1, -(-size // BUCKET)))))
    indexed = buckets.groupBy("bucket").applyInArrow(lambda b: _marked(b, length), "row long, tie long, begin long, end long")
    whole = copies.select("row", "tie", F.lit(0).cast("long").alias("begin"), F.col("size").cast("long").alias("end"))
    return marks.unionByName(indexed).unionByName(whole)


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The documents without their marked bytes; a repeated row is a repeat as a whole."""
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            rows: dict[str, list] = {n: [] for n in ("doc_id", "n_bytes", "spans", "kept", "times")}
            for doc_id, text, times, marks in zip(*[batch[c].to_pylist() for c in ("doc_id", "text", "times", "marks")]):
                text = text.encode()
                merged: list[list[int]] = []
                for mark in sorted((m["begin"], m["end"]) for m in marks or ()):
                    if merged and mark[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], mark[1])
                    else:
                        merged.append([*mark])
                edges = [0, *(e for m in merged for e in m), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                found = [([{"begin": a, "end": b} for a, b in merged], kept, 1)]
                if times > 1:
                    found.append(([{"begin": 0, "end": len(text)}], b"", times - 1) if len(text) >= length else ([], text, times - 1))
                for spans, left, n in found:
                    for name, value in zip(rows, (doc_id, len(text), spans, left, n)):
                        rows[name].append(value)
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.list_(span), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], names=list(rows))


def remove_repeats(docs: DataFrame, length: int = LENGTH, kmer: int = KMER) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: every document without the bytes that ``length``-byte repeats cover.

    A repeat starts earlier in the corpus too: in a document with a smaller ``doc_id`` (NULL is last; of equal ids the smaller
    text hash first), or earlier in the same one. ``spans`` are the maximal removed runs, ``kept`` the remaining bytes. NULL
    texts are empty and shorter ones than ``length`` stay; of repeated rows the first one counts as the earlier. Other columns
    are ignored, an empty table gives an empty result.
    """
    marks = (
        repeated_spans(docs, length, kmer).groupBy("row", "tie").agg(F.collect_list(F.struct("begin", "end")).alias("marks"))
    )
    texts = _named(docs).groupBy("row", "tie").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("times"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary, times long"
    cut = in_arrow(texts.join(marks, ["row", "tie"], "left").select("doc_id", "text", "times", "marks"), lambda b: _cut(b, length), schema)
    return cut.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")


def op12_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All ``documents`` without passages of 100 bytes or more that occur earlier."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return remove_repeats(table(spark, folder, "documents")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


# Too slow for whole tables; a test holds the query against it on a small one.
OP12_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY md5(hx[2 * i + 1:2 * i + 200]) ORDER BY doc_id, i) AS place
  FROM (SELECT doc_id, hx, unnest(range(n - 99)) AS i FROM d)
),
later AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, -1) AS fresh FROM w WHERE place > 1),
runs AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM later),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM spans
  UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id
),
kept AS (
  SELECT doc_id, string_agg(hx[2 * x + 1:2 * coalesce(y, n)], '' ORDER BY x) AS hx FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
),
sums AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(s.n_removed, 0) AS n_removed, coalesce(s.n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(k.hx, CASE WHEN s.doc_id IS NULL THEN d.hx ELSE '' END))) AS kept_sha256
FROM d LEFT JOIN sums s USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
