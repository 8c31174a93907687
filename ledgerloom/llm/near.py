"""Near-duplicate groups by HyperMinHash.

A document's shingle hashes are dealt into buckets by their value; the smallest of a bucket is kept
as a register of its leading-zero count and some mantissa bits. Four registers make a band.
Documents that share a band are candidates; a collision-corrected estimate from all registers drops
the hopeless ones, and what remains is confirmed on the full shingle sets.

Copies with the same set are one node. Within a band's bucket, nodes are first compared with one
centre, which joins most of a large group with as many comparisons as it has members, and buckets
that still hold several components with another one. Only nodes then still in different components
are compared with each other, in large buckets block against block, so no group is expanded into
all pairs, and no link between components is lost.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Memo
from .common import in_arrow, staged, table, text_of

WIDTH = 5  # words of a shingle, unless a contract says otherwise
PERCENT = 80  # least similarity
BANDS, ROWS = 32, 4  # a pair at 0.8 shares no band with probability 5e-8
MANTISSA = 10  # bits; the other 6 bits of a register count zeros
COLLISION = 0.17 / (1 << MANTISSA)  # that registers of unequal minima agree, sets of like size
SLACK = 6.0  # standard errors an estimate may lie below the limit
LIGHT = 8  # pairs per row up to which a bucket's pairs are made
BLOCK_ITEMS = 400_000  # shingles of a block in larger buckets
BLOCK_CELLS = 1 << 24  # comparisons of a task at a time
BLOCK_ROWS = 4096  # rows of a block that query rows are held against at a time
COLUMNS = 2048  # shingles multiplied at a time
EMPTY = 0xFFFF

BUCKETS = BANDS * ROWS
EDGES = np.array([-(-(i << 64) // BUCKETS) for i in range(BUCKETS)], dtype=np.uint64)


def _word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


@functools.lru_cache(1)
def _memo() -> Memo:
    return Memo(_word_hash)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; A-Z are lower-cased.

    Fewer words than ``width`` are one shingle, no words none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    memo = _memo()
    hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    span = min(width, len(words))
    out = np.full(len(words) - span + 1, span, np.uint64)
    for k in range(span):
        out = _mix(out + hashes[k : len(hashes) - span + 1 + k])
    return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The HyperMinHash registers (16 bits) of sorted distinct hashes."""
    at = np.searchsorted(hashes, EDGES)
    ends = np.append(at[1:], len(hashes))
    out = np.full(BUCKETS, EMPTY, np.uint16)
    filled = at < ends
    least = hashes[at[filled]] - EDGES[filled]
    # The minimum as a fraction of its bucket's range, in 63 bits.
    share = least.astype(np.float64) / (2.0**64 / BUCKETS)
    mantissa, exponent = np.frexp(np.maximum(share, 2.0**-60))
    zeros = np.clip(-exponent, 0, 62)
    bits = np.clip((mantissa * 2 - 1) * (1 << MANTISSA), 0, (1 << MANTISSA) - 1)
    out[filled] = (zeros.astype(np.uint16) << MANTISSA) | bits.astype(np.uint16)
    return out


def _signature(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, text) to (doc_id, text_hash, n_shingles, node, bands)."""
    _memo().taken()
    for batch in batches:
        counts, nodes, bands = [], [], []
        for text in batch["text"].to_pylist():
            found = shingles(text, width)
            counts.append(len(found))
            if len(found):
                nodes.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                bands.append(registers(found).view(np.int64))
            else:
                nodes.append(None)
                bands.append(None)
        arrays = [pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["text_hash"], *arrays],
            names=["doc_id", "text_hash", "n_shingles", "node", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    _memo().taken()
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            found = [shingles(t, width).view(np.int64) for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["node"], pa.array(found, pa.list_(pa.int64()))], names=["node", "items"])


def estimate(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected similarity of rows of registers, and how many buckets it rests on."""
    used = (left != EMPTY) | (right != EMPTY)
    same = (left == right) & used
    union = np.maximum(used.sum(1), 1)
    return np.maximum(same.sum(1) / union - COLLISION, 0) / (1 - COLLISION), union


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    limit = PERCENT / 100
    for batch in batches:
        if batch.num_rows:
            left, right = (
                np.asarray(batch[c].flatten(), np.int64).reshape(-1, BANDS).view(np.uint16) for c in ("bands_a", "bands_b")
            )
            value, union = estimate(left, right)
            keep = value >= limit - SLACK * np.sqrt(limit * (1 - limit) / union)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep))


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose estimated similarity may reach the limit."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("bands").alias(f"bands_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "bands_a", "bands_b")
    return in_arrow(joined, _hopeful, "a binary, b binary")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs linked by their full sets."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("items").alias(f"items_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    both = F.size(F.array_intersect("items_a", "items_b"))
    enough = 100 * both >= PERCENT * (F.size("items_a") + F.size("items_b") - both)
    return joined.where(enough).select("a", "b").distinct()


def _similar_size(x: Column, y: Column) -> Column:
    return (100 * F.least(x, y)) >= (PERCENT * F.greatest(x, y))


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (a, b): the smallest node it is connected with.

    Large-star and small-star rounds in turn; a node with many links is only ever grouped with
    partial aggregation, and the links are written after every round.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.where("u <> v").distinct(), "large-star")
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = staged(small.where("u <> v").distinct(), "small-star")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def _identified(docs: DataFrame) -> DataFrame:
    text = text_of()
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))


def near_groups(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, text_hash, n_shingles, first``: one row per row of ``docs``.

    ``first`` (missing, doc_id, text_hash) is the row of the connected group that comes first: by
    doc_id, NULL ids last. Texts without words (NULL, empty) are linked with nothing. Repeated rows
    are links of similarity 1. Other columns are ignored; an empty table gives an empty table.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = in_arrow(
        _identified(docs),
        lambda b: _signature(b, width),
        f"doc_id {kind}, text_hash long, n_shingles long, node binary, bands array<long>",
    )
    signed = staged(signed, "signatures")
    row = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash")
    nodes = staged(
        signed.where("node is not null")
        .groupBy("node")
        .agg(F.min(row).alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")),
        "nodes",
    )
    labels = _labels(docs, nodes, width)
    grouped = nodes.select("node", "first").join(labels, "node")
    leaders = grouped.groupBy("label").agg(F.min("first").alias("leader"))
    moved = staged(labels.join(leaders, "label").select("node", "leader"), "leaders")
    firsts = staged(
        nodes.select("node", "first").join(moved, "node", "left").select("node", F.coalesce("leader", "first").alias("first")),
        "firsts",
    )
    keyed = signed.drop("bands")
    with_words = keyed.where("node is not null").join(firsts, "node")
    without = keyed.where("node is null").withColumn("first", row)
    columns = ["doc_id", "text_hash", "n_shingles", "first"]
    return with_words.select(*columns).unionByName(without.select(*columns))


def _labels(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``node, label`` of the nodes that have confirmed links."""
    blank = F.lit(-1).cast("long")  # four empty registers
    banded = nodes.select("node", "n", F.posexplode("bands").alias("band", "value")).where(F.col("value") != blank)
    postings = banded.select(F.xxhash64("band", "value").alias("key"), "node", "n")
    shared = postings.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("other"))
    shared = staged(shared.where("centre <> other").select("key", "centre"), "band-centres")
    postings = staged(postings.join(shared, "key"), "postings")

    active = postings.select("node").distinct()
    wanted = nodes.join(active, "node").select("node", F.col("first.doc_id").alias("d"), F.col("first.text_hash").alias("h"))
    texts = _identified(docs).join(
        wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))
    )
    sets = staged(in_arrow(texts.select("node", "text"), lambda b: _sets(b, width), "node binary, items array<long>"), "sets")

    sizes = nodes.select(F.col("node").alias("centre"), F.col("n").alias("m"))
    pairs = postings.where("node <> centre").groupBy("centre", "node").agg(F.first("n").alias("n"))
    pairs = pairs.join(sizes, "centre").where(_similar_size(F.col("n"), F.col("m")))
    pairs = pairs.select(F.col("node").alias("a"), F.col("centre").alias("b"))
    labels = components(_confirmed(_likely(pairs, nodes), sets))

    # Every bucket that still holds several components takes another centre, each its own, so a
    # node meets up to BANDS of them.
    open_ = _unsettled(postings, labels)
    pick = F.struct(F.xxhash64("node", "key").alias("h"), "label", "node", "n")
    centres = open_.groupBy("key").agg(F.max(pick).alias("c"))
    centres = centres.select("key", F.col("c.node").alias("b"), F.col("c.label").alias("l"), F.col("c.n").alias("m"))
    pairs = open_.join(staged(centres, "band-centres"), "key").where(
        (F.col("label") != F.col("l")) & _similar_size(F.col("n"), F.col("m"))
    )
    pairs = pairs.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()
    labels = components(_edges(labels).unionByName(_confirmed(_likely(pairs, nodes), sets)))

    open_ = _unsettled(postings, labels)
    sizes = open_.groupBy("key", "label").agg(F.count("*").cast("double").alias("rows"), F.sum("n").alias("items"))
    pairs = (F.pow(F.sum("rows"), 2) - F.sum(F.col("rows") * F.col("rows"))) / 2
    sizes = sizes.groupBy("key").agg(
        (pairs > LIGHT * F.sum("rows")).alias("heavy"),
        F.sum("items").alias("items"),
        F.max_by("label", F.struct("rows", "label")).alias("main"),
    )
    sizes = staged(sizes, "bucket-sizes")
    light = _light_links(open_.join(sizes.where("not heavy").select("key"), "key"), nodes, sets)
    heavy = _heavy_links(open_.join(sizes.where("heavy"), "key"), sets)
    return components(_edges(labels).unionByName(light).unionByName(heavy))


def _light_links(open_: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links within buckets that have a few pairs per row at most."""
    x, y = (
        open_.select("key", F.col("node").alias(a), F.col("n").alias(n), F.col("label").alias(k))
        for a, n, k in (("a", "n", "k"), ("b", "m", "l"))
    )
    near = (F.col("k") < F.col("l")) & _similar_size(F.col("n"), F.col("m"))
    pairs = x.join(y, "key").where(near)
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    return _confirmed(_likely(pairs, nodes), sets)


def _heavy_links(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Links within large buckets, block against block and without making pairs.

    Rows outside the bucket's main component are held against all its rows. Both are dealt by hash
    into blocks of about BLOCK_ITEMS shingles, and a task sees two blocks at a time.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("items") / F.lit(BLOCK_ITEMS)).cast("int"))
    dealt = open_.select(
        "key", "node", "label", blocks.alias("blocks"), (F.col("label") != F.col("main")).alias("outside")
    ).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    as_query = dealt.where("outside").select("key", "node", "label", F.col("own").alias("i"), every.alias("j"), F.lit(True).alias("query"))
    as_row = dealt.select("key", "node", "label", every.alias("i"), F.col("own").alias("j"), F.lit(False).alias("query"))
    full = as_query.unionByName(as_row).join(sets, "node").select("key", "i", "j", "query", "node", "label", "items")
    return full.groupBy("key", "i", "j").applyInArrow(_block_links, "a binary, b binary").distinct()


def _block_links(block: pa.Table) -> pa.Table:
    """Links from every query row to every other component that it is linked with.

    Query rows and rows are taken in slices, so that there are about BLOCK_CELLS comparisons at a
    time, however many short rows the block has. A slice gives one link for each query row and component.
    """
    query = block["query"].to_numpy()
    left, right = np.flatnonzero(query), np.flatnonzero(~query)
    wide = max(1, BLOCK_CELLS // max(1, min(len(right), BLOCK_ROWS)))
    if len(left) <= wide and len(right) <= BLOCK_ROWS:
        return _slice_links(block)
    parts = [block.slice(0, 0).select(["node", "node"]).rename_columns(["a", "b"])]
    for j in range(0, len(right), BLOCK_ROWS):
        rows = block.take(pa.array(right[j : j + BLOCK_ROWS]))
        for i in range(0, len(left), wide):
            parts.append(_slice_links(pa.concat_tables([block.take(pa.array(left[i : i + wide])), rows])))
    return pa.concat_tables(parts)


def _slice_links(block: pa.Table) -> pa.Table:
    query = block["query"].to_numpy()
    sizes = block["items"].combine_chunks().value_lengths().to_numpy().astype(np.int64)
    owners = np.repeat(np.arange(len(query)), sizes)
    names, items = np.unique(block["items"].combine_chunks().flatten().to_numpy(), return_inverse=True)
    asked = np.bincount(items[query[owners]], minlength=len(names)) > 0
    held = np.bincount(items[~query[owners]], minlength=len(names)) > 0
    useful = asked & held
    places = np.cumsum(useful) - 1
    keep = useful[items]
    owners, items = owners[keep], places[items[keep]]
    left, right = np.flatnonzero(query), np.flatnonzero(~query)
    row_of = np.zeros(len(query), np.int64)
    row_of[left], row_of[right] = np.arange(len(left)), np.arange(len(right))
    both = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(items, kind="stable")
    owners, items = owners[order], items[order]
    for begin in range(0, int(useful.sum()), COLUMNS):
        lo, hi = np.searchsorted(items, (begin, begin + COLUMNS))
        who, what = owners[lo:hi], items[lo:hi] - begin
        x, y = np.zeros((len(left), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
        q = query[who]
        x[row_of[who[q]], what[q]] = 1
        y[row_of[who[~q]], what[~q]] = 1
        both += x @ y.T
    total = sizes[left][:, None] + sizes[right][None, :] - both
    labels = np.unique(np.array(block["label"].to_pylist(), dtype=object), return_inverse=True)[1]
    linked = (100 * both >= PERCENT * total) & (labels[left][:, None] != labels[right][None, :])
    a, b = np.nonzero(linked)
    first = np.unique(np.stack([a, labels[right[b]]], 1), axis=0, return_index=True)[1] if len(a) else a
    node = block["node"]
    return pa.table([node.take(pa.array(left[a[first]])), node.take(pa.array(right[b[first]]))], names=["a", "b"])


def _edges(labels: DataFrame) -> DataFrame:
    return labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))


def _unsettled(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings with their component's ``label``, of bands whose nodes are not all in one."""
    known = postings.join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
    known = staged(known, "labelled")
    spread = known.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    return staged(known.join(spread, "key", "left_semi"), "open-postings")


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` without those whose group has an earlier row; all columns are kept.

    Of rows with equal doc_id and text one stays.
    """
    groups = near_groups(docs, width)
    own = (F.col("doc_id").eqNullSafe(F.col("first.doc_id"))) & (F.col("text_hash") == F.col("first.text_hash"))
    copies = F.when(F.col("n_shingles") > 0, F.count("*")).otherwise(1)
    kept = groups.where(own).groupBy("doc_id", "text_hash", "n_shingles").agg(copies.alias("copies"))
    kept = staged(kept.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "copies"), "kept-rows")
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    rows = rows.withColumn("h2", F.xxhash64(text_of("row.text")))
    match = F.col("row.doc_id").eqNullSafe(F.col("d")) & (F.col("h2") == F.col("h"))
    once = rows.join(kept.where("copies = 1"), match, "left_semi").select("row")
    more = rows.join(kept.where("copies > 1"), match).groupBy("d", "h").agg(F.first("row").alias("row")).select("row")
    return once.unionByName(more).select("row.*")


def op7_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = near_groups(table(spark, folder, "documents"), width=2)
    component = F.col("first.doc_id")
    return groups.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )
