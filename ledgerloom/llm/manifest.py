"""Merkle manifest of a dataset by butterfly exchange.

Leaves are sorted into aligned blocks of ``fanout ** LEAF_LEVELS``; a block hashes its own subtree
and every leaf's path in it. Then the blocks swap subtree roots round by round: in a round,
groups of ``fanout ** WIDTH`` blocks, whose numbers differ in one digit only, learn each other's
root, and each block hashes the common ancestors itself. So every block ends with the path
of its own root up to the top, and nothing is handed down again. The roots of the groups are the
leaves of one more such tree.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, staged, table
from .places import numbered

FANOUT = 2
LEAF_LEVELS = 10  # levels hashed within a block
WIDTH = 4  # levels hashed in one round of the exchange
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before: string, after: string>>"
STEP = pa.struct([("before", pa.string()), ("after", pa.string())])


def encoded(field: Column) -> Column:
    """``-`` for NULL, else UTF-8 byte count, colon, value."""
    text = field.cast("string")
    return F.when(field.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def record_hash(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


def _hash(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_above(nodes: int, fanout: int) -> int:
    """Levels from ``nodes`` nodes up to one."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // fanout), levels + 1
    return levels


def climb(nodes: list[str], levels: int, fanout: int) -> tuple[str, list[list[dict]]]:
    """The node ``levels`` above consecutive ``nodes``, and each node's path to it.

    A step of a path is what stands before and after the node in its run.
    """
    paths: list[list[dict]] = [[] for _ in nodes]
    for level in range(levels):
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        steps = [{"before": "".join(run[:i]), "after": "".join(run[i + 1 :])} for run in runs for i in range(len(run))]
        width = fanout**level
        for i, path in enumerate(paths):
            path.append(steps[i // width])
        nodes = [_hash(*run) for run in runs]
    (top,) = nodes
    return top, paths


def fold(node: str, path: list[dict]) -> str:
    """The root that ``node`` leads to along ``path``."""
    for step in path:
        node = _hash(step["before"], node, step["after"])
    return node


def merkle_paths(leaves: DataFrame, order: list[Column], label: str, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """One tree for each value of ``grp``: (leaves with their path in their block, blocks with theirs).

    ``leaves`` has ``grp`` (not NULL) and ``leaf``. The first result adds ``block, path``, the second is
    ``grp, block, root, path``: from the block's root up to ``root``, the tree's. Both are empty for no leaves.
    """
    size = fanout**LEAF_LEVELS
    placed = numbered(leaves, "grp", order, f"{label}-places")
    cut = placed.withColumn("block", F.floor(F.col("place") / size))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema)

    def hash_block(block: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        levels = min(LEAF_LEVELS, levels_above(block["total"][0].as_py(), fanout))
        root, paths = climb(block["leaf"].to_pylist(), levels, fanout)
        roots = [root] + [None] * (block.num_rows - 1)  # once a block
        block = block.append_column("path", pa.array(paths, pa.list_(STEP))).append_column("block_root", pa.array(roots, pa.string()))
        return block.drop_columns(["place"])

    local = staged(
        cut.groupBy("grp", "block").applyInArrow(hash_block, f"{kinds}, total long, block long, path {PATH}, block_root string"),
        f"{label}-leaves",
    )
    blocks = local.where("block_root IS NOT NULL").select(
        "grp", "block", F.ceil(F.col("total") / size).alias("blocks"), F.col("block_root").alias("root"), F.array().cast(PATH).alias("path")
    )
    most = blocks.agg(F.max("blocks")).first()[0] or 1
    span = 1
    while span < most:
        blocks = _exchange(blocks, span, fanout)
        span *= fanout**WIDTH
    return local.drop("total", "block_root"), blocks.drop("blocks")


def _exchange(blocks: DataFrame, span: int, fanout: int) -> DataFrame:
    """One round: each block knows the root of its ``span`` blocks, then of ``span * fanout ** WIDTH``.

    Partners have equal numbers but for one digit. The last ``span`` may be short of blocks; those
    it has then send their root in place of the missing ones too.
    """
    group = fanout**WIDTH
    low, digit = F.col("block") % span, F.floor(F.col("block") / span) % group
    last = F.floor((F.col("blocks") - 1) / span)
    there = F.when(F.floor(F.col("block") / span) == last, F.col("blocks") - last * span).otherwise(F.lit(span))
    sent = (
        blocks.withColumns({"digit": digit, "high": F.floor(F.col("block") / (span * group))})
        .withColumn("low", F.explode(F.sequence(low, F.lit(span - 1), there)))
        .withColumn("own", F.col("low") == low)
        .withColumn("path", F.when(F.col("own"), F.col("path")))
    )

    def swap(partners: pa.Table) -> pa.Table:
        partners = partners.sort_by("digit")
        levels = min(WIDTH, levels_above(-(-partners["blocks"][0].as_py() // span), fanout))
        top, paths = climb(partners["root"].to_pylist(), levels, fanout)
        known = [(old or []) + new for old, new in zip(partners["path"].to_pylist(), paths)]
        joined = pa.table(
            [partners["grp"], partners["block"], partners["blocks"], pa.array([top] * partners.num_rows), pa.array(known, pa.list_(STEP))],
            names=["grp", "block", "blocks", "root", "path"],
        )
        return joined.filter(partners["own"])

    return sent.groupBy("grp", "high", "low").applyInArrow(swap, f"grp string, block long, blocks long, root string, path {PATH}")


def manifest(docs: DataFrame, tampered: Column | None = None, altered: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """``doc_id, leaf, subroot, root, path, proof_sha256, folded_root, verified``: one row per row of ``docs``.

    A tree per ``lang`` (NULL is one more, before all others), rows by ``doc_id`` (NULL last; equal ones by
    their hash, so repeated rows get the same set of proofs in any order), then a tree over the languages'
    roots. NULL fields are hashed as ``-``, empty ones as ``0:``; an empty table gives an empty result.
    Other columns are ignored. Where ``tampered`` holds, the root is recomputed from the record with the
    ``altered`` fields; elsewhere from the record as it is.
    """
    given = {name: F.col(name) for name in FIELDS}
    claim = record_hash(list((given | (altered or {})).values()))
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("grp"),
        "doc_id",
        record_hash(list(given.values())).alias("leaf"),
        (F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))).alias("tampered"),
        claim.alias("claim"),
    ).withColumn("claim", F.when(F.col("tampered"), F.col("claim")).otherwise(F.col("leaf")))
    local, blocks = merkle_paths(leaves.drop("tampered"), [F.col("doc_id").asc_nulls_last(), F.col("leaf")], "manifest", fanout)
    blocks = staged(blocks, "manifest-blocks")
    tops = blocks.where("block = 0").select(F.lit("").alias("grp"), F.col("grp").alias("lang"), F.col("root").alias("leaf"))
    langs, lang_blocks = merkle_paths(tops, [F.col("lang")], "manifest-langs", fanout)
    above = (
        langs.join(lang_blocks.select("block", "root", F.col("path").alias("rest")), "block")
        .select(F.col("lang").alias("grp"), F.col("leaf").alias("subroot"), "root", F.concat("path", "rest").alias("rest"))
    )
    upper = blocks.select("grp", "block", "path").join(above, "grp").select(
        "grp", "block", "subroot", "root", F.concat("path", "rest").alias("upper")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, leaf string, subroot string, root string, path {PATH}, proof_sha256 string, folded_root string, verified boolean"
    found = local.join(upper, ["grp", "block"]).select(
        "doc_id", "leaf", "claim", "subroot", "root", F.concat("path", "upper").alias("path")
    )
    return in_arrow(found, _proved, schema)


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        proofs, folded = [], []
        for claim, path in zip(batch["claim"].to_pylist(), batch["path"].to_pylist()):
            proofs.append(_hash(*itertools.chain.from_iterable((s["before"], s["after"]) for s in path)))
            folded.append(fold(claim, path))
        verified = [own == root for own, root in zip(folded, batch["root"].to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["leaf"], batch["subroot"], batch["root"], batch["path"], pa.array(proofs, pa.string()), pa.array(folded, pa.string()), pa.array(verified, pa.bool_())],
            names=["doc_id", "leaf", "subroot", "root", "path", "proof_sha256", "folded_root", "verified"],
        )


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of ``documents``; rows whose id's CRC-32 is a multiple of 7 are checked with one character more."""
    docs = table(spark, folder, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest(docs, tampered, {"n_chars": F.col("n_chars") + 1}).drop("path")


OP11_SQL = r"""
WITH RECURSIVE
bits AS (
  SELECT i, 0 AS k, i AS c FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
),
crc AS (SELECT list(c ORDER BY i) AS steps FROM bits WHERE k = 8),
rows AS (
  SELECT *, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)])), 4294967295::BIGINT) % 7 = 0 AS tampered
  FROM documents, crc
),
parts AS (
  SELECT doc_id, lang, n_chars, tampered,
    concat(
      coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'),
      coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-')) AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM rows
),
leaves AS (
  SELECT doc_id, lang,
    sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN tampered THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS changed
  FROM parts
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM leaves
),
tree AS (
  SELECT lang, 0 AS level, i, leaf AS h, n FROM placed
  UNION ALL
  SELECT lang, any_value(level) + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2
  FROM tree WHERE n > 1 GROUP BY lang, i // 2
),
subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n, level AS levels
  FROM tree WHERE n = 1
),
top AS (
  SELECT 0 AS level, i, subroot AS h, n FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2
  FROM top WHERE n > 1 GROUP BY i // 2
),
steps AS (
  SELECT p.lang, p.i, t.level, t.i < (p.i >> t.level) AS before, CASE WHEN t.i <> p.i >> t.level THEN t.h END AS sibling
  FROM placed p JOIN tree t ON t.lang IS NOT DISTINCT FROM p.lang AND t.n > 1 AND t.i >> 1 = p.i >> (t.level + 1)
  UNION ALL
  SELECT p.lang, p.i, s.levels + t.level, t.i < (s.i >> t.level), CASE WHEN t.i <> s.i >> t.level THEN t.h END
  FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN top t ON t.n > 1 AND t.i >> 1 = s.i >> (t.level + 1)
),
paths AS (
  SELECT lang, i, level, any_value(before) FILTER (sibling IS NOT NULL) AS before, any_value(sibling) AS sibling
  FROM steps GROUP BY lang, i, level
),
proofs AS (
  SELECT lang, i, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof,
    list((CASE WHEN before THEN 'B' WHEN sibling IS NULL THEN 'N' ELSE 'A' END) || coalesce(sibling, '') ORDER BY level) AS path
  FROM paths GROUP BY lang, i
)
SELECT p.doc_id, p.leaf, s.subroot, t.h AS root, coalesce(q.proof, sha256('')) AS proof_sha256,
  list_reduce(list_prepend(coalesce(p.changed, p.leaf), coalesce(q.path, [])),
    lambda h, x: sha256(CASE x[1] WHEN 'B' THEN x[2:] || h WHEN 'A' THEN h || x[2:] ELSE h END)) AS folded_root,
  folded_root = root AS verified
FROM placed p
JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang
JOIN (SELECT h FROM top WHERE n = 1) t ON true
LEFT JOIN proofs q ON q.lang IS NOT DISTINCT FROM p.lang AND q.i = p.i
"""
