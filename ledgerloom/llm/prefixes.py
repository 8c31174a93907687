"""Prefix trie of conversations whose heads were exchanged, by composable fingerprints.

A sequence of turns has the fingerprint (length n, value v) with v = sum of turn_i * BASE ** i modulo a
prime, in four lanes. Sequences compose as (n1, v1) (n2, v2) = (n1 + n2, v1 + BASE ** n1 * v2), and prefixes
divide out, so every prefix of a rebuilt conversation is computed from running sums over the stored
turns: head of the base, then a stretch of the conversation's own turns. No rebuilt text is made. Each
prefix points to the stored turn that ends it; equal fingerprints are verified on these turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_arrow, staged, table, text_of
from .places import numbered, running_sums

PRIME = 2**31 - 1
BASES = (1103515245, 69069, 1664525, 48271)  # one a lane
LANES = range(len(BASES))
STRIDE = 100  # conversation c takes its head from c - c % STRIDE
HEADS = 6  # and the head has fewer turns than this
ENDS_BLOCK = 4096


def _power(base: int, exponent: Column, digits: int = 5) -> Column:
    """``base ** exponent`` modulo PRIME for exponents below 256 ** digits, from a table for each digit."""
    tables = [F.array(*[F.lit(pow(base, d * 256**k, PRIME)) for d in range(256)]) for k in range(digits)]
    factors = [F.get(t, F.shiftright(exponent, 8 * k).bitwiseAND(255).cast("int")) for k, t in enumerate(tables)]
    return reduce(lambda a, b: a * b % PRIME, [f.cast("long") for f in factors])


def _lane(digest: Column, lane: int) -> Column:
    return F.conv(F.substring(digest, 1 + 8 * lane, 8), 16, 10).cast("long") % PRIME


def stored_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, place, total, role, text, digest, v0…v3``: turns in order with the fingerprint of the prefix they end.

    Order is by ``turn`` (NULL first), equal ones by role and text. NULL roles and texts are empty; rows
    without ``conv_id`` belong to no conversation.
    """
    named = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", text_of("role").alias("role"), text_of().alias("text"))
    placed = numbered(named, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "conversation-turns")
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    termed = placed.withColumn("digest", digest).withColumns(
        {f"term{k}": _lane(F.col("digest"), k) * _power(BASES[k], F.col("place")) % PRIME for k in LANES}
    )
    summed = running_sums(termed, "conv_id", "place", {f"v{k}": f"term{k}" for k in LANES})
    return staged(
        summed.withColumns({f"v{k}": F.col(f"v{k}") % PRIME for k in LANES}).drop("turn", *[f"term{k}" for k in LANES]),
        "conversation-prefixes",
    )


def rebuilt_prefixes(stored: DataFrame, head_turns: Column, base_of: Column) -> DataFrame:
    """``conv_id, turns, depth, v0…v3, ref_conv, ref_place, length``: every prefix of every rebuilt conversation.

    Conversation c is the first ``head_turns`` turns of ``base_of`` (fewer if it has fewer, none if there is none), then
    its own turns after that many. ``turns`` is the rebuilt length, ``ref_conv, ref_place`` the stored turn at the end
    (none at depth 0), ``length`` its code points. ``head_turns`` must be below HEADS.
    """
    sums = [F.col(f"v{k}") for k in LANES]
    short = stored.where(F.col("place") < HEADS - 1)
    heads = short.groupBy("conv_id").agg(
        F.max("total").alias("total"),
        # At most HEADS - 1 entries.
        F.sort_array(F.collect_list(F.struct("place", *sums, F.char_length("text").alias("length")))).alias("steps"),
    )
    own = heads.select("conv_id", "total", F.col("steps").alias("own_steps"), head_turns.alias("h"), base_of.alias("base"))
    base = heads.select(F.col("conv_id").alias("base"), F.col("steps").alias("base_steps"))
    plan = (
        own.join(base, "base", "left")
        .withColumn("head", F.slice(F.coalesce("base_steps", F.array().cast(heads.schema["steps"].dataType)), F.lit(1), F.col("h")))
        .withColumn("nb", F.size("head"))
        .withColumn("turns", F.col("nb") + F.greatest(F.col("total") - F.col("h"), F.lit(0)))
        .withColumn("cut", F.get("own_steps", F.col("h") - 1))  # own prefix that is left out
        .withColumn("joint", F.get("head", F.col("nb") - 1))  # head that stands before
    )
    at_root = plan.select(
        "conv_id", "turns", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(f"v{k}") for k in LANES],
        F.lit(None).cast(stored.schema["conv_id"].dataType).alias("ref_conv"), F.lit(None).cast("long").alias("ref_place"), F.lit(0).alias("length"),
    )
    at_head = plan.select("conv_id", "turns", "base", F.explode("head").alias("s")).select(
        "conv_id", "turns", (F.col("s.place") + 1).alias("depth"), *[F.col(f"s.v{k}").alias(f"v{k}") for k in LANES],
        F.col("base").alias("ref_conv"), F.col("s.place").alias("ref_place"), F.col("s.length").alias("length"),
    )
    # Own stretch: divide out the prefix left out, move by the change in length, put the head before it.
    back = [F.array(*[F.lit(pow(pow(b, -1, PRIME), n, PRIME)) for n in range(HEADS)]) for b in BASES]
    stretch = plan.select(
        "conv_id", "turns", "h", "nb",
        *[F.coalesce(F.col(f"cut.v{k}"), F.lit(0)).alias(f"cut{k}") for k in LANES],
        *[F.coalesce(F.col(f"joint.v{k}"), F.lit(0)).alias(f"joint{k}") for k in LANES],
    )
    at_own = (
        stored.join(stretch, "conv_id")
        .where(F.col("place") >= F.col("h"))
        .select(
            "conv_id", "turns", (F.col("place") - F.col("h") + F.col("nb") + 1).alias("depth"),
            *[
                ((F.col(f"joint{k}") + (F.col(f"v{k}") - F.col(f"cut{k}") + PRIME) % PRIME * F.get(back[k], F.col("h") - F.col("nb"))) % PRIME).alias(f"v{k}")
                for k in LANES
            ],
            F.col("conv_id").alias("ref_conv"), F.col("place").alias("ref_place"), F.char_length("text").alias("length"),
        )
    )
    return at_root.unionByName(at_head).unionByName(at_own)


def _key() -> list[str]:
    return ["depth", *[f"v{k}" for k in LANES]]


def verified_nodes(prefixes: DataFrame, stored: DataFrame) -> DataFrame:
    """``depth, v0…v3, node_conv, n_convs, most``: the groups of equal prefixes, verified.

    ``most`` is the longest member. Members that end in the same stored turn as the group's representative are equal
    there by reference; the others' turns are compared as texts. Since depth d - 1 is compared as well, whole
    prefixes are. The job stops with an error at a difference (a collision of 124 bits).
    """
    here = F.struct("ref_conv", "ref_place")
    groups = prefixes.groupBy(*_key()).agg(
        F.min("conv_id").alias("node_conv"), F.count("*").alias("n_convs"), F.max("turns").alias("most"), F.min(here).alias("rep")
    )
    # One row for each pair of stored turns to compare, however many conversations share them.
    pairs = (
        prefixes.select(*_key(), "ref_conv", "ref_place").distinct().join(groups.select(*_key(), "rep"), _key())
        .where((F.col("ref_conv") != F.col("rep.ref_conv")) | (F.col("ref_place") != F.col("rep.ref_place")))
        .select("ref_conv", "ref_place", F.col("rep.ref_conv").alias("rep_conv"), F.col("rep.ref_place").alias("rep_place")).distinct()
    )
    one = stored.select(F.col("conv_id").alias("ref_conv"), F.col("place").alias("ref_place"), F.struct("role", "text").alias("one"))
    other = stored.select(F.col("conv_id").alias("rep_conv"), F.col("place").alias("rep_place"), F.struct("role", "text").alias("other"))
    different = pairs.join(one, ["ref_conv", "ref_place"]).join(other, ["rep_conv", "rep_place"]).where("one != other")
    if different.limit(1).count():
        raise ArithmeticError("different turns under one fingerprint")
    return groups.drop("rep")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for each run of rows of a node, whatever its length."""
    node, running = None, None
    for batch in batches:
        done = []
        for conv, depth, part in zip(batch["node_conv"].to_pylist(), batch["depth"].to_pylist(), batch["ids"].to_pylist()):
            if (conv, depth) != node:
                if running:
                    done.append((*node, running.hexdigest()))
                node, running = (conv, depth), hashlib.sha256(part.encode())
            else:
                running.update(b"," + part.encode())
        yield _ends_batch(done, batch.schema)
        schema = batch.schema
    if running:
        yield _ends_batch([(*node, running.hexdigest())], schema)


def _ends_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    kinds = [schema.field("node_conv").type, pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(3)], names=["node_conv", "depth", "ends_sha256"])


def ends_of(ending: DataFrame) -> DataFrame:
    """``node_conv, depth, ends_sha256`` from one row for each conversation that ends at a node.

    Ids are numbered within their node and joined to texts block by block; only these texts meet in a task, one at a time.
    """
    kind = ending.schema["node_conv"].dataType.simpleString()
    node = ending.select("node_conv", "depth", "conv_id", F.struct("node_conv", "depth").alias("node"))
    placed = numbered(node, "node", [F.col("conv_id")], "conversation-ends")
    texts = (
        placed.groupBy("node_conv", "depth", F.floor(F.col("place") / ENDS_BLOCK).alias("block"))
        .agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
        .select("node_conv", "depth", "block", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids"))
    )
    lined = texts.repartition("node_conv", "depth").sortWithinPartitions("node_conv", "depth", "block")
    return in_arrow(lined.select("node_conv", "depth", "ids"), _hashed, f"node_conv {kind}, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, head_turns: Column, base_of: Column) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: ``conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``.

    A node is named by its smallest member and its depth. A conversation owns the nodes of which it is the smallest
    member, the deep end of its path; what a node's subtree holds is the owner's part below it plus all that its other
    members own, so no walk over levels is needed. An empty table gives no rows, repeated rows are repeated turns.
    """
    stored = stored_turns(turns)
    prefixes = staged(rebuilt_prefixes(stored, head_turns, base_of), "conversation-members")
    groups = staged(verified_nodes(prefixes, stored), "conversation-nodes")
    members = staged(prefixes.join(groups, _key()).select("conv_id", "turns", "depth", "length", "node_conv", "n_convs", "most"), "conversation-paths")

    own = members.where("conv_id = node_conv").select(
        "conv_id", "depth", "n_convs",
        ((F.col("n_convs") - 1) * F.col("length")).alias("saving"),
        (F.col("most") == F.col("depth")).cast("long").alias("leaf"),
    )
    owned = own.groupBy("conv_id").agg(F.sum("saving").alias("all_saving"), F.sum("leaf").alias("all_leaf"))
    upto = running_sums(own, "conv_id", "depth", {"saved": "saving", "leaves": "leaf"})
    at_owner = upto.join(owned, "conv_id").select(
        "conv_id", "depth", "n_convs",
        (F.col("all_saving") - F.col("saved") + F.col("saving")).alias("own_saved"),
        (F.col("all_leaf") - F.col("leaves") + F.col("leaf")).alias("own_leaves"),
    )
    from_others = (
        members.where("conv_id != node_conv").join(owned, "conv_id")
        .groupBy(F.col("node_conv").alias("conv_id"), "depth")
        .agg(F.sum("all_saving").alias("other_saved"), F.sum("all_leaf").alias("other_leaves"))
    )
    parents = members.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node_conv").alias("parent_conv_id"))
    nodes = staged(
        at_owner.join(from_others, ["conv_id", "depth"], "left").join(parents, ["conv_id", "depth"], "left"), "conversation-trie"
    )
    children = nodes.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("children"))
    ends = ends_of(members.where("depth = turns").select("node_conv", "depth", "conv_id"))
    none = F.sha2(F.lit(""), 256)
    return (
        nodes.join(children, ["conv_id", "depth"], "left")
        .join(ends.withColumnRenamed("node_conv", "conv_id"), ["conv_id", "depth"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs",
            F.coalesce("children", F.lit(0)).alias("n_children"),
            (F.col("own_leaves") + F.coalesce("other_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("own_saved") + F.coalesce("other_saved", F.lit(0))).alias("saved_tokens"),
            F.coalesce("ends_sha256", none).alias("ends_sha256"),
        )
    )


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The trie of all ``conversations``, each with up to five turns of its hundred's first one as its head."""
    own = F.col("conv_id")
    return prefix_trie(table(spark, folder, "conversations"), F.crc32(own.cast("string").cast("binary")) % HEADS, own - own % STRIDE)


OP13_SQL = r"""
WITH RECURSIVE
bits AS (
  SELECT i, 0 AS k, i AS c FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
),
crc AS (SELECT list(c ORDER BY i) AS steps FROM bits WHERE k = 8),
convs AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
heads AS (
  SELECT conv_id, turns, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)])), 4294967295::BIGINT) % 6 AS h
  FROM convs, crc
),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
  FROM heads c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 100
),
members AS (
  SELECT conv_id, d AS depth, turns[1:d] AS prefix, len(turns) = d AS ends, len(turns) AS most
  FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
),
nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(most) = depth AS leaf,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
    CASE WHEN depth > 0 THEN (count(*) - 1) * length(prefix[depth].t) ELSE 0 END AS saving
  FROM members GROUP BY prefix, depth
),
up AS (
  SELECT n.prefix AS top, d.prefix[1:n.depth] AS p, d.leaf, d.saving, d.depth - n.depth AS below
  FROM nodes n JOIN nodes d ON d.depth >= n.depth AND d.prefix[1:n.depth] = n.prefix
),
sums AS (
  SELECT top, count(*) FILTER (below = 1) AS n_children, count(*) FILTER (leaf) AS n_leaves, sum(saving)::BIGINT AS saved_tokens
  FROM up GROUP BY top
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.top = n.prefix
LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = n.prefix[1:n.depth - 1]
"""
