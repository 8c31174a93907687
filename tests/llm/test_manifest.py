"""The Merkle manifest against a tree built in one place."""

import hashlib
import zlib
from collections import Counter

import oracle
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import manifest

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, root string, place int, grp string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def record(row, n_chars):
    values = (row[0], row[3], row[2], n_chars, row[1])
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, fanout):
    """Root, and for each node its (before, after) up to it."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at):
            run = nodes[i // fanout * fanout :][:fanout]
            path.append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
        at = [i // fanout for i in at]
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def brute(rows, fanout=2):
    langs = {}
    for row in rows:
        langs.setdefault(row[2], []).append((row[0] is None, row[0] or 0, record(row, row[4]), row))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: tree([x[2] for x in sorted(langs[lang], key=lambda x: x[:3])], fanout) for lang in order}
    root, tops = tree([trees[lang][0] for lang in order], fanout)
    found = Counter()
    for lang, top in zip(order, tops):
        for (_, _, leaf, row), path in zip(sorted(langs[lang], key=lambda x: x[:3]), trees[lang][1]):
            node = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[4] is not None:
                node = record(row, row[4] + 1)
            for before, after in path + top:
                node = h(before, node, after)
            proof = h(*[x for step in path + top for x in step])
            found[row[0], leaf, trees[lang][0], root, proof, node, node == root] += 1
    return found


def run(df, fanout=2):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = manifest.manifest(df, tampered, {"n_chars": F.col("n_chars") + 1}, fanout).drop("path")
    return Counter(tuple(r) for r in found.collect())


ROWS = [(i * 3, f"text {i}" * (i % 4), "en", "s", i % 11 or None, "r", 1, "g") for i in range(203)]
ROWS += [(i, None, "de", None, None, None, None, None) for i in range(33)] + [(5, "é你", "é", "s", 2, "r", 1, "g")]
ROWS += [(i, "x", None, "s", 1, "r", 1, "g") for i in range(64)] + [(None, "x", "en", "", 1, "r", 1, "g")] * 2
ROWS += [(9, "again", "en", "s", 1, "r", 1, "g")] * 40 + [(9, "another", "en", "s", 1, "r", 1, "g")]
ROWS += [(1, "a" * 3_000_000, f"lang{i}", "s", 3, "r", 1, "g") for i in range(1)]
ROWS += [(1, "", f"x{i}", "s", 3, "r", 1, "g") for i in range(19)]


@pytest.mark.parametrize("fanout, leaf_levels, width", [(2, 10, 4), (2, 2, 1), (2, 1, 2), (3, 1, 1)])
def test_manifest_equals_one_tree(spark, monkeypatch, fanout, leaf_levels, width):
    monkeypatch.setattr(manifest, "LEAF_LEVELS", leaf_levels)
    monkeypatch.setattr(manifest, "WIDTH", width)
    df = spark.createDataFrame(ROWS, DDL).repartition(5)
    assert run(df, fanout) == brute(ROWS, fanout)


def test_single_leaf_and_empty_table(spark):
    one = spark.createDataFrame(ROWS[:1], DDL)
    assert run(one) == brute(ROWS[:1])
    assert run(one.limit(0)) == Counter()


def test_without_tampering_all_is_verified(spark):
    df = spark.createDataFrame(ROWS[:50], DDL)
    assert manifest.manifest(df).where("verified").count() == 50


def test_query_equals_sql(spark, data):
    query = manifest.op11_merkle_manifest(spark, data)
    assert oracle.differences(query, oracle.connect(data), manifest.OP11_SQL) is None
