"""The conversation trie against nested dictionaries."""

import hashlib
import zlib
from collections import Counter, defaultdict

import oracle
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import places, prefixes

DDL = "conv_id bigint, turn bigint, role string, text string, depth int, place int, v0 string"


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(convs.get(c - c % 100, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    )


def run(df):
    own = F.col("conv_id")
    found = prefixes.prefix_trie(df, F.crc32(own.cast("string").cast("binary")) % 6, own - own % 100)
    return Counter(tuple(r) for r in found.collect())


def awkward():
    rows = []
    for c in [*range(0, 40), *range(97, 130), *range(205, 215), 1000, 4003]:
        for t in range(c * 7 % 9):
            rows.append((c, t, "user" if t % 2 else None, f"turn {t % 3} {c % 4 if t > 2 else ''}" if t != 1 else None, 1, 2, "v"))
    rows += [(0, None, "system", "first", 1, 2, "v"), (0, None, "system", "first", 1, 2, "v"), (300, 1, "user", "é" * 2_000_000, 1, 2, "v")]
    rows += [(301, t, "a", "same", 1, 2, "v") for t in range(90)] + [(302, t, "a", "same", 1, 2, "v") for t in range(60)]
    return rows + [(None, 1, "user", "no conversation", 1, 2, "v"), (7, 1, "user", "a tie", 1, 2, "v"), (8, 2, "user", "x", 1, 2, "v")] * 2


@pytest.mark.parametrize("block", [4096, 4])
def test_trie_equals_dictionaries(spark, monkeypatch, block):
    monkeypatch.setattr(prefixes, "ENDS_BLOCK", block)
    monkeypatch.setattr(places.running_sums, "__defaults__", (block,))
    rows = awkward()
    assert run(spark.createDataFrame(rows, DDL).repartition(5)) == brute(rows)


def test_empty_table_and_one_turn(spark):
    df = spark.createDataFrame([(5, 1, "user", "x", 1, 2, "v")], DDL)
    assert run(df.limit(0)) == Counter()
    assert run(df) == brute([(5, 1, "user", "x")])


def test_powers_of_the_base(spark):
    exponents = [0, 1, 255, 256, 70_000, 2**33 + 5]
    df = spark.createDataFrame([(e,) for e in exponents], "e long")
    assert [r[0] for r in df.select(prefixes._power(69069, F.col("e"))).collect()] == [pow(69069, e, prefixes.PRIME) for e in exponents]


def test_a_collision_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "_lane", lambda digest, lane: F.lit(1).cast("long"))
    df = spark.createDataFrame([(5, 1, "user", "x", 1, 2, "v"), (6, 1, "user", "y", 1, 2, "v"), (5, 2, "u", "", 1, 2, "v"), (6, 2, "u", "", 1, 2, "v")], DDL)
    with pytest.raises(ArithmeticError):
        prefixes.prefix_trie(df, F.lit(0), F.col("conv_id")).collect()


def test_query_equals_sql(spark, data):
    query = prefixes.op13_prefix_trie(spark, data)
    assert oracle.differences(query, oracle.connect(data), prefixes.OP13_SQL) is None
