"""Removal of repeated passages against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import repeats

DDL = "doc_id bigint, text string, lang string, row string, tie int, start string, spans int"


def brute(rows, length):
    """rows in corpus order, as (doc_id, text)"""
    seen, found = set(), Counter()
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = True
            seen.add(window)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        spans = tuple(zip(edges[::2].tolist(), edges[1::2].tolist()))
        found[doc_id, len(data), spans, bytes(data[i] for i in np.flatnonzero(~gone))] += 1
    return found


def run(df, length, kmer=repeats.KMER):
    return Counter(
        (r["doc_id"], r["n_bytes"], tuple((s["begin"], s["end"]) for s in r["spans"]), bytes(r["kept"]))
        for r in repeats.remove_repeats(df, length, kmer).collect()
    )


def corpus(seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgé你") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(n) for n in (12, 20, 30, 60, 200)]
    rows = []
    for i in range(160):
        parts = [text(rng.randint(0, 60)), rng.choice(passages) if i % 2 else "", text(rng.randint(0, 30)), rng.choice(passages) if i % 5 == 0 else ""]
        rows.append((i, " ".join(parts)))
    rows += [(200 + i, rows[i * 7][1]) for i in range(15)]  # copies
    rows += [(230 + i, rows[3][1].replace("a", "b", i)) for i in range(8)]
    rows += [(300, "x" * 5000), (301, "ab" * 900), (302, None), (303, ""), (304, "\x00" * 400), (305, passages[4] * 3), (306, "x" * 99), (307, "x" * 100)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "r", 1, "s", 2) for i, t in rows], DDL).repartition(6)


@pytest.mark.parametrize("length, kmer, crowd, bucket, sample", [(100, 32, 2048, 1 << 20, 64), (100, 32, 2, 5000, 1), (40, 16, 4, 300, 2), (100, 32, 0, 1 << 20, 1)])
def test_spans_equal_all_windows(spark, monkeypatch, length, kmer, crowd, bucket, sample):
    for name, value in (("CROWD", crowd), ("BUCKET", bucket), ("SAMPLE", sample)):
        monkeypatch.setattr(repeats, name, value)
    rows = corpus()
    assert run(frame(spark, rows), length, kmer) == brute(rows, length)


@pytest.mark.parametrize("crowd", [2048, 1])
def test_null_and_repeated_ids(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    long, short = "a passage of some length, " * 9, "short"
    rows = [(1, "one " + long), (1, "one " + long), (2, short), (2, short), (None, "two " + long), (None, "two " + long), (7, "seven " + long)]
    got = run(frame(spark, rows), 100)
    assert got == brute(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), 100)


def test_long_text_is_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 1000)
    rng = random.Random(1)
    part = "".join(rng.choice("abcdefghij ") for _ in range(30_000))
    rows = [(1, part), (2, "shifted" + part), (3, part[5000:] + "é" * 300_000)]
    assert run(frame(spark, rows), 100) == brute(rows, 100)


def test_empty_table(spark):
    assert run(frame(spark, [(1, "x")]).limit(0), 100) == Counter()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=8, unique=True))
def test_index_gives_matching_statistics(contents):
    data = np.frombuffer(b"".join(c + b"\xff" for c in contents) + b"\xfe", np.uint8)
    raw = data.tobytes()
    order = sorted(range(len(raw)), key=lambda i: raw[i:])
    assert repeats.suffix_array(data).tolist() == order
    index = repeats.build_index(data)
    assert len(index.symbols) == sum(raw[a - 1] != raw[b - 1] for a, b in zip(order, order[1:])) + 1
    lengths, match = repeats.matching_statistics(data, index)
    for before, at in zip(order, order[1:]):
        common = next(i for i in range(len(raw)) if raw[before + i : before + i + 1] != raw[at + i : at + i + 1])
        assert (lengths[at], match[at]) == (common, before)


def test_query_equals_sql(spark, data):
    query = repeats.op12_suffix_array_dedup(spark, data)
    assert oracle.differences(query, oracle.connect(data), repeats.OP12_SQL) is None
