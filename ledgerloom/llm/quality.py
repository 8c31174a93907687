"""Quality classifier: ordinal regression with cumulative links on graded ratings.

One weight vector over hashed words, their stems and text shapes gives every document a score;
ordered thresholds turn it into the probability of reaching each grade. A grade counts what is right
with a document, so that every fault moves the score the same way and words of one fault are not held
back by another's. The model is fitted on a bounded,
documented sample of labelled rows; scoring is one pass without a shuffle.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Memo
from .common import in_arrow, table, text_of

BUCKETS = 1 << 18
PER_GRADE = 2000  # labelled rows of each grade that are used at most, by hash of their id
LEAST_ROWS = 5  # rows of the sample a bucket must occur in
STEPS = 400
PENALTY = 5e-4
LEAST_Z = 5.0  # standard errors by which a bucket's share must differ between grades
KEEP_PROBABILITY = 0.5  # a document goes if it is more likely than not to have a fault
STEMS = (5, 7)  # letters of the stems by which longer words are known too, for inflected languages
MARKS = ".,;:!?\"'()[]*#$%&|<>-_"


def grade(quality: str = "quality", toxic: str = "toxic") -> Column:
    """0: poor and toxic, 1: one of the two, 2: good. NULL if a rating is missing."""
    return (F.col(quality) + F.lit(1) - F.col(toxic)).cast("int")


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) & (BUCKETS - 1)


def _word_buckets(token: str) -> tuple[int, ...]:
    word = token.strip(MARKS).lower()
    return _bucket("w " + word), *[_bucket("p " + word[:n]) for n in STEMS if len(word) > n]


def _shapes(distinct: set[str], n_words: int) -> list[str]:
    """Words for what a text looks like: variety, capitals, symbols and size, in coarse steps."""
    kinds = len(distinct)
    if not kinds:
        return ["empty"]
    capitals = sum(map(str.isupper, distinct))
    symbols = sum(not token[-1].isalnum() and token[-1] not in ".,;:?)\"'" for token in distinct)
    return [
        f"variety {min(9, 10 * kinds // n_words)} {min(12, n_words.bit_length())}",
        f"capitals {10 * capitals // kinds}",
        f"symbols {10 * symbols // kinds}",
        f"size {n_words.bit_length()}",
    ]


def features(text: str, memo: Memo) -> set[int]:
    tokens = text.split()
    distinct = set(tokens)
    found = set().union(*map(memo.__getitem__, distinct))
    found.update(map(_bucket, _shapes(distinct, len(tokens))))
    return found


@functools.lru_cache(1)
def _memo() -> Memo:
    return Memo(_word_buckets)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = _memo().taken()
    for batch in batches:
        found = [sorted(features(t, memo)) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["grade"], pa.array(found, pa.list_(pa.int32()))], names=["grade", "features"])


@dataclass(frozen=True)
class Model:
    """Scores above threshold k speak for a grade above k."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and threshold."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def sample(docs: DataFrame, graded: DataFrame, n_grades: int, per_grade: int = PER_GRADE) -> DataFrame:
    """``grade, text`` of at most ``per_grade`` rows of each grade, one row for each id: of repeated
    ones the smallest text. Weights are implied by the grades' shares in all of ``graded``."""
    picked = None
    for g in range(n_grades):
        some = graded.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_grade)
        picked = some if picked is None else picked.unionByName(some)
    # At most n_grades * per_grade rows of 12 bytes.
    found = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select("grade", "text")


def fit(docs: DataFrame, graded: DataFrame, n_grades: int = 3, per_grade: int = PER_GRADE) -> Model:
    """Fits the model to ``graded`` (doc_id, grade from 0). Rows without grade or text row are
    ignored. Without any, the model finds every document of the best grade.
    """
    graded = graded.where(F.col("grade").between(0, n_grades - 1)).select("doc_id", "grade")
    shares = {r["grade"]: r["n"] for r in graded.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    rows = in_arrow(sample(docs, graded, n_grades, per_grade), _featurise, "grade int, features array<int>").toArrow()
    grades = rows["grade"].to_numpy().astype(np.int64)
    lists = rows["features"].combine_chunks()
    columns = np.asarray(lists.flatten(), dtype=np.int64)
    owners = np.repeat(np.arange(len(grades)), np.asarray(lists.value_lengths()).astype(np.int64))
    return train(grades, owners, columns, n_grades, shares)


def _telling(grades: np.ndarray, owners: np.ndarray, columns: np.ndarray, n_grades: int) -> np.ndarray:
    """Buckets whose share of rows differs between the rows above and below some threshold."""
    rows = np.bincount(grades, minlength=n_grades)
    found = np.stack([np.bincount(columns[grades[owners] == g], minlength=BUCKETS) for g in range(n_grades)])
    total, telling = found.sum(0), np.zeros(BUCKETS, bool)
    share = total / len(grades)
    for k in range(1, n_grades):
        below, above = rows[:k].sum(), rows[k:].sum()
        if below and above:
            error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / below + 1 / above))
            telling |= np.abs(found[:k].sum(0) / below - found[k:].sum(0) / above) >= LEAST_Z * error
    return telling & (total >= LEAST_ROWS)


def train(grades: np.ndarray, owners: np.ndarray, columns: np.ndarray, n_grades: int, shares: dict[int, int]) -> Model:
    """Minimises the weighted likelihood plus a ridge penalty by Adam; deterministic."""
    nothing = Model(np.zeros(BUCKETS, np.float32), np.linspace(-20, -10, n_grades - 1))
    if not len(grades):
        return nothing
    # The same rows in the same order, whatever order they came in.
    keep = _telling(grades, owners, columns, n_grades)[columns]
    owners, columns = owners[keep], columns[keep]
    names, columns = np.unique(columns, return_inverse=True)
    sizes = np.bincount(grades, minlength=n_grades)
    weight = np.array([shares.get(g, 0) / max(1, sizes[g]) for g in range(n_grades)])[grades]
    weight /= weight.sum()
    below = np.cumsum([shares.get(g, 0) for g in range(n_grades)])[:-1] / max(1, sum(shares.values()))
    start = np.log(np.clip(below, 1e-3, 1 - 1e-3) / (1 - np.clip(below, 1e-3, 1 - 1e-3)))
    # thresholds = first, then steps of at least a tenth
    gaps = np.maximum(np.diff(start) - 0.1, 1e-2)
    state = np.concatenate([np.zeros(len(names)), start[:1], np.log(gaps)])
    mean, square = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, STEPS + 1):
        w, first, logs = state[: len(names)], state[len(names)], state[len(names) + 1 :]
        thresholds = first + np.concatenate([[0.0], np.cumsum(np.exp(logs) + 0.1)])
        scores = np.bincount(owners, weights=w[columns], minlength=len(grades))
        edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
        upper, lower = _sigmoid(edges[grades + 1] - scores), _sigmoid(edges[grades] - scores)
        # d(-log(upper - lower)) / d score
        by_score = weight * (1 - upper - lower)
        likely = np.maximum(upper - lower, 1e-12)
        slope_up = -weight * upper * (1 - upper) / likely
        slope_low = weight * lower * (1 - lower) / likely
        by_edge = np.bincount(grades + 1, slope_up, n_grades + 1) + np.bincount(grades, slope_low, n_grades + 1)
        by_threshold = by_edge[1:n_grades]
        from_right = np.cumsum(by_threshold[::-1])[::-1]
        gradient = np.concatenate(
            [
                np.bincount(columns, weights=by_score[owners], minlength=len(names)) + PENALTY * w,
                from_right[:1],
                from_right[1:] * np.exp(logs),
            ]
        )
        mean += 0.1 * (gradient - mean)
        square += 0.01 * (gradient**2 - square)
        rate = 0.1 * (1 - 0.9 * step / STEPS)
        state = state - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    w, first, logs = state[: len(names)], state[len(names)], state[len(names) + 1 :]
    weights = np.zeros(BUCKETS, np.float32)
    weights[names] = w
    return Model(weights, first + np.concatenate([[0.0], np.cumsum(np.exp(logs) + 0.1)]))


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    memo, weights = _memo().taken(), model.weights.astype(np.float64)
    for batch in batches:
        scores = []
        for text in batch["text"].to_pylist():
            found = features(text, memo)
            # Sorted, so that the sum does not depend on the order within a set.
            scores.append(float(weights[sorted(found)].sum()))
        tails = model.tails(np.array(scores, dtype=np.float64))
        lists = pa.array(list(tails), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch["row"], pa.array(tails.sum(1)), lists], names=["row", "expected", "tails"])


def grade_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (struct of all columns), ``expected_grade`` and ``tails``: P(grade >= 1), P(grade >= 2), …

    One row per row of ``docs``; NULL texts are graded as empty ones.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    nested = docs.select(row.alias("row"), text_of().alias("text"))
    kind = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in nested.schema["row"].dataType)
    scored = in_arrow(nested, lambda b: _score(b, model), f"row struct<{kind}>, expected double, tails array<double>")
    return scored.withColumnRenamed("expected", "expected_grade")


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, expected_grade, p_fair, p_good, kept`` of every row of ``documents``; NULL texts count
    as empty, repeated rows are graded alike, without labels all are kept."""
    docs = table(spark, folder, "documents")
    graded = table(spark, folder, "labels").select("doc_id", grade().alias("grade"))
    scored = grade_documents(docs.select("doc_id", "text"), fit(docs, graded))
    return scored.select(
        "row.doc_id",
        F.round("expected_grade", 6).alias("expected_grade"),
        F.round(F.get("tails", F.lit(0)), 6).alias("p_fair"),
        F.round(F.get("tails", F.lit(1)), 6).alias("p_good"),
        (F.get("tails", F.lit(1)) >= KEEP_PROBABILITY).alias("kept"),
    )
