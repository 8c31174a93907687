"""From raw documents to packed training sequences, one written stage after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import exact, near, packing, pii, quality
from ledgerloom.llm.common import staged, table


def grade_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted to the labels, does not reject."""
    graded = table(spark, sf_dir, "labels").select("doc_id", quality.grade().alias("grade"))
    scored = quality.grade_documents(docs, quality.fit(docs, graded))
    good = F.element_at("tails", -1) >= quality.KEEP_PROBABILITY
    return scored.where(good).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more."""
    return near.drop_near_duplicates(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values replaced by pseudonyms of the same format."""
    spans = max(docs.columns, key=len) + "_"  # a name that no column has
    return pii.replace_personal_data(docs, pii.secret_of(spark), spans).drop(spans)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' token pieces and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", grade_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("pii", hide_personal_data),
    ("packing", pack_sequences),
]

# The classifier, the similarity groups and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``; each one's rows are written for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
