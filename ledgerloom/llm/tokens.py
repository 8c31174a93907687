"""Token counts with the whole-token shortcut.

Before any text is read, every string of the vocabulary that is one match of the split pattern is
encoded alone; those that come out as one token are proven whole. In texts, pre-tokens among them
count one each; only the others go through the merges.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import in_arrow, table, text_of

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
LIMIT = 512


@functools.lru_cache(2)
def whole_tokens(vocabulary: str = VOCABULARY, ranks: str = RANKS) -> frozenset[str]:
    """The vocabulary strings proven to encode alone as one token."""
    import regex

    library, encoding = bpe.json_tokenizer(vocabulary), bpe.rank_encoding(ranks)
    pattern = regex.compile(public_tokenizers.PATTERN)
    strings = []
    for raw in encoding.token_byte_values():
        try:
            string = raw.decode()
        except UnicodeDecodeError:
            continue
        if pattern.fullmatch(string):
            strings.append(string)
    encoded = library.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, encoded) if len(e.ids) == 1)


class TokenCounter:
    """Counts as the tokenizers library does, special strings included."""

    def __init__(self, vocabulary: str, ranks: str):
        import regex

        self.encoder = bpe.library_encoder(vocabulary, ranks)
        self.whole = whole_tokens(vocabulary, ranks)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.memo = bpe.Memo(self._count)

    def _count(self, part: str) -> int:
        if part in self.whole:
            return 1
        if max(part) >= bpe.PLAIN:
            return len(self.encoder.library.encode(part, add_special_tokens=False).ids)
        merge = self.encoder.encoding.encode_ordinary
        return sum(1 if token in self.whole else len(merge(token)) for token in self.pattern.findall(part))

    def __call__(self, text: str) -> int:
        total = 0
        for place, segment in enumerate(self.encoder.segments(text)):
            if place % 2:
                total += 1
            elif segment:
                total += sum(map(self.memo.__getitem__, bpe.parts(segment)))
        return total


@functools.lru_cache(2)
def _counter(vocabulary: str, ranks: str) -> TokenCounter:
    return TokenCounter(vocabulary, ranks)


def _count(batches: Iterator[pa.RecordBatch], vocabulary: str, ranks: str) -> Iterator[pa.RecordBatch]:
    counter = _counter(vocabulary, ranks)
    for batch in batches:
        counts = pa.array([counter(text) for text in batch["text"].to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], counts], names=["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens``: one row per row of ``docs``, no shuffle.

    NULL and empty texts have 0 bytes and tokens; a NULL ``doc_id`` stays NULL; repeated rows are
    repeated; other columns are ignored.
    """
    text = text_of()
    docs = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_tokens long"
    return in_arrow(docs, lambda b: _count(b, vocabulary, ranks), schema)


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = count_tokens(table(spark, folder, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
