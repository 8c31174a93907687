"""Byte-pair encoding of single texts, for use inside tasks.

A text is cut where a non-blank character is followed by a space, tab or line end. No match of the
split pattern crosses such a place and no look-ahead reaches over it, so the parts can be encoded
one by one, and what a part encodes to is remembered. Texts holding any other white space are
encoded in one go.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from array import array
from collections.abc import Callable

import public_tokenizers

PARTS = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
OTHER_BLANKS = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁤　﻿]")
REMEMBERED = 400_000  # parts of texts kept per worker process, about 80 MB
PLAIN = "ɐ"  # below it the two libraries agree on letters, numbers and blanks (tested)


class Memo(dict):
    """A dictionary that computes what it lacks and starts afresh when full."""

    used = None  # the one that a task of this worker process took last

    def __init__(self, compute: Callable, limit: int = REMEMBERED):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) < 64:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value

    def taken(self) -> Memo:
        """This one, for a task that begins. Workers outlive an operator, so what the one before remembers is dropped."""
        if Memo.used is not self:
            if Memo.used is not None:
                Memo.used.clear()
            Memo.used = self
        return self


@functools.lru_cache(2)
def rank_encoding(file: str):
    """The tiktoken encoding of a rank file, without special tokens."""
    import tiktoken

    with open(public_tokenizers.path(file), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(file, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(2)
def json_tokenizer(file: str):
    """The tokenizers library's tokenizer, one thread (Spark has the others)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(file))


def parts(text: str) -> list[str]:
    return [text] if OTHER_BLANKS.search(text) else PARTS.findall(text)


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if out.itemsize != 4:
        raise TypeError("unsigned int has no 32 bits here")
    if os.sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def unpacked(ids: bytes) -> list[int]:
    """What ``packed`` was given."""
    out = array("I", ids)
    if os.sys.byteorder == "big":
        out.byteswap()
    return out.tolist()


class LibraryEncoder:
    """Text to packed ids as the tokenizers library gives them, special strings included.

    ``ranks`` names the same vocabulary as ranks. Its faster encoder takes the parts whose
    characters both libraries class alike; the library itself takes the others.
    """

    def __init__(self, file: str, ranks: str):
        self.library = json_tokenizer(file)
        self.encoding = rank_encoding(ranks)
        added = self.library.get_added_tokens_decoder()
        self.special = {token.content: packed([i]) for i, token in added.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.marks = list(self.special)
        self.memo = Memo(self._encode)

    def _encode(self, part: str) -> bytes:
        if max(part) < PLAIN:
            return packed(self.encoding.encode_ordinary(part))
        return packed(self.library.encode(part, add_special_tokens=False).ids)

    def segments(self, text: str) -> list[str]:
        """The text around special strings, and those strings at odd places."""
        return self.split.split(text) if any(mark in text for mark in self.marks) else [text]

    def __call__(self, text: str) -> bytes:
        out = []
        for place, segment in enumerate(self.segments(text)):
            if place % 2:
                out.append(self.special[segment])
            elif segment:
                out.extend(map(self.memo.__getitem__, parts(segment)))
        return b"".join(out)


@functools.lru_cache(2)
def library_encoder(file: str, ranks: str) -> LibraryEncoder:
    return LibraryEncoder(file, ranks)
