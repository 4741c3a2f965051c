"""Byte-level BPE by a monoid tree: halves are encoded on their own and joined.

A text is cut by the tokenizer's pattern; merges never cross a cut, so the encodings of the pieces are concatenated.
Within a piece, up to LEAF bytes are merged directly; longer pieces are halved, and the halves' tokens are joined: the
tokens next to the seam are decoded, encoded anew, and kept once both edges are stable; else the window grows on
the side that isn't. An edge between two tokens is stable if their bytes together encode to just these two. If that
holds for every neighbouring pair, then no merge ever crosses an edge (the first one to do so would also
happen when the two tokens' bytes are encoded alone), so the tokens are what the merges give for the whole piece.
Decoding halves the tokens and concatenates the halves' bytes up the tree.

Null texts are empty, and an empty text has no tokens. Repeated rows are encoded alike.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.common import mapped

LEAF = 24
#: White space other than blanks and line feeds.
OTHER_WHITE = re.compile(r"[^\S \n]")
#: Tokens of a leaf in decoding.
TOKENS = 4096
#: Pieces whose tokens a worker remembers; beyond it they are forgotten and encoded again.
REMEMBERED = 100_000
#: White space as Unicode has it, which the pattern's \s stands for.
WHITE = r"\t-\r \x85\xa0  -     　"


class Encoder:
    """Ranks of byte strings, and the pattern that cuts a text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF):
        self.ranks, self.leaf = ranks, leaf
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.cut = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")).findall
        self.stable: dict[tuple[int, int], bool] = {}
        self.words = Remembered(lambda w: self._cut(" " + w))
        self.pieces = Remembered(self._piece)
        self.byte_ids = [ranks.get(bytes([c]), -1) for c in range(256)]
        #: The token that two tokens merge to, by both ids.
        self.pairs = {ranks[b[:k]] << 32 | ranks[b[k:]]: i for b, i in ranks.items() for k in range(1, len(b)) if b[:k] in ranks and b[k:] in ranks}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Encoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def merged(self, piece: bytes) -> list[int]:
        """The tokens of a short piece: the pair of the lowest rank is merged, the first among equals, until none is left."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        get = self.pairs.get
        ids = [self.byte_ids[c] for c in piece]
        ranks = [get(a << 32 | b, _NONE) for a, b in pairwise(ids)]
        while ranks and (least := min(ranks)) < _NONE:
            i = ranks.index(least)
            ids[i] = least  # a token's id is its rank
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(least << 32 | ids[i + 1], _NONE)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | least, _NONE)
        return ids

    def decoded(self, tokens: list[int]) -> bytes:
        """The bytes of tokens: leaves of TOKENS each, concatenated up the tree."""
        if len(tokens) <= TOKENS:
            return b"".join(map(self.bytes_of.__getitem__, tokens))
        half = len(tokens) // 2
        return self.decoded(tokens[:half]) + self.decoded(tokens[half:])

    def is_stable(self, a: int, b: int) -> bool:
        found = self.stable.get((a, b))
        if found is None:
            if len(self.stable) > REMEMBERED:
                self.stable.clear()
            found = self.stable[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of two neighbours' bytes together."""
        if not left or not right or self.is_stable(left[-1], right[0]):
            return left + right
        i, j = len(left) - 1, 1
        while True:
            middle = self.merged(self.decoded(left[i:]) + self.decoded(right[:j]))
            before = i == 0 or self.is_stable(left[i - 1], middle[0])
            after = j == len(right) or self.is_stable(middle[-1], right[j])
            if before and after:
                return left[:i] + middle + right[j:]
            if not before:
                i = max(0, i - max(1, len(left) - i))
            if not after:
                j = min(len(right), 2 * j)

    def encoded(self, piece: bytes) -> list[int]:
        """The tokens of a piece of any length: a tree of halves, joined from the leaves up."""
        if len(piece) <= self.leaf:
            return self.merged(piece)
        half = len(piece) // 2
        return self.joined(self.encoded(piece[:half]), self.encoded(piece[half:]))

    def ids(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers."""
        if lone_spaces(text):
            first, *rest = text.split(" ")
            return self._cut(first) + b"".join(map(self.words.__getitem__, rest))
        return self._cut(text)

    def _cut(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.cut(text)))

    def _piece(self, piece: str) -> bytes:
        ids = self.encoded(piece.encode("utf-8", "surrogatepass"))
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()

    def decoded_ids(self, ids: bytes) -> bytes:
        return self.decoded(np.frombuffer(ids, "<u4").tolist())


def lone_spaces(text: str) -> bool:
    """Whether each space stands alone between others than white space: the pattern then cuts before every space, so
    a text may be split at spaces, and what follows each be encoded with its space on its own."""
    if "  " in text or " \n" in text or "\n " in text:
        return False
    return not OTHER_WHITE.search(text) or not re.search(r" \s|\s ", text)


class Remembered(dict):
    """What a function gave for short words. Two generations: once one is full, the older is forgotten."""

    def __init__(self, make, most: int = REMEMBERED, longest: int = 64):
        self.make, self.most, self.longest, self.older = make, most, longest, {}

    def __missing__(self, word: str):
        made = self.older.get(word)
        if made is None:
            made = self.make(word)
            if len(word) > self.longest:
                return made
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = made
        return made


_NONE = 1 << 40
#: Packers of short rows of ids.
_PACK = [struct.Struct(f"<{n}I").pack for n in range(33)]


@cache
def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker."""
    return Encoder.from_file(path, pattern)


def encoded_documents(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with a binary column ``ids`` (little-endian unsigned 32-bit) of each whole text, in place of one of that name; a map without a shuffle."""

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(path, pattern)
        for texts in batches:
            yield mapped(texts, lambda t: own.ids(t or ""), pa.binary())

    return docs.withColumn("ids", ids(F.col(text)))


def decoded_documents(docs: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """docs with a binary column ``decoded``: the bytes of their ids, in place of one of that name."""

    @F.arrow_udf("binary")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(path, pattern)
        for some in batches:
            yield mapped(some, lambda x: own.decoded_ids(x or b""), pa.binary())

    return docs.withColumn("decoded", decoded(F.col(ids)))


def both_ways(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with ``ids`` and, decoded from them, ``decoded``: as the two above, in one Python worker; columns of these names are replaced."""

    @F.arrow_udf("struct<ids: binary, decoded: binary>")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(path, pattern)
        for texts in batches:
            ids = mapped(texts, lambda t: own.ids(t or ""), pa.binary())
            yield pa.StructArray.from_arrays([ids, mapped(ids, own.decoded_ids, pa.binary())], ["ids", "decoded"])

    return docs.withColumn("_coded", coded(F.col(text))).withColumns({"ids": F.col("_coded.ids"), "decoded": F.col("_coded.decoded")}).drop("_coded")


def round_trip(docs: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each document, by encoding and decoding again."""
    coded = both_ways(docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")), path, pattern, "_text")
    n = (F.octet_length("ids") / 4).cast("long")
    return coded.select(F.col("_id").alias(id), n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
