"""Token ids as binary files: documents in ascending order of their ids, coded by the adaptive mixing coder.

The file format is a table of segments, written by Spark, so that it can lie in any store and a lost executor's part is
written again. A segment holds whole documents: their ids, their lengths, and the coded blocks of all their
token ids (see mixing_coder), each block with its checksum. (part, segment) is the order of segments.

Null and empty texts have the end id alone. Documents of equal ids are ordered by a hash of their text; repeated rows
are all written. Null ids come first.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelgrid.llm import mixing_coder
from reelgrid.llm.bpe import lone_spaces

END_ID = 0
#: Words whose ids a worker remembers at most.
REMEMBERED = 2_000_000
#: Characters of texts that are encoded at a time.
CHARACTERS = 1 << 23
#: How a byte-level vocabulary writes the space or line feed that a token begins with.
SPACE, LINE_FEED = "\u0120", "\u010a"
#: What is cut off after a word's last letter; no apostrophe, which may begin a contraction.
TAILS = ",.;:!?$#%&*"
WHITE = "\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
INNER_WHITE = f".[{WHITE}]|^.?$|^[{WHITE}][{WHITE}]"
NOT_LONE_LINES = f"^\n|\n$|[{WHITE}]\n|\n[{WHITE}]"
NOT_LONE = f"[{WHITE}] | [{WHITE}]"
LONE = re.compile(r"(?<=\S) (?=\S)")
SEGMENT = mixing_coder.BLOCK * mixing_coder.LANES
_ARROW = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("blocks", pa.list_(pa.binary()))])
SCHEMA = "part int, segment int, doc_ids array<long>, lengths array<long>, n_ids long, blocks array<binary>"


class Encoder:
    """A tokenizer file's encoder that remembers what lies between lone spaces, which the tokenizer treats apart.

    Each distinct word of a chunk is looked up once, cut at lone line feeds and without the punctuation after its last
    letter, which the tokenizer treats apart too. New words are encoded many at a time, joined by their spaces: a token
    that begins with a space begins a word. Words and their ids stay Arrow arrays throughout.
    """

    def __init__(self, path: str, most: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = _Words(most)
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith((SPACE, LINE_FEED))]] = True
        special = "".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.cut_off = "".join(c for c in TAILS if c not in special)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, one after the other, and each one's number of ids."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), "<u4", int(sizes.sum())), sizes

    def _together(self, text: str, n: int) -> tuple[np.ndarray, np.ndarray] | None:
        """As _each, for n words with a lone space or line feed before each, in one text; None if it has more white space."""
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.begins[ids])
        return (ids, np.diff(at, append=len(ids))) if len(at) == n else None

    def _new(self, words: pa.Array) -> pa.Array:
        """The coded ids of each of some words, which begin with white space."""
        found = []
        for i in range(0, len(words), 1000):
            some = words.slice(i, 1000)
            ends, raw = _ends(some), some.buffers()[2]
            made = self._together(raw[int(ends[0]) : int(ends[-1])].to_pybytes().decode(), len(some))
            found.append(made or self._each(some.cast(pa.string()).to_pylist()))
        return _coded(*map(np.concatenate, zip(*found, strict=True)))

    def _of_stems(self, stems: pa.Array) -> pa.Array:
        stems = stems.dictionary_encode()
        at, keys = self.known.find(stems.dictionary)
        if len(missing := np.flatnonzero(at < 0)):
            rest = stems.dictionary.take(pa.array(missing))
            many = pc.match_substring_regex(rest.cast(pa.string()), INNER_WHITE).to_numpy(zero_copy_only=False)  # these aren't encoded together
            parts = [_coded(*self._each(rest.filter(pa.array(many)).cast(pa.string()).to_pylist()))] if many.any() else []
            if not many.all():
                parts.insert(0, self._new(rest.filter(pa.array(~many))))
            new, coded = np.concatenate([missing[~many], missing[many]]), pa.concat_arrays(parts)
            made = pa.concat_arrays([self.known.ids(at[at >= 0]), coded])
            at[at >= 0], at[new] = np.arange(len(at) - len(new)), len(at) - len(new) + np.arange(len(new))
            self.known.add(keys[new], coded)
        else:
            made, at = self.known.ids(at), np.arange(len(at))
        return made.take(pa.array(at).take(stems.indices))

    def _of_words(self, words: pa.Array) -> pa.Array:
        """The coded ids of each of some distinct words after its space."""
        whole = pc.match_substring_regex(words, NOT_LONE_LINES)
        lines = pc.split_pattern(pc.if_else(whole, "", words), "\n")
        begins, first = lines.offsets.to_numpy(), np.zeros(len(lines.values), np.int8)
        first[begins[:-1]] = 1
        of_whole = np.zeros(len(first), bool)
        of_whole[begins[:-1][whole.to_numpy(zero_copy_only=False)]] = True
        lines = pc.replace_with_mask(lines.values, pa.array(of_whole), words.filter(whole)) if whole.true_count else lines.values
        lines = pc.binary_join_element_wise(pa.array(["\n", " "]).take(pa.array(first)), lines, "")
        stems = pc.ascii_rtrim(lines, characters=self.cut_off)
        upto, ends = _ends(stems), _ends(lines)
        cut = np.diff(ends) - np.diff(upto)
        last = np.frombuffer(stems.buffers()[2] or b"", np.uint8)[upto[1:] - 1] | 32
        cut[(last < ord("a")) | (last > ord("z"))] = 0
        raw, some = np.frombuffer(lines.buffers()[2] or b"", np.uint8), np.cumsum(cut)
        raw = raw[np.repeat(ends[1:] - some, cut) + np.arange(some[-1] if len(some) else 0)]
        tails = pa.Array.from_buffers(pa.string(), len(cut), [None, pa.py_buffer(np.append(0, some).astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
        tails = _coded(*self._each(tails.dictionary.to_pylist())).take(tails.indices)
        stems = self._of_stems(pc.if_else(pa.array(cut > 0), stems, lines).cast(pa.binary()))
        made = pc.binary_join_element_wise(stems, tails, pa.scalar(b""))
        return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(_ends(made)[begins].astype(np.int32)), made.buffers()[2]])

    def _parts(self, texts: pa.Array, end: int | None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The coded ids of distinct parts, the part at each place of some texts (not none), and each text's first place; ``end`` comes before all texts but the first."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if pc.any(pc.match_substring_regex(texts, NOT_LONE)).as_py():
            cut = pa.array([t.split(" ") if lone_spaces(t) else LONE.split(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            cut = pc.split_pattern(texts, " ")
        first = cut.offsets.to_numpy()[:-1]
        coded = cut.values.cast(pa.binary()).dictionary_encode()
        which = coded.indices.to_numpy().copy()
        later = np.ones(len(which), bool)
        later[first] = False
        used = np.zeros(len(coded.dictionary), bool)
        used[which[later]] = True
        made = self._of_words(coded.dictionary.filter(pa.array(used)).cast(pa.string()))
        which = (np.cumsum(used, dtype=np.int32) - 1)[which]
        which[first] = len(made) + np.arange(len(texts), dtype=np.int32)
        ids, sizes = self._each(cut.values.take(pa.array(first)).to_pylist())
        if end is not None:
            ids, sizes = np.insert(ids, np.cumsum(sizes)[:-1], end), sizes + (np.arange(len(sizes)) > 0)
        return pa.concat_arrays([made.cast(pa.large_binary()), _coded(ids, sizes).cast(pa.large_binary())]), which, first

    def ids(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, each with ``end`` after it if there is one; and each text's number of ids."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        made, which, first = self._parts(texts, end)
        found = made.take(pa.array(which))
        ends, ids = _ends(found) // 4, np.frombuffer(found.buffers()[2] or b"", "<u4")
        begins, upto = ends[first], len(ids)
        if end is not None:
            ids, upto = np.append(ids, np.uint32(end)), upto + 1
            begins[1:] += 1
        return ids, np.diff(begins, append=upto)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Each text's number of ids; they aren't put together."""
        if not len(texts):
            return np.zeros(0, np.int64)
        made, which, first = self._parts(texts, None)
        return np.add.reduceat(np.diff(_ends(made))[which], first) // 4


class _Words:
    """The coded ids of up to ``most`` words of up to 23 bytes, found by the words' own bytes; the older half is forgotten at a time."""

    def __init__(self, most: int):
        self.most, self.n = most, 0
        self.keys = np.zeros((most, 3), np.uint64)
        self.ends, self.raw = np.zeros(most + 1, np.int32), np.zeros(0, np.uint8)
        self.bits = (2 * most).bit_length()  # of a place in the table
        self.table = np.full(1 << self.bits, -1, np.int32)

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which of the known ones each word is, or -1; and three longs for each that say what it is, its length among them (0: too long)."""
        ends, sizes = _ends(words), np.diff(_ends(words))
        raw = np.append(np.frombuffer(words.buffers()[2] or b"", np.uint8)[: ends[-1]], np.zeros(24, np.uint8))
        longs = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))  # of every eight bytes
        upto = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        keys = np.empty((len(words), 3), np.uint64)
        for j in range(3):
            keys[:, j] = longs[np.minimum(ends[:-1] + 8 * j, len(longs) - 1)] & upto[np.clip(sizes - 8 * j, 0, 8)]
        keys[:, 2] |= sizes.astype(np.uint64) << np.uint64(56)
        keys[sizes > 23] = 0
        at = np.full(len(words), -1)
        for place in self._places(keys):
            i = self.table[place]
            k = self.keys[i]
            found = (i >= 0) & (k[:, 0] == keys[:, 0]) & (k[:, 1] == keys[:, 1]) & (k[:, 2] == keys[:, 2])
            at[found] = i[found]
        return at, keys

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two places in the table for each word."""
        h = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15)
        for j in (1, 2):
            h = (h ^ h >> np.uint64(29) ^ keys[:, j]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return (h & np.uint64(len(self.table) - 1)).astype(np.int64), (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def ids(self, at: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), self.n, [None, pa.py_buffer(self.ends), pa.py_buffer(self.raw)]).take(pa.array(at))

    def add(self, keys: np.ndarray, coded: pa.Array) -> None:
        some = np.flatnonzero(keys[:, 2])[: self.most // 2]
        keys, coded = keys[some], coded.take(pa.array(some))
        if self.n + len(some) > self.most:
            gone = self.n - min(self.n, self.most // 2)
            size = int(self.ends[gone])
            self.keys[: self.n - gone], self.raw = self.keys[gone : self.n].copy(), self.raw[size:].copy()
            self.ends[: self.n - gone + 1] = self.ends[gone : self.n + 1] - size
            self.table = np.where(self.table >= gone, self.table - np.int32(gone), np.int32(-1))
            self.n -= gone
        n, at, ends = self.n + len(some), int(self.ends[self.n]), _ends(coded)
        if at + int(ends[-1]) > len(self.raw):
            self.raw = np.concatenate([self.raw[:at], np.zeros(at // 2 + 2 * int(ends[-1]), np.uint8)])
        self.raw[at : at + int(ends[-1])] = np.frombuffer(coded.buffers()[2] or b"", np.uint8)[: ends[-1]]
        self.keys[self.n : n], self.ends[self.n + 1 : n + 1] = keys, at + ends[1:]
        first, second = self._places(keys)
        self.table[np.where(self.table[first] >= 0, second, first)] = np.arange(self.n, n)
        self.n = n


def _ends(values: pa.Array) -> np.ndarray:
    """Where the values of a binary array begin in its bytes, and where the last one ends."""
    kind = np.int64 if pa.types.is_large_binary(values.type) else np.int32
    return np.frombuffer(values.buffers()[1], kind)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, kind)


def _coded(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Ids cut into pieces of some sizes, as little-endian unsigned 32-bit."""
    ends = np.cumsum([0, *sizes], dtype=np.int64) * 4
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())


@cache
def encoder(path: str, most: int = REMEMBERED) -> Encoder:
    """One for each Python worker."""
    return Encoder(path, most)


def slices(batch: pa.RecordBatch, text: int, most: int = CHARACTERS) -> Iterator[pa.RecordBatch]:
    """Rows with about ``most`` bytes of text together, in the column of that number."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
        upto = max(at + 1, upto)
        yield batch.slice(at, upto - at)
        at = upto


def _segments(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    own, part, segment = encoder(path), TaskContext.get().partitionId(), 0
    doc_ids: list = []
    lengths: list[int] = []
    coded: list[np.ndarray] = []
    size = 0

    def closed() -> pa.RecordBatch:
        row = {"part": part, "segment": segment, "doc_ids": doc_ids, "lengths": lengths, "n_ids": size, "blocks": list(mixing_coder.encode(np.concatenate(coded)))}
        return pa.RecordBatch.from_pylist([row], _ARROW)

    for batch in batches:
        for some in slices(batch, 1):
            ids, counts = own.ids(some.column(1), END_ID)
            at = begin = 0
            for doc_id, n in zip(some.column(0).to_pylist(), counts.tolist(), strict=True):
                if size and size + n > SEGMENT:
                    coded.append(ids[begin:at])
                    yield closed()
                    doc_ids, lengths, coded, size, segment, begin = [], [], [], 0, segment + 1, at
                doc_ids.append(doc_id)
                lengths.append(n)
                size += n
                at += n
            coded.append(ids[begin:])
    if doc_ids:
        yield closed()


def write(docs: DataFrame, path: str, tokenizer: str, id: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of all documents' texts, each followed by END_ID. One shuffle, by ranges of ids; hot ids are dealt by their texts."""
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda it: _segments(it, tokenizer), SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def documents(segments: DataFrame) -> DataFrame:
    """(part, segment, place, doc_id, ids) of every document of some segments: decoded, checked, ids as little-endian unsigned 32-bit."""

    def decoded(batches):
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                ids = np.ascontiguousarray(mixing_coder.decode(row["blocks"]), "<u4")
                ends = np.cumsum([0, *row["lengths"]])
                for i in range(0, len(row["lengths"]), 2000):
                    own = ends[i : i + 2001]
                    k = len(own) - 1
                    raw = [None, pa.py_buffer((own - own[0]) * 4), pa.py_buffer(ids[own[0] : own[-1]])]
                    coded = pa.Array.from_buffers(pa.large_binary(), k, raw).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * k, pa.int32()), pa.array([row["segment"]] * k, pa.int32()), pa.array(own[:-1]), pa.array(row["doc_ids"][i : i + k], pa.int64()), coded], ["part", "segment", "place", "doc_id", "ids"])

    return segments.select("part", "segment", "doc_ids", "lengths", "blocks").mapInArrow(decoded, "part int, segment int, place long, doc_id long, ids binary")


def report(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document read back; start counts the ids of all documents before it."""
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))  # a row for each part
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = segments.select("part", "segment", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("begin")).join(parts, "part")
    found = documents(segments).select("part", "segment", "place", "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return found.join(starts, ["part", "segment"]).select("doc_id", (F.col("part_start") + F.col("begin") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
