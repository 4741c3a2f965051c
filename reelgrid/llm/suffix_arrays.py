"""Benchmark decontamination with suffix arrays of the training text.

The documents of a slice of an Arrow batch form shards of about SHARD_BYTES; a document never leaves its shard. A shard's suffix
array orders its positions by the words that follow, up to the longest item or the document's end, by doubling the
compared length. Only runs of benchmark words can match, so positions at other words are left out. Every suffix of
every item is binary-searched in every shard: the range of its first WINDOW words gives all occurrences of that
window, and windows that follow each other in an item and a document make up the longest verbatim matches, with their
locations. (longest() gives the longest match of any length for every suffix, from its neighbours in the array.) Hits
are compared word by word, so equal hashes never make a match.

The benchmark is sent to the tasks in blocks of BLOCK_BYTES at most, larger ones one block after another, each block
over all documents, with the spans found so far carried along. Null and empty texts have no words. Items without an id
are searched for like others, but aren't among the ids found. Repeated rows are judged alike. Documents' columns may
have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.common import LOWER, UPPER, staged, whole_rows

WINDOW = 10
SHARD_BYTES = 2 << 20
#: Bytes of benchmark text in a task at once.
BLOCK_BYTES = 16 << 20
#: Bytes of documents that a task takes from an Arrow batch at a time; only a shard of these is Python objects.
SLICE_BYTES = 8 << 20
#: Words that are hashed at a time.
WORDS = 1 << 15

_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[list(UPPER.encode())] = list(LOWER.encode())
_IN_WORD = np.zeros(256, bool)
_IN_WORD[0x30:0x3A] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x80:] = True
_MIX = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of some texts: lower-cased bytes, begins and ends, each word's document and a 64-bit hash."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.bytes = _LOWERED[raw]
        word = _IN_WORD[self.bytes]
        edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
        self.begin, self.end = edge[::2], edge[1::2]
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.begin, starts)  # of each document's words; one more at the end
        if not len(self.begin):
            self.hash = np.zeros(0, np.uint64)
            return
        length = self.end - self.begin
        powers = np.full(int(length.max()), _STEP, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        h = np.zeros(len(length), np.uint64)
        for i in range(0, len(length), WORDS):  # a few words at a time: indices take eight times a byte's room
            n, begin = length[i : i + WORDS], self.begin[i : i + WORDS]
            first_of = np.cumsum(n) - n
            place = np.arange(n.sum()) - np.repeat(first_of, n)
            h[i : i + WORDS] = np.add.reduceat(_MIX[self.bytes[np.repeat(begin, n) + place]] * powers[place], first_of)
        self.hash = (h ^ (h >> np.uint64(29))) * _STEP

    def word(self, i: int) -> bytes:
        return self.bytes[self.begin[i] : self.end[i]].tobytes()


class Benchmark:
    """A block of items: their words as codes 2, 3, ...; each suffix of each item, cut off at the item's end."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window, self.ids = window, [i for i, _ in items]
        self.words = w = Words([t for _, t in items])
        self.vocabulary, code = np.unique(w.hash, return_inverse=True)
        sizes = np.diff(w.first)
        item = np.repeat(np.arange(len(items)), sizes)
        self.left = w.first[1:][item] - np.arange(len(w.hash)) if len(item) else np.zeros(0, np.int64)
        self.codes, self.item = code.astype(np.int64) + 2, item
        self.longest = int(sizes.max(initial=0))
        need = np.minimum(window, sizes)[item] if len(item) else self.left
        self.is_window, self.need = self.left >= need, need


def doubled(codes: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """The positions ``at`` in the order of the codes from there on, compared over ``most`` or more; 0 ends a suffix.

    The first sort takes as many codes as fit in a long; then only ties are sorted again, by the ranks of what
    follows, so each round doubles the compared length.
    """
    n = len(codes)
    key = codes[at]
    span, width = 1, int(codes.max(initial=1)).bit_length()
    while span < most and width * (span + 1) < 63:  # as many words as fit in a long
        key = (key << width) | _later(codes, at, span)
        span += 1
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    group = np.flatnonzero(new)[np.cumsum(new) - 1]
    rank = np.zeros(n + 1, np.int64)
    rank[at[order]] = group + 1
    while span < most:
        tied = ~(new & np.concatenate((new[1:], [True])))
        where = np.flatnonzero(tied)
        if not len(where):
            break
        follow = rank[np.minimum(at[order[where]] + span, n)]
        deeper = np.lexsort((follow, group[where]))
        order[where] = order[where][deeper]
        f, g = follow[deeper], group[where]
        changed = np.concatenate(([True], (f[1:] != f[:-1]) | (g[1:] != g[:-1])))
        new[where] = changed
        group[where] = where[np.flatnonzero(changed)][np.cumsum(changed) - 1]
        rank[at[order[where]]] = group[where] + 1
        span *= 2
    return at[order]


def _later(codes: np.ndarray, at: np.ndarray, by: int) -> np.ndarray:
    """The codes ``by`` positions on; 0 beyond the end. An earlier 0 ends the suffix, so what follows it doesn't matter."""
    to = at + by
    return np.where(to < len(codes), codes[np.minimum(to, len(codes) - 1)], 0)


class Shard:
    """The suffix array of some documents' words against one block of the benchmark."""

    def __init__(self, texts: list[bytes], block: Benchmark):
        self.block, self.words = block, Words(texts)
        w = self.words
        n = len(w.hash)
        gaps = np.arange(len(texts))  # a 0 after each document, so no match spans two
        self.place = np.arange(n) + np.repeat(gaps, np.diff(w.first))  # of each word among the codes
        self.codes = np.zeros(n + len(texts), np.int64)
        v = block.vocabulary
        if n and len(v):
            i = np.minimum(np.searchsorted(v, w.hash), len(v) - 1)
            self.codes[self.place] = np.where(v[i] == w.hash, i + 2, 0)
        self.array = doubled(self.codes, np.flatnonzero(self.codes), block.longest) if len(self.codes) else np.zeros(0, np.int64)

    def _less(self, rows: np.ndarray, begin: np.ndarray, limit: np.ndarray, or_equal: bool) -> np.ndarray:
        """Whether the suffix in each of rows is below the item words at begin, over limit words (or equal over them)."""
        out = np.full(len(rows), or_equal)
        open_ = np.flatnonzero(limit > 0)
        at, k = self.array[rows], 0
        while len(open_):
            mine, theirs = _later(self.codes, at[open_], k), self.block.codes[begin[open_] + k]
            out[open_[mine < theirs]], out[open_[mine > theirs]] = True, False
            k += 1
            open_ = open_[(mine == theirs) & (limit[open_] > k)]
        return out

    def bound(self, begin: np.ndarray, limit: np.ndarray, upper: bool) -> np.ndarray:
        """The first place of the array not below (upper: above) the item words at begin, by binary search."""
        low, high = np.zeros(len(begin), np.int64), np.full(len(begin), len(self.array))
        while len(live := np.flatnonzero(low < high)):
            mid = (low[live] + high[live]) // 2
            less = self._less(mid, begin[live], limit[live], upper)
            low[live[less]], high[live[~less]] = mid[less] + 1, mid[~less]
        return low

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """For every suffix of every item, the most words that match verbatim, and the word where one such match begins."""
        begin, left = np.arange(len(self.block.codes)), self.block.left
        best, where = np.zeros(len(begin), np.int64), np.full(len(begin), -1)
        if not len(self.array):
            return best, where
        at = self.bound(begin, left, False)
        for row in (at - 1, at):
            ok = np.flatnonzero((row >= 0) & (row < len(self.array)))
            n, live, k, p = np.zeros(len(begin), np.int64), ok, 0, np.zeros(len(begin), np.int64)
            p[ok] = self.array[row[ok]]
            while len(live := live[left[live] > k]):
                live = live[_later(self.codes, p[live], k) == self.block.codes[live + k]]
                k += 1
                n[live] = k
            better = n > best
            best[better], where[better] = n[better], np.searchsorted(self.place, p[better])
        return best, where

    def occurrences(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(benchmark word, its window's words, the words of this shard where that window begins), exact."""
        b = self.block
        begin = np.flatnonzero(b.is_window)
        if not len(self.array) or not len(begin):
            return
        low, high = self.bound(begin, b.need[begin], False), self.bound(begin, b.need[begin], True)
        for i in np.flatnonzero(high > low):
            n = int(b.need[begin[i]])
            at = np.searchsorted(self.place, self.array[low[i] : high[i]])
            want = [b.words.word(begin[i] + k) for k in range(n)]
            yield int(begin[i]), n, np.array([p for p in at.tolist() if all(self.words.word(p + k) == want[k] for k in range(n))], np.int64)

    def hits(self) -> list[tuple]:
        """A tuple of RESULT for each document. Windows that follow each other in an item and in a document make one verbatim match."""
        w, b = self.words, self.block
        n, docs = len(w.hash), len(w.first) - 1
        cover, found = np.zeros(n + 1, np.int64), [set() for _ in range(docs)]
        longest, where = np.zeros(docs, np.int64), np.full(docs, -1)
        begins: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
        for start, length, at in self.occurrences():
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length, -1)
            begins.append(np.column_stack((np.full(len(at), start), at, np.full(len(at), length))))
            if (item := b.ids[b.item[start]]) is not None:
                for d in np.unique(self.document_of(at)).tolist():
                    found[d].add(item)
        start, at, length = np.concatenate(begins).T
        if len(at):
            shift = at - start  # a match keeps it, and lies in one item and one document
            order = np.lexsort((start, shift))
            start, at, length, item, doc = start[order], at[order], length[order], b.item[start[order]], self.document_of(at[order])
            shift = shift[order]
            new = np.concatenate(([True], (np.diff(shift) != 0) | (np.diff(start) != 1) | (np.diff(item) != 0) | (np.diff(doc) != 0)))
            first = np.flatnonzero(new)
            words = length[first] + np.diff(np.append(first, len(at))) - 1
            doc, at = doc[first], at[first]
            best = np.lexsort((at, -words, doc))
            best = best[np.concatenate(([True], np.diff(doc[best]) != 0))]
            longest[doc[best]], where[doc[best]] = words[best], at[best] - w.first[doc[best]]
        hit = np.cumsum(cover[:-1]) > 0
        out = []
        for d in range(docs):
            own = hit[w.first[d] : w.first[d + 1]]
            spans = np.flatnonzero(np.diff(own, prepend=False, append=False)).tolist() if longest[d] else []
            out.append((len(own), spans, sorted(found[d]), int(longest[d]), int(where[d])))
        return out

    def document_of(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.words.first, words, side="right") - 1


RESULT = pa.struct([("n_words", pa.int64()), ("hit_spans", pa.list_(pa.int64())), ("hit_items", pa.list_(pa.string())), ("longest", pa.int64()), ("longest_at", pa.int64())])
_NAMES = [f.name for f in RESULT]
KIND = "struct<n_words: long, hit_spans: array<long>, hit_items: array<string>, longest: long, longest_at: long>"


def _cut(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Slices of some binary texts, none of them null, of about ``most`` bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False) + 1)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield texts.slice(at, end - at)
        at = end


def _searched(block: Benchmark):
    """A UDF: RESULT of each text against a block."""

    @F.arrow_udf(KIND)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [pa.array([], RESULT)]
            for some in _cut(pc.fill_null(texts.cast(pa.binary()), b""), SLICE_BYTES):
                coded = some.dictionary_encode()  # exact copies are searched once in a slice
                hits = (h for shard in _cut(coded.dictionary, SHARD_BYTES) for h in Shard(shard.to_pylist(), block).hits())
                found.append(pa.array([dict(zip(_NAMES, h, strict=True)) for h in hits], RESULT).take(coded.indices))
            yield pa.concat_arrays(found)

    return search


def blocks_of(benchmark: DataFrame, id: str, text: str, window: int, block_bytes: int) -> Iterator[Benchmark]:
    """The benchmark in blocks of about block_bytes, each fetched on its own; its size is looked at first."""
    items = benchmark.select(F.col(id).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + 2 * total // block_bytes if total > block_bytes else 1
    for i in range(n):
        some = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i)
        yield Benchmark([(r.id, bytes(r.text)) for r in some.collect()], window)


def matched(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, found): docs' rows as a struct, and a struct of RESULT.

    n_words; hit_spans (word spans [begin, end, ...], of all blocks, they may overlap); hit_items, the ids of items found;
    longest, the words of the longest verbatim match that holds a window, and longest_at, the first word where one begins
    (0 and -1 if there is none). A map over documents, without a shuffle. With more than one block each pass is written
    to the shared folder.
    """
    out = None
    for block in blocks_of(benchmark, item_id, item_text, window, block_bytes):
        if out is None:
            out = whole_rows(docs, found=_searched(block)(F.col(text)))
            continue
        both = staged(out, "blocks").select("row", F.col("found").alias("a"), _searched(block)(F.col(f"row.`{text}`")).alias("b"))
        better = (F.col("b.longest") > F.col("a.longest")) | ((F.col("b.longest") == F.col("a.longest")) & (F.col("b.longest_at") < F.col("a.longest_at")))
        best = [F.when(better, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in ("longest", "longest_at")]
        out = both.select("row", F.struct("a.n_words", F.concat("a.hit_spans", "b.hit_spans").alias("hit_spans"), F.array_union("a.hit_items", "b.hit_items").alias("hit_items"), *best).alias("found"))
    return out


def words_covered(spans: Column) -> Column:
    """The words that spans [begin, end, ...] cover, which may overlap."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(spans) - 2, F.lit(2)), lambda i: F.struct(F.get(spans, i).alias("a"), F.get(spans, i + 1).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    add = lambda s, p: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), p["b"] - F.greatest(p["a"], s["upto"]))).alias("n"), F.greatest(s["upto"], p["b"]).alias("upto"))
    return F.when(F.size(spans) > 0, F.aggregate(pairs, start, add)["n"]).otherwise(F.lit(0).cast("long"))


def contaminated() -> Column:
    return F.col("found.longest") > 0


def report(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", **options) -> DataFrame:
    """A row of figures for each document: id, n_words, n_hit, n_items, items_sha256, contaminated, longest, longest_at."""
    items = F.array_join(F.array_sort("found.hit_items"), ",")
    return matched(docs.select(id, options.get("text", "text")), benchmark, **options).select(
        f"row.{id}", "found.n_words", words_covered(F.col("found.hit_spans")).alias("n_hit"), F.size("found.hit_items").cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"), contaminated().alias("contaminated"), "found.longest", "found.longest_at",
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that hold a window of the benchmark; their columns stay as they were, whatever their names."""
    return matched(docs, benchmark, **options).where(~contaminated()).select("row.*")


def oracle_sql(window: int = WINDOW) -> str:
    """report() over documents and benchmark, for DuckDB."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, {words} AS w FROM documents),
    b AS (SELECT row_number() OVER () AS k, CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
    bw AS (SELECT k, item, j, least({window}, len(w)) AS n, array_to_string(w[j:j + least({window}, len(w)) - 1], ' ') AS g
        FROM (SELECT k, item, w, unnest(range(1, len(w) - least({window}, len(w)) + 2)) AS j FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM bw),
    dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, CAST(len(w) AS BIGINT) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
    m AS (SELECT dw.r, dw.i, bw.n, bw.k, bw.j, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
    h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
    t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m WHERE item IS NOT NULL) GROUP BY r),
    v AS (SELECT r, min(i) AS i, max(n) + count(*) - 1 AS words FROM (SELECT *, j - row_number() OVER (PARTITION BY r, k, i - j ORDER BY j) AS run FROM m) GROUP BY r, k, i - j, run),
    l AS (SELECT r, max(words) AS longest, CAST(arg_min(i, struct_pack(a := -words, b := i)) - 1 AS BIGINT) AS longest_at FROM v GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest, coalesce(longest_at, -1) AS longest_at
        FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r) LEFT JOIN l USING (r)"""
