"""Probabilistic suffix tree over words: contexts of varying length, kept by divergence tests.

Tokens are words and one END for each text. A context is the DEPTH or fewer words before a token. Following the
classical construction, a context is a candidate if its share of the training tokens is at least LEAST_CONTEXT, and
a next symbol counts for it if its share within the context is at least LEAST_NEXT. A candidate is kept if its
next-symbol distribution diverges from its suffix's by DIVERGENCE nats or more, or if a longer kept context ends with it.
In a kept context each counted symbol's count is discounted by DISCOUNT; what is left goes to the suffix's
distribution, down to the root's add-one shares. So every state's probabilities sum to one over all
training tokens and one unknown.

Both shares bound what is sent to the tasks, whatever the corpus: symbols with a share of LEAST_CONTEXT * LEAST_NEXT
(1 / that many words at most), and 1 / LEAST_CONTEXT contexts of each length. Contexts that end with any other word, whose
number grows with the corpus, are never sent: their tokens are dealt to buckets by that word, so that one task has all tokens of a
context, none with a larger share than LEAST_CONTEXT. There a context of one or two words needs two training tokens and the
same divergence; a next word seen twice has its discounted share and the suffix's part, as in the tree. Only for words without a code, whose
share of all tokens isn't known in a bucket, that part is of the least that it can be (it was seen twice): of a share of LEAST_CONTEXT *
LEAST_NEXT at most. Rarer words meet their counts in a join. Counting covers
all training texts; sums are made before each shuffle. Words are told apart by 64-bit hashes in the buckets and the join:
of N distinct words one in 2^64 / N is taken for another.

Null and empty texts have the one token END. A null id is the empty text for the hold-out rule. Repeated rows are
scored alike, and each of them is a training text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.common import hot_join, space_words, staged

END = b" "
DEPTH = 2
LEAST_CONTEXT, LEAST_NEXT = 1e-4, 1e-2
DIVERGENCE, DISCOUNT = 0.05, 0.75
FOLDS, HELD_OUT = 7, 2
#: Rows of partial counts a task holds before it passes them on.
HELD = 1_000_000
#: Training tokens for each bucket of rarer words' contexts, about.
BUCKET_TOKENS = 1 << 20


def words_of(text: str | bytes | None) -> list[bytes]:
    return [*space_words(text), END]


def held_out(id: Column) -> Column:
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes | None]:
    for batch in batches:
        for x in batch.column(0).cast(pa.binary()):
            yield x.as_py()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts of a column, END among them."""

    def partial(batches):
        counts: Counter = Counter()
        for text in _texts(batches):
            counts.update(words_of(text))
            if len(counts) > HELD:
                yield from _pairs(counts)
                counts.clear()
        yield from _pairs(counts)

    return texts.mapInArrow(partial, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _pairs(counts: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    keys, n = list(counts), list(counts.values())
    for i in range(0, len(keys), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000], pa.binary()).cast(pa.string()), pa.array(n[i : i + 100_000], pa.int64())], ["word", "n"])


class Codes:
    """Codes 0, 1, ... of the words that can be symbols of a context, the commonest first; -1 is any other."""

    def __init__(self, words: list[bytes], counts: list[int]):
        self.of = {w: i for i, w in enumerate(words)}
        self.counts = np.array(counts, np.int64)

    def coded(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.of.get, words, repeat(-1)), np.int64, len(words))


def _ngram_counts(texts: DataFrame, codes, contexts: np.ndarray, depth: int) -> DataFrame:
    """(gram, n): counts of the grams whose first depth codes are among the contexts; a gram is its codes in base |codes|.

    contexts: sorted packed contexts of that depth, sent along with the codes (both are bounded).
    """
    kept = texts.sparkSession.sparkContext.broadcast((codes, contexts))

    def partial(batches):
        codes, contexts = kept.value
        base, held = len(codes.of), {}
        parts: list[np.ndarray] = []
        size = 0

        def summed():
            grams, n = np.unique(np.concatenate(parts), return_counts=True)
            for i in range(0, len(grams), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(grams[i : i + 100_000]), pa.array(n[i : i + 100_000].astype(np.int64))], ["gram", "n"])

        for text in _texts(batches):
            c = codes.coded(words_of(text))
            if len(c) <= depth:
                continue
            ok = c[depth:] >= 0
            context = np.zeros(len(c) - depth, np.int64)
            for k in range(depth):
                ok &= c[k : len(c) - depth + k] >= 0
                context = context * base + c[k : len(c) - depth + k]
            context, last = context[ok], c[depth:][ok]
            if len(contexts):
                at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
                known = contexts[at] == context
                parts.append(context[known] * base + last[known])
                size += len(parts[-1])
            if size > 4 * HELD:
                yield from summed()
                parts, size = [], 0
        if size:
            yield from summed()

    return texts.mapInArrow(partial, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Tree:
    """The kept states, bounded by the shares: for each depth, sorted contexts with a back-off weight and their symbols."""

    def __init__(self, codes: Codes, total: int, distinct: int):
        self.codes, self.total, self.distinct = codes, total, distinct
        self.least_context, self.least_symbol = LEAST_CONTEXT * total, max(1.0, LEAST_CONTEXT * LEAST_NEXT * total)
        #: by depth: contexts, log10 back-off weights, (context, symbol) keys, log10 probabilities
        self.states: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def root(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.total + self.distinct + 1))

    def conditional(self, contexts: np.ndarray, depth: int, symbols: np.ndarray) -> np.ndarray:
        """log10 probability of coded symbols after packed contexts of a depth, in the longest kept suffix."""
        out = self.root(self.codes.counts[symbols])
        base = len(self.codes.of)
        for d in range(1, depth + 1):
            if d in self.states:
                found, p = self._one(d, contexts % base**d, symbols, out)
                out = np.where(found, p, out)
        return out

    def _one(self, depth: int, contexts: np.ndarray, symbols: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which contexts are kept at a depth, and their probabilities, given those of their suffixes. A symbol of -1 is only backed off."""
        states, backoff, keys, direct = self.states[depth]
        at = np.minimum(np.searchsorted(states, contexts), len(states) - 1)
        kept = states[at] == contexts
        p = lower + backoff[at]
        if len(keys):
            key = contexts * len(self.codes.of) + symbols
            to = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            counted = (keys[to] == key) & (symbols >= 0)
            p = np.where(counted, np.log10(10.0 ** direct[to] + 10.0**p), p)
        return kept, p

    def add(self, depth: int, contexts: np.ndarray, totals: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> None:
        """Keeps contexts with their counted symbols (keys: context and symbol packed)."""
        if not len(contexts):
            return
        at = np.searchsorted(contexts, keys // len(self.codes.of))
        left = counts - DISCOUNT
        mass = np.bincount(at, left, len(contexts))
        self.states[depth] = (contexts, np.log10(1 - mass / totals), keys, np.log10(left / totals[at]))

    def score(self, words: list[bytes], c: np.ndarray) -> tuple[int, float, float, list[bytes]]:
        """Tokens, base score and score of the coded words, and the others; the score has the back-off of all. c: the words' codes."""
        known = c >= 0
        root = np.where(known, self.root(self.codes.counts[c]), 0.0) if len(self.codes.counts) else np.zeros(len(c))
        out, base = root, len(self.codes.of)
        context, ok = np.zeros(len(c), np.int64), np.ones(len(c), bool)
        for d in range(1, DEPTH + 1):
            before = np.concatenate((np.full(min(d, len(c)), -1), c[:-d]))[: len(c)]
            ok = ok & (before >= 0)
            context = context + np.maximum(before, 0) * base ** (d - 1)
            if d in self.states:
                kept, p = self._one(d, context, c, out)
                out = np.where(ok & kept, p, out)
        return len(words), float(root.sum()), float(out.sum()), [words[i] for i in np.flatnonzero(~known).tolist()]


def _fetched(df: DataFrame) -> list[np.ndarray]:
    return [x.to_numpy() for x in df.toArrow().columns]


def grown(training: DataFrame, counts: DataFrame, text: str = "text") -> Tree:
    """The tree of the training texts, given their word counts (word, c). Only bounded states come to the driver."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    common = counts.where(F.col("c") >= max(1.0, LEAST_CONTEXT * LEAST_NEXT * total)).orderBy(F.desc("c"), "word").toArrow()
    codes = Codes(common["word"].cast(pa.binary()).to_pylist(), common["c"].to_pylist())
    tree, base = Tree(codes, total, distinct), len(codes.of)
    texts = training.select(text)
    end = codes.of.get(END, -1)
    candidates = np.flatnonzero((codes.counts >= LEAST_CONTEXT * total) & (np.arange(base) != end)) if base else np.zeros(0, np.int64)
    held = {}
    for depth in range(1, DEPTH + 1):
        if not len(candidates):
            break
        if base ** (depth + 1) >= 1 << 62:
            raise ValueError(f"{base} symbols and contexts of {depth} words don't fit into 62 bits")
        sums = _ngram_counts(texts, codes, candidates, depth)
        within = codes.counts[candidates] if depth == 1 else held["next_totals"]
        share = dict(zip(candidates.tolist(), within.tolist(), strict=True))
        least = int(max(1.0, math.ceil(LEAST_CONTEXT * total * LEAST_NEXT)))
        grams, n = _fetched(sums.where(F.col("n") >= least).orderBy("gram").select("gram", "n"))
        contexts = grams // base
        totals = np.array([share[x] for x in contexts.tolist()], np.int64)
        longer = (n >= LEAST_CONTEXT * total) & (grams % base != end)
        held["next"], held["next_totals"] = grams[longer], n[longer]
        counted = n >= np.maximum(LEAST_NEXT * totals, 2)
        keys, n, contexts, totals = grams[counted], n[counted], contexts[counted], totals[counted]
        lower = tree.conditional(contexts, depth - 1, keys % base)
        parts = n / totals * (np.log(n / totals) - lower * math.log(10))
        states, at = np.unique(contexts, return_inverse=True)
        diverges = np.bincount(at, parts, len(states)) >= DIVERGENCE
        held[depth] = (states, np.array([share[x] for x in states.tolist()], np.int64), keys, n, at, diverges)
        tree.add(depth, *_chosen(held[depth], diverges))
        candidates = held["next"]
    for depth in range(DEPTH - 1, 0, -1):  # what a longer kept context ends with is kept too
        if depth in held and depth + 1 in tree.states:
            states, *_, diverges = held[depth]
            keep = diverges | np.isin(states, tree.states[depth + 1][0] % base**depth)
            tree.add(depth, *_chosen(held[depth], keep))
    return tree


def _chosen(found: tuple, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    states, totals, keys, n, at, _ = found
    return states[keep], totals[keep], keys[keep[at]], n[keep[at]]


# ---- states of rarer words -----------------------------------------------------------------------------------------------


class Positions:
    """Tokens after words that aren't contexts of the tree, gathered from many texts and dealt to buckets by the word before."""

    def __init__(self, tree: Tree, buckets: int):
        self.tree, self.shift = tree, np.uint64(64 - (buckets.bit_length() - 1))
        self.buckets = buckets
        codes = tree.codes
        self.hashes = np.array([_hash(w) for w in codes.of], np.uint64)
        self.in_tree = (codes.counts >= tree.least_context) if len(codes.counts) else np.zeros(0, bool)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.docs: list[tuple[int, bool, int]] = []
        self.size = 0

    def add(self, key: int, train: bool, words: list[bytes], c: np.ndarray) -> None:
        known = c >= 0
        h = np.empty(len(c), np.uint64)
        if len(self.hashes):
            h[known] = self.hashes[c[known]]
        rest = np.flatnonzero(~known)
        h[rest] = np.fromiter((_hash(words[i]) for i in rest.tolist()), np.uint64, len(rest))
        rare = ~known[:-1]
        if len(self.in_tree):
            rare |= ~self.in_tree[c[:-1]]
        at = np.flatnonzero(rare)
        self.parts.append((h[at], h[at + 1], np.where(at > 0, h[np.maximum(at - 1, 0)], 0)))
        self.docs.append((key, train, len(at)))
        self.size += len(at)

    def dealt(self) -> list[dict]:
        """A row for each bucket: keys, train flags and numbers of tokens of texts, then the tokens; empties what was gathered."""
        if not self.size:
            self.parts, self.docs = [], []
            return []
        one, word, two = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        keys, train, sizes = (np.array([d[i] for d in self.docs]) for i in range(3))
        doc = np.repeat(np.arange(len(keys)), sizes)
        bucket = (one >> self.shift).astype(np.int64) if self.buckets > 1 else np.zeros(len(one), np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        rows = []
        for b in range(self.buckets):
            own = order[ends[b] : ends[b + 1]]
            if len(own):
                docs, n = np.unique(doc[own], return_counts=True)
                rows.append({"bucket": b, "keys": keys[docs], "train": train[docs].astype(np.int8), "sizes": n.astype(np.int32), "one": one[own].view(np.int64), "word": word[own].view(np.int64), "two": (two[own] >> np.uint64(32)).astype(np.uint32).view(np.int32)})
        self.parts, self.docs, self.size = [], [], 0
        return rows


def _hash(word: bytes, digest=xxhash.xxh64_intdigest) -> int:
    return digest(word, 42)


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts by columns, the last first, and each row's number of its group of equals."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= np.diff(c[order].view(np.int64) if c.dtype == np.uint64 else c[order]) != 0
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new)
    return order, group


def adjusted(one: np.ndarray, two: np.ndarray, word: np.ndarray, train: np.ndarray, root: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of tokens after rarer words, given all tokens of their contexts: (value, covered).

    one, two: hashes of the word before and of the one before that; train: whether a token is learnt from; root: log10 of
    the word's share of all tokens (for a rare word the most it can be, so a divergence isn't overstated); mixed: the same, for a rare word the least
    it can be, as it is added to its share in a state. A covered token has its value in place of the root's share: its discounted
    share in its state and the suffix's part; for others it is the back-off added to the root's share. States need two training tokens, a counted next word two
    as well.
    """
    if not len(one):
        return np.zeros(0), np.zeros(0, bool)
    value, covered, lower, mixed = np.zeros(len(one)), np.zeros(len(one), bool), root * math.log(10), mixed * math.log(10)
    levels = []
    for contexts in ((one,), (two, one)):
        _, context = _runs(*contexts)
        _, gram = _runs(word, *contexts)
        totals, counts = np.bincount(context, train), np.bincount(gram, train)
        n, total = counts[gram], np.maximum(totals[context], 1)
        first = np.zeros(len(counts), np.int64)
        first[gram] = np.arange(len(gram))  # a token of each gram
        counted = counts >= 2
        of = context[first]
        share = np.maximum(counts, 1) / np.maximum(totals[of], 1)
        parts = np.where(counted, share * (np.log(share) - lower[first]), 0.0)
        diverges = (np.bincount(of, parts, len(totals)) >= DIVERGENCE) & (totals >= 2)
        mass = np.bincount(of, np.where(counted, counts - DISCOUNT, 0.0), len(totals))
        back = np.log(1 - mass / np.maximum(totals, 1))
        hit, direct = counted[gram], np.log(np.maximum(n - DISCOUNT, DISCOUNT) / total)
        levels.append((context, diverges, hit, direct, back))
        keep = diverges[context]
        lower = np.where(keep, np.where(hit, np.logaddexp(direct, lower + back[context]), lower + back[context]), lower)
    longer = np.zeros(len(levels[0][1]), bool)
    longer[levels[0][0][levels[1][1][levels[1][0]]]] = True  # what a longer kept context ends with is kept too
    levels[0] = (levels[0][0], levels[0][1] | longer, *levels[0][2:])
    for context, kept, hit, direct, back in levels:
        keep = kept[context]
        suffix = np.where(covered, value, value + mixed) + back[context]
        value = np.where(keep & hit, np.logaddexp(direct, suffix), np.where(keep, value + back[context], value))
        covered |= keep & hit
    return value / math.log(10), covered


#: What a bucket says of its texts: a row for each range of keys.
SUMS = "range int, keys array<bigint>, more array<double>, sizes array<int>, gone array<bigint>"


def _bucket_sums(rows: pa.Table, tree: Tree, ranges: int) -> pa.Table:
    """SUMS of a bucket's wanted texts: what to add to the scores of keys, and ``sizes`` hashes each of rare words whose root shares go."""
    flat = lambda c: rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    keys, sizes, one, word, two = flat("keys"), flat("sizes"), flat("one"), flat("word"), flat("two")
    doc = np.repeat(np.arange(len(keys)), sizes)
    codes = tree.codes
    hashes = np.array([_hash(w) for w in codes.of], np.uint64).view(np.int64)
    place = np.argsort(hashes)
    most = math.log10((tree.least_symbol + 1) / (tree.total + tree.distinct + 1))
    root, mixed, coded = np.full(len(word), most), np.full(len(word), math.log10(3 / (tree.total + tree.distinct + 1))), np.zeros(len(word), bool)
    if len(hashes):
        at = place[np.minimum(np.searchsorted(hashes[place], word), len(hashes) - 1)]
        coded = hashes[at] == word
        own = tree.root(codes.counts)[at]
        root, mixed = np.where(coded, own, root), np.where(coded, own, mixed)
    value, covered = adjusted(one, two, word, flat("train")[doc].astype(float), root, mixed)
    keys, of = np.unique(keys, return_inverse=True)  # texts that were gathered in several parts
    doc = of[doc]
    more = np.bincount(doc, value - np.where(covered & coded, root, 0.0), len(keys))
    lost = np.flatnonzero(covered & ~coded)
    lost = lost[np.argsort(doc[lost], kind="stable")]
    return _ranged(keys, more, np.bincount(doc[lost], minlength=len(keys)), word[lost], ranges)


def _ranged(keys: np.ndarray, more: np.ndarray, sizes: np.ndarray, gone: np.ndarray, ranges: int) -> pa.Table:
    """Sorted keys with their sums and hashes as SUMS; the key 0 stands for texts that aren't scored."""
    shift = np.uint64(64 - (ranges.bit_length() - 1))
    edges = np.arange(1, ranges).astype(np.uint64) << shift
    # ranges of the keys as signed numbers, in their order
    cuts = np.concatenate(([0], np.searchsorted(keys, (edges ^ np.uint64(1 << 63)).view(np.int64)) if ranges > 1 else [], [len(keys)])).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    wanted = keys != 0
    out = {"range": [], "keys": [], "more": [], "sizes": [], "gone": []}
    for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
        own = np.arange(a, z)[wanted[a:z]]
        if not len(own):
            continue
        hashes = gone[ends[a] : ends[z]]
        zero = np.flatnonzero(~wanted[a:z])
        if len(zero):
            i = a + zero[0]
            hashes = np.concatenate((gone[ends[a] : ends[i]], gone[ends[i + 1] : ends[z]]))
        for name, x in (("range", k), ("keys", keys[own]), ("more", more[own]), ("sizes", sizes[own].astype(np.int32)), ("gone", hashes)):
            out[name].append(x)
    types = {"range": pa.int32(), "keys": pa.list_(pa.int64()), "more": pa.list_(pa.float64()), "sizes": pa.list_(pa.int32()), "gone": pa.list_(pa.int64())}
    return pa.table({n: pa.array(v, types[n]) for n, v in out.items()})


def _merged_sums(rows: pa.Table) -> pa.Table:
    """(key, more, gone) of the texts of a range of keys: the sums of all buckets, a row for each text."""
    flat = lambda c: rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    sizes = flat("sizes")
    keys, of = np.unique(flat("keys"), return_inverse=True)
    more = np.bincount(of, flat("more"), len(keys))
    to = np.repeat(of, sizes)
    order = np.argsort(to, kind="stable")
    ends = np.concatenate(([0], np.cumsum(np.bincount(to, minlength=len(keys)))))
    gone = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat("gone")[order], pa.int64()))
    return pa.table({"key": pa.array(keys, pa.int64()), "more": pa.array(more), "gone": gone})


def scored(docs: DataFrame, training: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' (id, n_tokens, n_known, train_tokens, base_score, score), under the tree of the training rows."""
    own = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"), F.lit(False).alias("_train"), F.lit(True).alias("_wanted"))
    learnt = training.select(F.lit(None).cast(docs.schema[id].dataType).alias("_id"), F.col(text).alias("_text"), F.lit(True).alias("_train"), F.lit(False).alias("_wanted"))
    return _scored(own.unionByName(learnt), id)


def _scored(rows: DataFrame, id: str) -> DataFrame:
    """rows: _id, _text, _train (learnt from), _wanted (scored).

    Common words and their contexts are scored where a text is read, from the bounded tree. Tokens after other words are dealt
    to buckets by that word, with all tokens of its contexts, and their sums come back by text; rare words go as hashes with
    their text's key to a join with the counts. Rows of equal id and text share a key and their sums are divided by how many they are.
    """
    spark = rows.sparkSession
    training = rows.where("_train").select("_text")
    counts = staged(word_counts(training), "counts")
    tree = grown(training, counts, "_text")
    total, distinct = tree.total, tree.distinct
    kept = spark.sparkContext.broadcast(tree)
    buckets = 1 << max(3, (total // BUCKET_TOKENS).bit_length())
    lists = {"keys": "bigint", "train": "tinyint", "sizes": "int", "one": "bigint", "word": "bigint", "two": "int"}
    types = {"bigint": pa.int64(), "tinyint": pa.int8(), "int": pa.int32()}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Positions(kept.value, buckets)

        def dealt() -> Iterator[pa.RecordBatch]:
            if found := gathered.dealt():
                yield pa.RecordBatch.from_arrays([pa.array([r["bucket"] for r in found], pa.int32()), *(pa.array([r[c] for r in found], pa.list_(types[t])) for c, t in lists.items())], ["bucket", *lists])

        for batch in batches:
            for k, t, train in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                words = words_of(t.as_py())
                gathered.add(k, train, words, kept.value.codes.coded(words))
                if gathered.size > HELD:
                    yield from dealt()
        yield from dealt()

    @F.arrow_udf("struct<n_tokens: long, base: double, score: double, rare: array<bigint>>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tree = kept.value
        for texts in batches:
            out, hashes, ends = [], [], [0]
            for t in texts.cast(pa.binary()):
                words = words_of(t.as_py())
                n, base, whole, rare = tree.score(words, tree.codes.coded(words))
                hashes.append(np.fromiter(map(_hash, rare), np.uint64, len(rare)))
                ends.append(ends[-1] + len(rare))
                out.append((n, base, whole))
            made = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.float64()))]
            flat = np.concatenate(hashes).view(np.int64) if hashes else np.zeros(0, np.int64)
            yield pa.StructArray.from_arrays([*made, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["n_tokens", "base", "score", "rare"])

    key = F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.lit("")), F.col("_id").isNull(), F.coalesce(F.col("_text"), F.lit("")))
    wanted = rows.where("_wanted").select("_id", key.alias("_key"), score("_text").alias("s"))
    texts = staged(wanted.select("_id", "_key", "s.n_tokens", "s.base", "s.score", "s.rare", F.lit(1).cast("long").alias("copies")), "scores")
    # the tokens go straight to their buckets: written first, they would take the room twice
    tokens = rows.select(F.when(F.col("_wanted"), key).otherwise(0).alias("_key"), "_text", "_train").mapInArrow(gather, "bucket int, " + ", ".join(f"{c} array<{t}>" for c, t in lists.items()))
    # a bucket's sums travel as one row for each range of keys; a range's rows are added up to one for each text
    by_bucket = tokens.groupBy("bucket").applyInArrow(lambda t: _bucket_sums(t, kept.value, buckets), SUMS)
    sums = staged(by_bucket.groupBy("range").applyInArrow(_merged_sums, "key long, more double, gone array<bigint>"), "sums")
    few = texts.select("_key", F.explode("rare").alias("h"), F.lit(1).alias("in_base"), F.lit(1).alias("in_score"))
    few = few.unionByName(sums.select(F.col("key").alias("_key"), F.explode("gone").alias("h"), F.lit(0).alias("in_base"), F.lit(-1).alias("in_score")))
    few = few.groupBy("h", "_key").agg(F.sum("in_base").alias("in_base"), F.sum("in_score").alias("in_score"))
    rare = counts.where(F.col("c") < tree.least_symbol).select(F.xxhash64("word").alias("h"), "c")
    share = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(total + distinct + 1)))
    found = few.join(rare, "h", "left").groupBy("_key").agg(
        F.sum("in_base").alias("n_rare"), F.sum(F.when(F.col("c").isNotNull(), F.col("in_base")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("in_base") * share).alias("rare_base"), F.sum(F.col("in_score") * share).alias("rare_score"),
    )
    copies = texts.groupBy("_key").agg(F.sum("copies").alias("copies"))
    whole = copies.join(sums.select(F.col("key").alias("_key"), "more"), "_key", "left").join(found, "_key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("copies")
    shared = whole.select("_key", zero("n_rare").cast("long").alias("n_rare"), zero("rare_known").cast("long").alias("rare_known"), zero("rare_base").alias("rare_base"), (zero("rare_score") + zero("more")).alias("more"))
    return hot_join(texts.drop("rare", "copies"), shared, "_key").select(
        F.col("_id").alias(id), "n_tokens", (F.col("n_tokens") - F.col("n_rare") + F.col("rare_known")).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare_base")).alias("base_score"), (F.col("score") + F.col("more")).alias("score"),
    )


def score_held_out(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """scored() over all documents, learnt from those that aren't held out; with held_out."""
    out = held_out(F.col(id))
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"), (~out).alias("_train"), F.lit(True).alias("_wanted"))
    return _scored(rows, id).select(id, out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
