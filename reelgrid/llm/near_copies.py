"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 4/5 or more, and what these link.

Candidates are pairs with an equal band of MinHashes: of BANDS bands of WIDE hashes each, a pair at the least
similarity shares none with a chance of 3 in 10^6 (less above it). Every candidate is confirmed on its whole sets before it links,
so nothing is linked that isn't a near copy. A text of fewer words is one shingle; texts without words are copies of
each other.

Only distinct sets are compared. In a bucket of up to SMALL members all pairs are; in a larger one each member is compared
with a pivot first, the member that meets most others in all its buckets, which is what a group of copies was made from or
close to it. So most of a group of copies is linked by as many comparisons as it has members. Then, in each larger bucket whose
members aren't in one component yet, all are compared with all, in blocks of bounded size (``_across``): no candidate is left out
but those that are linked already. This part grows with the square of such a bucket, but a pair costs a few sums of a matrix
product and only links leave a block.

With ``simhashed``, texts whose SimHash fingerprints (``simhash``: 3-word shingles, 2 bits) link are one component too, as op1 links them, and
both kinds of links are closed together: the bands find what no radius of fingerprints can reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.common import hot_join, mapped, space_words, staged
from reelgrid.llm.components import components
from reelgrid.llm.simhash import chosen_rows, component_of, digest_of, fingerprint, order_of

SHINGLE, BANDS, WIDE, SEED = 5, 32, 5, 42
#: The least similarity, as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
CHUNK = 1 << 11
#: Members of a bucket up to which all its pairs are compared.
SMALL = 8
#: Members of a larger bucket, and bytes of their sets, that a block has about; two blocks meet in a task at a time.
BLOCK_ROWS, BLOCK_BYTES = 1 << 11, 8 << 20
#: Shingles of two blocks that are counted at a time.
COLUMNS = 1 << 10
_random = np.random.default_rng(SEED)
FACTORS = _random.integers(0, 1 << 63, BANDS * WIDE, np.uint64) << np.uint64(1) | np.uint64(1)
TERMS = _random.integers(0, 1 << 63, BANDS * WIDE, np.uint64)


def shingles(text: str | bytes | None) -> np.ndarray:
    """The sorted distinct XXH64 of the text's shingles."""
    words = space_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    line, k = b" ".join(words), min(SHINGLE, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    begins = (ends - lengths)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in zip(begins, (ends[k - 1 :] - 1).tolist(), strict=True)), np.uint64, len(begins)))


def signature(text: str | bytes | None, simhashed: bool = False) -> dict:
    """The set's own hash (node), its size, its bands and, if asked for, the text's SimHash fingerprint."""
    found = shingles(text)
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max)
    for i in range(0, len(found), CHUNK):
        least = np.minimum(least, (found[i : i + CHUNK, None] * FACTORS + TERMS).min(0))
    bands = [xxhash.xxh64_intdigest(b.tobytes(), SEED + i) - (1 << 63) for i, b in enumerate(least.reshape(BANDS, WIDE))] if len(found) else []
    return {"node": xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63), "size": len(found), "bands": bands, "f": fingerprint(text) if simhashed else None}


SIGNATURE = pa.struct([("node", pa.int64()), ("size", pa.int64()), ("bands", pa.list_(pa.int64())), ("f", pa.int64())])


def _mapped_udf(make, made: pa.DataType, kind: str):
    """A UDF of make(text); a session has to be there already."""

    @F.arrow_udf(kind)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield mapped(texts.cast(pa.binary()), make, made)

    return of


def signatures(simhashed: bool = False):
    return _mapped_udf(lambda t: signature(t, simhashed), SIGNATURE, "struct<node: long, size: long, bands: array<long>, f: long>")


def sets_of_texts():
    return _mapped_udf(lambda t: shingles(t).tobytes(), pa.binary(), "binary")


def alike(a: bytes, b: bytes) -> bool:
    """Whether two sets, as bytes of their sorted hashes, are similar enough."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if DENOMINATOR * min(len(x), len(y)) < NUMERATOR * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both)


def _alike():
    @F.arrow_udf("boolean")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            yield pa.array([alike(x.as_buffer(), y.as_buffer()) for x, y in zip(a, b, strict=True)], pa.bool_())

    return of


def _fits(a: str, b: str) -> Column:
    """Sizes that similar sets can have."""
    return F.least(a, b) * DENOMINATOR >= F.greatest(a, b) * NUMERATOR


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are near copies."""
    one, two = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"of_{c}")) for c in "ab")
    return staged(pairs.distinct().join(one, "a").join(two, "b").where(_alike()("of_a", "of_b")).select("a", "b"), "near")


def _crowded(met: DataFrame, degrees: DataFrame) -> DataFrame:
    """met (key, node, size) with each bucket's pivot: its member that meets most others, of those in degrees (node, degree)."""
    ranked = met.join(degrees, "node")
    pivots = ranked.groupBy("key").agg(F.max(F.struct("degree", "node", "size")).alias("p")).select("key", F.col("p.node").alias("pivot"), F.col("p.size").alias("of_size"))
    return met.join(pivots, "key")


def _across(met: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between the components (node, root) that the members of met's buckets (key, node, size) are in, from all their pairs.

    A bucket of members of one component has none. The others are cut into blocks, each two of which are a group of their own: a hot bucket is many tasks.
    """
    labelled = staged(met.join(roots, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root")), "labelled")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("size") * 8 / BLOCK_BYTES)).alias("blocks")
    torn = labelled.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), blocks).where("x <> y").select("key", "blocks")
    members = labelled.join(torn, "key").join(sets, "node").withColumn("own", F.pmod("node", "blocks"))
    dealt = members.select("key", "root", "own", "shingles", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    return dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "root", "shingles").groupBy("key", "i", "j").applyInArrow(_links_across, "a long, b long")


def _links_across(rows: pa.Table) -> pa.Table:
    """(a, b): roots that near copies of two blocks join, each pair of sets compared; rows: i, j, own (a set's block), root, shingles."""
    none = pa.table({c: pa.array([], pa.int64()) for c in "ab"})
    if len(pc.unique(rows["root"])) == 1:
        return none
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["shingles"]]
    own, root, size = rows["own"].to_numpy(), rows["root"].to_numpy(), np.array([len(x) for x in sets])
    one, two = (np.flatnonzero(own == rows[c][0].as_py()) for c in "ij")
    place = np.unique(np.concatenate(sets), return_inverse=True)[1]
    often = np.bincount(place) > 1  # a shingle of one set is none that two share
    row, column = np.repeat(np.arange(len(sets)), size)[often[place]], (np.cumsum(often) - 1)[place[often[place]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(one), len(two)), np.int32)
    for first in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[row[a:b], column[a:b] - first] = 1
        both += (has[one] @ has[two].T).astype(np.int32)
    alike = (NUMERATOR + DENOMINATOR) * both >= NUMERATOR * (size[one][:, None] + size[two])
    x, y = np.nonzero(alike & (root[one][:, None] != root[two]))
    top: dict[int, int] = {}

    def top_of(node: int) -> int:
        while node in top:
            node = top[node]
        return node

    links = []  # as many as join all
    for a, b in np.unique(np.column_stack((root[one[x]], root[two[y]])), axis=0).tolist():
        p, q = top_of(a), top_of(b)
        if p != q:
            top[max(p, q)] = min(p, q)
            links.append({"a": a, "b": b})
    return pa.Table.from_pylist(links, none.schema)


def _fingerprint_links(prints: DataFrame) -> DataFrame:
    """(a, b): each node of prints (node, f) with the least node of its fingerprint's component."""
    own = staged(prints.select(F.col("node").alias("id"), "f").distinct(), "fingerprints")
    return hot_join(own, component_of(own), "f").where("id <> component_id").select(F.col("component_id").alias("a"), F.col("id").alias("b"))


def _rooted(prints: DataFrame, docs: DataFrame, text: str, simhashed: bool) -> DataFrame:
    """(node, root) of the linked nodes of prints (digest, node, size, bands, f); docs have the texts by their digests."""
    nodes = prints.where("size > 0").groupBy("node").agg(F.min("digest").alias("digest"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    keyed = staged(nodes, "distinct").select("node", "size", F.explode("bands").alias("key"))
    shared = staged(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = staged(keyed.join(shared, "key"), "met")
    members = met.groupBy("node").agg(F.sum(F.col("n") - 1).alias("degree"))
    degrees = staged(members, "degrees")
    digests = prints.join(degrees, "node", "left_semi").groupBy("node").agg(F.min("digest").alias("digest"))
    texts = docs.select(digest_of(F.col(text)).alias("digest"), F.col(text).alias("text")).join(digests, "digest")
    sets = staged(texts.groupBy("node").agg(F.first("text").alias("text")).select("node", sets_of_texts()("text").alias("shingles")), "sets")
    few = met.where(F.col("n") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("node", "size"))).alias("m"))
    every = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, SMALL), lambda y: F.struct(x["node"].alias("a"), x["size"].alias("s"), y["node"].alias("b"), y["size"].alias("t")))))
    pairs = few.select(F.inline(every)).where(_fits("s", "t")).select("a", "b")
    many = met.where(F.col("n") > SMALL)
    star = _crowded(many, degrees)
    near = _confirmed(pairs.unionByName(star.where((F.col("node") != F.col("pivot")) & _fits("size", "of_size")).select(F.col("pivot").alias("a"), F.col("node").alias("b"))), sets)
    roots = staged(components(near.unionByName(_fingerprint_links(prints)) if simhashed else near), "roots")
    more = staged(_across(many, roots, sets), "across")
    if more.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def first_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", simhashed: bool = False) -> DataFrame:
    """docs with one row of each component of near copies: the least id's (null ids last, then by a hash of the text); of its repeats one."""
    made = docs.select(order_of(F.col(id)).alias("id"), digest_of(F.col(text)).alias("digest"), signatures(simhashed)(text).alias("s"))
    prints = staged(made.select("id", "digest", "s.node", "s.size", "s.bands", "s.f"), "signatures")
    roots = _rooted(prints, docs, text, simhashed)
    rows = hot_join(staged(prints.groupBy("node", "id", "digest").agg(F.count("*").alias("n")), "counted"), roots, "node", "left")
    return chosen_rows(docs, rows.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("id", "digest", "n")).alias("c")).select("c.*"), id, text)
