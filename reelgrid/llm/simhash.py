"""SimHash near-duplicates by covering locality-sensitive hashing.

Each text gets a 64-bit fingerprint of its word shingles. For a radius r every bit position is given a non-zero vector
of r + 1 bits; each of the 2^(r+1) - 1 masks keeps the positions whose vector has an odd product with the mask's own.
Any r positions leave some mask none of them, so two fingerprints within the radius are equal under that mask: every
such pair meets in some table. Inside a table's bucket two fingerprints differ only where the mask is clear, so a
bucket of any size is resolved exactly by flipping each of up to r // 2 clear bits: fingerprints within r of
each other share a flipped form, and those that share one are within the radius when r is even.

Only distinct fingerprints are compared, copies follow theirs. Null and empty texts have the fingerprint zero, which
is linked like any other. Repeated rows stay as rows. Rows with a null id take part; a component's id is its least
non-null one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.common import hot_join, mapped, space_words, staged, whole_rows
from reelgrid.llm.components import components

BITS, SEED, SHINGLE, RADIUS = 64, 42, 3, 2
#: Fingerprints of a bucket up to which they are compared by pairs in place; larger buckets are split by flipped bits.
SMALL = 32
CHUNK = 1 << 16


def simhash(text: str | bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text: a bit is set if over half of the shingles' XXH64 have it."""
    words = space_words(text)
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    k = min(shingle, len(words))
    begins = (ends - lengths)[: len(words) - k + 1].tolist()
    ends = (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(begins), CHUNK):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(begins[i : i + CHUNK], ends[i : i + CHUNK], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(begins), bitorder="little").view("<u8")[0])


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE) -> int:
    """The same as a signed long."""
    return _signed(simhash(text, shingle))


def fingerprints(shingle: int = SHINGLE):
    """A UDF from texts to fingerprints as signed longs."""

    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield mapped(texts.cast(pa.binary()), lambda t: fingerprint(t, shingle), pa.int64())

    return of


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks; for any radius positions, one mask has none of them."""
    t = radius + 1
    vectors = [1 + i % ((1 << t) - 1) for i in range(bits)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & m).bit_count() % 2) for m in range(1, 1 << t)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _apart(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) whose transitive closure is that of all pairs of prints' distinct longs ``f`` within the radius.

    Buckets of one fingerprint go first, by counts summed before the shuffle. Small ones are compared in place. Larger
    ones are dealt by (table, form), where a form is a fingerprint with up to radius // 2 (rounded up) of the clear
    bits flipped; each form's members are linked to the least, by pairs that are checked. A form has as many members
    as there are flips, whatever the bucket's size. Odd radii keep pairs of a form that are within the radius.
    """
    masks = covering_masks(radius)
    table = F.array(*(F.struct(F.lit(i).alias("t"), F.col("f").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)))
    keyed = prints.select("f", F.inline(table))
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(shared, ["t", "key"])
    ids = F.col("ids")
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    near = F.flatten(F.transform(ids, lambda x, i: F.transform(F.filter(F.slice(ids, i + 2, F.lit(SMALL)), lambda y: _apart(x, y) <= radius), lambda y: pair(x, y))))
    small = met.where(F.col("n") <= SMALL).groupBy("t", "key").agg(F.collect_list("f").alias("ids")).select(F.inline(near))
    if (radius + 1) // 2 != 1:  # flips of one bit reach radius 2; for more, they are chained
        flips = lambda m: _flips(m, (radius + 1) // 2)
    else:
        flips = lambda m: [0, *(1 << i for i in range(BITS) if not m >> i & 1)]
    by_table = F.create_map(*(x for i, m in enumerate(masks) for x in (F.lit(i), F.array(*(F.lit(_signed(s)) for s in flips(m))))))
    forms = met.where(F.col("n") > SMALL).select("t", "f", F.explode(by_table[F.col("t")]).alias("flip")).select(F.col("f").bitwiseXOR(F.col("flip")).alias("form"), "f")
    grouped = forms.groupBy("form").agg(F.array_sort(F.collect_set("f")).alias("ids")).where(F.size("ids") > 1)
    if radius % 2 == 0:
        large = grouped.select(F.inline(F.transform(F.slice(ids, 2, 1 << 20), lambda y: pair(ids[0], y))))
    else:
        large = grouped.select(F.inline(F.flatten(F.transform(ids, lambda x, i: F.transform(F.filter(F.slice(ids, i + 2, 1 << 20), lambda y: _apart(x, y) <= radius), lambda y: pair(x, y))))))
    return small.unionByName(large)


def _flips(mask: int, most: int) -> list[int]:
    """Every way to flip up to ``most`` of the bits that the mask leaves clear."""
    clear, found = [1 << i for i in range(BITS) if not mask >> i & 1], {0}
    for _ in range(most):
        found |= {x ^ c for x in found for c in clear}
    return sorted(found)


def _rooted(prints: DataFrame, radius: int) -> DataFrame:
    """(f, first, root) of every distinct fingerprint of prints (id, f): its least id and its component's fingerprint."""
    firsts = staged(prints.groupBy("f").agg(F.min("id").alias("first")), "distinct")
    roots = components(links(firsts.select("f"), radius))
    return firsts.join(roots, F.col("f") == F.col("node"), "left").select("f", "first", F.coalesce("root", "f").alias("root"))


def component_of(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(f, component_id) of every distinct fingerprint of prints (id, f): the least id of its component."""
    rooted = _rooted(prints, radius)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("f", "component_id")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component_id) of every row: components of the links at radius or fewer differing bits."""
    prints = staged(docs.select(F.col(id).alias("id"), fingerprints(shingle)(text).alias("f")), "fingerprints")
    return hot_join(prints, component_of(prints, radius), "f").select(F.col("id").alias(id), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: the least id's (null ids last, then by a hash of the text); of its repeats one."""
    prints = staged(docs.select(order_of(F.col(id)).alias("id"), digest_of(F.col(text)).alias("digest"), fingerprints(shingle)(text).alias("f")), "fingerprints")
    rooted = _rooted(prints.select("id", "f"), radius).select("f", "root")
    rows = hot_join(staged(prints.groupBy("f", "id", "digest").agg(F.count("*").alias("n")), "counted"), rooted, "f")
    return chosen_rows(docs, rows.groupBy("root").agg(F.min(F.struct("id", "digest", "n")).alias("c")).select("c.*"), id, text)


def order_of(id: Column) -> Column:
    """Null ids last."""
    return F.coalesce(id.cast("long"), F.lit((1 << 63) - 1))


def digest_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def chosen_rows(docs: DataFrame, chosen: DataFrame, id: str, text: str) -> DataFrame:
    """The rows of docs that chosen (id, digest, n) names; of n repeats of an id and a text, one."""
    kept = staged(chosen, "chosen")
    rows = whole_rows(docs, id=order_of(F.col(id)), digest=digest_of(F.col(text)))
    once = rows.join(kept.where("n = 1"), ["id", "digest"], "left_semi")
    several = rows.join(kept.where("n > 1"), ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"])
    return once.unionByName(several).select("row.*")
