"""The pipeline's near-duplicates against all pairs' exact similarities."""

import collections
import itertools
import random

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelgrid.llm import near_copies
from reelgrid.llm.simhash import digest_of
from tests.llm.test_operators import SCHEMA, odd_rows

ROW = (None, None, None, None, None, None, None)


def brute_set(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_pairs(sets):
    """Pairs of places whose sets are similar by 0.8 or more, found by the shingles that they share."""
    having, found = collections.defaultdict(list), collections.Counter()
    for i, s in enumerate(sets):
        for g in s:
            having[g].append(i)
    for places in having.values():
        found.update(itertools.combinations(places, 2))
    empty = [i for i, s in enumerate(sets) if not s]
    return {(i, j) for (i, j), n in found.items() if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n)} | set(zip(empty, empty[1:], strict=False))


def brute_firsts(rows):
    """How many components there are, and their least ids."""
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in brute_pairs([brute_set(t) for _, t in rows]):
        root[top(i)] = top(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[top(i)].append((d is None, d or 0))
    return sorted(min(x) for x in least.values())


def crowd():
    """Copies with more and more words replaced, so that a chain links what isn't alike; copies of a line in other texts."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioustnl") for _ in range(6))
    base, line = [word() for _ in range(200)], [word() for _ in range(30)]
    texts = []
    for centre in range(3):
        now = [*base] if centre else [word() for _ in range(200)]
        for _ in range(60):
            copy = [*now]
            for _ in range(rng.randint(1, 6)):
                copy[rng.randrange(200)] = word()
            texts.append(copy)
            now = copy if rng.random() < 0.3 else now
    texts += [[*line, *(word() for _ in range(rng.randint(4, 30)))] for _ in range(60)]
    rng.shuffle(texts)
    return [(i, " ".join(t), *ROW) for i, t in enumerate(texts)]


@pytest.mark.parametrize("rows", [crowd(), odd_rows(), []])
def test_near_dedup_keeps_one_of_each_component_of_similar_pairs(spark, sf, rows):
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), sf)
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert got == brute_firsts([(r[0], r[1]) for r in rows])


def test_near_dedup_of_the_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.near_dedup(spark, docs, sf)
    assert sorted((False, r.doc_id) for r in kept.collect()) == brute_firsts([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("block", [1 << 11, 5])
def test_all_pairs_of_a_crowded_bucket_are_compared(spark, monkeypatch, block):
    """Two near copies (6 and 30) in a bucket of 40 where all others meet more often, so that neither is a pivot; and a bucket of ten of one component."""
    monkeypatch.setattr(near_copies, "BLOCK_ROWS", block)
    texts = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(40)]
    texts[30] = texts[6].rsplit(" ", 1)[0] + " other"
    texts += [" ".join(["same"] * 5 + [f"v{k}" for k in range(60)] + [f"end{i}"]) for i in range(10)]
    bands = [[1] if i in (6, 30) else [1, 2, 3] if i < 40 else [4] for i in range(50)]
    docs = spark.createDataFrame(list(zip(range(50), texts, bands, strict=True)), "node long, text string, bands array<long>")
    size = F.udf(lambda t: len(near_copies.shingles(t)), "long")
    prints = docs.select(digest_of(F.col("text")).alias("digest"), "node", size("text").alias("size"), "bands", F.lit(None).cast("long").alias("f"))
    got = near_copies._rooted(prints, docs, "text", False).collect()
    assert {r.node: r.root for r in got} == {6: 6, 30: 6, **{i: 40 for i in range(40, 50)}}


@pytest.mark.parametrize("block", [1 << 11, 6])
def test_links_across_are_those_of_all_pairs(monkeypatch, block):
    monkeypatch.setattr(near_copies, "COLUMNS", 7)
    texts = [r[1] for r in crowd()[:90]]
    sets, roots = [near_copies.shingles(t).tobytes() for t in texts], [i // 2 for i in range(90)]
    root, want = {}, {}
    top = lambda links, i: top(links, links[i]) if i in links else i
    blocks = -(-90 // block)
    for i in range(blocks):
        for j in range(i, blocks):
            held = [k for k in range(90) if k % blocks in (i, j)]
            rows = pa.table({"i": [i] * len(held), "j": [j] * len(held), "own": [k % blocks for k in held], "root": [roots[k] for k in held], "shingles": [sets[k] for k in held]})
            links = near_copies._links_across(rows).to_pylist()
            assert len(links) < len(held)
            for x in links:
                p, q = top(root, x["a"]), top(root, x["b"])
                root |= {max(p, q): min(p, q)} if p != q else {}
    for i, j in brute_pairs([brute_set(t) for t in texts]):
        p, q = top(want, roots[i]), top(want, roots[j])
        want |= {max(p, q): min(p, q)} if p != q else {}
    assert want and [top(root, i) for i in range(45)] == [top(want, i) for i in range(45)]
