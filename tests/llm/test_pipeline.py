"""The pipeline's stages against plain versions of what they say."""

import corpus_pipeline
import pytest

from reelgrid.llm import simhash
from tests.llm.test_near_copies import brute_firsts
from tests.llm.test_operators import SCHEMA, brute_hits, odd_rows, reference_encoding


def test_stages_of_the_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    (_, one), (_, two), (_, three), (_, four) = corpus_pipeline.STAGES
    kept = one(spark, docs, sf)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(rows)
    first = {d for _, d in brute_firsts(list(rows.items()))}
    kept = two(spark, docs, sf)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(first)
    clean = {d for d, t in rows.items() if not brute_hits(t, items)[4]}
    kept = three(spark, docs, sf)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == clean
    _, own = reference_encoding()
    counts = {r.doc_id: r.n_tokens for r in four(spark, docs, sf).collect()}
    assert counts == {d: len(own.encode_ordinary(t)) for d, t in rows.items()}
    whole = {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    assert whole == first & clean


@pytest.mark.parametrize("rows", [odd_rows(), []])
def test_stages_stand_odd_rows(spark, sf, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        n = out.count()
        assert n <= docs.count(), name
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns


def test_near_dedup_links_by_fingerprints_and_by_sets(spark, sf):
    often, prose = "to be or " * 60, [f"w{i}" for i in range(200)]
    texts = [often + "one two three four five six", often + "seven eight nine ten eleven twelve", " ".join(prose), " ".join(prose[:170] + ["new"] + prose[171:]), "nothing like it"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = [simhash.simhash(t) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= 2 < (prints[2] ^ prints[3]).bit_count()
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == [0, 2, 4]
