"""The queries of this subpackage: each applies its operator to its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.llm import bpe, language, main_text, media, periodic_runs, rollup, simhash, suffix_arrays, suffix_tree, token_blocks, turn_repair, url_filter, warc
from reelgrid.llm.common import shared_path, staged, table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_arrays.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses made of pages are written as WARC files, read back and converted."""
    path = shared_path(spark, "warc")
    made = warc.responses(table(spark, sf_dir, "pages"))
    warc.write_warc(warc.response_records(made), path)
    found = warc.derive(warc.read_responses(spark, path))
    return found.select(
        F.col("key").cast("long").alias("page_id"), "record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "payload_digest", "content_length", "block_digest", "block",
    )


def op4_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_blocks.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_blocks.report(token_blocks.read(spark, path))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.of_documents(docs).select("doc_id", "language", F.round("posterior", 9).alias("posterior"), "text_language", "accepted")


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same evidence on web pages: declared markup language, address suffix and host."""
    model = language.fitted(table(spark, sf_dir, "documents"))
    return language.of_pages(table(spark, sf_dir, "pages"), model).select("page_id", "language", F.round("posterior", 9).alias("posterior"), "text_language", "accepted")


def op6_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_held_out(table(spark, sf_dir, "documents"))


def op9_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.report(table(spark, sf_dir, "documents"))


def op10_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by two tokenizer files, as _four_commits() says."""
    one = rollup.counted(public_tokenizers.path("byte_bpe_50k.json"))
    two = rollup.counted(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return _four_commits(spark, sf_dir, {"byte_bpe_50k": one(F.col("text")), "byte_bpe_multi_50k": F.when(F.col("lang") == "en", two(F.when(F.col("lang") == "en", F.col("text"))))})


def token_rollups_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by two patterns, which SQL can count."""
    return _four_commits(spark, sf_dir, {t: rollup.token_count(F.col("text"), t) for t in rollup.TOKENIZERS})


def _four_commits(spark: SparkSession, sf_dir: str, counts: dict[str, Column]) -> DataFrame:
    """All documents in; the toxic ones out; the English ones counted anew by the second tokenizer; the second commit once more."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    toxic = labels.where("toxic = 1").select("doc_id").distinct().withColumn("toxic", F.lit(True))
    counted = docs.select("doc_id", "source", "lang", *(c.alias(f"n{i}") for i, c in enumerate(counts.values())))
    rows = staged(counted.join(toxic, "doc_id", "left"), "counted")
    one, two = (rollup.image(F.col("source"), F.col("lang"), t, F.col(f"n{i}")) for i, t in enumerate(counts))
    nothing = F.lit(None).cast(rollup.IMAGE)
    sums = rollup.Rollup(spark, shared_path(spark, "rollup"))
    gone = rows.where("toxic").select(one.alias("before"), nothing.alias("after"))
    sums.commit("load", rows.select(nothing.alias("before"), one.alias("after")))
    sums.commit("takedown", gone)
    sums.commit("recount", rows.where("toxic IS NULL AND lang = 'en'").select(one.alias("before"), two.alias("after")))
    sums.commit("takedown", gone)
    return sums.totals()


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.report(table(spark, sf_dir, "conversations"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(table(spark, sf_dir, "documents"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.report(table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_simhash_near_dedup, op2_benchmark_decontamination, op3_warc_derivatives, op4_token_blocks, op5_language_id, page_languages,
            op6_url_vocabulary, op7_byte_bpe, op8_suffix_tree_scores, op9_audio_fingerprints, op10_token_rollups,
            token_rollups_by_pattern, op11_turn_repair, op12_periodic_runs, op13_main_text,
        )
    }


ROLLUP_SQL = r"""
WITH d AS (SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n0, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+')) AS n1
    FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)),
t AS (SELECT source, lang, CASE WHEN lang = 'en' THEN 'alnum-2' ELSE 'words-1' END AS tokenizer, CASE WHEN lang = 'en' THEN n1 ELSE n0 END AS n FROM d)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM t GROUP BY ALL"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_benchmark_decontamination": suffix_arrays.oracle_sql(),
        "op3_warc_derivatives": warc.oracle_sql(),
        "op6_url_vocabulary": url_filter.oracle_sql(),
        "token_rollups_by_pattern": ROLLUP_SQL,
        "op11_turn_repair": turn_repair.oracle_sql(),
        "op12_periodic_runs": periodic_runs.oracle_sql(),
        "op13_main_text": main_text.oracle_sql(),
    }
