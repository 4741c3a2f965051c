"""Token counts kept by deltas: signed rows update additive totals by source, language and tokenizer version.

A batch of changes is summed to one signed row for each key before it is shuffled; these are added to the maintained
totals, never to the documents again. A batch that is committed again changes nothing. Null keys are keys of their own;
a null count is zero tokens; a key whose documents all went is left out; before any commit there are no totals.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.llm import bpe, token_blocks
from reelgrid.llm.common import SPACE_WORD, mapped

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, batch_id string"
#: The type of an image, for what there isn't.
IMAGE = "struct<source: string, lang: string, tokenizer: string, n_tokens: bigint>"
#: Tokenizer versions that are patterns of one token each.
TOKENIZERS = {"words-1": SPACE_WORD, "alnum-2": r"[A-Za-z0-9]+"}


def token_count(text: Column, tokenizer: str) -> Column:
    """Tokens of the whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[tokenizer])), F.lit(0)).cast("long")


#: Words that a worker remembers at most of a tokenizer in the library's format.
REMEMBERED = 100_000
#: Bytes of text that are counted at a time: two tokenizers share an executor, and what a slice takes is many times its text.
CHARACTERS = 1 << 22


def counted(path: str, pattern: str | None = None):
    """A UDF: tokens of whole texts under a tokenizer file: ranks with the pattern that cuts a text, or the library's own format. Null has none."""

    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = bpe.encoder(path, pattern) if pattern else token_blocks.encoder(path, REMEMBERED)
        for texts in batches:
            if pattern:
                yield mapped(texts, lambda t: len(own.ids(t or "")) // 4, pa.int64())
            else:
                some = token_blocks.slices(pa.record_batch([texts], ["text"]), 0, CHARACTERS)
                yield pa.concat_arrays([pa.array([], pa.int64()), *(pa.array(own.counts(b.column(0))) for b in some)])

    return of


def image(source: Column, lang: Column, tokenizer: str | Column, n_tokens: Column) -> Column:
    """A document's state before or after a change."""
    version = F.lit(tokenizer) if isinstance(tokenizer, str) else tokenizer
    return F.struct(source.alias("source"), lang.alias("lang"), version.alias("tokenizer"), n_tokens.cast("long").alias("n_tokens"))


def signed(changes: DataFrame) -> DataFrame:
    """changes: struct columns ``before`` (null for an insert) and ``after`` (null for a delete); a revised document has both.

    Returns a row of (source, lang, tokenizer, n_docs, n_tokens) for each key, n_docs and n_tokens signed.
    """
    both = F.array(F.struct(F.lit(-1).alias("sign"), F.col("before").alias("doc")), F.struct(F.lit(1).alias("sign"), F.col("after").alias("doc")))
    rows = changes.select(F.inline(both)).where("doc IS NOT NULL")
    return rows.groupBy(*(F.col(f"doc.{k}").alias(k) for k in KEYS)).agg(
        F.sum(F.col("sign").cast("long")).alias("n_docs"), F.sum(F.col("sign") * F.coalesce("doc.n_tokens", F.lit(0))).cast("long").alias("n_tokens")
    )


class Rollup:
    """Totals under a root folder in a store that all executors share; one writer at a time.

    ``version=N`` holds the totals after N commits and the ids of the batches in them. A commit adds its signed sums to the
    newest totals and writes the next version whole, so a failed attempt leaves the version before it as it was and is
    made again over what it left. A version counts once its writer has marked it as done. Two versions are kept.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def version(self) -> int:
        """The newest version that is done, 0 before any commit."""
        if not self.files.exists(self._path("")):
            return 0
        names = [s.getPath().getName() for s in self.files.listStatus(self._path(""))]
        numbers = [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
        return max((n for n in numbers if self.files.exists(self._path(f"version={n}/_SUCCESS"))), default=0)

    def _stored(self, version: int) -> DataFrame:
        if not version:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.root}/version={version}")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch; one whose id is among the totals already changes nothing. Whether it was added."""
        now = self.version()
        stored = self._stored(now)
        if not stored.where(F.col("batch_id") == batch_id).isEmpty():
            return False
        old, ids = stored.where("batch_id IS NULL"), stored.where("batch_id IS NOT NULL")
        both = old.select(*KEYS, "n_docs", "n_tokens").unionByName(signed(changes))
        sums = both.groupBy(*KEYS).agg(F.sum("n_docs").cast("long").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens")).withColumn("batch_id", F.lit(None).cast("string"))
        mark = self.spark.createDataFrame([(None, None, None, 0, 0, batch_id)], SCHEMA)
        sums.unionByName(ids).unionByName(mark).write.mode("overwrite").parquet(f"{self.root}/version={now + 1}")
        if now > 1:
            self.files.delete(self._path(f"version={now - 1}"), True)
        return True

    def totals(self) -> DataFrame:
        return self._stored(self.version()).where("batch_id IS NULL AND (n_docs <> 0 OR n_tokens <> 0)").drop("batch_id")
