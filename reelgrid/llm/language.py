"""Language identification by Bayesian evidence fusion.

Four kinds of evidence about a row's language are multiplied:

* the text, by a naive Bayes model over hashed byte trigrams and a junk class that spreads evenly over the trigrams of
  its bytes; a text's log-likelihoods count as those of EVIDENCE trigrams at most, since neighbours depend on each other;
* the declared markup language, by how often each declaration goes with each language by text alone;
* the address suffix (the last label of the host and the first of the path), likewise;
* the host, by its languages' shares by text alone, smoothed with HOST_WEIGHT pseudo-rows towards the shares of its
  domain, which are smoothed towards those of all rows.

The shares and tables are grouped aggregates over all rows, less the row's own vote. The trigram model is fitted on
labelled rows: TRAIN_ROWS of each language at most, taken by a hash of their ids (the documented bound). Labels are read
as two or three letters without their region, so there are 27^2 + 27^3 languages at most; other labels are none.
Null and empty texts have no text evidence; null declarations, addresses and hosts are values of their own. A row is
rejected if junk is likelier than every language, if its text has no letters, or if the best language's posterior is
below LEAST. Rejected rows have the language ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.llm.common import staged, whole_rows

BUCKETS = 1 << 15
TRAIN_ROWS = 500
EVIDENCE = 60
HOST_WEIGHT = 20.0
#: Pseudo-rows of the tables of declarations and suffixes.
TABLE_WEIGHT = 1.0
LEAST = 0.5
#: How likely a text's bytes are junk before it is read.
JUNK_PRIOR = 1e-3
UND = "und"


def _trigrams(text: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of a text, upper-case ASCII letters lowered, other ASCII than letters as blanks."""
    b = _FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]
    b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))].astype(np.uint32)
    return ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761) >> np.uint32(17)).astype(np.int64)


_FOLD = np.full(256, 32, np.uint8)
for _c in range(256):
    if chr(_c).isascii() and chr(_c).isalpha():
        _FOLD[_c] = ord(chr(_c).lower())
    elif _c >= 0x80:
        _FOLD[_c] = _c


class Model:
    """Log-probabilities of trigrams in each language, fitted from bucket counts."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        logs = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS))
        #: junk: every trigram of 27 signs alike
        self.logs = np.vstack((logs, np.full((1, BUCKETS), -3 * np.log(27.0)))).T.astype(np.float32)

    def scores(self, text: bytes) -> tuple[list[float], int]:
        """Tempered log-likelihoods (the languages', then junk's), and the trigrams with letters."""
        g = _trigrams(text)
        if not len(g):
            return [0.0] * (len(self.langs) + 1), 0
        total = np.zeros(self.logs.shape[1], np.float64)
        for i in range(0, len(g), 1 << 18):
            total += self.logs[g[i : i + (1 << 18)]].sum(0, dtype=np.float64)
        total *= min(1.0, EVIDENCE / len(g))
        return [round(float(x), 6) for x in total - total.max()], len(g)


def fitted(labelled: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", rows: int = TRAIN_ROWS) -> Model:
    """A model of the languages that labelled rows have; at most ``rows`` of each, by the least hashes of id and text."""
    order = F.xxhash64(F.col(id).cast("string"), F.col(text))
    known = labelled.select(short_code(F.col(lang)).alias("lang"), F.col(text).alias("text"), order.alias("o")).where("lang <> '' AND text IS NOT NULL")
    # the least hashes of each language, without sorting a language in one task: a cut by its rows' share first
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 2.0 * rows / n))))) if sizes else None
    if share is None:
        return Model([], np.zeros((0, BUCKETS)))
    few = known.where((F.pmod("o", F.lit(1_000_003)) / 1_000_003.0) < share[F.col("lang")])
    sample = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("o"))).where(F.col("k") <= rows).drop("o", "k")

    def counted(rows: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS, np.int64)
        for t in rows["text"].cast(pa.binary()).to_pylist():
            total += np.bincount(_trigrams(t), minlength=BUCKETS)
        return pa.table({"lang": rows["lang"][:1], "counts": pa.array([total.tolist()], pa.list_(pa.int64()))})

    found = sorted((r.lang, r["counts"]) for r in sample.groupBy("lang").applyInArrow(counted, "lang string, counts array<long>").collect())
    return Model([k for k, _ in found], np.array([c for _, c in found], np.float64).reshape(len(found), BUCKETS))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#:]*)", 1))


def domain_of(host: Column) -> Column:
    """The last two labels."""
    return F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1)


def country_of(host: Column) -> Column:
    """The last label of a host, if it has two letters."""
    return F.regexp_extract(host, r"\.([a-z]{2})$", 1)


def path_language(url: Column) -> Column:
    """The first label of the path, if it has two letters."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))


def short_code(declared: Column) -> Column:
    """A declaration as two or three lower-case letters; anything else is empty."""
    return F.regexp_extract(F.lower(F.coalesce(declared, F.lit(""))), "^([a-z]{2,3})(?:[-_].*)?$", 1)


def declared_in(html: Column) -> Column:
    """The language that the markup declares, without its region."""
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html[^>]*\blang=[\"']?([A-Za-z]+)", 1))


#: Evidence of few values: codes of letters, so many at most. Their tables are small enough to be sent to every task.
SMALL = {"declared": 27**3, "country": 27**2, "path": 27**2}


def _votes(rows: DataFrame, by: str, n: int) -> DataFrame:
    """(by, votes): how many rows of each value have each language by text alone."""
    counts = [F.count_if(F.col("vote") == i).cast("double") for i in range(n)]
    return rows.where("vote >= 0").groupBy(by).agg(F.array(*counts).alias(f"{by}_votes"))


def fused(rows: DataFrame, model: Model) -> DataFrame:
    """rows: struct columns ``seen`` (text, declared, country, path, host, domain; strings) and ``kept`` (anything).

    Returns the fields of kept, then language, posterior, text_language, accepted. The hosts' votes are written as a
    table first, so Spark knows its size: within its threshold it is sent to the tasks and the rows stay where they are, beyond
    it both are shuffled by host, and a hot host is split by AQE's skew join.
    """
    langs, n = model.langs, len(model.langs)
    if not n:
        return rows.select("kept.*", F.lit(UND).alias("language"), F.lit(0.0).alias("posterior"), F.lit(UND).alias("text_language"), F.lit(False).alias("accepted"))
    sent = rows.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<logs: array<double>, letters: long>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            got = [sent.value.scores(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in got], pa.list_(pa.float64())), pa.array([k for _, k in got], pa.int64())], ["logs", "letters"])

    best = F.array_max(F.slice("logs", 1, n))
    junk = F.element_at("logs", n + 1)
    vote = F.when((F.col("letters") > 0) & (best >= junk), F.array_position("logs", best).cast("int") - 1).otherwise(-1)
    codes = [short_code(F.col("seen.declared")).alias("declared"), *(F.coalesce(f"seen.{c}", F.lit("")).alias(c) for c in ("country", "path", "host", "domain"))]
    seen = staged(rows.select("kept", *codes, read("seen.text").alias("r")).select("*", "r.logs", "r.letters").drop("r").withColumn("vote", vote), "language")
    totals = seen.where("vote >= 0").agg(*(F.count_if(F.col("vote") == i).cast("double") for i in range(n))).first()
    everywhere = [(totals[i] + 1.0) / (sum(totals) + n) for i in range(n)]
    domains = seen.groupBy("host").agg(F.min("domain").alias("domain"))  # of a host it is always the same
    hosts = staged(domains.join(_votes(seen, "host", n), "host", "left").join(_votes(seen, "domain", n), "domain", "left").drop("domain"), "hosts")
    out = seen.drop("domain").join(hosts, "host", "left")
    for by in SMALL:
        out = out.join(F.broadcast(_votes(seen, by, n)), by, "left")
    # arrays over the languages, each computed once for a row
    zeros, numbers = F.array_repeat(F.lit(0.0), n), F.sequence(F.lit(0), F.lit(n - 1))
    out = out.withColumn("mine", F.transform(numbers, lambda i: F.when(i == F.col("vote"), 1.0).otherwise(0.0)))
    others = lambda by: F.zip_with(F.coalesce(f"{by}_votes", zeros), "mine", lambda a, own: F.greatest(a - own, F.lit(0.0)))
    out = out.withColumns({f"{by}_others": others(by) for by in ("host", "domain", *SMALL)})
    size = lambda by: F.aggregate(f"{by}_others", F.lit(0.0), lambda a, x: a + x)
    out = out.withColumns({"host_size": size("host"), "domain_size": size("domain")})
    shares, rows_of = F.array(*(F.lit(float(x)) for x in everywhere)), F.array(*(F.lit(float(max(t - 1, 0.0))) for t in totals))
    domain = F.zip_with("domain_others", shares, lambda o, e: (o + HOST_WEIGHT * e) / (F.col("domain_size") + HOST_WEIGHT))
    prior = F.zip_with("host_others", domain, lambda o, d: (o + HOST_WEIGHT * d) / (F.col("host_size") + HOST_WEIGHT))
    fused_logs = F.zip_with(F.slice("logs", 1, n), prior, lambda x, p: x + F.log(p))
    for by, k in SMALL.items():
        share = F.transform(f"{by}_others", lambda o: o + TABLE_WEIGHT / k)  # noqa: B023
        says = F.zip_with(share, rows_of, lambda o, t: F.log(o / (t + TABLE_WEIGHT)))
        fused_logs = F.zip_with(fused_logs, says, lambda a, x: a + x)
    out = out.withColumn("fused", fused_logs)
    top = F.array_max("fused")
    posterior = F.lit(1.0) / F.aggregate(F.transform("fused", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    out = out.withColumns({"posterior": posterior, "best": F.array_position("fused", top).cast("int")})
    accepted = (F.col("letters") > 0) & (junk + float(np.log(JUNK_PRIOR)) <= best) & (F.col("posterior") >= LEAST)
    names = F.array(*(F.lit(x) for x in langs))
    return out.withColumn("accepted", accepted).select(
        "kept.*", F.when(F.col("accepted"), F.element_at(names, F.col("best"))).otherwise(UND).alias("language"), "posterior",
        F.when(F.col("vote") >= 0, F.element_at(names, F.col("vote") + 1)).otherwise(UND).alias("text_language"), "accepted",
    )


def of_documents(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with language, posterior, text_language and accepted: lang is the declaration, source the host. Columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in ("language", "posterior", "text_language", "accepted")]
    return fused(_documents(docs, kept), model or fitted(docs))


def _documents(docs: DataFrame, columns: list[str]) -> DataFrame:
    host = F.lower(F.col("source"))
    seen = F.struct("text", F.col("lang").alias("declared"), country_of(host).alias("country"), F.lit("").alias("path"), host.alias("host"), domain_of(host).alias("domain"))
    return docs.select(seen.alias("seen"), F.struct(*columns).alias("kept"))


def of_pages(pages: DataFrame, model: Model, columns: tuple[str, ...] = ("page_id",), text: Column | None = None) -> DataFrame:
    """Columns of pages (page_id, url, html) with language, posterior, text_language and accepted."""
    host = host_of(F.col("url"))
    shown = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</(script|style)\s*>", " "), r"<[^>]*>", " ") if text is None else text
    seen = F.struct(shown.alias("text"), declared_in(F.col("html")).alias("declared"), country_of(host).alias("country"), path_language(F.col("url")).alias("path"), host.alias("host"), domain_of(host).alias("domain"))
    return fused(pages.select(seen.alias("seen"), F.struct(*columns).alias("kept")), model)


def accepted_documents(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs without the rejected rows; their columns stay as they were. Names that clash with the results' don't matter."""
    held = whole_rows(docs, text=F.col("text"), lang=F.col("lang"), source=F.col("source"))
    return fused(_documents(held, ["row"]), model or fitted(docs)).where("accepted").select("row.*")
