"""URL filter: a weighted vocabulary matched by Aho-Corasick, under host and path rules.

Null or malformed URLs (no ``://``) have an empty host and path; their text is still scanned. Repeated rows
are judged alike, one output row for each input row; columns of the input other than the URL are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.common import LOWER_TABLE, lower_ascii

#: One distinct strict term rejects a URL, SOFT_LIMIT distinct soft ones do.
STRICT_TERMS = ("cheap-pills", "spam-farm", "porn", "porno", "xxx", "hentai", "warez", "casino-bonus", "replica-watches")
SOFT_TERMS = (
    "adult", "bet", "bonus", "casino", "cheap", "dating", "escort", "farm", "free", "loan", "nude", "payday",
    "pills", "poker", "sex", "slots", "spam", "torrent", "viagra", "webcam",
)
SOFT_LIMIT = 2
#: The weights of terms, and the weight at which a URL is rejected.
LIMIT = 1.0
VOCABULARY = {t: LIMIT / SOFT_LIMIT for t in SOFT_TERMS} | {t: LIMIT for t in STRICT_TERMS}
#: (verdict, host and path prefix); a rule holds for its host and all subdomains.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does; the first wins among equals."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        at, slash, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def vocabulary_of(terms: DataFrame, most: int = 1_000_000) -> dict[str, float]:
    """The vocabulary in a table (term, weight): terms in lower case, the highest weight of each. Refuses more than ``most`` terms, the bound of what tasks are sent."""
    rows = terms.where("term <> '' AND weight > 0").groupBy(lower_ascii(F.col("term")).alias("term")).agg(F.max("weight").cast("double").alias("weight")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms")
    return {r.term: r.weight for r in rows}


def term_hits(vocabulary: dict[str, float]):
    """A UDF: how many distinct strict terms (of weight LIMIT or more) and soft ones a URL holds, each bounded by non-alphanumeric characters, and their weight together."""

    @F.pandas_udf("strict int, soft int, weight double")
    def hits(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for term, weight in vocabulary.items():
            automaton.add_word(term, (term, weight))
        if vocabulary:
            automaton.make_automaton()
        word = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

        def count(url: str | None) -> tuple[int, int, float]:
            url = (url or "").translate(LOWER_TABLE)
            found = {}
            for end, (term, weight) in automaton.iter(url) if vocabulary else ():
                begin = end - len(term)
                if (begin < 0 or url[begin] not in word) and (end + 1 == len(url) or url[end + 1] not in word):
                    found[term] = weight
            strict = sum(w >= LIMIT for w in found.values())
            return strict, len(found) - strict, float(sum(found.values()))

        for series in urls:
            yield pd.DataFrame([count(u) for u in series], columns=["strict", "soft", "weight"])

    return hits


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    vocabulary: dict[str, float] = VOCABULARY,
    rules: Sequence[tuple[str, str]] = RULES,
) -> DataFrame:
    """pages with a struct column ``judged`` (host, path, rule, strict_hits, soft_hits, weight, verdict).

    The longest fitting rule decides; without one, a URL is blocked if its distinct terms weigh LIMIT or more together.
    A map over rows: no shuffle. An existing column ``judged`` is replaced.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rule, said = longest_rule(F.col("judged.host"), F.col("judged.path"), rules)
    hits = term_hits(vocabulary)(F.col(url))
    own = F.when(F.col("judged.hits.weight") >= LIMIT, "block").otherwise("allow")
    return pages.withColumn("judged", F.struct(host.alias("host"), path.alias("path"), hits.alias("hits"))).withColumn(
        "judged",
        F.struct(
            F.col("judged.host"), F.col("judged.path"), rule.alias("rule"), F.col("judged.hits.strict").alias("strict_hits"),
            F.col("judged.hits.soft").alias("soft_hits"), F.col("judged.hits.weight").alias("weight"), F.coalesce(said, own).alias("verdict"),
        ),
    )


def oracle_sql() -> str:
    """The query over the table pages for DuckDB; boundary checks as patterns instead of the automaton."""
    lowered = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hit = lambda t: f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS BIGINT)"
    fits = lambda r: "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')".format(r.partition("/")[0], "/" + r.partition("/")[2])
    by_length = sorted(RULES, key=lambda r: -len(r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in by_length) + " END"
    said = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{v}'" for v, r in by_length)
    return f"""
    WITH p AS (SELECT page_id, {lowered} AS u,
        translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    h AS (SELECT *, {" + ".join(map(hit, STRICT_TERMS))} AS strict_hits, {" + ".join(map(hit, SOFT_TERMS))} AS soft_hits FROM p)
    SELECT page_id, host, path, {rule} AS rule,
        {said} WHEN strict_hits >= 1 OR soft_hits >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict FROM h"""
