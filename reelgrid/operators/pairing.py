"""Pairing subtitles with films by name: exactly, or by the longest shared beginning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def years_agree(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | (a == b)


def agreeing(rows: DataFrame, others: DataFrame, key: str, values: dict[str, tuple[str, Column]]) -> DataFrame:
    """rows that others (key, year) of their key and an agreeing year meet, with aggregates over those: {name: (count, min or max, of what)}.

    Others are summed by key and year, over all years of a key and over those without one; a row meets one of each, however many there are.
    """
    own = others.groupBy(F.col(key).alias("_k"), F.col("year").alias("_y")).agg(*(getattr(F, f)(c).alias(f"_{n}") for n, (f, c) in values.items()), F.count("*").alias("_met"))
    merge = lambda n, f, c: getattr(F, "sum" if f == "count" else f)(c).alias(n)
    names = {**{f"_{n}": f for n, (f, _) in values.items()}, "_met": "count"}
    free = F.col("_y").isNull()
    keys = own.groupBy(F.col("_k").alias("_of_key")).agg(*(merge(f"_all{n}", f, n) for n, f in names.items()), *(merge(f"_any{n}", f, F.when(free, F.col(n))) for n, f in names.items()))
    # merged, not broadcast: what a compressed table takes once it is built says nothing of it before
    met = rows.join(keys.hint("merge"), F.col(key) == F.col("_of_key")).join(own.where("_y IS NOT NULL").hint("merge"), (F.col(key) == F.col("_k")) & (F.col("year") == F.col("_y")), "left")

    def both(n: str, f: str) -> Column:
        if f == "count":
            some = F.coalesce(f"_any{n}", F.lit(0)) + F.coalesce(n, F.lit(0))
        else:
            some = (F.least if f == "min" else F.greatest)(f"_any{n}", n)
        return F.when(F.col("year").isNull(), F.col(f"_all{n}")).otherwise(some)

    return met.where(both("_met", "count") > 0).select(*rows.columns, *(both(f"_{n}", f).alias(n) for n, (f, _) in values.items()))


def exact(subtitles: DataFrame, films: DataFrame) -> DataFrame:
    """(subtitle, n_films, film) of subtitles with films of equal key and agreeing year; film only if there is exactly one.

    subtitles: subtitle, key, year; films: film, key, year. Films are counted by key and year first, so a key that many have makes no pairs.
    """
    met = agreeing(subtitles.select("subtitle", "key", "year"), films.where("key <> ''").select("film", "key", "year"), "key", {"n_films": ("count", F.lit(1)), "film": ("min", F.col("film"))})
    met = met.groupBy("subtitle").agg(F.sum("n_films").alias("n_films"), F.min("film").alias("film"))
    return met.withColumn("film", F.when(F.col("n_films") == 1, F.col("film")))


def by_beginning(subtitles: DataFrame, films: DataFrame) -> DataFrame:
    """(subtitle, film, shared): the film whose words and the subtitle's agree over the shorter of the two, the longest such; none if two tie.

    A single shared word has four bytes or more. subtitles: subtitle, words, year; films: film, words, year. The join is on
    the words of the shorter list: each list is offered whole and by its beginnings. Films are summed by what they offer first, to their least and
    greatest id: one film if both are the same, a tie if not.
    """
    joined = lambda c: F.array_join(c, " ")
    def offered(rows: DataFrame, id: str) -> DataFrame:
        n = F.size("words")
        starts = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(joined(F.slice("words", 1, i)).alias("start"), i.alias("shared"), (i == n).alias("whole")))
        return rows.where(n > 0).select(id, "year", F.inline(starts))
    worth = (F.col("shared") > 1) | (F.octet_length("start") >= 4)
    a, b = offered(subtitles, "subtitle").where(worth), offered(films, "film").where(worth)
    ends = {"low": ("min", F.col("film")), "high": ("max", F.col("film"))}
    met = lambda rows, others: agreeing(rows.select("subtitle", "year", "start", "shared"), others.select("film", "year", "start"), "start", ends)
    # a whole film among a subtitle's beginnings, and a whole subtitle among the longer films' beginnings
    found = met(a, b.where("whole")).unionByName(met(a.where("whole"), b.where("NOT whole")))
    best = found.groupBy("subtitle", "shared").agg(F.min("low").alias("low"), F.max("high").alias("high")).groupBy("subtitle").agg(F.max(F.struct("shared", "low", "high")).alias("b"))
    return best.where("b.low = b.high").select("subtitle", F.col("b.low").alias("film"), F.col("b.shared").cast("long").alias("shared"))


def paired(subtitles: DataFrame, films: DataFrame, relaxed: bool = True) -> DataFrame:
    """(subtitle, film, match): exact pairs, and where no film has the key, pairs by beginning if relaxed. Two exact hits pair with none.

    Both tables: id columns subtitle or film, key, words, year.
    """
    first = exact(subtitles.select("subtitle", "key", "year"), films)
    pairs = first.where("film IS NOT NULL").select("subtitle", "film", F.lit("exact").alias("match"))
    if not relaxed:
        return pairs
    rest = subtitles.join(first.select("subtitle"), "subtitle", "left_anti")
    return pairs.unionByName(by_beginning(rest, films).select("subtitle", "film", F.lit("approximate").alias("match")))


def unpaired(subtitles: DataFrame, pairs: DataFrame) -> DataFrame:
    return subtitles.join(pairs.select("subtitle"), "subtitle", "left_anti")


def first_agreeing(wanted: DataFrame, found: DataFrame, id: str) -> DataFrame:
    """For each row of wanted (id, key, year), the first path of found (path, key, year) with its key and an agreeing year."""
    met = agreeing(wanted.select(id, "key", "year"), found.select("path", "key", "year"), "key", {"path": ("min", F.col("path"))})
    return met.groupBy(id).agg(F.min("path").alias("path"))


def ranked_first(rows: DataFrame, by: str, *order) -> DataFrame:
    """The first row of each group in an order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_rank = 1").drop("_rank")
