"""Views of a library: sorting, shelves, resuming, search, tallies and default tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.functions.text import LATIN, fold_text, folded, folded_latin


def sorted_by(films: DataFrame, key: str | Column, descending: bool, ties: Sequence[str | Column]) -> DataFrame:
    """In order of a key with nulls last either way; ties in ascending order of ``ties``."""
    k = F.col(key) if isinstance(key, str) else key
    return films.orderBy(k.desc_nulls_last() if descending else k.asc_nulls_last(), *(F.asc(t) if isinstance(t, str) else t.asc() for t in ties))


def numbered_by(films: DataFrame, by: Sequence[str], key: Column, descending: bool, ties: Sequence[str], name: str = "place") -> DataFrame:
    """The same order within each group, as a number."""
    w = Window.partitionBy(*by).orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), *ties)
    return films.withColumn(name, F.row_number().over(w).cast("long"))


def watched_share(finished: Column, progress: Column) -> Column:
    return F.when(finished, 1.0).otherwise(progress)


def shelves(films: DataFrame, shelf: str, id: str) -> DataFrame:
    """(shelf, first_id, n): shelves, to be shown in order of their least film id."""
    return films.groupBy(shelf).agg(F.min(id).alias("first_id"), F.count("*").alias("n"))


def resumable(positions: DataFrame, films: DataFrame, n: int) -> DataFrame:
    """The n unfinished films last watched; the film id breaks ties. A top-k, without a full sort."""
    return positions.where(~F.col("finished")).join(films, "film_id").orderBy(F.desc("updated_at"), "film_id").limit(n)


def search(entries: DataFrame, text: str, query: str, order: str, shown: int = 40) -> DataFrame:
    """(order, found): the first ``shown`` entries whose folded text holds the folded query, with ``found``, how many there are in all.

    A blank query finds nothing. Texts of letters up to U+017F are folded in the JVM, by a table of what Unicode's decomposition
    makes of each letter; only the others reach Python. All texts are read once: each part's count and first entries go on.
    """
    wanted = fold_text(query.strip())
    if not wanted:
        return entries.select(order, F.lit(0).cast("long").alias("found")).limit(0)
    rows = entries.select(order, F.col(text).alias("_text"))
    plain = F.col("_text").rlike(LATIN)
    hits = rows.where(plain & folded_latin(F.col("_text")).contains(wanted)).unionByName(rows.where(~plain & folded(F.col("_text")).contains(wanted))).select(order)
    held = hits.groupBy(F.spark_partition_id().alias("_part")).agg(F.count("*").alias("_n"), F.slice(F.array_sort(F.collect_list(order)), 1, shown).alias("_first"))
    both = held.agg(F.sum("_n").cast("long").alias("found"), F.slice(F.array_sort(F.flatten(F.collect_list("_first"))), 1, shown).alias("_first"))  # ``shown`` of each part
    return both.select(F.explode("_first").alias(order), "found")


def cover_tally(films: DataFrame, source: str, example: str, order: str) -> DataFrame:
    """(source, n, example): films of each kind of cover but none, with the first that isn't null as an example."""
    first = F.min(F.when(F.col(example).isNotNull(), F.struct(order, example)))
    return films.where(F.col(source) != "none").groupBy(source).agg(F.count("*").alias("n"), first[example].alias("example"))


def total_or_null(films: DataFrame, value: str) -> DataFrame:
    """(total): the sum, null if any film lacks the value or there is none."""
    return films.agg(F.when(F.count_if(F.col(value).isNull()) == 0, F.sum(value)).alias("total"))


def default_track(tracks: DataFrame, film: str, preferred: str, order: str) -> DataFrame:
    """One track for each film: 4 for the preferred language, 2 if it isn't forced, 1 if not for the hard of hearing; the first of the best."""
    language = F.lit(0) if preferred == "any" else F.when(F.col("language") == preferred, 4).otherwise(0)
    score = language + F.when(F.col("forced"), 0).otherwise(2) + F.when(F.col("hearing_impaired"), 0).otherwise(1)
    w = Window.partitionBy(film).orderBy(F.desc("score"), order)
    return tracks.withColumn("score", score).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def active_track(films: DataFrame, tracks: DataFrame, preferred: str) -> DataFrame:
    """(film_id, track_id): none where subtitles are off, else the chosen track if it can be read, else the default one."""
    readable = tracks.where(F.col("codec").isin("subrip", "ass", "webvtt") & (F.col("cue_count") > 0))
    best = default_track(readable, "film_id", preferred, "id").select("film_id", F.col("id").alias("_default"))
    chosen = readable.select(F.col("id").alias("chosen_track_id"), F.lit(True).alias("_ok"), F.col("film_id").alias("id"))
    both = films.join(chosen, ["id", "chosen_track_id"], "left").join(best, F.col("id") == F.col("film_id"), "left")
    return both.select(F.col("id").alias("film_id"), F.when(~F.col("subtitles_off"), F.when(F.col("_ok"), F.col("chosen_track_id")).otherwise(F.col("_default"))).alias("track_id"))


def headline(films: DataFrame, resumable_films: DataFrame) -> DataFrame:
    """One film: the first of those to resume that isn't missing, else the newest that isn't."""
    r = resumable_films.where("missing_since IS NULL").select("film_id", F.lit(0).alias("o"), (-F.col("updated_at")).alias("k"))
    f = films.where("missing_since IS NULL").select("film_id", F.lit(1).alias("o"), (-F.col("film_id")).alias("k"))
    return r.unionByName(f).orderBy("o", "k").limit(1).select("film_id")


def film_views(films: DataFrame, folders: DataFrame, tracks: DataFrame, audio: DataFrame, positions: DataFrame) -> DataFrame:
    """A row for each film with its folder, tracks, audio streams and position nested."""
    t = tracks.groupBy("film_id").agg(F.array_sort(F.collect_list(F.struct(F.col("language").isNull().alias("unknown"), "language", "forced", "path", "id", "cue_count", "match_kind", "offset_ms", "rate"))).alias("tracks"))
    a = audio.groupBy("film_id").agg(F.array_sort(F.collect_list(F.struct("stream_number", "codec", "channels", "language", "is_default"))).alias("audio"))
    p = positions.select("film_id", F.struct("position_ms", "duration_ms", "finished", "updated_at").alias("position"))
    out = films.join(folders.select(F.col("id").alias("folder_id"), F.col("path").alias("folder")), "folder_id", "left")
    for more in (t, a, p):
        out = out.join(more, F.col("id") == F.col("film_id"), "left").drop("film_id")
    return out


def settings(stored: DataFrame, known: dict[str, tuple[float, float, float]]) -> DataFrame:
    """(key, value) of numeric settings: known keys with stored values held to their range, or the default. known: key to (default, least, most)."""
    spec = stored.sparkSession.createDataFrame([(k, *v) for k, v in known.items()], "key string, d double, a double, b double")
    value = F.expr("try_cast(value AS double)")
    return spec.join(stored, "key", "left").select("key", F.coalesce(F.greatest("a", F.least("b", value)), "d").alias("value"))
