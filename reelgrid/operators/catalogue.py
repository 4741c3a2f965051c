"""Reads of the library's tables: lookups, filters, projections, orders, shelves, cues, references, counters.

Tables have the columns of ``sources.tables``. Everything is a plan over DataFrames; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.functions import labels
from reelgrid.functions.media import COVER_RANKS, TEXT_CODECS, is_inside
from reelgrid.functions.text import filed_title, folded, natural_key
from reelgrid.functions.timing import MAX_MS, corrected, progress
from reelgrid.operators import library

FEWEST_CUES = 100
# Fixed values.
AROUND_MS, STARTED_MS, STEP_BACK_MS = 15_000, 1_000, 400
#: Films of a shelf that are shown.
SHELF_SHOWN = 12


# ---- lookups and filters -------------------------------------------------------------------------------------------------


def matching(rows: DataFrame, **equal) -> DataFrame:
    """Rows whose columns have the given values; None is null."""
    for column, value in equal.items():
        rows = rows.where(F.col(column).eqNullSafe(F.lit(value)))
    return rows


def unprobed(films: DataFrame, folder_id: int) -> DataFrame:
    """(id) of films never looked inside."""
    return films.where((F.col("folder_id") == folder_id) & F.col("probed_at").isNull()).select("id")


def undescribed(films: DataFrame, folder_id: int) -> DataFrame:
    """(id) of films whose container isn't known."""
    return films.where((F.col("folder_id") == folder_id) & F.col("container").isNull()).select("id")


def present(films: DataFrame, hide_missing: bool = True) -> DataFrame:
    """Films without those that are missing, where these are to be hidden."""
    return films.where("missing_since IS NULL") if hide_missing else films


def in_folders(films: DataFrame, folder_ids: DataFrame) -> DataFrame:
    """Films of the folders (id)."""
    return films.join(folder_ids.select(F.col("id").alias("folder_id")).distinct(), "folder_id", "left_semi").select(films.columns)


# ---- projections ---------------------------------------------------------------------------------------------------------


def fingerprints(films: DataFrame) -> DataFrame:
    """(id, path, size_bytes, modified_at, missing): what a scan compares with the disk."""
    return films.select("id", "path", "size_bytes", "modified_at", F.col("missing_since").isNotNull().alias("missing"))


def covers(films: DataFrame) -> DataFrame:
    """(id, cover): a struct (path, source), null without a path whatever the source says; unknown sources are none."""
    source = F.when(F.col("cover_source").isin(*COVER_RANKS), F.col("cover_source")).otherwise("none")
    return films.select("id", F.when(F.col("cover_path").isNotNull(), F.struct(F.col("cover_path").alias("path"), source.alias("source"))).alias("cover"))


def video(films: DataFrame) -> DataFrame:
    """(id, video): a struct, null without a codec; figures that are zero or don't fit their types are null."""
    held = lambda c, most: F.when((F.col(c) > 0) & (F.col(c) <= most), F.col(c))
    made = F.struct(
        F.col("video_codec").alias("codec"), held("video_width", 2**32 - 1).cast("long").alias("width"), held("video_height", 2**32 - 1).cast("long").alias("height"),
        held("bit_depth", 255).cast("int").alias("bit_depth"), F.when((F.col("frame_rate") > 0) & (F.col("frame_rate") < float("inf")), F.col("frame_rate")).alias("frame_rate"),
    )
    return films.select("id", F.when(F.col("video_codec").isNotNull(), made).alias("video"))


# ---- orders and shelves --------------------------------------------------------------------------------------------------


def listed(films: DataFrame) -> DataFrame:
    """The stored order: by title and year, nulls first."""
    return films.orderBy(F.asc_nulls_first("title"), F.asc_nulls_first("year"), "id")


def folders(watched: DataFrame) -> DataFrame:
    return watched.orderBy("added_at", "id")


def preferences(stored: DataFrame) -> DataFrame:
    return stored.orderBy("key")


def sort_keys(films: DataFrame) -> dict[str, Column]:
    """The keys of the eight orders over film_view(): text is folded with its numbers padded, figures are as they are."""
    watched = F.when(F.col("finished"), F.lit(1.0)).otherwise(progress(F.col("position_ms"), F.coalesce("watched_ms", "duration_ms")))
    return {
        "title": natural_key(filed_title(F.col("title"))), "folder": natural_key(F.col("shelf")), "year": F.col("year"), "runtime": F.col("duration_ms"),
        "video": F.col("video_height"), "size": F.when(F.col("container").isNotNull(), F.col("size_bytes")), "added": F.col("added_at"), "watched": F.when(F.col("position_ms").isNotNull(), watched),
    }


def ordered(films: DataFrame, name: str, descending: bool = False) -> DataFrame:
    """Films in one of the eight orders, what has no key last either way; ties by the filed title, the title, then the id."""
    return library.sorted_by(films, sort_keys(films)[name], descending, [natural_key(filed_title(F.col("title"))), F.col("title"), F.col("id")])


def places(films: DataFrame, name: str, descending: bool = False) -> DataFrame:
    """(id, place): the same order as numbers, by folder."""
    k = films.withColumns({"_k": sort_keys(films)[name], "_filed": natural_key(filed_title(F.col("title")))})
    return library.numbered_by(k, ["folder_id"], F.col("_k"), descending, ["_filed", "title", "id"]).select("id", "folder_id", "place")


def shelves(films: DataFrame, resumable: DataFrame, shown: int = SHELF_SHOWN) -> DataFrame:
    """(key, name, place, n, film_ids): shelves of films (id, shelf, shelf_path) in order of their first film; what is being watched, if anything, before them.

    resumable: film_id, updated_at. film_ids: the first ``shown`` of the n films, in order of ids; of those being watched the latest first. Ranks are
    cut off before films are shuffled, so no shelf is gathered whole.
    """
    own = films.select(F.lit(1).alias("late"), F.col("shelf_path").alias("key"), F.col("shelf").alias("name"), F.col("id").alias("o"), "id")
    watched = resumable.select(F.lit(0).alias("late"), F.lit("carrying-on").alias("key"), F.lit("Carry on watching").alias("name"), (-F.col("updated_at")).alias("o"), F.col("film_id").alias("id"))
    both = own.unionByName(watched)
    k = F.row_number().over(Window.partitionBy("late", "key", "name").orderBy("o", "id"))
    heads = both.withColumn("_k", k).where(F.col("_k") <= shown).groupBy("late", "key", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "id"))), lambda x: x["id"]).alias("film_ids"))
    counts = both.groupBy(F.col("late").alias("_late"), F.col("key").alias("_key"), F.col("name").alias("_name")).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    met = heads.join(counts, F.col("late").eqNullSafe(F.col("_late")) & F.col("key").eqNullSafe(F.col("_key")) & F.col("name").eqNullSafe(F.col("_name")))
    place = F.row_number().over(Window.orderBy("late", "first")).cast("long")  # a row for each shelf
    return met.withColumn("place", place).select("key", "name", "place", "n", "film_ids")


def columns_for(width: Column, least: int, gap: int) -> Column:
    """How many tiles fit side by side, one at least."""
    return F.when((width > 0) & (width < float("inf")), F.greatest(F.lit(1), F.floor((width + gap) / (least + gap)))).otherwise(1).cast("long")


def grid(items: DataFrame, by: Sequence[str], order: Sequence[str], across: int) -> DataFrame:
    """items with line and at, from 0: dealt in order into lines of ``across``."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return items.withColumn("_k", k).withColumns({"line": F.floor(F.col("_k") / max(1, across)).cast("long"), "at": (F.col("_k") % max(1, across)).cast("long")}).drop("_k")


def commands_matching(commands: DataFrame, query: str, name: str = "name") -> DataFrame:
    """Commands whose folded name holds the folded query; all for a blank one."""
    wanted = query.strip()
    return commands.where(folded(F.col(name)).contains(folded(F.lit(wanted)))) if wanted else commands


def cover_tally(films: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((source, place, n, example), left over): films of each kind of cover in their fixed order, and the films (id) without any."""
    rank = labels._cases(F.col("cover_source"), {k: v for k, v in COVER_RANKS.items() if k != "none"})
    known = films.withColumn("_rank", rank)
    example = F.min(F.when(F.col("cover_path").isNotNull(), F.struct("id", "cover_path")))["cover_path"]
    tally = known.where("_rank IS NOT NULL").groupBy(F.col("cover_source").alias("source"), F.col("_rank").cast("long").alias("place")).agg(F.count("*").alias("n"), example.alias("example"))
    return tally, films.where("cover_source = 'none'").select("id")


def lines_of(tracks: DataFrame) -> DataFrame:
    """(film_id, lines): cues of all tracks of each film."""
    return tracks.groupBy("film_id").agg(F.sum("cue_count").cast("long").alias("lines"))


def scan_counts(found: DataFrame, by: str = "folder") -> DataFrame:
    """(folder, films, subtitles, images, sidecars, other, size_bytes) of found files (folder, kind, size_bytes)."""
    of = lambda kind: F.count_if(F.col("kind").eqNullSafe(F.lit(kind)))
    return found.groupBy(by).agg(
        of("film").alias("films"), of("subtitle").alias("subtitles"), of("image").alias("images"), of("sidecar").alias("sidecars"), of(None).alias("other"), F.sum("size_bytes").cast("long").alias("size_bytes")
    )


# ---- tracks and cues -----------------------------------------------------------------------------------------------------


def cues(track_cues: DataFrame, tracks: DataFrame, authored: bool = False) -> DataFrame:
    """(track_id, place, start_ms, end_ms, position, text): cues in order of their authored times, then corrected as their tracks say.

    Positions that aren't 1 to 9 are null. authored: times as they are written.
    """
    known = tracks.select(F.col("id").alias("track_id"), "offset_ms", "rate")
    w = Window.partitionBy("track_id").orderBy("start_ms", "ordinal")
    rows = track_cues.withColumn("place", F.row_number().over(w).cast("long")).join(known, "track_id")
    at = (lambda c: F.col(c).cast("long")) if authored else (lambda c: corrected(F.col(c), F.col("offset_ms"), F.col("rate")))
    return rows.select("track_id", "place", at("start_ms").alias("start_ms"), at("end_ms").alias("end_ms"), F.when(F.col("position").between(1, 9), F.col("position")).alias("position"), "text")


def saturating(ms: Column) -> Column:
    """A time held to what one can be."""
    return F.greatest(F.lit(0), F.least(F.lit(MAX_MS), ms)).cast("long")


def stepped(positions: DataFrame, lines: DataFrame, by: Sequence[str], at: str, start: str) -> DataFrame:
    """positions with next_ms, the first start after, and previous_ms, the last start STEP_BACK_MS or more before. Two as-of joins in one shuffle each."""
    from reelgrid.operators.intervals import nearest

    after = nearest(positions.withColumn("_t", F.col(at) + 1), lines, by, "_t", start).withColumnRenamed("following", "next_ms").drop("previous", "_t")
    back = nearest(after.withColumn("_t", F.col(at) - STEP_BACK_MS), lines, by, "_t", start)
    return back.withColumnRenamed("previous", "previous_ms").drop("following", "_t")


def nearest_within(positions: DataFrame, lines: DataFrame, by: Sequence[str], at: str, start: str, end: str, around: int = AROUND_MS, least: int = STARTED_MS) -> DataFrame:
    """positions with line_ms: the start of the line that is on, else of the nearest within ``around`` (of two as near, the one before); null before ``least``.

    The distance to a line is that to its nearer edge. Only the last line begun and the next one are looked at.
    """
    from reelgrid.operators import intervals, series

    seen = series.nearest(positions, lines, by, at, start, intervals.CHUNK_MS, F.struct(F.col(start).alias("s"), F.col(end).alias("e")))
    t, b, a = F.col(at), F.col("previous"), F.col("following")
    away_b, away_a = F.when(b.isNotNull(), F.greatest(F.lit(0), t - b["e"])), a["s"] - t
    line = F.when((away_b <= around) & (away_a.isNull() | (away_b <= away_a)), b["s"]).when(away_a <= around, a["s"]).when(away_b <= around, b["s"])
    return seen.select(*positions.columns, F.when(t >= least, line).alias("line_ms"))


def best_reference(tracks: DataFrame) -> DataFrame:
    """(track_id, reference_id): the other track of its film to measure each track against.

    Text with FEWEST_CUES cues or more; inside the film first, then most cues, then the first id. The two best of each film are
    enough, as a track isn't its own reference: no track meets all others.
    """
    usable = tracks.where(F.col("codec").isin(*TEXT_CODECS) & (F.col("cue_count") >= FEWEST_CUES))
    w = Window.partitionBy("film_id").orderBy((F.col("origin") != "stream").cast("int"), F.desc("cue_count"), "id")
    two = usable.withColumn("_k", F.row_number().over(w)).where("_k <= 2").groupBy("film_id").agg(F.max(F.when(F.col("_k") == 1, F.col("id"))).alias("_one"), F.max(F.when(F.col("_k") == 2, F.col("id"))).alias("_two"))
    met = tracks.select(F.col("id").alias("track_id"), "film_id").join(two, "film_id", "left")
    return met.select("track_id", F.when(F.col("track_id").eqNullSafe(F.col("_one")), F.col("_two")).otherwise(F.col("_one")).alias("reference_id"))


def against_references(track_cues: DataFrame, tracks: DataFrame, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(cues, runs) that alignment.aligned() takes to measure tracks (all, or those wanted: track_id) against their references: a track's authored cues, its reference's corrected ones.

    ``film`` is the track's id in both, so each track is measured on its own.
    """
    from reelgrid.operators.alignment import BIN_MS, cue_runs

    pairs = best_reference(tracks).where("reference_id IS NOT NULL")
    pairs = pairs if wanted is None else pairs.join(wanted.select("track_id"), "track_id", "left_semi")
    own = cues(track_cues, tracks, authored=True).join(pairs.select("track_id"), "track_id", "left_semi").select("track_id", F.col("track_id").alias("film"), "start_ms", "end_ms", "text")
    theirs = pairs.select(F.col("track_id").alias("film"), F.col("reference_id").alias("track_id")).join(cues(track_cues, tracks), "track_id").select("film", "start_ms", "end_ms", "text")
    length = theirs.groupBy("film").agg((F.floor(F.max("end_ms") / BIN_MS) + 1).cast("long").alias("film_bins"))
    return own, cue_runs(theirs, ["film"]).join(length, "film")


def track_rows(audio: DataFrame, tracks: DataFrame, active: DataFrame) -> DataFrame:
    """(film_id, place, key, kind, language, codec, what, state, warn): a film's soundtracks, then its subtitles. active: film_id, track_id."""
    from reelgrid.functions.media import channel_layout

    text = "string"
    sound = audio.select(
        "film_id", F.struct(F.lit(0).alias("k"), F.col("stream_number").cast("long").alias("n")).alias("o"), F.concat(F.lit("sound-"), F.row_number().over(Window.partitionBy("film_id").orderBy("stream_number")).cast(text)).alias("key"), F.lit("Sound").alias("kind"),
        F.nullif(labels.language_name(F.col("language")), F.lit("")).alias("language"), "codec", F.when(F.col("channels").isNotNull(), channel_layout(F.col("channels"))).alias("what"), F.when(F.col("is_default"), "Default").alias("state"), F.lit(False).alias("warn"),
    )
    wrong = labels.track_problem(F.col("codec"))
    chosen = active.select(F.col("track_id").alias("id"), F.lit(True).alias("_on"))
    subs = tracks.join(chosen, "id", "left").select(
        "film_id", F.struct(F.lit(1).alias("k"), F.col("id").cast("long").alias("n")).alias("o"), F.concat(F.lit("subtitle-"), F.col("id").cast(text)).alias("key"), F.lit("Subtitle").alias("kind"),
        F.nullif(labels.language_name(F.col("language")), F.lit("")).alias("language"), F.lit(None).cast(text).alias("codec"), labels.track_about(F.col("origin"), F.col("cue_count"), F.col("forced"), F.col("hearing_impaired")).alias("what"),
        F.coalesce(wrong, F.when(F.col("_on"), "Chosen")).alias("state"), wrong.isNotNull().alias("warn"),
    )
    both = sound.unionByName(subs)
    return both.withColumn("place", F.row_number().over(Window.partitionBy("film_id").orderBy("o")).cast("long")).drop("o")


# ---- folders -------------------------------------------------------------------------------------------------------------


def under(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (path) that are, or lie below, one of roots (path). Each row is offered under all its beginnings, so it is a hash join."""
    parts = F.split("path", "/")
    above = rows.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("_above"))
    met = above.join(roots.select(F.col("path").alias("_above")), "_above", "left_semi").select("path").distinct()
    return rows.join(met, "path", "left_semi").select(rows.columns)


def touched_folders(watched: DataFrame, paths: DataFrame) -> DataFrame:
    """Watched folders (id, path) that hold one of the changed paths (path). Each path is offered under all its beginnings, so it is a hash join."""
    parts = F.split("path", "/")
    roots = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path")).distinct()
    return watched.join(roots, "path", "left_semi").select(watched.columns)


def outermost(paths: DataFrame) -> DataFrame:
    """(path): folders that lie in none of the others, each once."""
    own = paths.select("path").where("path IS NOT NULL").distinct()
    parts = F.split("path", "/")
    above = own.select("path", F.explode(F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i > 0), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("above"))
    inside = above.join(own.select(F.col("path").alias("above")), "above", "left_semi").select("path").distinct()
    return own.join(inside, "path", "left_anti")


def inside(path: Column, root: Column) -> Column:
    return is_inside(path, root)


def fraction_read(subtitles_read: Column, films_read: Column, subtitles: Column, films: Column) -> Column:
    """How much of a scan is done; all of it where there is nothing to read."""
    wanted = subtitles + films
    return F.when(wanted == 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (subtitles_read + films_read) / wanted)))
