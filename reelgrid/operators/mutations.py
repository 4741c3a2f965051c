"""Changes of the library's tables: each takes tables and gives the new version of one, with ``changed`` where the caller counts writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.functions.timing import clamped_offset, clamped_rate
from reelgrid.operators import series
from reelgrid.operators.upserts import differs, nulled, replaced, upserted, without

LEAST_POSITION_MS = 1_000
# What one commit of tracks holds.
PACK_TRACKS, PACK_CUES = 64, 20_000


class Refused(ValueError):
    """A change that the library's rules don't allow."""


def set_columns(rows: DataFrame, key: str, fresh: DataFrame, columns: Sequence[str], keep_known: Sequence[str] = ()) -> DataFrame:
    """rows where those of fresh (key, columns) take its values; keep_known columns only where fresh has them. Adds ``changed``; no row is added."""
    got = fresh.select(F.col(key), F.struct(*columns, *keep_known).alias("_new"))
    both = rows.join(got, key, "left")
    hit, changed, out = F.col("_new").isNotNull(), F.lit(False), {}
    for c in (*columns, *keep_known):
        to = F.coalesce(F.col(f"_new.{c}"), F.col(c)) if c in keep_known else F.col(f"_new.{c}")
        out[c] = F.when(hit, to).otherwise(F.col(c))
        changed = changed | (hit & differs(to, F.col(c)))
    return both.withColumns({"changed": changed, **out}).select(*rows.columns, "changed")


def set_covers(films: DataFrame, covers: DataFrame) -> DataFrame:
    """films after covers (id, cover: struct path, source, or null for none); ``changed`` where the path or the source differs."""
    fresh = covers.select("id", F.col("cover.path").alias("cover_path"), F.coalesce("cover.source", F.lit("none")).alias("cover_source"))
    return set_columns(films, "id", fresh, ["cover_path", "cover_source"])


def pointed(tracks: DataFrame, pairs: DataFrame) -> DataFrame:
    """tracks paired by hand with films (id, film_id): a track that goes to another film forgets its correction."""
    p = pairs.select("id", F.col("film_id").alias("_film"))
    both = tracks.join(p, "id", "left")
    hit = F.col("_film").isNotNull()
    moved = hit & differs(F.col("_film"), F.col("film_id"))
    return both.withColumns(
        {"offset_ms": F.when(moved, 0).otherwise(F.col("offset_ms")), "rate": F.when(moved, 1.0).otherwise(F.col("rate")), "film_id": F.coalesce("_film", "film_id"), "match_kind": F.when(hit, "by-hand").otherwise(F.col("match_kind"))}
    ).select(tracks.columns)


def with_corrections(tracks: DataFrame, corrections: DataFrame) -> DataFrame:
    """tracks after corrections (id, offset_ms, rate), held to their ranges; with ``changed``."""
    held = corrections.select("id", clamped_offset(F.col("offset_ms")).cast("int").alias("offset_ms"), clamped_rate(F.col("rate")).alias("rate"))
    return set_columns(tracks, "id", held, ["offset_ms", "rate"])


def chosen_tracks(films: DataFrame, tracks: DataFrame, choices: DataFrame) -> DataFrame:
    """films after choices (id, track_id, off): a track, no subtitles, or (nulls) no choice; off wins. With ``changed``, and ``refused`` where the track is another film's."""
    owned = tracks.select(F.col("id").alias("track_id"), F.col("film_id").alias("_owner"))
    asked = choices.join(owned, "track_id", "left")
    bad = F.col("track_id").isNotNull() & ~F.coalesce(F.col("off"), F.lit(False)) & ~F.col("_owner").eqNullSafe(F.col("id"))
    asked = asked.withColumn("refused", bad)
    fresh = asked.where("NOT refused").select("id", F.when(~F.coalesce(F.col("off"), F.lit(False)), F.col("track_id")).alias("chosen_track_id"), F.coalesce("off", F.lit(False)).alias("subtitles_off"))
    out = set_columns(films, "id", fresh, ["chosen_track_id", "subtitles_off"])
    return out.join(asked.where("refused").select("id", "refused"), "id", "left").withColumn("refused", F.coalesce("refused", F.lit(False)))


def added(rows: DataFrame, fresh: DataFrame, unique: str) -> DataFrame:
    """INSERT OR IGNORE: fresh rows whose unique column is new, after rows; of several the first by their ids."""
    order = F.struct(F.lit(1).alias("late"), F.col("id"))
    both = rows.withColumn("_o", F.struct(F.lit(0).alias("late"), F.col("id"))).unionByName(fresh.withColumn("_o", order))
    w = Window.partitionBy(unique).orderBy("_o")
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_o")


def numbered_ids(stored: DataFrame, fresh: DataFrame, natural: Sequence[str], buckets: int = 1024) -> DataFrame:
    """fresh with ids: those of stored rows of equal natural keys; new keys are numbered on from the greatest id, in the same way each time.

    Keys are numbered within hash buckets, and the buckets' counts added up before them: no task sorts all keys.
    """
    rest = [c for c in fresh.columns if c != "id"]
    keyed = fresh.select(rest).join(stored.select("id", *natural), list(natural), "left")
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("_top"))  # one row
    new = keyed.where("id IS NULL").select(*natural).distinct().withColumn("_b", F.pmod(F.xxhash64(*natural), F.lit(buckets)))
    sizes = new.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each bucket
    k = F.row_number().over(Window.partitionBy("_b").orderBy(*natural))
    made = new.withColumn("_k", k).join(F.broadcast(before), "_b").crossJoin(F.broadcast(top)).select(*natural, (F.col("_top") + F.col("_before") + F.col("_k")).alias("_new"))
    return keyed.join(made, list(natural), "left").select(F.coalesce("id", "_new").alias("id"), *rest)


def described(films: DataFrame, audio: DataFrame, facts: DataFrame, streams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(films, audio) after facts (id, container, video_codec, ..., duration_ms) and streams (film_id, stream_number, ...) of the same films.

    A known duration isn't overwritten by an unknown one; the audio of all films of facts is replaced, by nothing where they have none.
    """
    columns = [c for c in ("container", "video_codec", "video_width", "video_height", "bit_depth", "frame_rate") if c in facts.columns]
    new = set_columns(films, "id", facts, columns, ["duration_ms"])
    kept = without(audio, facts.select(F.col("id").alias("film_id")), "film_id", "film_id")
    return new, kept.unionByName(streams.join(facts.select(F.col("id").alias("film_id")).distinct(), "film_id", "left_semi").select(audio.columns))


def _by_hand_kept(tracks: DataFrame, found: DataFrame) -> DataFrame:
    """found tracks, where a stored one of the same file and stream was paired by hand, with its film and match kind."""
    hand = tracks.where("match_kind = 'by-hand'").select("path", "stream_number", F.col("film_id").alias("_film"))
    both = found.join(hand, ["path", "stream_number"], "left")
    return both.withColumns({"match_kind": F.when(F.col("_film").isNotNull(), "by-hand").otherwise(F.col("match_kind")), "film_id": F.coalesce("_film", "film_id")}).select(found.columns)


def with_streams(tracks: DataFrame, cues: DataFrame, films: DataFrame, found: DataFrame, found_cues: DataFrame, opened: DataFrame, now: Column | int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tracks, cues, films) after films (opened: film_id) were looked inside.

    found: their tracks (id set, origin stream), found_cues: the cues of these. Tracks inside a film that it no longer has go,
    cues are replaced whether or not the track changed, and the films are stamped; a choice of a track that went is none. Files beside a
    film aren't touched.
    """
    inside_ = tracks.where("origin = 'stream'").join(opened.select("film_id").distinct(), "film_id", "left_semi")
    gone = inside_.join(found.select("path", "stream_number"), ["path", "stream_number"], "left_anti").select("id")
    stayed = without(tracks, gone, "id", "id")
    columns = [c for c in tracks.columns if c not in ("id", "path", "stream_number", "offset_ms", "rate")]
    new_tracks = upserted(stayed, _by_hand_kept(stayed, found.select(tracks.columns)), ["path", "stream_number"], columns).drop("changed")
    left = without(cues, gone, "track_id", "id")
    fresh = without(left, found, "track_id", "id").unionByName(found_cues.select(cues.columns))
    stamp = F.lit(now) if isinstance(now, int) else now
    seen = opened.select(F.col("film_id").alias("id"), F.lit(True).alias("_seen")).distinct()
    stamped = films.join(seen, "id", "left").withColumn("probed_at", F.when(F.col("_seen"), stamp).otherwise(F.col("probed_at"))).select(films.columns)
    if "chosen_track_id" in films.columns:
        stamped = nulled(stamped, gone, "chosen_track_id", "id")
    return new_tracks, fresh, stamped


def written_tracks(tracks: DataFrame, cues: DataFrame, found: DataFrame, found_cues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tracks with changed, cues): the track/cue sink: tracks upserted by (path, stream_number), the cues of all of them replaced. What was paired by hand stays with its film."""
    columns = [c for c in tracks.columns if c not in ("id", "path", "stream_number", "offset_ms", "rate")]
    return upserted(tracks, _by_hand_kept(tracks, found.select(tracks.columns)), ["path", "stream_number"], columns), without(cues, found, "track_id", "id").unionByName(found_cues.select(cues.columns))


def packed(tracks: DataFrame, most_tracks: int = PACK_TRACKS, most_cues: int = PACK_CUES) -> DataFrame:
    """tracks (id, cue_count) with ``pack``: which commit each belongs to, in order of ids and the same whenever it is worked out.

    A pack has ``most_tracks`` tracks at most, and a track isn't put to a pack that has ``most_cues`` cues already. By sums of what comes before a
    track: each step of either sum over a limit begins a pack, so numbers rise and may leave some out.
    """
    sums = {"_tracks": F.lit(1), "_cues": F.coalesce("cue_count", F.lit(0))}
    return series.running(tracks, [], ["id"], 1 << 16, sums).withColumn("pack", (F.floor(F.col("_tracks") / most_tracks) + F.floor(F.col("_cues") / most_cues)).cast("long")).drop("_tracks", "_cues")


def attached(tracks: DataFrame, cues: DataFrame, films: DataFrame, film_id: int, track: DataFrame, track_cues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tracks, cues) after a subtitle file was given to a film by hand. track: one row with an id, track_cues its cues.

    Only .srt files, only to films there are: else Refused.
    """
    row = track.select("path").first()
    if row is None or not row.path.lower().endswith(".srt"):
        raise Refused("only .srt files can be attached")
    if films.where(F.col("id") == film_id).isEmpty():
        raise Refused(f"no film {film_id}")
    own = track.withColumns({"film_id": F.lit(film_id).cast("long"), "match_kind": F.lit("by-hand"), "origin": F.lit("sidecar"), "stream_number": F.lit(0).cast("long")})
    now, fresh = written_tracks(pointed(tracks, own.select("id", "film_id")), cues, own, track_cues)
    return now.drop("changed"), fresh


def saved_positions(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """positions after fresh (film_id, position_ms, duration_ms, finished, updated_at): the latest of each film, a known duration kept, nothing under LEAST_POSITION_MS; with ``changed``."""
    worth = fresh.where(F.col("position_ms") >= LEAST_POSITION_MS)
    w = Window.partitionBy("film_id").orderBy(F.desc("updated_at"), F.desc("position_ms"))
    last = worth.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return upserted(stored, last, ["film_id"], ["position_ms", "finished", "updated_at"], ["duration_ms"])


def saved_preferences(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """preferences after fresh (key, value); a null value forgets the key. With ``changed``."""
    forgotten = fresh.where("value IS NULL")
    return upserted(without(stored, forgotten, "key", "key"), fresh.where("value IS NOT NULL"), ["key"], ["value"])


def known_settings(stored: DataFrame, known: DataFrame, dead: Sequence[str] = ()) -> DataFrame:
    """(key, value, source): known settings (key, default) with what is stored; keys that are no more are passed over."""
    live = stored.where(~F.col("key").isin(*dead)) if dead else stored
    return known.join(live, "key", "left").select("key", F.coalesce("value", "default").alias("value"), F.when(F.col("value").isNull(), "default").otherwise("stored").alias("source"))


__all__ = ["Refused", "added", "attached", "chosen_tracks", "described", "known_settings", "numbered_ids", "pointed", "replaced", "saved_positions", "saved_preferences", "set_columns", "set_covers", "with_corrections", "with_streams", "written_tracks"]
