"""New versions of tables: upserts that say what changed, soft deletes, cascades, plans of an incremental scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def differs(a: Column, b: Column) -> Column:
    """Null-safe inequality."""
    return ~a.eqNullSafe(b)


def upserted(stored: DataFrame, fresh: DataFrame, keys: Sequence[str], update: Sequence[str], keep_known: Sequence[str] = ()) -> DataFrame:
    """stored after fresh: rows matched by keys take the ``update`` columns, and those of ``keep_known`` where fresh has them.

    Returns stored's columns and ``changed``: whether a row was inserted, or one of its columns really took another value.
    Columns that fresh lacks are null in new rows.
    """
    s, f = stored.withColumn("_s", F.lit(True)).alias("s"), fresh.withColumn("_f", F.lit(True)).alias("f")
    both = s.join(f, [F.col(f"s.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys], "full_outer")
    new, hit = F.col("s._s").isNull(), F.col("f._f").isNotNull()
    out, changed = [], new
    for c in stored.columns:
        old = F.col(f"s.{c}")
        if c in keys:
            out.append(F.coalesce(old, F.col(f"f.{c}")).alias(c))
        elif c in update or c in keep_known:
            to = F.coalesce(F.col(f"f.{c}"), old) if c in keep_known else F.col(f"f.{c}")
            out.append(F.when(hit, to).otherwise(old).alias(c))
            changed = changed | (hit & differs(to, old))
        else:
            out.append((F.when(new, F.col(f"f.{c}")).otherwise(old) if c in fresh.columns else old).alias(c))
    return both.select(*out, changed.alias("changed"))


def marked_missing(stored: DataFrame, present: DataFrame, key: str, now: int | Column, stamp: str = "missing_since") -> DataFrame:
    """stored with a stamp on the rows that are no longer present; those that have one keep it."""
    here = present.select(key).distinct().withColumn("_here", F.lit(True))
    time = F.lit(now) if isinstance(now, int) else now
    return stored.join(here, key, "left").withColumn(stamp, F.when(F.col("_here").isNull() & F.col(stamp).isNull(), time).otherwise(F.col(stamp))).drop("_here")


def without(rows: DataFrame, gone: DataFrame, column: str, gone_column: str) -> DataFrame:
    """A delete, or one step of a cascade: rows whose column isn't among those gone."""
    return rows.join(gone.select(F.col(gone_column).alias(column)).distinct(), column, "left_anti").select(rows.columns)


def nulled(rows: DataFrame, gone: DataFrame, column: str, gone_column: str) -> DataFrame:
    """ON DELETE SET NULL."""
    ids = gone.select(F.col(gone_column).alias("_gone")).distinct()
    return rows.join(ids, F.col(column) == F.col("_gone"), "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(rows.columns)


def cascade(tables: dict[str, DataFrame], gone_films: DataFrame) -> dict[str, DataFrame]:
    """The library's tables without some films (film_id): their tracks, cues, positions and audio go, and choices of gone tracks."""
    out = dict(tables)
    tracks = tables["subtitle_track"].join(gone_films, "film_id", "left_semi").select(F.col("id").alias("track_id"))
    out["cue"] = without(tables["cue"], tracks, "track_id", "track_id")
    for name in ("subtitle_track", "playback_position", "audio_stream"):
        out[name] = without(tables[name], gone_films, "film_id", "film_id")
    out["film"] = nulled(without(tables["film"], gone_films, "id", "film_id"), tracks, "chosen_track_id", "track_id")
    return out


def replaced(rows: DataFrame, fresh: DataFrame, scope: str) -> DataFrame:
    """rows with those of fresh in place of all that share its scope."""
    return without(rows, fresh, scope, scope).unionByName(fresh)


def plan(stored: DataFrame, found: DataFrame, key: str = "path", gone_by_hand: DataFrame | None = None) -> DataFrame:
    """(key, action) of an incremental scan: read (new, or other bytes), repoint (same bytes, other film or match), remove, or keep.

    stored: key, size_bytes, modified_at, film_id, match_kind; found the same for what is on disk now. Hand-made pairs are never repointed, and
    as their files may lie elsewhere, they are removed only if gone_by_hand (key) says that they are gone.
    """
    s, f = stored.alias("s"), found.alias("f")
    both = s.join(f, key, "full_outer")
    same = F.col("s.size_bytes").eqNullSafe(F.col("f.size_bytes")) & F.col("s.modified_at").eqNullSafe(F.col("f.modified_at"))
    by_hand = F.coalesce(F.col("s.match_kind") == "by-hand", F.lit(False))
    moved = ~by_hand & (differs(F.col("s.film_id"), F.col("f.film_id")) | differs(F.col("s.match_kind"), F.col("f.match_kind")))
    action = (
        F.when(F.col("s.size_bytes").isNull(), "read").when(F.col("f.size_bytes").isNull(), F.when(by_hand, "keep").otherwise("remove"))
        .when(~same, "read").when(moved, "repoint").otherwise("keep")
    )
    done = both.select(key, action.alias("action"))
    if gone_by_hand is None:
        return done
    gone = gone_by_hand.select(key).distinct().withColumn("_gone", F.lit(True))
    return done.join(gone, key, "left").select(key, F.when(F.coalesce("_gone", F.lit(False)) & (F.col("action") == "keep"), "remove").otherwise(F.col("action")).alias("action"))


def film_jobs(found: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, job): whole for changed or never probed films, header for those never described; others aren't listed."""
    s = stored.alias("s")
    same = (F.col("f.size_bytes") == F.col("s.size_bytes")) & (F.col("f.modified_at") == F.col("s.modified_at")) & F.col("s.missing_since").isNull()
    job = F.when(~F.coalesce(same, F.lit(False)) | F.col("s.probed_at").isNull(), "whole").when(F.col("s.container").isNull(), "header")
    return found.alias("f").join(s, "path", "left").select("path", job.alias("job")).where("job IS NOT NULL")


def repaired(tracks: DataFrame, pairs: DataFrame) -> DataFrame:
    """tracks (path, film_id, match_kind, offset_ms, rate) pointed at the films of pairs (path, film_id, match_kind).

    Hand-made pairs stay; a track that goes to another film forgets its correction.
    """
    p = pairs.select("path", F.col("film_id").alias("_film"), F.col("match_kind").alias("_match"))
    both = tracks.join(p, "path", "left")
    hit = F.col("_film").isNotNull() & (F.col("match_kind") != "by-hand")
    moved = hit & differs(F.col("_film"), F.col("film_id"))
    new = {"offset_ms": F.when(moved, 0).otherwise(F.col("offset_ms")), "rate": F.when(moved, 1.0).otherwise(F.col("rate")), "film_id": F.when(hit, F.col("_film")).otherwise(F.col("film_id")), "match_kind": F.when(hit, F.col("_match")).otherwise(F.col("match_kind"))}
    return both.withColumns(new).select(tracks.columns)
