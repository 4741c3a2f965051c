"""What to do about every track's timing, all tracks in one plan of two stages: other tracks first, then the film's sound.

A track is measured against another track of its film where there is one; what that doesn't settle is measured against the film's
speech. What is refused has a reason. Nothing comes to the driver: outcomes, corrections and landings are columns, and
one write stores all corrections.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.functions.timing import corrected
from reelgrid.operators import alignment, catalogue
from reelgrid.operators.alignment import BIN_MS, FEWEST_CUES, LANDING_BAR, LEAST_SCORE, REFERENCE_SCORE
from reelgrid.sources.shared import written

#: How an outcome was come by.
FOUND = ("offset_ms", "rate", "score", "misfit", "misfit_at_ms", "examined", "before", "after")
#: The columns of outcomes().
COLUMNS = ("track_id", "outcome", "against", "cue_count", *FOUND)
#: The names of misfits as outcomes.
MISFITS = {"Breaks": "breaks", "DifferentCut": "different-cut"}


def measured(lines: DataFrame, runs: DataFrame) -> DataFrame:
    """(track_id, FOUND): the correction of each track of lines (track_id, film, start_ms, end_ms, text) against runs (film, from_bin, to_bin, film_bins), and how it lands.

    before and after: the shares of lines that land as they are written and as corrected; examined: how many are near speech once corrected.
    """
    found = written(alignment.aligned(lines, runs), "found")
    both = lines.select("track_id", "film", "start_ms").join(found.select("track_id", "offset_ms", "rate"), "track_id")
    at = F.array(
        F.struct(F.lit("before").alias("way"), F.col("start_ms").cast("long").alias("at")), F.struct(F.lit("after").alias("way"), corrected(F.col("start_ms"), F.col("offset_ms"), F.col("rate")).alias("at"))
    )
    moved = both.select("track_id", "film", F.inline(at))
    starts = runs.select("film", (F.col("from_bin") * BIN_MS).alias("speech_at"))
    landed = alignment.landing(moved, starts, ["film"], "at", "speech_at", groups=["track_id", "way"])
    share = lambda way: F.max(F.when(F.col("way") == way, F.col("fraction")))
    shares = landed.groupBy("track_id").agg(share("before").alias("before"), share("after").alias("after"), F.max(F.when(F.col("way") == "after", F.col("examined"))).alias("examined"))
    return found.join(shares, "track_id", "left").select("track_id", *FOUND)


def worth_writing(before: Column, after: Column) -> Column:
    """Whether a correction lands well enough, and no worse than what is written; not if nothing was measured."""
    return F.coalesce((after >= F.coalesce(before, F.lit(0.0))) & (after >= LANDING_BAR), F.lit(False))


def settled(found: DataFrame) -> DataFrame:
    """Measurements against other tracks that settle the matter: sure, of one piece and worth writing."""
    return found.where((F.col("score") >= REFERENCE_SCORE) & F.col("misfit").isNull() & worth_writing(F.col("before"), F.col("after")))


def said_of_sound(score: Column, misfit: Column, before: Column, after: Column) -> Column:
    """The outcome of a measurement against the film's speech; the order of the tests matters."""
    kinds = F.element_at(F.create_map(*(F.lit(x) for pair in MISFITS.items() for x in pair)), misfit)
    return F.when(F.coalesce(score, F.lit(0.0)) < LEAST_SCORE, "uncertain").when(misfit.isNotNull(), kinds).when(~worth_writing(before, after), "no-better").otherwise("aligned")


def outcomes(tracks: DataFrame, cues: DataFrame, listen: Callable[[DataFrame], tuple[DataFrame, DataFrame]], wanted: DataFrame | None = None) -> DataFrame:
    """COLUMNS for every track: aligned, too-few-cues, uncertain, breaks, different-cut, no-better, or why the film's sound couldn't be read.

    tracks and cues: the library's tables. listen: of films (film_id) that other tracks don't settle, (film_id, outcome), ok or a refusal, and the speech
    (film, from_bin, to_bin, film_bins) of those that are ok; a film without an outcome has no-audio. wanted: (track_id) of the tracks to decide, all if
    none are given. against: track or sound, null where nothing was measured.
    """
    asked = tracks if wanted is None else tracks.join(wanted.select(F.col("track_id").alias("id")), "id", "left_semi")
    wide = asked.withColumn("_few", F.col("cue_count") < FEWEST_CUES)
    few = wide.where("_few").select(F.col("id").alias("track_id"), F.lit("too-few-cues").alias("outcome"), F.lit(None).cast("string").alias("against"), "cue_count", *(F.lit(None).alias(c) for c in FOUND))
    enough = wide.where("NOT _few").select(F.col("id").alias("track_id"), "film_id", "cue_count")

    # against other tracks
    lines, runs = catalogue.against_references(cues, tracks, enough.select("track_id"))
    own = lines.join(enough.select("track_id"), "track_id", "left_semi")
    held = written(runs, "runs")
    done = written(settled(measured(written(own, "lines"), held)), "settled")
    first = enough.join(done, "track_id").select("track_id", F.lit("aligned").alias("outcome"), F.lit("track").alias("against"), "cue_count", *FOUND)

    # against the sound of their films
    unsettled = written(enough.join(done.select("track_id"), "track_id", "left_anti"), "unsettled")
    sound, speech = listen(unsettled.select("film_id").distinct())
    rest = written(unsettled.join(sound.select("film_id", F.col("outcome").alias("heard")), "film_id", "left"), "rest")
    silent = rest.where("NOT heard <=> 'ok'").select("track_id", F.coalesce("heard", F.lit("no-audio")).alias("outcome"), F.lit(None).cast("string").alias("against"), "cue_count", *(F.lit(None).alias(c) for c in FOUND))
    heard = rest.where("heard = 'ok'")
    lines = catalogue.cues(cues, tracks, authored=True).join(heard.select("track_id", F.col("film_id").alias("film")), "track_id").select("track_id", "film", "start_ms", "end_ms", "text")
    found = heard.select("track_id", "cue_count").join(measured(written(lines, "heard"), speech), "track_id", "left")
    second = found.select("track_id", said_of_sound(F.col("score"), F.col("misfit"), F.col("before"), F.col("after")).alias("outcome"), F.lit("sound").alias("against"), "cue_count", *FOUND)
    kinds = {f.name: f.dataType for f in second.schema.fields}
    same = lambda rows: rows.select(*(F.col(c).cast(kinds[c]).alias(c) for c in COLUMNS))
    return same(few).unionByName(same(first)).unionByName(same(silent)).unionByName(same(second))


def corrections(decided: DataFrame) -> DataFrame:
    """(id, offset_ms, rate) of the tracks that outcomes() aligned."""
    return decided.where("outcome = 'aligned'").select(F.col("track_id").alias("id"), "offset_ms", "rate")
