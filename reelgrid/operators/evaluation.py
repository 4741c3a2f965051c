"""A corpus of spoilt subtitles with known answers: made from true ones, corrected, judged and tallied.

Cases are made by joining true cues with a literal table of ways to spoil them, so a corpus of any size is one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.functions.timing import MAX_MS, RATES, corrected
from reelgrid.operators import series
from reelgrid.operators.catalogue import FEWEST_CUES

# Fixed values.
OFFSETS_MS = (-60_000, -10_000, -2_000, -500, 500, 2_000, 10_000, 60_000)
BOTH = ((1, 2_500), (2, -4_000))
SPLICE_MS, SPLICE_AT, RECUT_MS, RECUT_AT = 90_000, 0.4, 240_000, 0.6
SHIFT_SLACK_MS, STRETCH_SLACK_MS, TRUTH_LANDS = 50, 100, 0.5
THRESHOLDS = (0.02, 0.05, 0.10, 0.20, 0.30, 0.45, 0.60)


def ways() -> list[tuple[int, str, float, float, int | None]]:
    """(way, family, offset, rate, slack): a shown time is (t - offset) / rate; no slack means that the case must be refused."""
    found = [("shift", float(o), 1.0, SHIFT_SLACK_MS) for o in OFFSETS_MS]
    found += [("stretch", 0.0, r, STRETCH_SLACK_MS) for r in RATES]
    found += [("both", float(o), RATES[k], STRETCH_SLACK_MS) for k, o in BOTH]
    found += [("splice", 0.0, 1.0, None), ("recut", 0.0, 1.0, None)]
    return [(i, *w) for i, w in enumerate(found)]


def cases(truth: DataFrame) -> DataFrame:
    """(film, way, family, slack, ordinal, start_ms, end_ms, belongs_ms, text): every true cue (film, ordinal, start_ms, end_ms, text) under every way.

    Cues that would begin or end before the film aren't part of a case. A splice takes 90 s out before what follows 40 % of the
    film, a recut leaves 240 s from 60 % on out; films too short for one have no such case.
    """
    spark = truth.sparkSession
    table = F.broadcast(spark.createDataFrame(ways(), "way int, family string, offset double, rate double, slack int"))
    last = truth.groupBy("film").agg(F.max("end_ms").alias("last"))
    rows = truth.join(last, "film").crossJoin(table)  # 18 ways, a literal table
    splice, recut = F.floor(F.col("last") * SPLICE_AT), F.floor(F.col("last") * RECUT_AT)
    long_enough = F.when(F.col("family") == "splice", splice > SPLICE_MS).when(F.col("family") == "recut", F.col("last") >= recut + 2 * RECUT_MS).otherwise(True)
    dropped = (F.col("family") == "recut") & (F.col("start_ms") >= recut) & (F.col("start_ms") < recut + RECUT_MS)

    def put(t: Column) -> Column:
        moved = F.round((t - F.col("offset")) / F.col("rate")).cast("long")
        moved = F.when(F.col("family") == "splice", F.when(t < splice, t).otherwise(t - SPLICE_MS)).when(F.col("family") == "recut", F.when(t < recut, t).otherwise(t - RECUT_MS)).otherwise(moved)
        return F.when((moved >= 0) & (moved <= MAX_MS), moved).cast("long")

    out = rows.where(long_enough & ~dropped).select("film", "way", "family", "slack", "ordinal", put(F.col("start_ms")).alias("put"), put(F.col("end_ms")).alias("put_end"), F.col("start_ms").cast("long").alias("belongs_ms"), "text")
    return out.where("put IS NOT NULL AND put_end IS NOT NULL").select("film", "way", "family", "slack", "ordinal", F.col("put").alias("start_ms"), F.greatest("put", "put_end").alias("end_ms"), "belongs_ms", "text")


def mismatched(truth: DataFrame, against: int = 2) -> DataFrame:
    """(film, of_film, way, family, slack, ordinal, start_ms, end_ms, belongs_ms, text): each film's true cues as if they were another's, of the ``against`` films
    that follow it in a hashed order, round in a circle. Any correction of these is wrong.

    The order is by ranks, joined with ranks a step away: a film meets ``against`` others, not all of them.
    """
    films = truth.select("film").distinct().withColumn("_h", F.conv(F.substring(F.md5(F.col("film").cast("string").cast("binary")), 1, 15), 16, 10).cast("long"))
    ranked = series.placed(films, [], ["_h", "film"], 1 << 50)  # 1,024 stretches of hashes
    n = films.agg(F.count("*").alias("_n"))  # one row
    steps = ranked.crossJoin(F.broadcast(n)).select(F.col("film").alias("of_film"), "place", "_n", F.explode(F.sequence(F.lit(1), F.lit(against))).alias("_j"))
    others = ranked.select(F.col("film"), F.col("place").alias("_place"))
    pairs = steps.join(others, F.col("_place") == (F.col("place") + F.col("_j")) % F.col("_n")).where(F.col("film") != F.col("of_film"))
    first = len(ways())
    pairs = pairs.select("film", "of_film", (first - 1 + F.col("_j")).cast("int").alias("way"), F.lit("mismatched").alias("family"), F.lit(None).cast("int").alias("slack")).dropDuplicates(["film", "of_film"])
    lines = truth.select(F.col("film").alias("of_film"), "ordinal", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), F.lit(None).cast("long").alias("belongs_ms"), "text")
    return pairs.join(lines, "of_film").select("film", "of_film", "way", "family", "slack", "ordinal", "start_ms", "end_ms", "belongs_ms", "text")


def worst_errors(made: DataFrame, corrections: DataFrame) -> DataFrame:
    """(film, way, worst_ms): the furthest that a correction (film, way, offset_ms, rate) puts a line of a case from where it belongs."""
    both = made.join(corrections.hint("shuffle_hash"), ["film", "way"])  # a row for each case, so its many lines aren't sorted
    away = F.abs(corrected(F.col("start_ms"), F.col("offset_ms"), F.col("rate")) - F.col("belongs_ms"))
    return both.groupBy("film", "way").agg(F.max(away).alias("worst_ms"))


def outcome(score: Column, misfit: Column, examined: Column, before: Column, after: Column, threshold: Column, bar: float) -> Column:
    """uncertain, the misfit's own name, no-better or accepted: the order of the tests matters."""
    worse = (examined == 0) | (after < before) | (after < bar)
    return F.when(score < threshold, "uncertain").when(misfit.isNotNull(), misfit).when(worse, "no-better").otherwise("accepted")


def verdict(said: Column, slack: Column, worst_ms: Column) -> Column:
    """right, wrong or missed."""
    good = F.coalesce(worst_ms <= slack, F.lit(False))
    return F.when(said == "accepted", F.when(slack.isNotNull() & good, "right").otherwise("wrong")).when(slack.isNotNull(), "missed").otherwise("right")


def sweep(judged: DataFrame, bar: float, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(threshold, right_n, wrong_n, missed_n) over judged cases (score, misfit, examined, before, after, slack, worst_ms)."""
    at = judged.withColumn("threshold", F.explode(F.array(*(F.lit(t) for t in thresholds))))
    said = outcome(*(F.col(c) for c in ("score", "misfit", "examined", "before", "after", "threshold")), bar)
    v = at.select("threshold", verdict(said, F.col("slack"), F.col("worst_ms")).alias("v"))
    return v.groupBy("threshold").agg(*(F.count_if(F.col("v") == k).alias(f"{k}_n") for k in ("right", "wrong", "missed")))


def true_tracks(tracks: DataFrame, landed: DataFrame) -> DataFrame:
    """(film, track_id): a film's truth is its text track with most cues, FEWEST_CUES or more, that lands on its speech as it is written (landed: track_id, fraction)."""
    worth = tracks.where(F.col("cue_count") >= FEWEST_CUES).join(landed.where(F.col("fraction") >= TRUTH_LANDS), F.col("id") == F.col("track_id"))
    return worth.groupBy(F.col("film_id").alias("film")).agg(F.max(F.struct("cue_count", (-F.col("id")).alias("back"), "id")).alias("b")).select("film", F.col("b.id").alias("track_id"))


def distinct_rates() -> list[float]:
    """The rates that are tried, each once."""
    return [r for i, r in enumerate(RATES) if all(abs(r - q) > 1e-6 for q in RATES[:i])]
