"""Interval and event operators: as-of joins, stabbing, islands, rolling counts, profiles.

Each takes ``by``, the columns that part independent series (films, users). A series without partition columns is one
series: windows over it would sort it in one task, so ``by`` should name enough series, or the *bucketed* forms be used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.operators import series


#: Milliseconds of a chunk of an as-of join, unless its caller says otherwise.
CHUNK_MS = 6 * 3_600_000


def nearest(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, right_at: str, width: int | None = CHUNK_MS) -> DataFrame:
    """left with ``previous`` (the last right_at <= at) and ``following`` (the first right_at >= at), null where there is none.

    In chunks of ``width`` of a series' time; None for series that are short by themselves.
    """
    if width is not None:
        return series.nearest(left, right, by, at, right_at, width)
    l = left.select(F.struct(*left.columns).alias("row"), *by, F.col(at).alias("t"), F.lit(None).cast(right.schema[right_at].dataType).alias("hit"))
    r = right.select(F.lit(None).cast(l.schema["row"].dataType).alias("row"), *by, F.col(right_at).alias("t"), F.col(right_at).alias("hit"))
    both = l.unionByName(r).withColumns({"previous": F.max("hit").over(series.upto(by, "t")), "following": F.min("hit").over(series.upto(by, "t", True))})
    return both.where("row IS NOT NULL").select("row.*", "previous", "following")


def nearest_distance(at: Column, previous: Column, following: Column) -> Column:
    return F.least(at - previous, following - at)


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str = "ordinal") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def active_at(points: DataFrame, intervals: DataFrame, by: Sequence[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """points joined with the interval on at that moment (start <= at < end): of several the latest started, then the latest ended.

    Intervals are dealt to buckets of ``width``, so only those near a point meet it; a hot bucket is split by AQE.
    """
    spans = intervals.where(F.col(end) > F.col(start)).select(*by, F.struct(start, end).alias("span"), F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))).alias("bucket"))
    moments = points.select(*by, F.col(at).alias("_at")).distinct().withColumn("bucket", F.floor(F.col("_at") / width))
    on = (F.col(f"span.{start}") <= F.col("_at")) & (F.col("_at") < F.col(f"span.{end}"))
    best = moments.join(spans, [*by, "bucket"]).where(on).groupBy(*by, "_at").agg(F.max("span").alias("_span"))
    met = points.withColumn("_at", F.col(at)).join(best, [*by, "_at"], "left")  # every point, repeats too
    return met.select(*points.columns, F.col(f"_span.{start}").alias(start), F.col(f"_span.{end}").alias(end))


def running_end(intervals: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """With latest_end, the latest end so far in order of starts."""
    w = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    return intervals.withColumn("latest_end", F.max(end).over(w))


def islands(events: DataFrame, by: Sequence[str], at: str, gap: int, least: int = 0) -> DataFrame:
    """Runs of events at most ``gap`` apart: (by, island_start, island_end, n); runs shorter than ``least`` go after merging."""
    w = Window.partitionBy(*by).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(w) <= gap, 0).otherwise(1)
    marked = events.select(*by, at, new.alias("new")).withColumn("island", F.sum("new").over(w))
    runs = marked.groupBy(*by, "island").agg(F.min(at).alias("island_start"), F.max(at).alias("island_end"), F.count("*").alias("n"))
    return runs.where(F.col("island_end") - F.col("island_start") >= least).drop("island")


def merged_runs(runs: DataFrame, by: Sequence[str], start: str, end: str, gap: int, least: int) -> DataFrame:
    """Half-open runs merged where the gap between them is below ``gap``; then those shorter than ``least`` go."""
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("_new", F.when(F.col(start) - before < gap, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    out = marked.groupBy(*by, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")
    return out.where(F.col(end) - F.col(start) >= least)


def rising_edges(bins: DataFrame, by: Sequence[str], bin: str, active: str) -> DataFrame:
    """Bins that are active where the one before isn't, the first included."""
    w = Window.partitionBy(*by).orderBy(bin)
    before = F.when(F.lag(bin).over(w) == F.col(bin) - 1, F.lag(active).over(w)).otherwise(False)
    return bins.withColumn("_before", before).where(F.col(active) & ~F.coalesce("_before", F.lit(False))).drop("_before")


def rolling_count(events: DataFrame, by: Sequence[str], at: str, width: int) -> DataFrame:
    """With n, the events from each one to ``width`` later, that moment left out."""
    order = Window.partitionBy(*by).orderBy(at) if by else Window.orderBy(at)
    return events.withColumn("n", F.count("*").over(order.rangeBetween(0, width - 1)))


def busiest(events: DataFrame, at: str, width: int) -> DataFrame:
    """(at, n): the event with most events in the ``width`` from it on, the earliest among equals.

    Without a sort in one task: moments are dealt to overlapping buckets of ``width`` as candidates, as neighbours and as the ends of candidates' windows.
    A window's count is the running sum at its end less what came before it, so a bucket costs its rows, however dense; each bucket's best is kept
    before the last comparison.
    """
    bucket = F.floor(F.col(at) / width)
    kind = lambda b, t, add, sign: F.struct(b.alias("b"), t.alias("t"), add.alias("add"), F.lit(sign).alias("sign"))
    ways = F.array(kind(bucket, F.col(at), F.col("same"), -1), kind(bucket - 1, F.col(at), F.col("same"), 0), kind(bucket, F.col(at) + (width - 1), F.lit(0).cast("long"), 1))
    dealt = events.groupBy(at).agg(F.count("*").alias("same")).select(at, F.inline(ways))
    summed = dealt.withColumn("upto", F.sum("add").over(series.upto(["b"], "t"))).where("sign <> 0")
    counted = summed.groupBy("b", at).agg(F.sum(F.col("sign") * F.col("upto") + F.col("add")).alias("n"))
    best = counted.groupBy("b").agg(F.max(F.struct(F.col("n"), (-F.col(at)).alias("back"))).alias("best"))
    return best.agg(F.max("best").alias("best")).where("best IS NOT NULL").select((-F.col("best.back")).alias(at), F.col("best.n").alias("n"))


def activity_profile(spans: DataFrame, by: Sequence[str], start: str, end: str, duration: str, buckets: int = 320) -> DataFrame:
    """(by, bucket, overlap, share): how much of each of ``buckets`` equal parts of the duration is covered, over the most covered one."""
    width = F.col(duration) / buckets
    inside = spans.where((F.col(duration) > 0) & (F.col(end) > F.col(start)) & (F.col(start) < F.col(duration)))
    last = F.least(F.lit(buckets - 1), F.floor(F.col(end) / width))
    each = inside.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(start) / width), last)))
    part = F.greatest(F.lit(0.0), F.least(F.col(end).cast("double"), (F.col("bucket") + 1) * width) - F.greatest(F.col(start).cast("double"), F.col("bucket") * width))
    sums = each.groupBy(*by, "bucket").agg(F.sum(part).alias("overlap"))
    most = F.max("overlap").over(Window.partitionBy(*by))
    return sums.withColumn("share", F.when(most > 0, F.col("overlap") / most))


def comfortable(cues: DataFrame, by: Sequence[str], start: str, end: str, shift: int = 0, lead_in: int = 0, least: int = 0) -> DataFrame:
    """Cues moved by ``shift``, begun ``lead_in`` early where the one before has ended, and held ``least`` where the next allows it."""
    w = Window.partitionBy(*by).orderBy(start, end)
    s, e = F.col(start) + shift, F.col(end) + shift
    early = F.greatest(s - lead_in, F.least(F.coalesce(F.lag(end).over(w) + shift, F.lit(0)), s), F.lit(0))
    late = F.greatest(e, F.least(s + least, F.coalesce(F.lead(start).over(w) + shift, s + least)))
    return cues.withColumns({"shown_from": early.cast("long"), "shown_to": late.cast("long")})
