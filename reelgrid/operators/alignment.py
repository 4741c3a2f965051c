"""Where dialogue lies against speech: levels to speech, correlation, a robust line through chunks, landing, misfit, and the decision.

Levels, speech, landing and decisions are relational, over (film, bin) or (track, line) rows. Only the search for a
correction needs a film's whole signal at once, as runs: a grouped map by film and track, each group a film's runs and a track's lines.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from reelgrid.functions.text import spoken
from reelgrid.functions.timing import FURTHEST_MS, RATE_TOLERANCE, RATES, DRIFT_MS, corrected
from reelgrid.operators import intervals, series
from reelgrid.operators.correlation import Signal, clipped, part_correlations, peaks, tiled, united

# Fixed values.
BIN_MS, MAX_BINS = 10, 4_320_000
LEAD_MS, LATE_MS, REACH_MS = 700, 250, 2000
TILE_BINS, FLOOR_SHARE, MARGIN_DB, SWING_DB, GAP_BINS, RUN_BINS = 6000, 0.15, 6.0, 2.5, 30, 20
SLOW_BINS, FAST_BINS, DEPTH_BINS = 51, 5, 25
COARSE_BINS, LOCAL_BINS, SHOULDER_BINS, CARRIED = 12_000, 1_000, 100, 6
CHUNKS, SHORTEST_BINS, LONGEST_BINS = 24, 6_000, 30_000
AGREE_MS, APART_MS, FAR_MS, STEP_MS = 150.0, 250.0, 2000.0, 1000.0
# Bins of a stretch, so that an Arrow batch of their pairs stays small, and sums over lags that are held at once.
STRETCH, HELD = 1 << 12, 500
FEWEST_CUES, REFERENCE_SCORE, LEAST_SCORE, LANDING_BAR = 100, 0.80, 0.10, 0.58


# ---- levels to speech ------------------------------------------------------------------------------------------------


def levels(energy: DataFrame) -> DataFrame:
    """(film, bin, level): decibels of (film, bin, sum_sq, n) rows, which may be partial sums."""
    sums = energy.groupBy("film", "bin").agg(F.sum("sum_sq").alias("s"), F.sum("n").alias("n"))
    return sums.select("film", "bin", F.when(F.col("n") > 0, 10 * F.log10(F.col("s") / F.col("n") + 1e-12)).otherwise(-120.0).alias("level"))


def moving_mean(column: Column | str, width: int, by: list[str], order: str) -> Column:
    """The mean over a centred window, which shrinks at the ends."""
    return F.avg(column).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-(width // 2), width // 2))


def swing(rows: DataFrame, by: list[str], place: str, level: str, slow: int = SLOW_BINS, fast: int = FAST_BINS, depth: int = DEPTH_BINS) -> DataFrame:
    """rows with swing: how far the level moves about its slow mean. place: 0, 1, 2 and so on in each series (``series.placed``).

    A series is dealt to chunks of places with a halo as wide as the three windows reach: any length of series is many tasks.
    """
    dealt, keys = series.with_halo(rows, place, slow // 2 + fast // 2 + depth // 2), [*by, "chunk"]
    out = dealt.withColumn("_d", F.col(level) - moving_mean(level, slow, keys, place)).withColumn("_f", F.abs(moving_mean("_d", fast, keys, place)))
    return out.withColumn("swing", moving_mean("_f", depth, keys, place)).where("own").drop("_d", "_f", "chunk", "own")


def rolling_floor(rows: DataFrame, by: list[str], order: str, level: str, tile: int = TILE_BINS, share: float = FLOOR_SHARE) -> DataFrame:
    """rows with floor: each tile's low percentile (by index) stands at its middle; linear between, flat beyond the ends."""
    tiled = rows.withColumn("tile", F.floor(F.col(order) / tile))
    ranked = F.array_sort(F.collect_list(level))
    low = F.element_at(ranked, (F.floor((F.size(ranked) - 1) * share) + 1).cast("int"))
    marks = tiled.groupBy(*by, "tile").agg(low.alias("low"), ((F.min(order) + F.max(order) + 1) / 2.0).alias("mid"))
    w = Window.partitionBy(*by).orderBy("tile")
    marks = marks.withColumns({"low_b": F.lag("low").over(w), "mid_b": F.lag("mid").over(w), "low_a": F.lead("low").over(w), "mid_a": F.lead("mid").over(w)})
    at = F.col(order) + 0.5
    lerp = lambda x0, y0, x1, y1: y0 + (y1 - y0) * (at - x0) / (x1 - x0)
    floor = F.when(at < F.col("mid"), F.coalesce(lerp(F.col("mid_b"), F.col("low_b"), F.col("mid"), F.col("low")), F.col("low"))).otherwise(F.coalesce(lerp(F.col("mid"), F.col("low"), F.col("mid_a"), F.col("low_a")), F.col("low")))
    return tiled.join(marks, [*by, "tile"]).withColumn("floor", floor).drop("tile", "low", "mid", "low_b", "mid_b", "low_a", "mid_a")


def speech(found: DataFrame) -> DataFrame:
    """(film, from_bin, to_bin): half-open runs of speech in (film, bin, level)."""
    loud = swing(rolling_floor(found, ["film"], "bin", "level"), ["film"], "bin", "level").where((F.col("level") > F.col("floor") + MARGIN_DB) & (F.col("swing") > SWING_DB))
    runs = loud.select("film", F.col("bin").alias("from_bin"), (F.col("bin") + 1).alias("to_bin"))
    return intervals.merged_runs(runs, ["film"], "from_bin", "to_bin", GAP_BINS, RUN_BINS)


def cue_runs(cues: DataFrame, by: list[str], rate: Column | float = 1.0) -> DataFrame:
    """(by, from_bin, to_bin): bins in which somebody speaks; runs that touch or overlap are one. cues: by, start_ms, end_ms, text."""
    r = F.lit(rate) if isinstance(rate, float) else rate
    at = lambda c: F.least(F.lit(MAX_BINS), F.floor(F.col(c) * r / BIN_MS)).cast("long")
    runs = cues.where(spoken(F.col("text"))).select(*by, at("start_ms").alias("from_bin"), at("end_ms").alias("to_bin")).where("to_bin > from_bin")
    return intervals.merged_runs(runs, by, "from_bin", "to_bin", 1, 1)


# ---- landing ---------------------------------------------------------------------------------------------------------


def landing(lines: DataFrame, starts: DataFrame, by: list[str], at: str, start: str, lead: int = LEAD_MS, late: int = LATE_MS, reach: int = REACH_MS, groups: list[str] | None = None) -> DataFrame:
    """(groups, examined, landed, fraction, median_ms): how many lines begin near an utterance's start; groups: columns of lines, ``by`` if none are given.

    A line is examined if a start is within reach; it lands if a start follows within lead or came within late. The median is
    the upper one, of distances within reach: lines are counted by distance before they are shuffled, so a series has a row for
    each whole distance at most, and the median is read off the running count.
    """
    groups = groups or by
    near = intervals.nearest(lines, starts, by, at, start)
    before, after = F.col(at) - F.col("previous"), F.col("following") - F.col(at)
    away = F.least(before, after)
    seen = near.select(*groups, away.alias("_away"), (F.coalesce(after <= lead, F.lit(False)) | F.coalesce(before <= late, F.lit(False))).alias("_hit")).where(F.col("_away") <= reach)
    slots = seen.groupBy(*groups, "_away").agg(F.count("*").alias("_n"), F.count_if("_hit").alias("_landed"))
    w = Window.partitionBy(*groups)
    ranked = slots.withColumns({"_upto": F.sum("_n").over(w.orderBy("_away")), "_all": F.sum("_n").over(w)})
    middle = F.min(F.when(F.col("_upto") > F.floor(F.col("_all") / 2), F.col("_away")))
    out = ranked.groupBy(*groups).agg(F.sum("_n").alias("examined"), F.sum("_landed").alias("landed"), middle.alias("median_ms"))
    return out.withColumn("fraction", F.col("landed") / F.col("examined"))


# ---- correlation and lines, relational -------------------------------------------------------------------------------


def lag_products(a: DataFrame, b: DataFrame, by: list[str], bin: str, window: int | None = None, groups: list[str] | None = None) -> DataFrame:
    """(groups, lag, n): bins of b that are active ``lag`` after one of a, for every lag, or each within the window if there is one.

    Sparse signals: a row for each active bin. groups: columns of ``by`` that are kept, all of them if none are given; a sum over others is taken before
    the shuffle. Within a window bins meet by stretches as wide as it: a's in their own, b's in the two at most that they reach. Without one,
    each stretch of a meets each of b, as arrays, so a long signal is many pairs of stretches and a task holds a few of them, not a signal.
    Merged, as a broadcast would put a whole signal on the driver.
    """
    groups = by if groups is None else groups
    total = F.sum("n").cast("long").alias("n")
    if window is None:
        one, two = (_stretches(x, by, bin, name) for x, name in ((a, "_a"), (b, "_b")))
        met = one.join(two.hint("merge"), by) if by else one.crossJoin(two)
        dealt = met.repartition(*by, "_a_slot", "_b_slot").select(*groups, (F.col("_b_slot") - F.col("_a_slot")).alias("_apart"), "_a", "_b")
        kept = [dealt.schema[c] for c in groups]
        return dealt.mapInArrow(_counted_lags, StructType([*kept, StructField("lag", LongType()), StructField("n", LongType())])).groupBy(*groups, "lag").agg(total)
    wide = 2 * window + 1
    slot = lambda c: F.floor(c / wide)
    own = a.select(*by, F.col(bin).alias("_a"), slot(F.col(bin)).alias("_slot"))
    near = b.select(*by, F.col(bin).alias("_b"), F.explode(F.sequence(slot(F.col(bin) - window), slot(F.col(bin) + window))).alias("_slot"))
    lag = (F.col("_b") - F.col("_a")).alias("lag")
    return own.join(near.hint("merge"), [*by, "_slot"]).select(*groups, lag).where(F.col("lag").between(-window, window)).groupBy(*groups, "lag").agg(F.count("*").alias("n"))


def _stretches(signal: DataFrame, by: list[str], bin: str, name: str) -> DataFrame:
    """(by, slot, places): the active bins of each stretch that has some, as places from its beginning."""
    slot = F.floor(F.col(bin) / STRETCH)
    place = (F.col(bin) - slot * STRETCH).cast("int")
    return signal.where(F.col(bin).isNotNull()).groupBy(*by, slot.alias(f"{name}_slot")).agg(F.collect_list(place).alias(name))


def _lags(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many pairs of places lie each lag apart, from 1 - STRETCH to STRETCH - 1: by pairs if these are few, else by a transform (exact once rounded)."""
    if len(a) * len(b) <= 1 << 16:
        return np.bincount((b[None] - a[:, None] + (STRETCH - 1)).ravel(), minlength=2 * STRETCH - 1)
    one, two = (np.fft.rfft(np.bincount(x, minlength=STRETCH), 2 * STRETCH) for x in (a, b))
    return np.roll(np.rint(np.fft.irfft(one.conj() * two, 2 * STRETCH)).astype(np.int64), STRETCH - 1)[: 2 * STRETCH - 1]


def _counted_lags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(groups, lag, n) of rows (groups, _apart, _a, _b), summed over a few hundred groups and distances of stretches at a time."""
    held: dict[tuple, np.ndarray] = {}

    def summed() -> pa.RecordBatch:
        found = [np.flatnonzero(n) for n in held.values()]
        rows = pa.array(np.repeat(np.arange(len(held)), [len(i) for i in found]))
        lag = [i + 1 - STRETCH + key[-1] * STRETCH for key, i in zip(held, found, strict=True)]
        n = [n[i] for n, i in zip(held.values(), found, strict=True)]
        keys = [pa.array([key[i] for key in held], kind).take(rows) for i, kind in enumerate(kinds)]
        return pa.record_batch([*keys, pa.array(np.concatenate(lag)), pa.array(np.concatenate(n))], [*names, "lag", "n"])

    for batch in batches:
        names, kinds = batch.schema.names[:-3], batch.schema.types[:-3]
        keys = zip(*(batch.column(i).to_pylist() for i in range(len(names) + 1)), strict=True)
        for key, a, b in zip(keys, batch.column("_a"), batch.column("_b"), strict=True):
            n = _lags(*(x.values.to_numpy(zero_copy_only=False) for x in (a, b)))
            held[key] = held[key] + n if key in held else n
            if len(held) == HELD:
                yield summed()
                held = {}
    if held:
        yield summed()


def theil_sen(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, slope, intercept): lower medians of the slopes of all pairs of a series and of what is left; series are short (chunks of a film)."""
    p = points.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    one, two = p.alias("a"), p.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in by] + [F.col("a.x") < F.col("b.x")]
    slopes = one.join(two, on).select(*(F.col(f"a.{k}").alias(k) for k in by), ((F.col("b.y") - F.col("a.y")) / (F.col("b.x") - F.col("a.x"))).alias("s"))
    slope = slopes.groupBy(*by).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY s)").alias("slope"))
    rest = p.join(slope, by, "left") if by else p.crossJoin(F.broadcast(slope))  # one row
    rest = rest.withColumn("r", F.col("y") - F.coalesce("slope", F.lit(0.0)) * F.col("x"))
    return rest.groupBy(*by).agg(F.coalesce(F.first("slope"), F.lit(0.0)).alias("slope"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY r)").alias("intercept"))


# ---- the search for a correction, a track at a time ----------------------------------------------------------------------


def _lower_median(x: np.ndarray) -> float:
    return float(np.sort(x)[(len(x) - 1) // 2])


def _line(at: np.ndarray, left: np.ndarray) -> tuple[float, float]:
    if len(at) == 1:
        return 0.0, float(left[0])
    i, j = np.triu_indices(len(at), 1)
    slope = _lower_median((left[j] - left[i]) / (at[j] - at[i]))
    return slope, _lower_median(left - slope * at)


def _apply(t: float, offset: int, rate: float) -> float:
    return t if (offset, rate) == (0, 1.0) else min(max(math.floor(t * rate + offset + 0.5), 0), 4_294_967_295)


def _foretold(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of some readings lie on the line through the two before them."""
    out = np.zeros(len(y), bool)
    if len(y) > 2:
        slope = np.diff(y)[:-1] / np.diff(x)[:-1]
        out[2:] = np.abs(y[1:-1] + slope * (x[2:] - x[1:-1]) - y[2:]) <= AGREE_MS
    return out


def _misfit(said: list[float | None], at: np.ndarray) -> tuple[str, int] | None:
    """DifferentCut or Breaks and where, from each chunk's distance to the line: None is a quiet chunk, nan one without an answer.

    A reading holds if its neighbours on one side foretell it. If the film ends with enough chunks that neither hold nor are near
    the line, it is another cut. If the readings that hold nearest to a boundary are level on each side of it, but a step apart,
    it has breaks.
    """
    n, heard = len(said), np.array([s is not None for s in said], bool)
    y = np.array([math.nan if s is None else s for s in said], float)
    known = np.flatnonzero(~np.isnan(y))
    holds, good = np.zeros(n, bool), np.zeros(n, bool)
    x, z = np.asarray(at, float)[known], y[known]
    holds[known] = _foretold(x, z) | _foretold(x[::-1], z[::-1])[::-1]
    good[known] = np.abs(z) <= FAR_MS
    good |= holds
    fine = np.flatnonzero(heard & good)
    tail = np.flatnonzero(heard)
    tail = tail[tail > (fine[-1] if len(fine) else -1)]
    if len(tail) >= 3 and 5 * len(tail) >= n:
        return "DifferentCut", int((at[tail[0] - 1] + at[tail[0]]) / 2) if tail[0] else 0
    held = np.flatnonzero(holds)
    for k in range(2, len(held) - 1):  # boundaries before which and after which two readings hold
        before, after = held[:k][::-1][:4], held[k:][:4]
        levels = [_lower_median(y[near]) for near in (before, after)]
        spreads = [np.abs(y[near] - level) for near, level in zip((before, after), levels, strict=True)]
        if all(_lower_median(s) <= AGREE_MS and s[0] <= AGREE_MS for s in spreads) and abs(levels[1] - levels[0]) >= STEP_MS:
            return "Breaks", int((at[before[0]] + at[after[0]]) / 2)
    return None


def found_correction(starts: np.ndarray, ends: np.ndarray, film: Signal) -> dict:
    """The correction of a track of spoken lines (ms) against a film's speech, with its score and misfit."""
    none = {"offset_ms": 0, "rate": 1.0, "score": 0.0, "misfit": None, "misfit_at_ms": None}
    n = film.length
    if not n or not len(starts):
        return none

    def signal(rate: float) -> Signal:
        a, b = np.floor(starts * rate / BIN_MS).astype(np.int64), np.floor(ends * rate / BIN_MS).astype(np.int64)
        return united(a, b, min(MAX_BINS, int(b.max(initial=0))))

    lines = {r: signal(r) for i, r in enumerate(RATES) if all(abs(r - q) > 1e-6 for q in RATES[:i])}
    tried = sorted(((h, r, lag) for r, own in lines.items() for lag, h in peaks(film, own, COARSE_BINS, SHOULDER_BINS)), key=lambda x: -x[0])
    own = next((i for i, x in enumerate(tried) if x[1] == 1.0), None)
    if own is not None and own >= CARRIED:
        tried[CARRIED - 1], tried[own] = tried[own], tried[CARRIED - 1]
    size = min(n, max(SHORTEST_BINS, min(LONGEST_BINS, n // CHUNKS)))
    count, film_ms = max(1, n // size), float(n * BIN_MS)
    middles = np.array([(k * size + size // 2) * BIN_MS for k in range(count)], float)
    parts = tiled(film, 0, size, count)  # once for all rates and lags

    def local(track: Signal, lag: int) -> tuple[np.ndarray, np.ndarray]:
        """Each chunk's best lag and its height; a lag of the window's edge is none."""
        own = tiled(track, -lag, size, count)
        c = part_correlations(parts, own, LOCAL_BINS)
        best = c.argmax(1)
        found = np.where(parts.flat | own.flat, LOCAL_BINS, best - LOCAL_BINS)
        return found, c[np.arange(count), best]

    measured = []
    for _, rate, lag in tried[:CARRIED]:
        found, height = local(lines[rate], lag)
        ok = np.abs(found) < LOCAL_BINS
        if not ok.any():
            continue
        x, y = middles[ok], found[ok] * float(BIN_MS)
        slope, intercept = _line(x, y)
        away = np.abs(y - intercept - slope * x)
        score = float((away <= AGREE_MS).sum() / count * min(1.0, max(0.0, 1 - _lower_median(away) / AGREE_MS)))
        stretched, moved = rate * (1 + slope), lag * BIN_MS * (1 + slope) + intercept
        near = min(RATES, key=lambda r: abs(r - stretched))
        if abs(near - stretched) > RATE_TOLERANCE or abs(near - stretched) * film_ms > DRIFT_MS:
            continue
        settled = int((stretched - near) * ((film_ms / 2 - moved) / stretched) + moved)
        measured.append((score, max(-FURTHEST_MS, min(FURTHEST_MS, settled)), near, lag, lines[rate], slope, intercept, found, height))
    measured.sort(key=lambda m: -m[0])
    if not measured or measured[0][0] <= 0:
        return none
    score, offset, rate, lag, track, slope, intercept, found, height = measured[0]
    other = next((m for m in measured[1:] if any(abs(_apply(t, offset, rate) - _apply(t, m[1], m[2])) > APART_MS for t in (0, film_ms))), None)
    separation = 1.0 if other is None else min(1.0, max(0.0, (score - other[0]) / score))

    def wider(k: int) -> float:
        window = min(COARSE_BINS, size // 2)
        peak = peaks(clipped(film, k * size, size), clipped(track, k * size - lag, size), window, SHOULDER_BINS)
        return peak[0][0] * BIN_MS - (slope * middles[k] + intercept) if peak and abs(peak[0][0]) < window and peak[0][1] > 0 else math.nan

    away = np.where((np.abs(found) < LOCAL_BINS) & (height > 0), found * float(BIN_MS) - (slope * middles + intercept), math.nan)
    said = [None if quiet else float(d) for d, quiet in zip(away, parts.flat, strict=True)]
    for k in [k for k, s in enumerate(said) if s is not None and (math.isnan(s) or abs(s) > FAR_MS)]:
        said[k] = said[k] if math.isnan(wide := wider(k)) else wide
    kind, where = _misfit(said, middles) or (None, None)
    return {"offset_ms": offset, "rate": rate, "score": score * separation, "misfit": kind, "misfit_at_ms": where}


ALIGNED = "track_id long, offset_ms int, rate double, score double, misfit string, misfit_at_ms long"


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each group in batches that are sorted by keys; no more than a batch and a group are held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        with_last = pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), batch]) if held else batch
        changed = np.zeros(with_last.num_rows - 1, bool)
        for key in keys:
            column = with_last.column(key)
            a, b = column.slice(0, len(changed)), column.slice(1)
            other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null()))
            changed |= other.to_numpy(zero_copy_only=False)
        at = 0
        for end in (np.flatnonzero(changed) + (0 if held else 1)).tolist():
            yield pa.concat_batches([*held, batch.slice(at, end - at)])
            held, at = [], end
        held.append(batch.slice(at))
    if held:
        yield pa.concat_batches(held)


_FOUND = pa.schema([("track_id", pa.int64()), ("offset_ms", pa.int32()), ("rate", pa.float64()), ("score", pa.float64()), ("misfit", pa.string()), ("misfit_at_ms", pa.int64())])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of ALIGNED for each track of rows (film, track_id, film_bins, a, b) sorted by film and track: its lines, and with film_bins its film's runs. None without lines."""
    rows: list[dict] = []
    for group in _groups(batches, ["film", "track_id"]):
        bins, a, b = (group.column(c) for c in ("film_bins", "a", "b"))
        of_film, a, b = (x.to_numpy(zero_copy_only=False) for x in (bins.is_valid(), a, b))
        n = min(pc.max(bins).as_py() or 0, MAX_BINS)
        film = united(a[of_film].astype(np.int64), b[of_film].astype(np.int64), n)
        if of_film.all():
            continue
        rows.append({"track_id": group.column("track_id")[0].as_py(), **found_correction(a[~of_film], b[~of_film], film)})
        if len(rows) == 1000:
            yield pa.RecordBatch.from_pylist(rows, _FOUND)
            rows = []
    yield pa.RecordBatch.from_pylist(rows, _FOUND)


def aligned(cues: DataFrame, speech_runs: DataFrame) -> DataFrame:
    """ALIGNED for each track of cues (track_id, film, start_ms, end_ms, text) against speech_runs (film, from_bin, to_bin, film_bins).

    A map over rows dealt and sorted by film and track: a film's runs go to each of its tracks, so one film with many tracks is many tasks. Signals stay runs.
    Lines and runs of a track come one after the other in batches of many tracks, which costs less than a group at a time.
    """
    lines = cues.where(spoken(F.col("text"))).select("film", "track_id", F.lit(None).cast("long").alias("film_bins"), F.col("start_ms").cast("double").alias("a"), F.col("end_ms").cast("double").alias("b"))
    pairs = cues.select("film", "track_id").distinct()  # of tracks without spoken lines too, rather than to look for speech twice
    runs = speech_runs.select("film", F.coalesce("film_bins", F.lit(0)).cast("long").alias("film_bins"), F.col("from_bin").cast("double").alias("a"), F.col("to_bin").cast("double").alias("b"))
    runs = runs.join(pairs, "film").select("film", "track_id", "film_bins", "a", "b")
    n = max(4 * lines.sparkSession.sparkContext.defaultParallelism, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = lines.unionByName(runs).repartition(n, "film", "track_id")  # the rows are few and each track is work: their number isn't to be made less by their size
    return dealt.sortWithinPartitions("film", "track_id").mapInArrow(_searched, ALIGNED)


def decided(found: DataFrame) -> DataFrame:
    """found with outcome: n_cues, score, misfit, after and before (landing fractions), reference (whether against another track).

    The order of the tests matters: too few lines, an uncertain score, a misfit, no better landing; else accepted.
    """
    worth = (F.col("after") >= F.col("before")) & (F.col("after") >= LANDING_BAR)
    least = F.when(F.col("reference"), REFERENCE_SCORE).otherwise(LEAST_SCORE)
    outcome = F.when(F.col("n_cues") < FEWEST_CUES, "too-few-cues").when(F.col("score") < least, "uncertain").when(F.col("misfit").isNotNull(), "misfit").when(~F.coalesce(worth, F.lit(False)), "no-better").otherwise("accepted")
    return found.withColumn("outcome", outcome)


def moved(cues: DataFrame, offset_ms: int, rate: float) -> DataFrame:
    """Cues under a correction."""
    return cues.withColumns({c: corrected(F.col(c), F.lit(offset_ms), F.lit(rate)) for c in ("start_ms", "end_ms")})
