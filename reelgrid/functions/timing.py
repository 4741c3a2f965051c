"""Column functions over media time (whole milliseconds from a film's start), sizes and labels. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_MS = 4_294_967_295
FURTHEST_MS, SLOWEST, FASTEST = 600_000, 0.5, 2.0
#: The frame-rate ratios between which films are converted.
RATES = (1.0, 25.0 / 23.976, 23.976 / 25.0, 24.0 / 23.976, 23.976 / 24.0, 30.0 / 29.97)
RATE_TOLERANCE, DRIFT_MS = 0.0005, 500.0
_CLOCK = r"^(?:(?:([0-9]{1,9}):)?([0-9]{1,9}):)?([0-9]{1,9})(?:[,.]([0-9]*))?$"


def parse_clock(text: Column) -> Column:
    """``[[HH:]MM:]SS[,fff]`` as milliseconds; null if it isn't one or is too large. A fraction is decimal, cut after 3 digits."""
    t = F.trim(text)
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(t, _CLOCK, i), F.lit("")), F.lit("0")).cast("long")
    fraction = F.rpad(F.substring(F.regexp_extract(t, _CLOCK, 4), 1, 3), 3, "0").cast("long")
    ms = (part(1) * 3600 + part(2) * 60 + part(3)) * 1000 + fraction
    return F.when(t.rlike(_CLOCK) & (ms <= MAX_MS), ms)


def format_clock(ms: Column) -> Column:
    """``HH:MM:SS,mmm``."""
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def clamped_offset(offset_ms: Column) -> Column:
    return F.greatest(F.lit(-FURTHEST_MS), F.least(F.lit(FURTHEST_MS), offset_ms))


def clamped_rate(rate: Column) -> Column:
    """Between SLOWEST and FASTEST; what isn't finite is 1."""
    odd = F.isnan(rate) | (F.abs(rate) == float("inf"))
    return F.when(odd, F.lit(1.0)).otherwise(F.greatest(F.lit(SLOWEST), F.least(F.lit(FASTEST), rate)))


def corrected(ms: Column, offset_ms: Column, rate: Column) -> Column:
    """round(ms * rate + offset) held to what a time can be; the identity leaves ms as it is."""
    offset, factor = clamped_offset(offset_ms), clamped_rate(rate)
    moved = ms * factor + offset
    held = F.when(moved <= 0, F.lit(0)).when(moved >= MAX_MS, F.lit(MAX_MS)).otherwise(F.round(moved)).cast("long")
    return F.when((offset == 0) & (factor == 1.0), ms.cast("long")).otherwise(held)


def snapped_rate(measured: Column, film_ms: Column) -> Column:
    """The nearest of RATES within RATE_TOLERANCE that drifts DRIFT_MS at most over the film; null if none. The first among equals."""
    apart = [F.when((F.abs(measured - r) <= RATE_TOLERANCE) & (F.abs(measured - r) * film_ms <= DRIFT_MS), F.abs(measured - r)) for r in RATES]
    best, rate = F.lit(None).cast("double"), F.lit(None).cast("double")
    for d, r in zip(apart, RATES, strict=True):
        better = d.isNotNull() & (best.isNull() | (d < best))
        best, rate = F.when(better, d).otherwise(best), F.when(better, F.lit(r)).otherwise(rate)
    return rate


def progress(position_ms: Column, duration_ms: Column) -> Column:
    """Share watched, between 0 and 1; null without a duration."""
    return F.when(duration_ms > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), position_ms / duration_ms)))


def bitrate(size_bytes: Column, duration_ms: Column) -> Column:
    """Average bits a second, null without a duration or above 32 bits."""
    bits = F.floor(size_bytes.cast("decimal(24,0)") * 8000 / duration_ms).cast("long")
    return F.when((duration_ms > 0) & (bits <= MAX_MS), bits)


def resume_from(position_ms: Column, finished: Column, rewind_ms: int = 5000) -> Column:
    return F.when(position_ms.isNull() | finished, F.lit(0)).otherwise(F.greatest(F.lit(0), position_ms - rewind_ms)).cast("long")


def is_finished(position_ms: Column, duration_ms: Column, share: float = 0.97) -> Column:
    return F.coalesce(position_ms >= duration_ms * share, F.lit(False))


def runtime_label(duration_ms: Column) -> Column:
    minutes = F.round(duration_ms / 60_000).cast("long")
    hours, rest = F.floor(minutes / 60).cast("string"), (minutes % 60).cast("string")
    return F.when(duration_ms < 60_000, None).when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).when(minutes % 60 == 0, F.concat(hours, F.lit(" hr"))).otherwise(F.concat(hours, F.lit(" hr "), rest, F.lit(" min")))


def time_left_label(position_ms: Column, duration_ms: Column) -> Column:
    left = duration_ms - position_ms
    minutes = F.round(left / 60_000).cast("long")
    hours, rest = F.floor(minutes / 60).cast("string"), (minutes % 60).cast("string")
    return (
        F.when(left.isNull(), "Carry on").when(left < 60_000, "Nearly finished").when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min left")))
        .when(minutes % 60 == 0, F.concat(hours, F.lit(" hr left"))).otherwise(F.concat(hours, F.lit(" hr "), rest, F.lit(" min left")))
    )


def one_decimal(x: Column) -> Column:
    """A number from 1 on with one decimal as C prints it: the double's own value to the nearest, exact ties to even. Java's formats round what they would print in full."""
    whole = F.floor(x)
    q = ((x - whole) * float(1 << 52)).cast("long") * 10  # exact: the fraction is a multiple of 2^-52
    tenth, rest = F.shiftright(q, 52), q.bitwiseAND((1 << 52) - 1)
    up = (rest > 1 << 51) | ((rest == 1 << 51) & (tenth % 2 == 1))
    tenths = whole * 10 + tenth + up.cast("long")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def size_label(size_bytes: Column) -> Column:
    return (
        F.when(size_bytes >= 10**9, F.concat(one_decimal(size_bytes / 1e9), F.lit(" GB"))).when(size_bytes >= 10**6, F.concat(F.round(size_bytes / 1e6).cast("long").cast("string"), F.lit(" MB")))
        .when(size_bytes >= 1000, F.concat(F.round(size_bytes / 1e3).cast("long").cast("string"), F.lit(" kB"))).otherwise(F.concat(size_bytes.cast("string"), F.lit(" bytes")))
    )


def player_clock(ms: Column) -> Column:
    """``H:MM:SS``, hours only if there are any; ``--:--`` for null."""
    s = F.floor(ms / 1000)
    long_, short = F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60), F.format_string("%d:%02d", F.floor(s / 60), s % 60)
    return F.when(ms.isNull(), "--:--").when(s >= 3600, long_).otherwise(short)


def offset_label(offset_ms: Column) -> Column:
    """Signed seconds with two decimals; the minus is U+2212."""
    sign = F.when(offset_ms < 0, "\u2212").when(offset_ms > 0, "+").otherwise("")
    return F.concat(sign, F.format_string("%.2f s", F.abs(offset_ms) / 1000))


def frame_rate(nanoseconds: Column) -> Column:
    """Frames a second; null for zero or null."""
    return F.when(nanoseconds > 0, 1e9 / nanoseconds)


def units_ms(units: Column, scale: Column) -> Column:
    """Container units of ``scale`` nanoseconds as milliseconds."""
    whole = F.floor(units.cast("decimal(20,0)") * scale.cast("decimal(18,0)") / 1_000_000)
    return F.least(F.lit(MAX_MS).cast("decimal(38,0)"), whole).cast("long")


def byte_range(first: Column, last: Column, suffix: Column, size: Column, chunk: int = 4 << 20) -> tuple[Column, Column]:
    """The inclusive range served for a request of bytes first-last, or of the last ``suffix``; nulls if it can't be."""
    begin = F.when(suffix.isNotNull(), F.greatest(F.lit(0), size - suffix)).otherwise(first).cast("long")
    end = F.least(F.coalesce(last, size - 1), size - 1, begin + chunk - 1)
    ok = (begin < size) & (begin >= 0) & (end >= begin) & (F.coalesce(suffix, F.lit(1)) > 0)
    return F.when(ok, begin), F.when(ok, end.cast("long"))
