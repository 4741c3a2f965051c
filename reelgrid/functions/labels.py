"""Labels of a library and a player as columns: dates, facts, tracks, covers, outcomes, colours. All run in the JVM but where noted.

Calendar days are those of the session's time zone; "today" is a parameter, so that results can be repeated.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from reelgrid.functions.media import AUDIO_CODECS, BITMAP_CODECS, TEXT_CODECS, _cases, base_name, codec_name, extension
from reelgrid.functions.timing import offset_label, one_decimal, player_clock, runtime_label, size_label, time_left_label

# Fixed values.
LANGUAGE_NAMES = {
    "ar": "Arabic", "bg": "Bulgarian", "cs": "Czech", "da": "Danish", "de": "German", "el": "Greek", "en": "English", "es": "Spanish", "fa": "Persian",
    "fi": "Finnish", "fr": "French", "he": "Hebrew", "hi": "Hindi", "hr": "Croatian", "hu": "Hungarian", "id": "Indonesian", "it": "Italian", "ja": "Japanese",
    "ko": "Korean", "nl": "Dutch", "no": "Norwegian", "pl": "Polish", "pt": "Portuguese", "ro": "Romanian", "ru": "Russian", "sr": "Serbian", "sv": "Swedish",
    "th": "Thai", "tr": "Turkish", "uk": "Ukrainian", "vi": "Vietnamese", "zh": "Chinese",
}
COVER_NAMES = {
    "chosen": "Your choice", "in-file": "Inside the film", "beside": "Beside the film", "sidecar": "From a media manager",
    "folder-above": "From the folder above", "none": "From the film itself",
}
OUTCOME_TITLES = {
    "aligned": "Lined up", "no-better": "No better than it is", "too-few-cues": "Not enough to go on", "no-audio": "Nothing to listen to",
    "unsupported": "Audio that cannot be read", "uncertain": "Not sure enough to say", "breaks": "This film has breaks in it",
    "different-cut": "A subtitle for a different cut", "unreadable": "This film could not be read", "stopped": "Stopped",
}
HUE_BINS, LEAST_APART, OPAQUE = 24, 4, 128
DARKEST, LIGHTEST, DULLEST = 0.06, 0.95, 0.1
SATURATIONS, LIGHTNESSES = (0.34, 0.82), (0.44, 0.7)
BLIND_SECONDS, MOMENT = 90.0, 0.2


def _day(millis: Column) -> Column:
    return F.to_date(F.timestamp_millis(millis))


# ---- dates and facts -----------------------------------------------------------------------------------------------------


def date_label(millis: Column, today: Column) -> Column:
    """Day and short month, with the year where it isn't today's; empty for null. today: a date."""
    day = _day(millis)
    short = F.concat(F.dayofmonth(day).cast("string"), F.lit(" "), F.date_format(day, "MMM"))
    return F.coalesce(F.when(F.year(day) == F.year(today), short).otherwise(F.concat(short, F.lit(" "), F.year(day).cast("string"))), F.lit(""))


def stopped_label(millis: Column, today: Column) -> Column:
    """When a film was stopped, in calendar days before today."""
    days = F.datediff(today, _day(millis))
    return F.when(days.isNull(), "Stopped earlier").when(days <= 0, "Stopped today").when(days == 1, "Stopped yesterday").otherwise(F.concat(F.lit("Stopped on "), date_label(millis, today)))


def left_label(position_ms: Column, duration_ms: Column) -> Column:
    """What is left, of how much where over a minute is."""
    said = time_left_label(position_ms, duration_ms)
    return F.when((duration_ms - position_ms >= 60_000) & runtime_label(duration_ms).isNotNull(), F.concat(said, F.lit(" of "), runtime_label(duration_ms))).otherwise(said)


def frame_rate_label(rate: Column) -> Column:
    whole = rate == F.floor(rate)
    return F.when((rate > 0) & (rate < float("inf")), F.concat(F.when(whole, rate.cast("long").cast("string")).otherwise(F.format_string("%.3f", rate)), F.lit(" fps")))


def bitrate_label(bits: Column) -> Column:
    return F.when(bits >= 1_000_000, F.concat(one_decimal(bits / 1e6), F.lit(" Mb/s"))).when(bits > 0, F.concat(F.round(bits / 1e3).cast("long").cast("string"), F.lit(" kb/s")))


def facts(film: dict[str, Column], today: Column) -> Column:
    """An array of (label, value) of what is known of a file, in their order.

    film: columns container, video_codec, video_width, video_height, bit_depth, frame_rate, bitrate, size_bytes, added_at, path.
    """
    both = film["video_width"].isNotNull() & film["video_height"].isNotNull()
    rows = (
        ("Container", film["container"]), ("Video", film["video_codec"]),
        ("Resolution", F.when(both, F.concat(film["video_width"].cast("string"), F.lit(" × "), film["video_height"].cast("string")))),
        ("Bit depth", F.concat(film["bit_depth"].cast("string"), F.lit("-bit"))), ("Frame rate", frame_rate_label(film["frame_rate"])),
        ("Average bitrate", bitrate_label(film["bitrate"])), ("Size", F.when(film["container"].isNotNull(), size_label(film["size_bytes"]))),
        ("Added", date_label(film["added_at"], today)), ("Path", film["path"]),
    )
    return F.filter(F.array(*(F.struct(F.lit(k).alias("label"), v.alias("value")) for k, v in rows)), lambda x: x["value"].isNotNull() & (x["value"] != ""))


def language_name(code: Column) -> Column:
    """What a code is called, the code in upper case where that isn't known; empty for a blank one."""
    bare = F.trim(code)
    return F.when(bare == "", "").otherwise(F.coalesce(_cases(F.lower(bare), LANGUAGE_NAMES), F.upper(bare)))


def audio_codec_name(codec_id: Column) -> Column:
    """How a refusal names a soundtrack's codec; null for one it has no name for."""
    named = codec_name(codec_id, AUDIO_CODECS)
    return F.when(named != codec_id, named)


# ---- tracks and covers ---------------------------------------------------------------------------------------------------


def track_name(language: Column, origin: Column, stream_number: Column, path: Column) -> Column:
    return F.when(language.isNotNull(), language_name(language)).when(origin == "stream", F.concat(F.lit("Track "), stream_number.cast("string"))).otherwise(base_name(path))


def track_note(origin: Column, forced: Column, hearing_impaired: Column) -> Column:
    """What else there is to say of a track; null if nothing."""
    said = F.concat_ws(" · ", F.when(origin == "stream", "Inside the film"), F.when(forced, "Forced"), F.when(hearing_impaired, "For the hard of hearing"))
    return F.nullif(said, F.lit(""))


def track_form(codec: Column) -> Column:
    """text, pictures or unrecognised."""
    return F.when(codec.isin(*TEXT_CODECS), "text").when(codec.isin(*BITMAP_CODECS), "pictures").otherwise("unrecognised")


def track_problem(codec: Column) -> Column:
    form = track_form(codec)
    return F.when(form == "pictures", "Pictures, not text").when(form == "unrecognised", "Not a subtitle format that can be read")


def track_about(origin: Column, cue_count: Column, forced: Column, hearing_impaired: Column) -> Column:
    lines = F.when(cue_count > 0, F.concat(F.format_number(cue_count, 0), F.lit(" lines")))
    place = F.when(origin == "stream", "Inside the film").otherwise("Beside the film")
    return F.concat_ws(" · ", place, lines, F.when(forced, "Forced"), F.when(hearing_impaired, "For the hard of hearing"))


def cover_name(source: Column) -> Column:
    return _cases(source, COVER_NAMES)


def picture_kind(poster_path: Column, cover_source: Column, frames: Column) -> Column:
    """artwork, frame or composed. frames: whether films without artwork show a frame of their own."""
    return F.when(poster_path.isNull(), "composed").when(cover_source != "none", "artwork").when(frames, "frame").otherwise("composed")


# ---- outcomes in words -----------------------------------------------------------------------------------------------------------


def _percent(fraction: Column) -> Column:
    return F.concat(F.round(fraction * 100).cast("long").cast("string"), F.lit(" %"))


def outcome_title(outcome: Column) -> Column:
    return _cases(outcome, OUTCOME_TITLES)


def outcome_sentence(found: dict[str, Column], wanted: int = 100) -> Column:
    """An outcome's figures in one line, in wording of our own: what was done or why nothing was, then how many lines start with speech.

    found: columns outcome, offset_ms, rate, n_cues, examined, before, after (landing fractions), at_ms, codec, message, agreed, across, spread_ms,
    against (null for speech, else how the other track is called).
    """
    f, say = found, lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    share = F.when(f["examined"] > 0, say("on time as written: ", _percent(f["before"])))
    then = say("on time if moved: ", _percent(f["after"]))
    parts = {
        "aligned": (say("moved by ", offset_label(f["offset_ms"])), F.when(f["rate"] != 1.0, say("rate ", F.format_string("%.4f", f["rate"]))), F.when(f["against"].isNotNull(), say("compared with ", f["against"])), then, share,
                    F.when(f["across"] > 0, say(f["agreed"].cast("string"), " of ", f["across"].cast("string"), " parts agree, median error ", f["spread_ms"].cast("string"), " ms"))),
        "no-better": (F.when(f["examined"] > 0, then).otherwise("no speech near any line"), share), "too-few-cues": (say(f["n_cues"].cast("string"), f" lines of the {wanted} that are needed"),),
        "no-audio": (F.lit("the film is silent"),), "unsupported": (say("no decoder for ", F.coalesce(f["codec"], F.lit("this sound"))),), "uncertain": (F.lit("no shift fits"), share),
        "breaks": (say("fits up to ", player_clock(f["at_ms"]), ", a constant step after"), share), "different-cut": (say("fits up to ", player_clock(f["at_ms"]), ", nothing after"), share),
        "unreadable": (f["message"],), "stopped": (F.lit("stopped before the end"),),
    }
    out = F.lit(None).cast("string")
    for name, said in parts.items():
        out = F.when(f["outcome"] == name, F.concat_ws("; ", *said)).otherwise(out)
    return out


#: What to suspect in a file of a kind that doesn't play; else an unknown format.
SUSPECTS = {"mkv": "HEVC or DTS", "avi": "an old codec", "mp4": "HEVC", "m4v": "HEVC", "mov": "HEVC", "webm": "a damaged copy"}


def unplayable_sentence(code: Column, path: Column) -> Column:
    """Why a film didn't play, in wording of our own, by a player's error code (1 aborted, 2 network, 3 decoding, 4 unsupported) and the file's kind."""
    suspect = F.concat(F.lit("; suspect "), F.coalesce(_cases(extension(path), SUSPECTS), F.lit("an unknown format")))
    return F.when(code == 1, "aborted").when(code == 2, "the file went away").when(code == 3, F.concat(F.lit("decoding failed"), suspect)).when(code == 4, F.concat(F.lit("not supported"), suspect)).otherwise("unknown error")


# ---- pictures ------------------------------------------------------------------------------------------------------------


def _round(x: Column) -> Column:
    """Halves up, as pixels are counted."""
    return F.floor(x + 0.5).cast("long")


def frame_moment(seconds: Column, asked: Column | None = None) -> Column:
    """Where to take a frame: where asked, else a fifth into the film, else at BLIND_SECONDS where its length isn't known."""
    usual = F.when((seconds > 0) & (seconds < float("inf")), seconds * MOMENT).otherwise(BLIND_SECONDS)
    return usual if asked is None else F.coalesce(asked, usual)


def centred_crop(width: Column, height: Column, ratio: Column) -> Column:
    """The largest centred rectangle of a ratio, as a struct (x, y, width, height); zeros if there is none."""
    w = F.least(width.cast("double"), height * ratio)
    ok = (width > 0) & (height > 0) & (ratio > 0)
    zero = F.lit(0).cast("long")
    held = {"x": (width - w) / 2, "y": (height - w / ratio) / 2, "width": w, "height": w / ratio}
    return F.struct(*(F.when(ok, _round(v)).otherwise(zero).alias(k) for k, v in held.items()))


def fitted_size(width: Column, height: Column, widest: int, tallest: int) -> Column:
    """A picture's size inside a frame, its shape kept, as a struct (width, height)."""
    ok, tall = (width > 0) & (height > 0), _round(F.lit(widest) * height / width)
    fits, one, zero = tall <= tallest, F.lit(1).cast("long"), F.lit(0).cast("long")
    w = F.when(~ok, zero).when(fits, F.lit(widest).cast("long")).otherwise(F.greatest(one, _round(F.lit(tallest) * width / height)))
    h = F.when(~ok, zero).when(fits, F.greatest(one, tall)).otherwise(F.lit(tallest).cast("long"))
    return F.struct(w.alias("width"), h.alias("height"))


def hsl(red: Column, green: Column, blue: Column) -> Column:
    """A struct (h, s, l): degrees, and shares of one. The hue is two sixths of the circle for each channel up to the strongest, and the
    difference of the two that follow it, over the span of all three, in sixths."""
    rgb = [c / 255.0 for c in (red, green, blue)]
    span, double = F.greatest(*rgb) - F.least(*rgb), F.greatest(*rgb) + F.least(*rgb)
    sixths = F.coalesce(*(F.when(c == F.greatest(*rgb), 2 * i + (rgb[(i + 1) % 3] - rgb[(i + 2) % 3]) / span) for i, c in enumerate(rgb)))
    coloured = span > 0
    return F.struct(F.when(coloured, F.pmod(sixths * 60, F.lit(360.0))).otherwise(0.0).alias("h"), F.when(coloured, span / F.least(double, 2 - double)).otherwise(0.0).alias("s"), (double / 2).alias("l"))


def hex_colour(hue: Column, saturation: Column, lightness: Column) -> Column:
    """#rrggbb of a colour, its saturation and lightness held to what can be read over.

    One formula for each channel: with k its distance on a circle of twelve (red 0, green 8, blue 4), lightness - reach * max(-1, min(k - 3, 9 - k, 1)).
    """
    held = lambda c, ends: F.greatest(F.lit(ends[0]), F.least(F.lit(ends[1]), c))
    light = held(lightness, LIGHTNESSES)
    reach = held(saturation, SATURATIONS) * F.least(light, 1 - light)

    def byte(n: int) -> Column:
        k = F.pmod(hue / 30 + n, F.lit(12.0))
        return F.lpad(F.lower(F.hex(_round((light - reach * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))) * 255))), 2, "0")

    return F.concat(F.lit("#"), byte(0), byte(8), byte(4))


def colour_pair(stored: Column) -> Column:
    """A struct (primary, pair) of two stored colours; null if they aren't two."""
    return F.when(stored.rlike("^#[0-9A-Fa-f]{6} #[0-9A-Fa-f]{6}$"), F.struct(F.split_part(stored, F.lit(" "), F.lit(1)).alias("primary"), F.split_part(stored, F.lit(" "), F.lit(2)).alias("pair")))


def accents(pixels, by: str):
    """(by, primary, pair) of pixels (by, red, green, blue, alpha): the two heaviest hues, weighted by saturation and averaged round the circle.

    Hues are counted in HUE_BINS; see-through, dark, bright and dull pixels don't count. The second is LEAST_APART bins away or
    more; without one, it is a third of the circle on. Two grouped sums; a picture is never in one task.
    """
    c = hsl(F.col("red"), F.col("green"), F.col("blue"))
    seen = pixels.where(F.col("alpha") >= OPAQUE).select(by, c.alias("c")).where((F.col("c.l") >= DARKEST) & (F.col("c.l") <= LIGHTEST) & (F.col("c.s") >= DULLEST))
    bin_, angle = F.least(F.lit(HUE_BINS - 1), F.floor(F.col("c.h") / 360 * HUE_BINS)), F.radians("c.h")
    s = F.col("c.s")
    sums = seen.groupBy(by, bin_.alias("bin")).agg(F.sum(s).alias("w"), F.sum(s * s).alias("ss"), F.sum(s * F.col("c.l")).alias("sl"), F.sum(s * F.cos(angle)).alias("x"), F.sum(s * F.sin(angle)).alias("y"))
    rank = lambda: F.struct(F.col("w"), (-F.col("bin")).alias("back"), "bin", "ss", "sl", "x", "y")  # noqa: E731  the first of the heaviest
    first = sums.groupBy(by).agg(F.max(rank()).alias("one"), F.collect_list(rank()).alias("all"))  # HUE_BINS at most
    apart = lambda b: F.least(F.abs(b["bin"] - F.col("one.bin")), HUE_BINS - F.abs(b["bin"] - F.col("one.bin")))
    first = first.withColumn("two", F.array_max(F.filter("all", lambda b: apart(b) >= LEAST_APART)))
    hue = lambda k: (F.degrees(F.atan2(F.col(f"{k}.y"), F.col(f"{k}.x"))) + 360) % 360
    colour = lambda k: hex_colour(hue(k), F.col(f"{k}.ss") / F.col(f"{k}.w"), F.col(f"{k}.sl") / F.col(f"{k}.w"))
    out = first.select(by, colour("one").alias("primary"), F.when(F.col("two").isNotNull(), colour("two")).alias("pair"))
    channel = lambda i: F.conv(F.substring("primary", 2 + 2 * i, 2), 16, 10).cast("int")
    own = hsl(channel(0), channel(1), channel(2))
    return out.withColumn("_own", own).select(by, "primary", F.coalesce("pair", hex_colour((F.col("_own.h") + 120) % 360, F.col("_own.s"), F.col("_own.l"))).alias("pair"))


def poster_name(path: Column, modified_at: Column, cover: Column) -> Column:
    """The cached poster's file name: 64-bit FNV-1a over the path, the time and the cover's path. An Arrow UDF: 64-bit products overflow in SQL."""

    @F.pandas_udf("string")
    def of(paths: pd.Series, times: pd.Series, covers: pd.Series) -> pd.Series:
        def name(p, t, c):
            h = 0xCBF29CE484222325
            for byte in (p or "").encode() + int(t).to_bytes(8, "little", signed=True) + (c.encode() if isinstance(c, str) else b""):
                h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
            return f"{h:016x}.webp"

        return pd.Series([name(p, 0 if t is None or (isinstance(t, float) and math.isnan(t)) else t, c) for p, t, c in zip(paths, times, covers, strict=True)], dtype=object)

    return of(path, modified_at, cover)
