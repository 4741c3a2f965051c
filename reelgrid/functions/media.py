"""Column functions that classify files, codecs and pictures. All run in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CONTAINERS = {"mp4": "MP4", "m4v": "MP4", "mkv": "Matroska", "mov": "QuickTime", "webm": "WebM", "avi": "AVI"}
SUBTITLES, IMAGES, SIDECARS = ("srt",), ("jpg", "jpeg", "png", "webp"), ("nfo",)
SKIPPED_FOLDERS = ("$recycle.bin", "system volume information", "recycler", "#recycle", "@eadir", "lost+found")
VIDEO_CODECS = (
    ("V_MPEGH/ISO/HEVC", "HEVC"), ("V_MPEG4/ISO/AVC", "H.264"), ("V_MPEG4/ISO/ASP", "MPEG-4"), ("V_MPEG2", "MPEG-2"), ("V_MPEG1", "MPEG-1"),
    ("V_AV1", "AV1"), ("V_VP9", "VP9"), ("V_VP8", "VP8"), ("V_THEORA", "Theora"), ("V_PRORES", "ProRes"),
)
AUDIO_CODECS = (
    ("A_MPEG/L3", "MP3"), ("A_MPEG/L2", "MP2"), ("A_TRUEHD", "TrueHD"), ("A_VORBIS", "Vorbis"), ("A_EAC3", "E-AC-3"), ("A_OPUS", "Opus"),
    ("A_FLAC", "FLAC"), ("A_ALAC", "ALAC"), ("A_AC3", "AC-3"), ("A_DTS", "DTS"), ("A_AAC", "AAC"), ("A_PCM", "PCM"),
)
TEXT_CODECS, BITMAP_CODECS = ("subrip", "ass", "webvtt"), ("pgs", "vobsub", "dvbsub")
SUBTITLE_CODECS = {
    "S_TEXT/UTF8": "subrip", "S_TEXT/ASCII": "subrip", "S_TEXT/ASS": "ass", "S_TEXT/SSA": "ass", "S_ASS": "ass", "S_SSA": "ass",
    "S_TEXT/WEBVTT": "webvtt", "D_WEBVTT/SUBTITLES": "webvtt", "S_HDMV/PGS": "pgs", "S_VOBSUB": "vobsub", "S_DVBSUB": "dvbsub",
}
COVER_RANKS = {"chosen": 0, "in-file": 1, "beside": 2, "sidecar": 3, "folder-above": 4, "none": 5}


def _cases(of: Column, values: dict | Sequence[tuple], test=None) -> Column:
    out = F.lit(None)
    for k, v in reversed(list(values.items() if isinstance(values, dict) else values)):
        out = F.when(test(of, k) if test else of == k, F.lit(v)).otherwise(out)
    return out


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def file_kind(name: Column) -> Column:
    """film, subtitle, image or sidecar by extension; null for others and for names that begin with a dot."""
    e = extension(name)
    kind = F.when(e.isin(*CONTAINERS), "film").when(e.isin(*SUBTITLES), "subtitle").when(e.isin(*IMAGES), "image").when(e.isin(*SIDECARS), "sidecar")
    return F.when(~name.startswith("."), kind)


def container_name(name: Column) -> Column:
    return _cases(extension(name), CONTAINERS)


def worth_walking(folder_name: Column) -> Column:
    return ~folder_name.startswith(".") & ~F.lower(folder_name).isin(*SKIPPED_FOLDERS)


def might_matter(name: Column) -> Column:
    """A changed name to look at: a classified file, or one without a dot, which could be a folder."""
    return ~name.startswith(".") & (file_kind(name).isNotNull() | ~name.contains("."))


def is_picture(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 12))
    return head.startswith("FFD8FF") | head.startswith("89504E470D0A1A0A") | (head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"))


def codec_name(codec_id: Column, names: Sequence[tuple[str, str]]) -> Column:
    """The first name whose prefix fits, whatever the case; else the id."""
    return F.coalesce(_cases(F.upper(codec_id), names, lambda c, k: c.startswith(k)), codec_id)


def subtitle_codec(codec_id: Column) -> Column:
    return F.coalesce(_cases(codec_id, SUBTITLE_CODECS), F.lit("unknown"))


def channel_layout(channels: Column) -> Column:
    return F.coalesce(_cases(channels, {1: "Mono", 2: "Stereo", 6: "5.1", 8: "7.1"}), F.concat(channels.cast("string"), F.lit(" channels")))


def resolution(width: Column, height: Column) -> Column:
    """Class by width, else the height."""
    by_width = F.lit(None)
    for least, name in ((800, "480p"), (1250, "720p"), (1900, "1080p"), (2500, "1440p"), (3800, "2160p")):
        by_width = F.when(width >= least, name).otherwise(by_width)
    return F.coalesce(by_width, F.concat(height.cast("string"), F.lit("p")))


def cover_rank(source: Column) -> Column:
    return F.coalesce(_cases(source, COVER_RANKS), F.lit(COVER_RANKS["none"]))


def shelf(path: Column, root: Column) -> Column:
    """The first folder under the root that a file is in; the root's own name for a file right in it."""
    inside = F.substring(path, F.length(root) + 2, F.length(path))
    return F.when(inside.contains("/"), F.split_part(inside, F.lit("/"), F.lit(1))).otherwise(base_name(root))


def is_inside(path: Column, root: Column) -> Column:
    return (path == root) | path.startswith(F.concat(root, F.lit("/")))


def ass_text(record: Column) -> Column:
    """The ninth field of an SSA record, commas and all; with fewer fields, the last."""
    return F.when(record.rlike("^(?:[^,]*,){8}"), F.regexp_extract(record, r"(?s)^(?:[^,]*,){8}(.*)$", 1)).otherwise(F.regexp_extract(record, "([^,]*)$", 1))


def fallback_hue(title: Column) -> Column:
    """A hue from the 32-bit FNV-1a hash of the lower-cased title's UTF-16 units (of its code points, below 65,536)."""
    units = F.transform(F.filter(F.split(F.lower(title), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    mixed = F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(4294967295)))
    return (mixed % 360000) / 1000.0


def shortest_code(name: Column) -> Column:
    """The base subtag of a declared language."""
    return F.lower(F.regexp_extract(name, "^([^-_]*)", 1))
