"""Facts, subtitle tracks, dialogue and artwork of Matroska files, from their bytes or by ranges of files where they lie.

The element tree is walked with sizes never trusted beyond the parent or the file; what isn't asked for is skipped, not
read. A file is read by one task, its cues leave it as rows. What the limits leave out is counted: probe() has the tracks
and dialogue_left_out() the cues and blocks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.functions.media import SUBTITLE_CODECS, TEXT_CODECS
from reelgrid.functions.names import language_code
from reelgrid.functions.text import clean_markup
from reelgrid.sources.ranged import Ranged, opened, rows_of
from reelgrid.sources.shared import Watch

# Ids of the elements that are read.
SEGMENT, INFO, SCALE, DURATION, TRACKS, ENTRY = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x1654AE6B, 0xAE
NUMBER, TYPE, CODEC, LANGUAGE, BCP47, DEFAULT, FORCED, IMPAIRED = 0xD7, 0x83, 0x86, 0x22B59C, 0x22B59D, 0x88, 0x55AA, 0x55AB
VIDEO, WIDTH, HEIGHT, FRAME_NS, AUDIO, CHANNELS, COLOUR, DEPTH = 0xE0, 0xB0, 0xBA, 0x23E383, 0xE1, 0x9F, 0x55B0, 0x55B2
CLUSTER, TIMESTAMP, SIMPLE, GROUP, BLOCK, LASTS = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
ATTACHMENTS, ATTACHED, FILE_NAME, MIME, DATA = 0x1941A469, 0x61A7, 0x466E, 0x4660, 0x465C
SEEK_HEAD, SEEK, SEEK_ID, SEEK_POSITION, SEEK_HOPS = 0x114D9B74, 0x4DBB, 0x53AB, 0x53AC, 2
TRACK_LIMIT, CUE_LIMIT, BLOCK_LIMIT = 64, 200_000, 64 << 10
#: The most bytes of each part that are read.
PART_LIMIT = {SEEK_HEAD: 1 << 20, INFO: 1 << 20, TRACKS: 16 << 20, ATTACHMENTS: 1 << 30}
PICTURES, COVERS = ("image/jpeg", "image/jpg", "image/png", "image/webp"), ("cover", "small_cover", "cover_land", "small_cover_land")


def _vint(b: bytes, at: int, end: int, most: int, keep: bool) -> tuple[int, int] | None:
    """A variable-length number and where it ends; with its length marker if it is an id."""
    if at >= end or not b[at]:
        return None
    n = 9 - b[at].bit_length()
    if n > most or at + n > end:
        return None
    v = int.from_bytes(b[at : at + n], "big")
    return (v if keep else v & ((1 << 7 * n) - 1)), at + n


def children(b: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, begin, end) of the elements between two places. An unknown size lasts to the parent's end."""
    while (head := _vint(b, at, end, 4, True)) and (size := _vint(b, head[1], end, 8, False)):
        unknown = size[0] == (1 << 7 * (size[1] - head[1])) - 1
        stop = end if unknown else min(end, size[1] + size[0])
        yield head[0], size[1], stop
        at = size[1] if unknown and head[0] == CLUSTER else stop  # a cluster without a size: its children follow in the segment


def _uint(b: bytes, a: int, z: int) -> int:
    return int.from_bytes(b[a:z][:8], "big")


def _fields(b: bytes, at: int, end: int) -> dict[int, tuple[int, int]]:
    out: dict[int, tuple[int, int]] = {}
    for i, a, z in children(b, at, end):
        out.setdefault(i, (a, z))
    return out


def _text(b: bytes, span: tuple[int, int] | None) -> str | None:
    return b[span[0] : span[1]].split(b"\0")[0].decode("utf-8", "replace") if span else None


def tracks_of(b: bytes, begin: int, end: int) -> tuple[list[dict], int]:
    """The track entries in order of their numbers, TRACK_LIMIT at most, and how many more there are."""
    found, more = [], 0
    for i, a, z in children(b, begin, end):
        if i != ENTRY:
            continue
        if len(found) == TRACK_LIMIT:
            more += 1
            continue
        f = _fields(b, a, z)
        flag = lambda k, d: bool(_uint(b, *f[k])) if k in f else d  # noqa: E731, B023
        number = lambda d, k: (_uint(b, *d[k]) or None) if k in d else None
        video, audio = (_fields(b, *f[k]) if k in f else {} for k in (VIDEO, AUDIO))
        colour = _fields(b, *video[COLOUR]) if COLOUR in video else {}
        named = _text(b, f.get(BCP47)) or _text(b, f.get(LANGUAGE)) or "eng"
        found.append({
            "number": number(f, NUMBER) or 0, "kind": number(f, TYPE) or 0, "codec_id": _text(b, f.get(CODEC)) or "", "language": language_code(named.replace("_", "-").split("-")[0]),
            "is_default": flag(DEFAULT, True), "forced": flag(FORCED, False), "hearing_impaired": flag(IMPAIRED, False), "width": number(video, WIDTH), "height": number(video, HEIGHT),
            "bit_depth": number(colour, DEPTH), "frame_ns": number(f, FRAME_NS), "channels": number(audio, CHANNELS),
        })
    return sorted(found, key=lambda t: t["number"]), more


def _segment(b: bytes) -> tuple[int, int] | None:
    return next(((a, z) for i, a, z in children(b, 0, len(b)) if i == SEGMENT), None)


def _element(b: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(id, begin, end) of the element at a place."""
    return next(children(b, at, end), None) if at < end else None


def located(b: bytes, span: tuple[int, int], wanted: tuple[int, ...]) -> tuple[dict[int, tuple[int, int]], int]:
    """Where a segment's parts are, and how many were refused as larger than PART_LIMIT.

    First by the index that the segment begins with, and one that this refers to; an entry counts if the part stands where it says. What
    the index doesn't have is looked for among what stands before the first frames. So parts behind the frames cost a few pages.
    """
    found: dict[int, tuple[int, int]] = {}
    refused, at = 0, span[0]

    def take(i: int, a: int, z: int) -> None:
        nonlocal refused
        if i in wanted and i not in found:
            found[i] = (a, a) if z - a > PART_LIMIT[i] else (a, z)
            refused += z - a > PART_LIMIT[i]

    for _ in range(SEEK_HOPS):
        head = _element(b, at, span[1])
        if head is None or head[0] != SEEK_HEAD or head[2] - head[1] > PART_LIMIT[SEEK_HEAD]:
            break
        places = {}
        for i, a, z in children(b, head[1], head[2]):
            entry = _fields(b, a, z) if i == SEEK else {}
            if SEEK_ID in entry and SEEK_POSITION in entry:
                places.setdefault(_uint(b, *entry[SEEK_ID]), span[0] + _uint(b, *entry[SEEK_POSITION]))
        for i in wanted:
            part = _element(b, places[i], span[1]) if i in places and i not in found else None
            if part and part[0] == i:
                take(*part)
        if SEEK_HEAD not in places:
            break
        at = places[SEEK_HEAD]
    if not found.keys() >= set(wanted):
        for i, a, z in children(b, *span):
            if i == CLUSTER:
                break
            take(i, a, z)
            if found.keys() >= set(wanted):
                break
    return found, refused


def described(b: bytes) -> dict:
    """Duration and tracks of a file; nothing where it isn't Matroska."""
    span = _segment(b)
    top, refused = located(b, span, (INFO, TRACKS)) if span else ({}, 0)
    info = _fields(b, *top[INFO]) if INFO in top else {}
    scale = _uint(b, *info[SCALE]) if SCALE in info else 1_000_000
    units = 0.0
    if DURATION in info:
        a, z = info[DURATION]
        units = struct.unpack(">d" if z - a == 8 else ">f", b[a:z])[0] if z - a in (4, 8) else 0.0
    ms = int(units * scale / 1e6) if DURATION in info and units > 0 and scale > 0 else None
    tracks, more = tracks_of(b, *top[TRACKS]) if TRACKS in top else ([], 0)
    return {"duration_ms": ms, "scale": scale, "tracks": tracks, "tracks_left_out": more, "parts_refused": refused}


def dialogue_of(b: bytes, left_out: dict | None = None) -> list[dict]:
    """The cues of the text tracks: by track, in order of time, numbered from 1. left_out takes counts of what the limits leave out, by track and kind."""
    missed = left_out if left_out is not None else {}
    facts, span = described(b), _segment(b)
    text = {t["number"]: SUBTITLE_CODECS.get(t["codec_id"]) for t in facts["tracks"] if t["kind"] == 0x11 and SUBTITLE_CODECS.get(t["codec_id"]) in TEXT_CODECS}
    if not span or not text:
        return []
    found: dict[int, list] = {n: [] for n in text}
    now = 0

    def block(a: int, z: int, lasts: int) -> None:
        head = _vint(b, a, z, 8, False)
        if not head or head[0] not in text or head[1] + 3 > z or b[head[1] + 2] & 0x06:
            return
        if (large := z - a > BLOCK_LIMIT) or len(found[head[0]]) >= CUE_LIMIT:
            key = head[0], "large-block" if large else "more-cues"
            missed[key] = missed.get(key, 0) + 1
            return
        start = max(0, now + struct.unpack(">h", b[head[1] : head[1] + 2])[0])
        try:
            said = b[head[1] + 3 : z].decode()
        except UnicodeDecodeError:
            return
        if text[head[0]] == "ass":
            said = said.split(",", 8)[-1]
        said, position = clean_markup(said)
        if said:
            at = start * facts["scale"] // 1_000_000
            found[head[0]].append((at, at + lasts * facts["scale"] // 1_000_000, said, position))

    def walk(a: int, z: int) -> None:
        nonlocal now
        for i, p, q in children(b, a, z):
            if i == CLUSTER:
                walk(p, q)
            elif i == TIMESTAMP:
                now = _uint(b, p, q)
            elif i == SIMPLE:
                block(p, q, 0)
            elif i == GROUP:
                f = _fields(b, p, q)
                if BLOCK in f:
                    block(*f[BLOCK], _uint(b, *f[LASTS]) if LASTS in f else 0)

    walk(*span)
    return [
        {"stream_number": n, "ordinal": k + 1, "start_ms": s, "end_ms": e, "position": p, "text": t}
        for n, cues in sorted(found.items()) for k, (s, e, t, p) in enumerate(sorted(cues, key=lambda c: c[:2]))
    ]


def artwork_of(b: bytes) -> tuple[str, bytes] | None:
    """The name and bytes of the attached picture with the most conventional name, the first of equals."""
    span, best = _segment(b), None
    for a, z in located(b, span, (ATTACHMENTS,))[0].values() if span else ():
        for i, p, q in children(b, a, z):
            f = _fields(b, p, q) if i == ATTACHED else {}
            name, mime = _text(b, f.get(FILE_NAME)) or "", (_text(b, f.get(MIME)) or "").lower()
            stem, _, ext = name.lower().rpartition(".")
            if DATA in f and (mime in PICTURES or ext in ("jpg", "jpeg", "png", "webp")):
                rank = COVERS.index(stem) if stem in COVERS else len(COVERS)
                if best is None or rank < best[0]:
                    best = (rank, name, b[f[DATA][0] : f[DATA][1]])
    return best and best[1:]


_CUES = "path string, stream_number long, ordinal int, start_ms long, end_ms long, position int, text string"


def cues(files: DataFrame) -> DataFrame:
    """(path, stream_number, ordinal, start_ms, end_ms, position, text) of files (path, content)."""
    arrow = pa.schema([("path", pa.string()), ("stream_number", pa.int64()), ("ordinal", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("position", pa.int32()), ("text", pa.string())])

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                rows = [{"path": path, **c} for c in dialogue_of(content or b"")]
                for k in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_pylist(rows[k : k + 5000], arrow)

    return files.select("path", "content").mapInArrow(read, _CUES)


def facts(files: DataFrame) -> DataFrame:
    """(path, duration_ms, tracks[]) of files (path, content); flags and sizes that a file doesn't state are null."""
    kinds = (("number", "long"), ("kind", "long"), ("codec_id", "string"), ("language", "string"), ("is_default", "boolean"), ("forced", "boolean"), ("hearing_impaired", "boolean"), ("width", "long"), ("height", "long"), ("bit_depth", "long"), ("frame_ns", "long"), ("channels", "long"))
    types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    schema = "duration_ms long, tracks array<struct<" + ", ".join(f"{n}: {k}" for n, k in kinds) + ">>"
    arrow = pa.struct([("duration_ms", pa.int64()), ("tracks", pa.list_(pa.struct([(n, types[k]) for n, k in kinds])))])

    @F.arrow_udf(f"struct<{schema.replace(' long', ': long', 1).replace('tracks array', 'tracks: array')}>")
    def read(content: pa.Array) -> pa.Array:
        rows = [described(b or b"") for b in content.to_pylist()]
        return pa.array([{"duration_ms": r["duration_ms"], "tracks": r["tracks"]} for r in rows], arrow)

    return files.withColumn("_f", read("content")).select("path", "_f.*")


# ---- by ranges -----------------------------------------------------------------------------------------------------------

_PROBE = "path string, outcome string, duration_ms long, video_codec_id string, width long, height long, bit_depth long, frame_ns long, tracks_left_out long, parts_refused long, bytes_read long, audio array<struct<stream_number: long, codec_id: string, channels: long, language: string, is_default: boolean>>, subtitles array<struct<stream_number: long, codec_id: string, language: string, forced: boolean, hearing_impaired: boolean>>"
_AUDIO = pa.struct([("stream_number", pa.int64()), ("codec_id", pa.string()), ("channels", pa.int64()), ("language", pa.string()), ("is_default", pa.bool_())])
_SUBTITLE = pa.struct([("stream_number", pa.int64()), ("codec_id", pa.string()), ("language", pa.string()), ("forced", pa.bool_()), ("hearing_impaired", pa.bool_())])
_PROBED = pa.schema([("path", pa.string()), ("outcome", pa.string()), *((c, pa.string() if c == "video_codec_id" else pa.int64()) for c in ("duration_ms", "video_codec_id", "width", "height", "bit_depth", "frame_ns", "tracks_left_out", "parts_refused", "bytes_read")), ("audio", pa.list_(_AUDIO)), ("subtitles", pa.list_(_SUBTITLE))])


def probed(path: str) -> Iterator[dict]:
    """One row of _PROBE: outcome is ok, not-matroska or unreadable; bytes_read is what it took."""
    try:
        with opened(path) as f:
            b = Ranged(f)
            if _segment(b) is None:
                yield {"path": path, "outcome": "not-matroska", "bytes_read": b.fetched}
                return
            found = described(b)
    except OSError:
        yield {"path": path, "outcome": "unreadable"}
        return
    tracks = found["tracks"]
    video = next((t for t in tracks if t["kind"] == 1), {})
    yield {
        "path": path, "outcome": "ok", "duration_ms": found["duration_ms"], "video_codec_id": video.get("codec_id"), **{c: video.get(c) for c in ("width", "height", "bit_depth", "frame_ns")}, "tracks_left_out": found["tracks_left_out"], "parts_refused": found["parts_refused"], "bytes_read": b.fetched,
        "audio": [{"stream_number": t["number"], **{c: t[c] for c in ("codec_id", "channels", "language", "is_default")}} for t in tracks if t["kind"] == 2],
        "subtitles": [{"stream_number": t["number"], **{c: t[c] for c in ("codec_id", "language", "forced", "hearing_impaired")}} for t in tracks if t["kind"] == 0x11],
    }


def probe(paths: DataFrame, watch: Watch | None = None) -> DataFrame:
    """_PROBE of each path (path): a few pages of each file are read, whatever its size. watch: as in rows_of()."""
    return rows_of(paths, probed, _PROBED, _PROBE, watch=watch)


def dialogue(paths: DataFrame) -> DataFrame:
    """The columns of cues() of each path (path); only the blocks of text tracks are read of what follows the headers."""
    arrow = pa.schema([("path", pa.string()), ("stream_number", pa.int64()), ("ordinal", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("position", pa.int32()), ("text", pa.string())])

    def make(path: str) -> Iterator[dict]:
        try:
            with opened(path) as f:
                found = dialogue_of(Ranged(f))
        except OSError:
            return
        yield from ({"path": path, **c} for c in found)

    return rows_of(paths, make, arrow, _CUES)


def dialogue_left_out(paths: DataFrame) -> DataFrame:
    """(path, stream_number, why, n) of cues and blocks that the limits leave out."""

    def make(path: str) -> Iterator[dict]:
        missed: dict = {}
        try:
            with opened(path) as f:
                dialogue_of(Ranged(f), missed)
        except OSError:
            return
        yield from ({"path": path, "stream_number": t, "why": why, "n": n} for (t, why), n in sorted(missed.items()))

    return rows_of(paths, make, pa.schema([("path", pa.string()), ("stream_number", pa.int64()), ("why", pa.string()), ("n", pa.int64())]), "path string, stream_number long, why string, n long")


def artwork(paths: DataFrame) -> DataFrame:
    """(path, name, content) of the best attached picture of each path (path) that has one."""

    def make(path: str) -> Iterator[dict]:
        try:
            with opened(path) as f:
                found = artwork_of(Ranged(f))
        except OSError:
            return
        if found:
            yield {"path": path, "name": found[0], "content": found[1]}

    return rows_of(paths, make, pa.schema([("path", pa.string()), ("name", pa.string()), ("content", pa.binary())]), "path string, name string, content binary", held=8)
