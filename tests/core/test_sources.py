import io
import os
import struct
import wave

import numpy as np

from reelgrid.operators import subtitles
from reelgrid.sources import audio, folders, matroska

TIMES = "1\n00:00:01,000 --> 00:00:04,000\nAlpha here.\n\n2\n00:00:05,000 --> 00:00:06,500\nBeta here.\n"


def cues(spark, **files):
    table = spark.createDataFrame([(k, v) for k, v in files.items()], "path string, text string")
    found, warned = subtitles.parsed(table)
    texts = {k: [] for k in files}
    for r in sorted(found.collect(), key=lambda r: (r.path, r.ordinal)):
        texts[r.path].append((r.start_ms, r.end_ms, r.text))
    kinds = {k: [] for k in files}
    for r in sorted(warned.collect(), key=lambda r: (r.path, r["rank"])):
        kinds[r.path].append((r.kind, r.n))
    return texts, kinds


def test_subtitles(spark):
    both = [(1000, 4000, "Alpha here."), (5000, 6500, "Beta here.")]
    texts, kinds = cues(
        spark,
        plain=TIMES,
        windows=TIMES.replace("\n", "\r\n"),
        mac=TIMES.replace("\n", "\r"),
        unnumbered=TIMES.replace("1\n0", "0").replace("2\n0", "0"),
        named=TIMES.replace("1\n0", "one\n0", 1),
        empty="",
        blank="\n\n\n",
        prose="This is not\na subtitle file.\n",
        back="1\n00:00:05,000 --> 00:00:06,500\nBeta here.\n\n2\n00:00:01,000 --> 00:00:04,000\nAlpha here.\n",
        cut=TIMES + "\n3\n",
        negative="1\n00:00:05,000 --> 00:00:04,000\nBackwards.\n",
        hollow="1\n00:00:01,000 --> 00:00:02,000\n\n2\n00:00:03,000 --> 00:00:04,000\nStays.\n",
    )
    for name in ("plain", "windows", "mac", "unnumbered", "named", "back", "cut"):
        assert texts[name] == both, name
    assert not kinds["plain"] and not kinds["windows"] and not kinds["mac"]
    assert kinds["unnumbered"] == [("MissingIndex", 2)]
    assert kinds["named"] == [("MalformedIndex", 1)]
    assert kinds["back"] == [("OutOfOrder", 1)]
    assert kinds["cut"] == [("TruncatedCue", 1)]
    assert texts["empty"] == texts["blank"] == texts["prose"] == [] and not kinds["empty"] and not kinds["blank"]
    assert kinds["prose"] == [("UnexpectedLine", 2)]
    assert texts["negative"] == [(5000, 5000, "Backwards.")] and kinds["negative"] == [("NegativeDuration", 1)]
    assert texts["hollow"] == [(3000, 4000, "Stays.")] and kinds["hollow"] == [("EmptyCue", 1)]


def test_encodings():
    said = "Voilà, un café à Paris."
    assert subtitles.decode_bytes(said.encode())[:2] == (said, "utf-8")
    assert subtitles.decode_bytes(b"\xef\xbb\xbf" + said.encode())[:2] == (said, "utf-8")
    assert subtitles.decode_bytes(b"\xff\xfe" + said.encode("utf-16-le"))[:2] == (said, "utf-16-le")
    assert subtitles.decode_bytes(said.encode("utf-16-be"))[:2] == (said, "utf-16-be")
    assert subtitles.decode_bytes(said.encode("windows-1252"))[:2] == (said, "windows-1252")
    russian = "Здравствуйте, как дела?"
    assert subtitles.decode_bytes(russian.encode("windows-1251"))[:2] == (russian, "windows-1251")
    assert subtitles.decode_bytes(None) == ("", "utf-8", False)


def element(i: int, body: bytes) -> bytes:
    return i.to_bytes((i.bit_length() + 7) // 8, "big") + (len(body) | 1 << 56).to_bytes(8, "big") + body


def film() -> bytes:
    number = lambda i, v: element(i, v.to_bytes(2, "big"))
    entry = element(matroska.ENTRY, number(matroska.NUMBER, 3) + number(matroska.TYPE, 0x11) + element(matroska.CODEC, b"S_TEXT/UTF8") + element(matroska.LANGUAGE, b"fre") + number(matroska.FORCED, 1))
    info = element(matroska.INFO, element(matroska.SCALE, (1_000_000).to_bytes(3, "big")) + element(matroska.DURATION, struct.pack(">d", 90_000.0)))
    block = lambda at, text, lasts: element(matroska.GROUP, element(matroska.BLOCK, b"\x83" + struct.pack(">h", at) + b"\0" + text) + number(matroska.LASTS, lasts))
    cluster = element(matroska.CLUSTER, number(matroska.TIMESTAMP, 5000) + block(250, b"<i>Later.</i>", 900) + block(-250, "Tôt.".encode(), 500))
    art = element(matroska.ATTACHMENTS, element(matroska.ATTACHED, element(matroska.FILE_NAME, b"cover.jpg") + element(matroska.MIME, b"image/jpeg") + element(matroska.DATA, b"\xff\xd8\xffpicture")))
    return element(0x1A45DFA3, b"") + element(matroska.SEGMENT, indexed((matroska.INFO, info), (matroska.TRACKS, element(matroska.TRACKS, entry)), (matroska.CLUSTER, cluster), (matroska.ATTACHMENTS, art)))


def indexed(*parts: tuple[int, bytes], said: dict[int, int] | None = None) -> bytes:
    """A segment's parts behind an index of where each begins; said: places that the index has wrong."""
    seek = lambda i, at: element(matroska.SEEK, element(matroska.SEEK_ID, i.to_bytes(4, "big")) + element(matroska.SEEK_POSITION, at.to_bytes(8, "big")))
    at, places = len(element(matroska.SEEK_HEAD, b"".join(seek(i, 0) for i, _ in parts))), {}
    for i, part in parts:
        places[i] = at
        at += len(part)
    return element(matroska.SEEK_HEAD, b"".join(seek(i, p) for i, p in (places | (said or {})).items())) + b"".join(p for _, p in parts)


def test_matroska(spark):
    files = spark.createDataFrame([("film.mkv", film()), ("other.mkv", b"not a film"), ("none.mkv", None)], "path string, content binary")
    found = [tuple(r) for r in matroska.cues(files).orderBy("ordinal").collect()]
    assert found == [("film.mkv", 3, 1, 4750, 5250, None, "Tôt."), ("film.mkv", 3, 2, 5250, 6150, None, "Later.")]
    facts = {r.path: r for r in matroska.facts(files).collect()}
    assert facts["film.mkv"].duration_ms == 90_000 and facts["other.mkv"].duration_ms is None
    (track,) = facts["film.mkv"].tracks
    assert (track.number, track.language, track.forced, track.is_default, track.hearing_impaired) == (3, "fr", True, True, False)
    assert matroska.artwork_of(film()) == ("cover.jpg", b"\xff\xd8\xffpicture") and matroska.artwork_of(b"") is None
    cut = film()
    for n in range(0, len(cut), 7):  # a file may end anywhere
        matroska.dialogue_of(cut[:n])


def test_folder_source(spark, tmp_path):
    for name in ("a.mkv", "_b.srt", "deep/er/c.mkv", ".hidden/d.mkv"):
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 5)
    (tmp_path / "link.mkv").symlink_to(tmp_path / "a.mkv")
    folders.register(spark)
    found = {r.path.removeprefix(f"{tmp_path}/"): r.size_bytes for r in spark.read.format("folder").load(str(tmp_path)).collect()}
    assert found == {"a.mkv": 5, "_b.srt": 5, "deep/er/c.mkv": 5}


def wav(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((samples * 20_000).astype("<i2").tobytes())
    return out.getvalue()


def test_audio_energy(spark):
    rate = 16_000
    t = np.arange(rate) / rate
    tone = np.where(t >= 0.5, np.sin(2 * np.pi * 1000 * t), 0)
    files = spark.createDataFrame([("tone", wav(tone, rate)), ("hum", wav(np.sin(2 * np.pi * 40 * t), rate)), ("bad", b"RIFFnothing"), ("none", None)], "path string, content binary")
    found = {}
    for r in audio.energy(files).collect():
        found.setdefault((r.film, r.outcome), {})[r.bin] = r.sum_sq
    assert set(found) == {("tone", "ok"), ("hum", "ok"), ("bad", "unreadable"), ("none", "unreadable")}
    loud, quiet = found["tone", "ok"][80], found["tone", "ok"][20]
    assert len(found["tone", "ok"]) == 100 and loud > 1 and quiet < 1e-6 * loud
    assert found["hum", "ok"][80] < 0.01 * loud
