"""A library from the first scan on: what is found, what changes, what goes."""

import wave

import pytest
from pyspark.sql import functions as F

from reelgrid.engine import Library
from reelgrid.operators import mutations
from tests.core.test_sources import film

SRT = "1\n00:00:01,000 --> 00:00:02,000\n<i>Good evening.</i>\n\n2\n00:00:03,000 --> 00:00:04,000\nAnd you.\n"


def test_a_library_from_its_first_scan_on(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    films = tmp_path / "films"
    (films / "Blue Moon (1999)").mkdir(parents=True)
    (films / "Blue Moon (1999)" / "Blue.Moon.1999.mkv").write_bytes(film())
    (films / "Blue Moon (1999)" / "Blue.Moon.1999.en.srt").write_text(SRT)
    (films / "Blue Moon (1999)" / "poster.jpg").write_bytes(b"\xff\xd8\xff\xe0")
    with wave.open(str(films / "tone.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(bytes(16_000))
    (films / "other.mp4").write_bytes(b"not matroska")
    lib = Library(spark, str(tmp_path / "lib"), now=1)
    folder = lib.add_folder(str(films), 1)
    assert lib.add_folder(str(films), 2) == folder
    counts = lib.scan(folder, 10).first()
    assert (counts.films, counts.subtitles, counts.images, counts.opened, counts.read, counts.removed) == (2, 1, 1, 2, 1, 0)
    rows = {r.title: r for r in lib.library().collect()}
    moon = rows["Blue Moon"]
    assert (moon.year, moon.duration_ms, moon.container, moon.probed_at, moon.missing_since) == (1999, 90_000, "Matroska", 10, None)
    assert moon.cover_source == "in-file"  # artwork attached inside goes before the poster beside it
    assert lib.cover_image(moon.id) == b"\xff\xd8\xffpicture" and lib.cover_image(rows["Other"].id) is None and lib.scan_progress() == 1.0
    assert sorted((t.language, t.cue_count) for t in moon.tracks) == [("en", 2), ("fr", 2)]
    beside = lib.table("subtitle_track").where("origin = 'sidecar'").first()
    assert [(r.start_ms, r.text) for r in lib.cues(beside.id).orderBy("place").collect()] == [(1000, "Good evening."), (3000, "And you.")]

    again = lib.scan(folder, 20).first()
    assert (again.opened, again.read, again.removed) == (0, 0, 0)
    assert lib.table("subtitle_track").count() == 2 and lib.table("cue").count() == 4

    assert lib.correct(beside.id, 500, 1.0) and not lib.correct(beside.id, 500, 1.0)
    assert [r.start_ms for r in lib.cues(beside.id).orderBy("place").collect()] == [1500, 3500]
    assert [r.start_ms for r in lib.cues(beside.id, authored=True).orderBy("place").collect()] == [1000, 3000]
    assert lib.choose_track(moon.id, beside.id)
    with pytest.raises(mutations.Refused):
        lib.choose_track(rows["Other"].id, beside.id)
    assert lib.choose_cover(moon.id, "/mine.png") and lib.table("film").where(F.col("id") == moon.id).first().cover_source == "chosen"
    assert not lib.save_position(moon.id, 900, None, False, 30) and lib.save_position(moon.id, 40_000, 90_000, False, 31)
    assert [r.film_id for r in lib.resumable(5).collect()] == [moon.id]
    lib.set_preference("theme", "dark")
    lib.set_preference("theme", None)
    assert lib.table("preference").count() == 0
    assert lib.align(beside.id) == "too-few-cues" and not lib.aligning.busy
    assert lib.folders_for_paths([str(films), str(films / "other.mp4"), str(films / "Blue Moon (1999)")]) == [str(films)]
    assert sorted(r.id for r in lib.posters_wanted(str(tmp_path / "cache")).collect()) == sorted(r.id for r in rows.values())
    assert lib.save_poster(moon.id, "/cache/x.webp", "#112233 #aabbcc")
    with pytest.raises(mutations.Refused):
        lib.save_poster(moon.id, "/cache/x.webp", "red")

    (films / "Blue Moon (1999)" / "Blue.Moon.1999.en.srt").unlink()
    (films / "other.mp4").unlink()
    gone = spark.createDataFrame([(str(films / "other.mp4"),)], "path string")
    assert lib.scan_containing(gone, 40) == [folder]
    assert {r.title: r.missing_since for r in lib.library().collect()} == {"Blue Moon": None, "Other": 40}
    assert [r.origin for r in lib.table("subtitle_track").collect()] == ["stream"] and lib.table("cue").count() == 2
    assert lib.table("film").where(F.col("id") == moon.id).first().cover_path == "/mine.png"
    (tmp_path / "extra.srt").write_text(SRT)
    lib.attach(moon.id, str(tmp_path / "extra.srt"), 50)
    assert lib.table("subtitle_track").where("match_kind = 'by-hand'").first().cue_count == 2
    lib.remove_folder(folder)
    assert all(lib.table(t).count() == 0 for t in ("film", "subtitle_track", "cue", "playback_position", "watched_folder"))


@pytest.fixture
def small(spark, tmp_path):
    """A library of one folder with one film and a subtitle beside it, scanned once."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    films = tmp_path / "films"
    (films / "inner").mkdir(parents=True)
    (films / "inner" / "Red.Sun.1971.mkv").write_bytes(b"not matroska")
    (films / "inner" / "Red.Sun.1971.srt").write_text(SRT)
    lib = Library(spark, str(tmp_path / "lib"), now=1)
    lib.scan(lib.add_folder(str(films), 1), 10)
    return lib, films, lib.table("subtitle_track").first()


def test_an_unplugged_folder_keeps_its_tracks(small):
    lib, films, track = small
    assert lib.correct(track.id, 500, 1.0)
    (films / "inner").rename(films.parent / "away")  # the folder is there and empty
    assert lib.rescan(20) and lib.table("film").first().missing_since == 20
    assert lib.table("subtitle_track").count() == 1 and lib.table("cue").count() == 2
    films.rename(films.parent / "off")  # now it isn't there
    counts = lib.scan(1, 30).first()
    assert lib.table("film").first().missing_since == 20 and lib.table("subtitle_track").count() == 1
    assert counts is None and [tuple(r) for r in lib.left_out.collect()] == [(str(films), "unreadable")]
    (films.parent / "off").rename(films)
    (films.parent / "away").rename(films / "inner")
    lib.rescan(40)
    back = lib.table("subtitle_track").first()
    assert lib.table("film").first().missing_since is None and (back.id, back.offset_ms) == (track.id, 500)


def test_a_folder_that_cannot_be_read_is_not_gone(small, monkeypatch):
    lib, films, track = small
    walked = lib.spark.createDataFrame([(str(films / "inner"), None, None, False)], "path string, size_bytes long, modified_at long, readable boolean")
    walked.write.parquet(str(films.parent / "walk"))
    real = type(lib.spark.read).format
    monkeypatch.setattr(type(lib.spark.read), "format", lambda self, kind: type("R", (), {"load": lambda _, root: lib.spark.read.parquet(str(films.parent / "walk"))})() if kind == "folder" else real(self, kind))
    lib.scan(1, 20)
    assert lib.table("film").first().missing_since is None and lib.table("subtitle_track").first().id == track.id
    assert [r.path for r in lib.left_out.collect()] == [str(films / "inner")]


def test_what_was_paired_by_hand_stays(spark, small):
    lib, films, _ = small
    (films / "odd name.srt").write_text(SRT)
    film = lib.table("film").first()
    lib.attach(film.id, str(films / "odd name.srt"), 20)
    lib.rescan(30)
    own = lib.table("subtitle_track").where("match_kind = 'by-hand'").first()
    assert (own.film_id, own.cue_count) == (film.id, 2)
    (films / "odd name.srt").write_text(SRT + "\n3\n00:00:05,000 --> 00:00:06,000\nMore.\n")
    lib.rescan(40)
    own = lib.table("subtitle_track").where("match_kind = 'by-hand'").first()
    assert (own.film_id, own.cue_count) == (film.id, 3) and lib.table("cue").where(F.col("track_id") == own.id).count() == 3
    tracks = spark.createDataFrame([{**own.asDict(), "film_id": 77, "match_kind": "exact", "language": "fr"}], lib.table("subtitle_track").schema)
    new, _ = mutations.written_tracks(lib.table("subtitle_track"), lib.table("cue"), tracks, lib.table("cue").limit(0))
    kept = new.where(F.col("id") == own.id).first()
    assert (kept.film_id, kept.match_kind, kept.language) == (film.id, "by-hand", "fr")
    (films / "odd name.srt").unlink()
    lib.rescan(50)
    assert lib.table("subtitle_track").where("match_kind = 'by-hand'").count() == 0


def test_a_chosen_track_that_goes_is_no_choice(spark, small, tmp_path):
    lib, films, track = small
    assert lib.choose_track(track.film_id, track.id)
    (films / "inner" / "Red.Sun.1971.srt").unlink()
    assert lib.rescan(20) and lib.table("film").first().chosen_track_id is None
    assert Library(spark, str(tmp_path / "lib"), now=30).table("film").count() == 1


def test_a_subtitle_too_large_is_left_out(small, monkeypatch):
    lib, films, _ = small
    big = films / "inner" / "Red.Sun.1971.fr.srt"
    with open(big, "wb") as f:
        f.truncate((32 << 20) + 1)
    counts = lib.scan(1, 20).first()
    assert counts.read == 0 and lib.table("subtitle_track").count() == 1
    assert (str(big), "too-large") in [tuple(r) for r in lib.left_out.collect()]


def test_a_scan_that_is_stopped_leaves_the_rest_to_the_next(small, monkeypatch):
    lib, films, _ = small
    (films / "inner" / "Red.Sun.1971.fr.srt").write_text(SRT)
    (films / "inner" / "Blue.Sun.1972.mkv").write_bytes(b"not matroska")
    real = lib._scan
    monkeypatch.setattr(lib, "_scan", lambda folder, now: (lib.cancel_scan(), real(folder, now))[1])
    assert lib.scan(1, 20).first().read == 0 and 0 <= lib.scan_progress() < 1
    assert {r.outcome for r in lib.left_out.collect()} == {"stopped"} and lib.left_out.count() == 2
    assert {r.title: r.probed_at for r in lib.table("film").collect()} == {"Red Sun": 10, "Blue Sun": None}
    monkeypatch.setattr(lib, "_scan", real)
    assert lib.scan(1, 30).first().read == 1 and lib.table("subtitle_track").count() == 2
