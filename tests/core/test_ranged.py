"""Files read where they lie, versions of tables, changes as a stream."""

import io
import os
import random
import time
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgrid.operators import alignment, mutations
from reelgrid.sources import audio, folders, matroska, ranged, tables
from reelgrid.sources.shared import Watch
from reelgrid.streaming import changes
from tests.core.test_sources import element, film, indexed


def paths(spark, *names):
    return spark.createDataFrame([(str(n),) for n in names], "path string")


def test_ranged_reads_what_bytes_are(tmp_path):
    raw = random.Random(1).randbytes(3_000_000)
    (tmp_path / "f").write_bytes(raw)
    with ranged.opened(f"file://{tmp_path}/f") as f:
        b, rng = ranged.Ranged(f), random.Random(2)
        assert len(b) == len(raw)
        for _ in range(500):
            i, j = sorted((rng.randrange(len(raw)), rng.randrange(len(raw))))
            j = min(j, i + rng.choice((0, 1, 3, 900, 700_000)))
            assert b[i] == raw[i] and b[i:j] == raw[i:j]
        assert b[-5:] == raw[-5:] and len(b.pages) <= ranged.PAGES


def test_a_huge_film_is_described_from_a_few_pages(spark, tmp_path):
    whole = film()
    with open(tmp_path / "film.mkv", "wb") as f:  # what follows the headers is a hole of 4 GiB, in a segment of unknown size
        at = whole.index(matroska.SEGMENT.to_bytes(4, "big"))
        f.write(whole[:at] + matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + whole[at + 12 :])
        f.truncate(4 << 30)
    (tmp_path / "small.mkv").write_bytes(whole)
    (tmp_path / "other.mkv").write_bytes(b"not a film")
    got = {os.path.basename(r.path): r for r in matroska.probe(paths(spark, *(tmp_path / n for n in ("film.mkv", "small.mkv", "other.mkv", "none.mkv")))).collect()}
    for name in ("film.mkv", "small.mkv"):
        assert (got[name].outcome, got[name].duration_ms, [s.stream_number for s in got[name].subtitles]) == ("ok", 90_000, [3])
        assert got[name].bytes_read < 4096 and got[name].tracks_left_out == 0
    assert got["other.mkv"].outcome == "not-matroska" and got["none.mkv"].outcome == "unreadable"


def test_dialogue_and_artwork_by_ranges(spark, tmp_path, monkeypatch):
    (tmp_path / "a.mkv").write_bytes(film())
    some = paths(spark, tmp_path / "a.mkv", tmp_path / "gone.mkv")
    assert [(r.ordinal, r.start_ms, r.text) for r in matroska.dialogue(some).orderBy("ordinal").collect()] == [(1, 4750, "Tôt."), (2, 5250, "Later.")]
    assert [(r.name, bytes(r.content)) for r in matroska.artwork(some).collect()] == [("cover.jpg", b"\xff\xd8\xffpicture")]
    assert matroska.dialogue_left_out(some).count() == 0
    monkeypatch.setattr(matroska, "CUE_LIMIT", 1)
    missed: dict = {}
    assert len(matroska.dialogue_of(film(), missed)) == 1 and missed == {(3, "more-cues"): 1}
    monkeypatch.setattr(matroska, "TRACK_LIMIT", 0)
    assert matroska.described(film())["tracks_left_out"] == 1
    assert element(0xA3, b"x")[-1:] == b"x"


@pytest.mark.parametrize(("rate", "width", "channels"), [(8000, 2, 1), (16_000, 1, 2), (44_100, 3, 1), (600, 2, 1)])
def test_streamed_energy_equals_that_of_the_whole_file(spark, tmp_path, rate, width, channels):
    rng = np.random.default_rng(rate)
    raw = rng.integers(0, 256, width * channels * (3 * audio.STEP + 777), np.uint8).tobytes()
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate)
        w.writeframes(raw)
    (tmp_path / "a.wav").write_bytes(out.getvalue())
    _, want = audio.energy_of(out.getvalue())
    got = audio.energy_at(paths(spark, tmp_path / "a.wav")).groupBy("bin").agg(F.sum("sum_sq").alias("s"), F.sum("n").alias("n")).orderBy("bin").collect()
    assert [(r.bin, r.n) for r in got] == [(b, n) for b, _, n in want]
    assert np.allclose([r.s for r in got], [s for _, s, _ in want], rtol=1e-6, atol=1e-9)
    assert alignment.levels(audio.energy_at(paths(spark, tmp_path / "a.wav"))).count() == len(want)


def test_energy_outcomes(spark, tmp_path):
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    with wave.open(str(tmp_path / "empty.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000)
    got = {os.path.basename(r.film): r.outcome for r in audio.energy_at(paths(spark, *(tmp_path / n for n in ("bad.wav", "empty.wav", "gone.wav")))).collect()}
    assert got == {"bad.wav": "unreadable", "empty.wav": "no-audio", "gone.wav": "unreadable"}
    with wave.open(str(tmp_path / "full.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(bytes(4 * audio.STEP))
    asked = iter([False, True])
    with open(tmp_path / "full.wav", "rb") as f:
        assert [o for o, _ in audio.streamed_energy(f, lambda: next(asked))] == ["ok", "stopped"]


def test_small_files_are_read_whole_or_refused(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"abc")
    got = {os.path.basename(r.path): (r.outcome, r.content) for r in ranged.contents(paths(spark, tmp_path / "a", tmp_path / "b"), most=3).collect()}
    assert got == {"a": ("ok", bytearray(b"abc")), "b": ("unreadable", None)}
    assert ranged.contents(paths(spark, tmp_path / "a"), most=2).first().outcome == "too-large"


def test_folder_parts_hold_every_file_once(spark, tmp_path):
    folders.register(spark)
    names = ["top.mkv", "a/1.mkv", "a/b/2.mkv", "a/b/c/3.mkv", "a/d/4.srt", "e/5.mkv", "_f/6.mkv", ".hidden/7.mkv", "@eaDir/8.mkv"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"x")
    (tmp_path / os.fsdecode(b"bad\xff.mkv")).write_bytes(b"x")
    got = sorted(os.path.relpath(r.path, tmp_path) for r in spark.read.format("folder").load(str(tmp_path)).collect())
    assert got == sorted(names[:7])


def test_changes_under_a_folder_are_a_stream(spark, tmp_path):
    folders.register(spark)
    root, seen = tmp_path / "films", []
    (root / "a").mkdir(parents=True)
    (root / "a" / "old.mkv").write_bytes(b"x")
    since = time.time_ns() // 1_000_000
    time.sleep(0.05)
    stream = spark.readStream.format("folder-changes").option("since", str(since)).load(str(root))
    watched = lambda: spark.createDataFrame([(1, str(root / "a")), (2, str(root / "b"))], "id long, path string")
    query = changes.refreshed(stream.select("path"), watched, lambda touched, n: seen.append(sorted(r.id for r in touched.collect())), str(tmp_path / "check"))
    try:
        (root / "a" / "new.mkv").write_bytes(b"y")
        until = time.time() + 60
        while not seen and time.time() < until:
            time.sleep(0.3)
        (root / "b").mkdir()
        (root / "b" / "more.srt").write_bytes(b"z")
        while not any(2 in s for s in seen) and time.time() < until:
            time.sleep(0.3)
    finally:
        query.stop()
    assert seen and 1 in seen[0] and any(2 in s for s in seen)


def test_one_job_at_a_time(spark):
    one = changes.OneAtATime(spark, "alignment")
    with pytest.raises(RuntimeError):
        one.run(lambda: one.run(lambda: 1))
    assert one.run(lambda: spark.range(3).count()) == 3
    one.cancel()


def test_store_keeps_the_last_whole_version(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path / "lib"))
    assert store.read("preference").count() == 0 and store.version("preference") == 0
    for k in range(3):
        store.write("preference", spark.createDataFrame([(f"k{i}", str(k)) for i in range(k + 1)], "key string, value string"))
    (tmp_path / "lib" / "preference" / "version=9").mkdir()  # a writer that failed
    assert store.version("preference") == 3 and store.read("preference").count() == 3
    assert not (tmp_path / "lib" / "preference" / "version=1").exists()


def files_of(root, name):
    return {p.relative_to(root): p.stat().st_mtime_ns for p in (root / name).rglob("*.parquet")}


def test_a_change_writes_its_bucket_only(spark, tmp_path):
    root = tmp_path / "lib"
    store = tables.Store(spark, str(root), buckets=8)
    cues = spark.range(400).select((F.col("id") % 40).alias("track_id"), F.col("id").cast("int").alias("ordinal"), F.col("id").alias("start_ms"), (F.col("id") + 5).alias("end_ms"), F.lit(None).cast("int").alias("position"), F.lit("a").alias("text"))
    store.commit({"cue": cues, "preference": spark.createDataFrame([("a", "1")], "key string, value string")})
    before = files_of(root, "cue")
    one = spark.createDataFrame([(7,)], "id long")
    n = store.commit({"cue": store.part("cue", one, lambda rows: rows.withColumn("text", F.when(F.col("track_id") == 7, "b").otherwise(F.col("text"))))})
    fresh = set(files_of(root, "cue")) - set(before)
    assert fresh and len({p.parts[2] for p in fresh}) == 1 and before.items() <= files_of(root, "cue").items()
    assert {(r.text, r.n) for r in store.read("cue").groupBy("text").agg(F.count("*").alias("n")).collect()} == {("a", 390), ("b", 10)}
    store.commit({"cue": tables.Part(store.read("cue", []), store.buckets_of("cue", one))})  # a bucket that is empty now
    assert store.read("cue").where("track_id = 7").count() == 0 and store.read("preference").count() == 1 and store.version("cue") == n + 1
    store.commit({"cue": store.part("cue", spark.createDataFrame([(8,)], "id long"), lambda rows: rows)})
    assert all(store._paths("cue", store.current()[1]["tables"]["cue"])) and len(list((root / "_commits").glob("[0-9]*"))) == 2


def test_tables_change_together_or_not_at_all(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path / "lib"), buckets=4)
    prefs = lambda v: spark.createDataFrame([("a", v)], "key string, value string")
    films = spark.createDataFrame([(1, "/f")], "id long, path string")
    store.commit({"preference": prefs("1"), "film": films}, "one")

    @F.udf("string")
    def broken(x):
        raise ValueError(x)

    with pytest.raises(Exception, match="broken|ValueError"):
        store.commit({"preference": prefs("2"), "film": films.withColumn("path", broken("path"))})
    assert store.read("preference").first().value == "1" and store.read("film").first().path == "/f"
    at = store.version("preference")
    assert store.commit({"preference": prefs("3")}, "one") == at and store.read("preference").first().value == "1"  # a batch that is tried again
    assert store.commit({"preference": prefs("3")}, "two") == at + 1 and store.read("preference").first().value == "3"
    with pytest.raises(tables.Conflict):
        store._publish(at + 1, {})


def test_packs_are_bounded_and_repeatable(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([0, 10, 900, 25_000])) for i in rng.sample(range(200_000), 500)]
    tracks = spark.createDataFrame(rows, "id long, cue_count long")
    got = [r for r in mutations.packed(tracks).sort("id").collect()]
    assert got == mutations.packed(tracks.repartition(7)).sort("id").collect()
    packs = {}
    for r in got:
        packs.setdefault(r.pack, []).append(r.cue_count)
    assert list(packs) == sorted(packs) and all(len(p) <= 64 and sum(p[:-1]) < 20_000 for p in packs.values()) and len(packs) > 50


def test_migrations_run_once_and_refuse_what_is_newer(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path / "lib"))
    old = spark.createDataFrame([(1, 1, "/a/f.mkv", "f")], "id long, folder_id long, path string, title string")
    old.write.parquet(f"{tmp_path}/lib/film/version=1")
    spark.createDataFrame([(1, "/a", 1)], tables.SCHEMAS["watched_folder"]).write.parquet(f"{tmp_path}/lib/watched_folder/version=1")
    assert store.migrate(5) == len(tables.MIGRATIONS) and store.migrate(6) == 0
    assert store.read("film").first().cover_source == "none"
    assert [(r.version, r.applied_at) for r in store.read("schema_migration").orderBy("version").collect()] == [(i + 1, 5) for i in range(len(tables.MIGRATIONS))]
    store.write("film", store.read("film").withColumn("folder_id", F.lit(7)))
    assert tables.dangling(store.read) == {("film", "folder_id"): 1}
    with pytest.raises(tables.Broken):
        store.migrate(7)
    store.write("schema_migration", spark.createDataFrame([(99, "later", 1)], tables.SCHEMAS["schema_migration"]))
    with pytest.raises(tables.Newer):
        store.migrate(8)
    twice = spark.createDataFrame([("/a", 1), ("/a", 2)], "path string, id long")
    assert [tuple(r) for r in tables.repeated(twice, tables.UNIQUE["watched_folder"]).collect()] == [("/a", 2)]


def test_reports_are_lines_of_json(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, 0.5), (2, "x", None)], "a long, b string, c double")
    tables.write_report(rows, f"{tmp_path}/r")
    assert sorted(map(tuple, tables.read_report(spark, f"{tmp_path}/r", "a long, b string, c double").collect())) == sorted(map(tuple, rows.collect()))
    text = "".join(open(tmp_path / "r" / n).read() for n in os.listdir(tmp_path / "r") if n.endswith(".json"))
    assert '"b":null' in text


def a_wav(path, seconds, rate=8000):
    x = (np.sin(np.arange(seconds * rate) * 0.9) * 9000 + np.random.default_rng(3).normal(0, 2000, seconds * rate)).astype("<i2")
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(x.tobytes())


def test_sums_of_ranges_are_those_of_one_pass(spark, tmp_path):
    a_wav(tmp_path / "long.wav", 61)
    a_wav(tmp_path / "short.wav", 1)
    (tmp_path / "broken.wav").write_bytes(b"RIFF")
    a_wav(tmp_path / "none.wav", 0)
    files = paths(spark, *(tmp_path / f"{n}.wav" for n in ("long", "short", "broken", "none", "absent")))
    plan = audio.ranges_of(files, 7)
    assert plan.where(plan.path.endswith("long.wav")).count() == 9
    watch = Watch(spark)
    got = audio.energy_at(files, 7, watch)
    assert got.rdd.getNumPartitions() >= 9
    rows = got.collect()
    assert {(r.film.rsplit("/", 1)[1], r.outcome) for r in rows} == {("long.wav", "ok"), ("short.wav", "ok"), ("broken.wav", "unreadable"), ("none.wav", "no-audio"), ("absent.wav", "unreadable")}
    assert watch.total == 13 and watch.fraction == 1.0
    for name in ("long", "short"):
        sums = {}
        for r in rows:
            if r.film.endswith(f"{name}.wav"):
                s, n = sums.get(r.bin, (0.0, 0))
                sums[r.bin] = s + r.sum_sq, n + r.n
        _, want = audio.energy_of((tmp_path / f"{name}.wav").read_bytes())
        assert [b for b, _, _ in want] == sorted(sums)
        assert all(sums[b][1] == n and abs(sums[b][0] - s) < 1e-9 * max(1.0, s) for b, s, n in want)


def test_a_stopped_reading_says_so(spark, tmp_path):
    a_wav(tmp_path / "a.wav", 20)
    watch = Watch(spark)
    assert watch.fraction == 0.0 and not watch.stopped
    watch.stop()
    rows = audio.energy_at(paths(spark, tmp_path / "a.wav"), 5, watch).collect()
    assert watch.stopped and {r.outcome for r in rows} == {"stopped"} and len(rows) == 4
    running = Watch(spark)
    stop = running.begun(2)
    parts = audio.streamed_energy(open(tmp_path / "a.wav", "rb"), stop)
    assert next(parts)[0] == "ok"
    running.stop()
    assert next(parts)[0] == "stopped"
    running.done.add(1)
    assert 0 < running.fraction < 1


def heading():
    number = lambda i, v: element(i, v.to_bytes(2, "big"))
    info = element(matroska.INFO, number(matroska.SCALE, 1000) + element(matroska.DURATION, np.array(5e6, ">f8").tobytes()))
    return info, element(matroska.TRACKS, element(matroska.ENTRY, number(matroska.NUMBER, 1) + number(matroska.TYPE, 1) + element(matroska.CODEC, b"V_TEST")))


def test_parts_behind_the_frames_are_found_by_the_index(spark, tmp_path):
    """4 GiB of frames that aren't there: a sparse file."""
    info, tracks = heading()
    frames = 4 << 30
    head = lambda i, n: i.to_bytes(4, "big") + (n | 1 << 56).to_bytes(8, "big")
    index = indexed((matroska.INFO, info), (matroska.TRACKS, b""), said={matroska.TRACKS: 0})
    behind = len(index) + 12 + frames
    index = indexed((matroska.INFO, info), (matroska.TRACKS, b""), said={matroska.TRACKS: behind})
    with open(tmp_path / "big.mkv", "wb") as f:
        f.write(element(0x1A45DFA3, b"") + head(matroska.SEGMENT, behind + len(tracks)) + index + head(matroska.CLUSTER, frames))
        f.seek(frames, 1)
        f.write(tracks)
    row = matroska.probe(paths(spark, tmp_path / "big.mkv")).first()
    assert (row.outcome, row.video_codec_id, row.duration_ms, row.parts_refused) == ("ok", "V_TEST", 5000, 0) and row.bytes_read < 4096


def test_an_index_is_a_hint_and_large_parts_are_refused(monkeypatch):
    info, tracks = heading()
    cluster = element(matroska.CLUSTER, b"")
    whole = lambda body: element(0x1A45DFA3, b"") + element(matroska.SEGMENT, body)
    wrong = whole(indexed((matroska.INFO, info), (matroska.TRACKS, tracks), said={matroska.TRACKS: 3}))
    assert matroska.described(wrong)["tracks"][0]["codec_id"] == "V_TEST"  # walked to instead
    assert matroska.described(whole(info + cluster + tracks))["tracks"] == []  # behind the frames, and no index
    far = indexed((matroska.INFO, info), (matroska.SEEK_HEAD, b""), said={matroska.SEEK_HEAD: 0})
    far = indexed((matroska.INFO, info), (matroska.SEEK_HEAD, b""), said={matroska.SEEK_HEAD: len(far) + len(cluster)})
    second = element(matroska.SEEK_HEAD, element(matroska.SEEK, element(matroska.SEEK_ID, matroska.TRACKS.to_bytes(4, "big")) + element(matroska.SEEK_POSITION, (len(far) + len(cluster) + 12 + 12 + 8 + 40).to_bytes(8, "big"))))
    at = len(far) + len(cluster) + len(second)
    second = element(matroska.SEEK_HEAD, element(matroska.SEEK, element(matroska.SEEK_ID, matroska.TRACKS.to_bytes(4, "big")) + element(matroska.SEEK_POSITION, at.to_bytes(8, "big"))))
    assert matroska.described(whole(far + cluster + second + tracks))["tracks"][0]["codec_id"] == "V_TEST"  # an index that the first one names
    monkeypatch.setitem(matroska.PART_LIMIT, matroska.TRACKS, 4)
    found = matroska.described(whole(info + tracks))
    assert (found["tracks"], found["parts_refused"], found["duration_ms"]) == ([], 1, 5000)
