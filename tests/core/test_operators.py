import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgrid.operators import alignment, correlation, intervals, pairing, upserts
from reelgrid.streaming import changes


@pytest.mark.parametrize("offset, rate", [(0, 1.0), (2000, 1.0), (-4500, 1.0), (30_000, 1.0), (500, 25 / 23.976)])
def test_alignment_undoes_a_known_correction(offset, rate):
    gaps = 1400 + np.arange(1200) % 7 * 900
    starts = 30_000 + np.cumsum(gaps)
    ends = starts + 900 + np.arange(1200) % 5 * 400
    film = correlation.united(starts // 10, ends // 10, int(ends.max()) // 10 + 6000)
    found = alignment.found_correction(((starts - offset) / rate).astype(np.int64), ((ends - offset) / rate).astype(np.int64), film)
    assert abs(found["offset_ms"] - offset) <= 60 and abs(found["rate"] - rate) < 1e-4, found


def in_bins(signal):
    out = np.zeros(signal.length, bool)
    for a, b in zip(signal.starts, signal.ends, strict=True):
        out[a:b] = True
    return out


def test_correlation_of_runs_equals_that_of_bins():
    """Against a Fourier transform of the bins, for random runs that overlap, touch or leave the signal."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        n, m = (int(x) for x in rng.integers(5, 400, 2))
        starts = [rng.integers(-20, k, int(rng.integers(1, 30))) for k in (n, m)]
        a, b = (correlation.united(s, s + rng.integers(0, 30, len(s)), k) for s, k in zip(starts, (n, m), strict=True))
        assert (np.diff(np.stack((a.starts, a.ends), 1).ravel()) > 0).all()
        if a.flat or b.flat:
            assert correlation.peaks(a, b, 5, 1) == []
            continue
        x, y, window = in_bins(a) - in_bins(a).mean(), in_bins(b) - in_bins(b).mean(), int(rng.integers(1, max(n, m)))
        size = n + m + window + 1
        c = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size)), size) / np.sqrt((x @ x) * (y @ y))
        assert np.allclose(correlation.correlations(a, b, window), np.concatenate((c[-window:], c[: window + 1])), atol=1e-9)
        at, size = int(rng.integers(-50, n)), int(rng.integers(1, 200))
        part = np.concatenate((np.zeros(50, bool), in_bins(a), np.zeros(400, bool)))[at + 50 : at + 50 + size]
        assert (in_bins(correlation.clipped(a, at, size)) == part).all()


def test_alignment_of_an_empty_track_says_nothing():
    none = np.zeros(0, np.int64)
    assert not alignment.found_correction(none, none, correlation.united(none, none, 1000))["score"]


def test_upsert_keeps_what_is_known(spark):
    stored = spark.createDataFrame([(1, "a", 10), (2, "b", None), (3, "c", 30)], "id int, name string, ms int")
    fresh = spark.createDataFrame([(1, "a", None), (2, "b", 20), (4, "d", None)], "id int, name string, ms int")
    got = {r.id: (r.name, r.ms, r.changed) for r in upserts.upserted(stored, fresh, ["id"], ["name"], ["ms"]).collect()}
    assert got == {1: ("a", 10, False), 2: ("b", 20, True), 3: ("c", 30, False), 4: ("d", None, True)}


def test_missing_stamps_stay(spark):
    stored = spark.createDataFrame([("a", None), ("b", 5), ("c", None)], "path string, missing_since long")
    present = spark.createDataFrame([("a",)], "path string")
    assert {r.path: r.missing_since for r in upserts.marked_missing(stored, present, "path", 9).collect()} == {"a": None, "b": 5, "c": 9}


def test_pairing(spark):
    films = spark.createDataFrame([(1, "thematrix", ["the", "matrix"], 1999), (2, "up", ["up"], None), (3, "alien", ["alien"], 1979), (4, "alien", ["alien"], 1979)], "film long, key string, words array<string>, year int")
    subs = spark.createDataFrame(
        [(1, "thematrix", ["the", "matrix"], None), (2, "thematrix", ["the", "matrix"], 2003), (3, "alien", ["alien"], None), (4, "thematrixextended", ["the", "matrix", "extended"], 1999), (5, "upagain", ["up", "again"], None), (6, None, None, None)],
        "subtitle long, key string, words array<string>, year int",
    )
    got = {r.subtitle: (r.film, r.match) for r in pairing.paired(subs, films).collect()}
    assert got == {1: (1, "exact"), 4: (1, "approximate")}
    assert {r.subtitle for r in pairing.unpaired(subs, pairing.paired(subs, films)).collect()} == {2, 3, 5, 6}


def test_intervals_over_an_empty_table(spark):
    none = spark.createDataFrame([], "k string, a long, b long")
    assert intervals.merged_runs(none, ["k"], "a", "b", 5, 0).count() == 0
    assert intervals.running_end(none, ["k"], "a", "b").count() == 0
    assert intervals.islands(none, ["k"], "a", 5, 0).count() == 0


def test_active_interval_is_half_open(spark):
    spans = spark.createDataFrame([("x", 1000, 4000), ("x", 2000, 3000), ("x", 5000, 5000)], "k string, a long, b long")
    points = spark.createDataFrame([("x", t) for t in (999, 1000, 2500, 3000, 3999, 4000, 5000)], "k string, t long")
    got = {r.t: r.a for r in intervals.active_at(points, spans, ["k"], "t", "a", "b", 1000).collect()}
    assert got == {999: None, 1000: 1000, 2500: 2000, 3000: 1000, 3999: 1000, 4000: None, 5000: None}


def test_sessions_are_cut_by_patience(spark):
    rows = [("x", t) for t in (0, 100, 200, 1000, *range(5000, 40_000, 200))]
    got = [tuple(r) for r in changes.sessions(spark.createDataFrame(rows, "k string, t long"), "k", "t", 300, 30_000).orderBy("first").collect()]
    assert got[:2] == [("x", 0, 200, 3), ("x", 1000, 1000, 1)]
    assert sum(r[3] for r in got) == len(rows) and all(r[2] - r[1] < 30_000 for r in got) and len(got) == 4


def test_sessions_equal_a_walk(spark):
    rng = random.Random(9)
    rows = [(k, rng.randrange(60_000 if k == "dense" else 3_000_000)) for k in ("dense", "thin", None) for _ in range(700)] + [("dense", None)]
    want = []
    for k in ("dense", "thin", None):
        first = last = None
        for t in sorted(t for j, t in rows if j == k and t is not None):
            if first is None or t - last >= 900 or t - first >= 5000:
                first = t
                want.append([k, t, t, 0])
            last = want[-1][2] = t
            want[-1][3] += 1
    got = changes.sessions(spark.createDataFrame(rows, "k string, t long"), "k", "t", 900, 5000).where("k IS NOT NULL").collect()
    assert sorted(map(list, got)) == sorted(w for w in want if w[0])
    assert changes.sessions(spark.createDataFrame([], "k string, t long"), "k", "t", 900, 5000).count() == 0


def test_stream_of_counts_and_batches(spark, tmp_path):
    source, seen = tmp_path / "in", []
    rows = spark.range(60).select(F.timestamp_millis(F.col("id") * 30_000).alias("ts"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"))
    rows.write.parquet(str(source))
    stream = spark.readStream.schema(rows.schema).parquet(str(source))
    query = changes.into(changes.windowed_counts(stream, "ts", "10 minutes", None, "1 minute", "kind"), lambda df, n: seen.extend(map(tuple, df.select("kind", "n").collect())), str(tmp_path / "checkpoint"))
    query.processAllAvailable()
    query.stop()
    assert sorted(seen) == [("a", 7), ("a", 7), ("b", 13), ("b", 13)]


def test_settled_paths_of_a_stream(spark, tmp_path):
    source, seen = tmp_path / "in", []
    spark.createDataFrame([("f", "f/b"), ("f", "f/a"), ("f", "f/a"), ("g", "g/c")], "folder string, path string").write.parquet(str(source))
    stream = spark.readStream.schema("folder string, path string").parquet(str(source))
    query = changes.into(changes.settled(stream, 1), lambda df, n: seen.extend(map(tuple, df.collect())), str(tmp_path / "checkpoint"))
    until = time.time() + 60
    while len(seen) < 3 and time.time() < until:  # a stream with timeouts never runs out of work
        time.sleep(0.2)
    query.stop()
    assert sorted(seen) == [("f", "f/a"), ("f", "f/b"), ("g", "g/c")]
