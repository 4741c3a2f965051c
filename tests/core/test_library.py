"""Operators of the library against plain versions, and what they refuse."""

import colorsys
import math
import random

import pytest
from pyspark.sql import functions as F

from reelgrid.functions import labels, text
from reelgrid.operators import catalogue, covers, intervals, library, mutations, pairing


def test_stabbing_keeps_repeated_points(spark):
    points = spark.createDataFrame([("a", 5, 1), ("a", 5, 1), ("a", 50, 2), ("b", 5, 3)], "k string, t long, x long")
    spans = spark.createDataFrame([("a", 0, 10), ("a", 4, 6), ("a", 5, 5)], "k string, s long, e long")
    got = sorted(map(tuple, intervals.active_at(points, spans, ["k"], "t", "s", "e", 7).collect()), key=str)
    assert got == sorted([("a", 5, 1, 4, 6), ("a", 5, 1, 4, 6), ("a", 50, 2, None, None), ("b", 5, 3, None, None)], key=str)


def test_beginnings_equal_all_pairs(spark):
    rng = random.Random(4)
    words = lambda: [rng.choice(["the", "a", "long", "way", "home"]) for _ in range(rng.randint(1, 4))]
    subs, films = [(i, words(), rng.choice([None, 1, 2])) for i in range(60)], [(i, words(), rng.choice([None, 1, 2])) for i in range(40)]
    want = []
    for s, a, y in subs:
        met = {}
        for f, b, z in films:
            n = min(len(a), len(b))
            if a[:n] == b[:n] and (y is None or z is None or y == z) and (n > 1 or len(a[0]) >= 4):
                met.setdefault(n, set()).add(f)
        if met and len(met[max(met)]) == 1:
            want.append((s, min(met[max(met)]), max(met)))
    got = pairing.by_beginning(spark.createDataFrame(subs, "subtitle long, words array<string>, year int"), spark.createDataFrame(films, "film long, words array<string>, year int"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_search_finds_what_folding_finds(spark):
    rows = ["Crème Brûlée", "CREME", "ÇREME", "crèmes Ω", "İcreme", "ﬁne crème", None, "", "кремe", "x" * 50 + "Crėme"]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, t string").repartition(3)
    want = [i for i, t in enumerate(rows) if t and "creme" in text.fold_text(t)]
    assert sorted(map(tuple, library.search(df, "t", " Crème ", "id").collect())) == [(i, len(want)) for i in want]
    assert [r.id for r in library.search(df, "t", "creme", "id", shown=2).collect()] == want[:2]
    assert library.search(df, "t", "  ", "id").count() == 0 and library.search(df.limit(0), "t", "x", "id").count() == 0


def plain_accent(pixels):
    bins = {}
    for r, g, b, alpha in pixels:
        h, l, s = colorsys.rgb_to_hls(r / 255, g / 255, b / 255)
        if alpha < 128 or not 0.06 <= l <= 0.95 or s < 0.1:
            continue
        w = bins.setdefault(min(23, int(h * 24)), [0.0] * 5)
        for i, x in enumerate((s, s * s, s * l, s * math.cos(2 * math.pi * h), s * math.sin(2 * math.pi * h))):
            w[i] += x
    if not bins:
        return None

    def colour(hue, s, l):
        r, g, b = colorsys.hls_to_rgb(hue % 1, min(0.70, max(0.44, l)), min(0.82, max(0.34, s)))
        return "#" + "".join(f"{math.floor(x * 255 + 0.5):02x}" for x in (r, g, b))

    of = lambda w: (math.atan2(w[4], w[3]) / (2 * math.pi), w[1] / w[0], w[2] / w[0])
    first = max(bins, key=lambda k: (bins[k][0], -k))
    far = [k for k in bins if min(abs(k - first), 24 - abs(k - first)) >= 4]
    primary = colour(*of(bins[first]))
    if far:
        return primary, colour(*of(bins[max(far, key=lambda k: (bins[k][0], -k))]))
    h, l, s = colorsys.rgb_to_hls(*(int(primary[i : i + 2], 16) / 255 for i in (1, 3, 5)))
    return primary, colour(h + 1 / 3, s, l)


def test_accents_equal_plain_sums(spark):
    rng = random.Random(8)
    pictures = {f: [(rng.randrange(256), rng.randrange(256) if f % 3 else 10, rng.randrange(256) if f % 2 else 20, rng.choice([255, 255, 0])) for _ in range(40)] for f in range(12)}
    pictures[50] = [(9, 9, 9, 255), (200, 200, 200, 255)]
    df = spark.createDataFrame([(f, *p) for f, px in pictures.items() for p in px], "film long, red int, green int, blue int, alpha int")
    got = {r.film: (r.primary, r["pair"]) for r in labels.accents(df, "film").collect()}
    channels = lambda c: [int(c[i : i + 2], 16) for i in (1, 3, 5)]
    assert set(got) == set(range(12))
    for f, found in got.items():
        for a, b in zip(found, plain_accent(pictures[f]), strict=True):
            assert all(abs(x - y) <= 1 for x, y in zip(channels(a), channels(b), strict=True)), (f, found)


def test_poster_names_follow_every_part(spark):
    rows = [("/a", 1, None), ("/a", 2, None), ("/a", 1, "/c"), ("", 0, None), (None, None, None)]
    df = spark.createDataFrame(rows, "p string, m long, c string")
    got = [r.n for r in df.select(labels.poster_name(F.col("p"), F.col("m"), F.col("c")).alias("n")).collect()]

    def fnv(data):
        h = 0xCBF29CE484222325
        for byte in data:
            h = (h ^ byte) * 0x100000001B3 % 2**64
        return f"{h:016x}.webp"

    assert got == [fnv((p or "").encode() + (m or 0).to_bytes(8, "little") + (c or "").encode()) for p, m, c in rows]


def test_stepping_through_lines(spark):
    lines = spark.createDataFrame([("f", 1000, 1500), ("f", 5000, 6000), ("f", 90_000, 91_000)], "k string, s long, e long")
    at = spark.createDataFrame([("f", t) for t in (500, 1000, 1300, 5399, 5400, 40_000, 95_000, 200_000)], "k string, t long")
    got = {r.t: (r.previous_ms, r.next_ms) for r in catalogue.stepped(at, lines, ["k"], "t", "s").collect()}
    assert got == {500: (None, 1000), 1000: (None, 5000), 1300: (None, 5000), 5399: (1000, 90_000), 5400: (5000, 90_000), 40_000: (5000, 90_000), 95_000: (90_000, None), 200_000: (90_000, None)}
    first = spark.createDataFrame([("f", 1000), ("f", 300_000)], "k string, t long")
    late = spark.createDataFrame([("f", 9000, 9500), ("f", 300_000, 300_500)], "k string, s long, e long")
    assert {r.t: r.line_ms for r in catalogue.nearest_within(first, late, ["k"], "t", "s", "e").collect()} == {1000: 9000, 300_000: 300_000}  # nothing before the first
    near = {r.t: r.line_ms for r in catalogue.nearest_within(at, lines, ["k"], "t", "s", "e").collect()}
    assert near == {500: None, 1000: 1000, 1300: 1000, 5399: 5000, 5400: 5000, 40_000: None, 95_000: 90_000, 200_000: None}


TRACK = "id long, film_id long, path string, origin string, stream_number long, codec string, language string, forced boolean, hearing_impaired boolean, match_kind string, encoding string, cue_count long, size_bytes long, modified_at long, offset_ms int, rate double"
CUE = "track_id long, ordinal int, start_ms long, end_ms long, position int, text string"


def test_attaching_by_hand(spark):
    tracks = spark.createDataFrame([(1, 7, "/s/a.srt", "sidecar", 0, "subrip", None, False, False, "exact", "utf-8", 1, 1, 1, 500, 1.5)], TRACK)
    cues = spark.createDataFrame([(1, 1, 0, 10, None, "old")], CUE)
    films = spark.createDataFrame([(7,), (8,)], "id long")
    again = tracks.withColumns({"cue_count": F.lit(2).cast("long")})
    new = spark.createDataFrame([(1, 1, 5, 10, None, "new"), (1, 2, 20, 30, None, "more")], CUE)
    t, c = mutations.attached(tracks, cues, films, 8, again, new)
    (row,) = t.collect()
    assert (row.film_id, row.match_kind, row.offset_ms, row.rate, row.cue_count) == (8, "by-hand", 0, 1.0, 2)
    assert sorted(r.text for r in c.collect()) == ["more", "new"]
    for film, path in ((9, "/s/a.srt"), (8, "/s/a.txt")):
        with pytest.raises(mutations.Refused):
            mutations.attached(tracks, cues, films, film, again.withColumn("path", F.lit(path)), new)


def test_new_ids_are_numbered_on(spark):
    stored = spark.createDataFrame([(4, "/a"), (9, "/b")], "id long, path string")
    fresh = spark.createDataFrame([(None, p, i) for i, p in enumerate(["/b", "/c", "/d", "/c", "/a"])], "id long, path string, x long")
    got = mutations.numbered_ids(stored, fresh, ["path"], buckets=2).collect()
    ids = {r.path: r.id for r in got}
    assert len(got) == 5 and ids["/a"] == 4 and ids["/b"] == 9 and sorted(ids.values()) == [4, 9, 10, 11]
    assert mutations.numbered_ids(stored.limit(0), fresh, ["path"]).agg(F.max("id")).first()[0] == 4


def test_covers_from_a_folder_and_posters_wanted(spark):
    films = spark.createDataFrame([("/f/Blue Moon (1999).mkv", "bluemoon", 1999), ("/f/Other.mkv", "other", None)], "film string, key string, year int")
    jpeg = b"\xff\xd8\xff\xe0"
    pictures = spark.createDataFrame([("/p/blue.moon.1999.jpg", jpeg), ("/p/other.png", b"text"), ("/p/Blue Moon 2001.jpg", jpeg)], "path string, content binary")
    assert [(r.film, r.cover.path, r.cover.source) for r in covers.from_folder(films, pictures).collect()] == [("/f/Blue Moon (1999).mkv", "/p/blue.moon.1999.jpg", "chosen")]
    rows = [(i, f"/f/{i}", 5, None, None, None if i != 3 else 1) for i in range(4)]
    table = spark.createDataFrame(rows, "id long, path string, modified_at long, cover_path string, poster_path string, missing_since long")
    have = table.withColumn("w", F.concat(F.lit("/cache/"), labels.poster_name(F.col("path"), F.col("modified_at"), F.col("cover_path"))))
    table = have.withColumn("poster_path", F.when(F.col("id") < 2, F.col("w"))).drop("w")
    cached = have.where("id = 0").select(F.col("w").alias("path"))
    assert sorted(r.id for r in covers.posters_wanted(table, cached, "/cache/").collect()) == [1, 2]
    odd = spark.createDataFrame([("/a.nfo", "<thumb>x</thumb>" * 9), ("/b.nfo", "x" * 70_000), ("/c.nfo", "")], "path string, text string")
    assert sorted(map(tuple, covers.refused_sidecars(odd).collect())) == [("/a.nfo", "more-thumbs"), ("/b.nfo", "too-large")]
