"""Jobs whose cost would be the square of a group, or whose tables would go to the driver, don't end or don't pass here."""

from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelgrid.functions import labels, text, timing
from reelgrid.operators import alignment, evaluation, intervals, pairing
from reelgrid.plans import film_queries
from reelgrid.streaming import changes

MANY = 100_000


def plan(rows) -> str:
    return rows._jdf.queryExecution().toString()


def test_signals_meet_without_a_broadcast(spark):
    a = [(k % 3, k * k % 211) for k in range(60)]
    b = [(k % 3, k * k * 7 % 301) for k in range(80)]
    one, two = (spark.createDataFrame(sorted(set(x)), "user long, bin long") for x in (a, b))
    got = alignment.lag_products(one, two, ["user"], "bin", 9)
    want = defaultdict(int)
    for u, x in set(a):
        for v, y in set(b):
            if u == v and abs(y - x) <= 9:
                want[u, y - x] += 1
    assert {(r.user, r.lag): r.n for r in got.collect()} == want
    assert "Broadcast" not in plan(got)


def test_levels_of_links_halve(spark, monkeypatch):
    times = sorted({k * 7919 % 400_000 for k in range(6000)} | {900_000, 900_003})
    counts, write = [], changes.written

    def counted(rows, name):
        out = write(rows, name)
        counts.append(out.count() if name == "links" else 0)
        return out

    monkeypatch.setattr(changes, "written", counted)
    got = changes.sessions(spark.createDataFrame([("a", t) for t in times], "k string, ms long"), "k", "ms", 1000, 3000)
    want, first = [], None
    for i, t in enumerate(times):
        if first is None or t - times[i - 1] >= 1000 or t - first >= 3000:
            first = t
            want.append([first, t, 0])
        want[-1][1:] = t, want[-1][2] + 1
    assert sorted((r["first"], r["last"], r["n"]) for r in got.collect()) == sorted(map(tuple, want))
    assert sum(counts) < 3 * len(times)


@pytest.mark.parametrize("width", [None, 1000])
def test_no_window_is_open_ahead(spark, width):
    rows = spark.createDataFrame([(1, t) for t in (5, 900, 2500)], "k int, t long")
    hits = spark.createDataFrame([(1, t) for t in (4, 901, 7000)], "k int, h long")
    near = intervals.nearest(rows, hits, ["k"], "t", "h", width)
    assert sorted((r.t, r.previous, r.following) for r in near.collect()) == [(5, 4, 901), (900, 4, 901), (2500, 901, 7000)]
    assert "unboundedfollowing" not in plan(near).lower()


def test_one_key_of_many(spark):
    rows = spark.range(MANY).select("id", F.lit("key").alias("key"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).cast("int").alias("year"))
    got = pairing.exact(rows.withColumnRenamed("id", "subtitle"), rows.withColumnRenamed("id", "film"))
    n = {i: rows.where(f"id % 3 = {i}").count() for i in range(3)}
    assert {(r.y, r.n, r.film) for r in got.select(F.col("subtitle") % 3, "n_films", "film").distinct().toDF("y", "n", "film").collect()} == {(0, MANY, None), (1, n[0] + n[1], None), (2, n[0] + n[2], None)}


def test_one_beginning_of_many(spark):
    rows = spark.range(MANY).select("id", F.array(F.lit("large"), F.lit("ring")).alias("words"), F.lit(1).alias("year"))
    one = spark.createDataFrame([(-1, ["large", "ring", "new"], 1)], "id long, words array<string>, year int")
    films = rows.unionByName(one).withColumnRenamed("id", "film")
    got = pairing.by_beginning(rows.unionByName(one).withColumnRenamed("id", "subtitle"), films)
    assert [tuple(r) for r in got.collect()] == [(-1, -1, 3)]


def test_unpaired_of_one_key(spark, tmp_path):
    spark.range(MANY).select(F.col("id").alias("p_partkey"), F.lit("large ring").alias("p_name")).write.parquet(f"{tmp_path}/part.parquet")
    assert film_queries.unpaired_subtitles(spark, str(tmp_path)).count() == MANY


def test_a_silent_day_has_its_level(spark, tmp_path):
    rows = [(1, "2024-01-01 10:00:00", 0.0), (1, "2024-01-02 10:00:00", None), (2, "2024-01-01 10:00:00", 10.0)]
    spark.createDataFrame(rows, "user_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    assert sorted((r.film, r.level) for r in film_queries.daily_levels(spark, str(tmp_path)).collect()) == [(1, -120.0), (2, 20.0)]


def test_rates_and_sizes_as_c_prints_them(spark):
    bits = [1_000_000, 1_149_999, 1_150_000, 1_250_000, 1_350_000, 1_450_000, 1_750_000, 9_950_000, 12_650_000, 999_950_000, *range(1_050_000, 40_000_000, 100_000)]
    rows = spark.createDataFrame([(b,) for b in bits], "bits long").select("bits", labels.bitrate_label(F.col("bits")).alias("rate"), timing.size_label(F.col("bits") * 1000).alias("size"))
    assert [(r.rate, r.size) for r in rows.collect()] == [(f"{b / 1e6:.1f} Mb/s", f"{b * 1000 / 1e9:.1f} GB") for b in bits]


def test_busiest_of_one_dense_hour(spark):
    rows = spark.range(3 * MANY).select(F.when(F.col("id") > 0, 3_600_000 * 7 + F.col("id") * 3).alias("ms"))
    assert [tuple(r) for r in intervals.busiest(rows, "ms", 300_000).collect()] == [(3_600_000 * 7 + 3, MANY)]


def test_texts_are_cleaned_a_few_at_a_time(spark):
    raw = [None, "", *(f"<i>{k} &amp; {{\\an{k % 9 + 1}}}b</i>" for k in range(1000))]
    parts = list(text.cleaned_parts(pa.array(raw)))
    want = [text.clean_markup(t) for t in raw]
    assert max(map(len, parts)) <= text.ROWS and [tuple(x.values()) for p in parts for x in p.to_pylist()] == want
    got = spark.createDataFrame(list(enumerate(raw)), "id int, t string").select("id", text.cleaned(F.col("t")).alias("c")).orderBy("id").collect()
    assert [(r.c.text, r.c.position) for r in got] == want


def test_cases_meet_their_corrections_unsorted(spark):
    made = spark.createDataFrame([(1, 0, 1000, 1500), (1, 0, 5000, 5000), (2, 1, 7, 7)], "film long, way int, start_ms long, belongs_ms long")
    said = spark.createDataFrame([(1, 0, 500, 1.0), (2, 1, 0, 1.0)], "film long, way int, offset_ms int, rate double")
    got = evaluation.worst_errors(made, said)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 500), (2, 1, 0)]
    assert "ShuffledHashJoin" in plan(got)


def test_tracks_are_searched_in_batches_of_many(spark):
    places = [k * k * 137 % 700_000 for k in range(150)]
    runs = spark.createDataFrame([(f, p, p + 90, 720_000) for f in "ab" for p in places], "film string, from_bin long, to_bin long, film_bins long")
    moved = {1: ("a", 0), 2: ("a", 200), 3: ("b", -300), 4: (None, 0), 5: ("c", 0)}
    cues = spark.createDataFrame([(k, f, (p + by) * 10, (p + by + 90) * 10, "line") for k, (f, by) in moved.items() for p in places if p + by >= 0], "track_id long, film string, start_ms long, end_ms long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)  # a track goes over several batches
    try:
        got = alignment.aligned(cues, runs)
        assert "CoGroup" not in plan(got)
        assert {r.track_id: (r.offset_ms, r.score > 0.9) for r in got.collect()} == {1: (0, True), 2: (-2000, True), 3: (3000, True), 4: (0, False), 5: (0, False)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
