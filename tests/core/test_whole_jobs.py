"""Queries that take part of their rows or texts only would fail these."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from reelgrid.operators import alignment
from reelgrid.plans import queries


def test_srt_files_have_whole_texts(spark, sf):
    letters = lambda texts: sum(c.isascii() and c.isalpha() for t in texts for c in t)
    turns = queries.read(spark, sf, "conversations").collect()
    want = letters(r.text for r in turns) + len(turns) * len("said")
    assert letters(r.text for r in queries.srt_parse_whole(spark, sf).collect()) == want
    spare = sum(len("an" "i" "i") for r in turns if r.turn % 5 == 0)  # of markup
    assert letters(r.text for r in queries.rendered(spark, sf).collect()) == want + spare


def test_every_event_is_in_an_aligned_film(spark, tmp_path):
    minutes = [0, 10, 30, 300, 310, 2000]  # of three films
    spark.createDataFrame([(i, m * 60_000) for i, m in enumerate(minutes)], "event_id long, ms long").selectExpr("event_id", "timestamp_millis(ms) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    got = [r.track_id for r in queries.align_recovery(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted({m // 120 * 4 + i for m in minutes for i in range(4)})


def test_every_lag_is_counted(spark, tmp_path):
    hours = [(1, "view", 0), (1, "click", 0), (1, "click", 49), (1, "click", 700), (1, "view", 700), (2, "view", 9000), (2, "click", 3), (3, "view", 5)]
    rows = [(i, u, kind, h * 3_600_000) for i, (u, kind, h) in enumerate(hours)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ms long").selectExpr("event_id", "user_id", "event_type", "timestamp_millis(ms) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    assert {r.lag: r.n for r in queries.cross_correlation(spark, str(tmp_path)).collect()} == {0: 2, 49: 1, 700: 1, -700: 1, -651: 1, -8997: 1}


@pytest.mark.parametrize("groups", [None, [], ["film"]])
def test_lags_of_long_signals(spark, groups):
    draw = np.random.default_rng(5)
    a, b = ({(film, track, int(x)) for film, track in ((1, 1), (1, 2), (2, None), (None, 1)) for x in draw.integers(-9000, 9000, 60)} | {(2, 5, x) for x in range(-at, 2 * at, 3)} for at in (900, 1300))
    want = Counter((*(k for k, name in ((film, "film"), (track, "track")) if name in (["film", "track"] if groups is None else groups)), y - x) for film, track, x in a for f, t, y in b if (film, track) == (f, t) and None not in (film, track))
    one, two = (spark.createDataFrame([*sorted(x, key=str), (2, 5, None)], "film long, track long, bin long") for x in (a, b))
    got = alignment.lag_products(one, two, ["film", "track"], "bin", groups=groups)
    assert {tuple(r)[:-1]: r.n for r in got.collect()} == want
    assert "Broadcast" not in got._jdf.queryExecution().toString()


def test_lags_are_held_for_a_few_groups(monkeypatch):
    monkeypatch.setattr(alignment, "HELD", 2)
    rows = pa.table({"user": [1, 2, 1, 3, None], "_apart": [0, 1, 0, -1, 0], "_a": [[0, 5], [1], [9], [4], [0]], "_b": [[5], [1, 2], [9], [4], [7]]})
    got = [tuple(r.values()) for batch in alignment._counted_lags(iter(rows.to_batches(max_chunksize=2))) for r in batch.to_pylist()]
    far = alignment.STRETCH
    assert sorted(got, key=str) == sorted([(1, 0, 1), (1, 5, 1), (2, far, 1), (2, far + 1, 1), (1, 0, 1), (3, -far, 1), (None, 7, 1)], key=str)
