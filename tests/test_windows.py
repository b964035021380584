import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstline.operators import windows as wn

START = 1_700_000_000


def stream(spark, offsets):
    rows = [(i, dt.datetime.fromtimestamp(START + s, dt.timezone.utc)) for i, s in enumerate(offsets)]
    return spark.createDataFrame(rows, "post_id long, ts timestamp")


def starts(df):
    return {r.post_id: r.window_id - START for r in df.collect()}


def test_anchored_edges(spark):
    # exactly at the end, one second before it, a gap, two posts in the closing second
    posts = stream(spark, [0, 59, 60, 119, 120, 120, 500, 501])
    windowed = wn.anchored_windows(posts, 1)
    assert starts(windowed) == {0: 0, 1: 0, 2: 60, 3: 60, 4: 120, 5: 120, 6: 500, 7: 500}
    closed = wn.drop_open_tail(windowed)
    assert starts(wn.drop_triggers(closed)) == {0: 0, 1: 0, 3: 60, 5: 120}
    seq = {r.window_id - START: (r.window_seq, r.block, r.place) for r in wn.window_sequence(closed).collect()}
    assert seq == {0: (1, 0, 1), 60: (2, 0, 2), 120: (3, 0, 3)}


def test_anchored_continues_an_open_window(spark):
    windowed = wn.anchored_windows(stream(spark, [-5, 30, 70, 200]), 1, open_anchor=START)
    assert starts(windowed) == {0: 0, 1: 0, 2: 70, 3: 200}
    assert starts(wn.with_trigger(windowed, START).filter("trigger")) == {2: 70, 3: 200}


def test_history_blocks_of_four(spark):
    seq = wn.window_sequence(wn.aligned_windows(stream(spark, range(0, 600, 60)), 1)).orderBy("window_seq").collect()
    assert [(r.block, r.place) for r in seq[:6]] == [(0, 1), (0, 2), (0, 3), (0, 4), (1, 1), (1, 2)]


@pytest.mark.parametrize("minutes,gap,n", [(2, 3000, 400), (0.1, 900, 3000)])
def test_anchored_equals_a_walk(spark, monkeypatch, minutes, gap, n):
    # short stretches, so that the chain skips some and enters others late
    monkeypatch.setattr(wn, "_STRETCH_SECONDS", 1)
    rng = np.random.default_rng(n)
    steps = np.where(rng.random(n) < .02, rng.integers(0, gap * 20, n), rng.integers(0, 40, n))
    offsets = np.cumsum(steps)
    got = starts(wn.anchored_windows(stream(spark, [int(x) for x in offsets]), minutes))
    anchor = offsets[0]
    for i, s in enumerate(offsets):
        if s - anchor >= minutes * 60:
            anchor = s
        assert got[i] == anchor


def walk(rows, length):
    """(id, window start, number of the window in its stream) of rows (id, stream, second), one stream after the other."""
    out, streams = {}, {}
    for i, stream, second in sorted(rows, key=lambda r: r[2]):
        anchor, n = streams.get(stream, (None, 0))
        if anchor is None or second - anchor >= length:
            anchor, n = second, n + 1
            streams[stream] = anchor, n
        out[i] = (anchor, n)
    return out


@pytest.mark.parametrize("shared", [1, 262_144])
def test_anchored_per_stream_equals_a_walk(spark, monkeypatch, shared):
    monkeypatch.setattr(wn, "_STRETCH_SECONDS", 1)
    monkeypatch.setattr(wn, "_TASK_SECONDS", shared)
    rng = np.random.default_rng(7)
    rows = []
    # streams of very different length, one without a key, one with a single post
    for stream, n, gap in [(1, 900, 50), (2, 300, 2000), (3, 60, 90_000), (None, 200, 700), (5, 1, 1)]:
        rows += [(stream, int(s)) for s in START + rng.integers(0, 9000) + np.cumsum(rng.integers(0, gap, n))]
    rows = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "post_id long, user long, second long").withColumn("ts", F.timestamp_seconds("second"))
    windowed = wn.anchored_windows(df, 2, by="user")
    want = walk(rows, 120)
    assert {r.post_id: r.window_id for r in windowed.collect()} == {i: w for i, (w, _) in want.items()}
    seq = {(r.user, r.window_id): r.window_seq for r in wn.window_sequence(windowed, by="user").collect()}
    assert all(seq[u, want[i][0]] == want[i][1] for i, u, _ in rows)
    last = {u: max(want[i][0] for i, v, _ in rows if v == u) for u in {r[1] for r in rows}}
    kept = {r.post_id for r in wn.drop_open_tail(windowed, by="user").collect()}
    assert kept == {i for i, u, _ in rows if want[i][0] < last[u]}
    first = {}
    for i, u, second in sorted(rows, key=lambda r: (r[2], r[0])):
        first.setdefault((u, want[i][0]), i)
    closing = {i for (u, w), i in first.items() if w > min(x for v, x in first if v == u)}
    assert {r.post_id for r in wn.with_trigger(windowed, by="user").where("trigger").collect()} == closing


def test_aligned_windows_do_not_shuffle(spark):
    df = wn.aligned_windows(spark.range(10).select(F.timestamp_seconds("id").alias("ts")), 15)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
