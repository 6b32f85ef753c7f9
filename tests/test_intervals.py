import random

import pytest
from pyspark.sql import functions as F

from framewise import KeyedEvents, KeyLayout
from framewise.functions.times import scale_to_millis
from framewise.operators import intervals
from framewise.operators.timewin import window_column

FRAMES = "key string, frame_seq long, frame_start long, start_tie long, frame_end long, is_closed boolean, agg long"


def random_frames(seed, n=80):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = rng.choice(["hot", "hot", "hot", "a", None])
        start = rng.randrange(300)
        rows.append((key, i, start, i, start + rng.randrange(0, 9), rng.random() < 0.7, i % 11))
    return rows


def layout_for(df, max_rows, *order):
    return KeyLayout.measure(df, ["key"], list(order), max_rows)


def united(rows, touching):
    out = []
    for key in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[3]))
        current = None
        for _, _, start, _, end, closed, agg in group:
            apart = current is None or (start > current[1] if touching else start >= current[1])
            if apart:
                current = [start, end, closed, 1, agg]
                out.append((key, current))
            else:
                current[1] = max(current[1], end)
                current[2] = (current[2] or closed) if not touching else False
                current[3] += 1
                current[4] += agg
    return sorted(((k, *c) for k, c in out), key=str)


@pytest.mark.parametrize("touching", [False, True])
@pytest.mark.parametrize("max_rows", [1000, 7])
def test_coalesce(spark, touching, max_rows):
    rows = random_frames(1)
    df = spark.createDataFrame(rows, FRAMES)
    got = intervals.coalesce_frames(
        df, ["key"], F.sum("agg").alias("agg"), touching=touching,
        layout=layout_for(df, max_rows, "frame_start", "start_tie"),
    )
    cells = ["key", "frame_start", "frame_end", "is_closed", "n_frames", "agg"]
    assert sorted((tuple(r) for r in got.select(cells).collect()), key=str) == united(rows, touching)


def events_of(spark, seed, max_rows, n=200):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "b", None]), rng.randrange(400), i, rng.uniform(0, 100))
            for i in range(n)]
    df = spark.createDataFrame(rows, "key string, ts long, tie long, value double")
    return rows, KeyedEvents.of(df, "key", "ts", "value", "tie", max_rows=max_rows)


@pytest.mark.parametrize("max_rows", [1000, 13])
def test_rows_in_frames_and_split(spark, max_rows):
    rows, events = events_of(spark, 4, max_rows)
    frames = events.threshold(40).bounds()
    listed = frames.collect()
    held = intervals.rows_in_frames(
        events.df, frames.select("key", "frame_seq", "frame_start", "frame_end"), ["key"],
        "ts", "tie", events.layout,
    )
    want = sorted(
        ((r[0], r[2], f.frame_seq) for r in rows for f in listed
         if f.key == r[0] and f.frame_start <= r[1] < f.frame_end), key=str)
    assert sorted(((r.key, r.tie, r.frame_seq) for r in held.collect()), key=str) == want

    points = [(k, p) for k in ("hot", "b", None) for p in range(0, 400, 7)] * 2
    cut = intervals.split_frames(
        frames, spark.createDataFrame(points, "key string, point long"), ["key"], layout=events.layout
    )
    expected = []
    for f in listed:
        inner = [p for p in range(0, 400, 7) if f.frame_start < p < f.frame_end]
        edges = [f.frame_start, *inner, f.frame_end]
        for i in range(len(edges) - 1):
            last = i == len(edges) - 2
            expected.append((f.key, f.frame_seq, i + 1, edges[i], edges[i + 1], not last or f.is_closed))
    assert sorted(map(tuple, cut.collect()), key=str) == sorted(expected, key=str)


def test_zero_length_frame_holds_no_row_and_survives_a_split(spark):
    df = spark.createDataFrame(
        [("k", 1, 10, 1, 10, True, 0), ("k", 2, 10, 2, 20, True, 0)], FRAMES)
    rows = spark.createDataFrame([("k", 10, 1, 1.0), ("k", 15, 2, 1.0)],
                                 "key string, ts long, tie long, value double")
    held = intervals.rows_in_frames(rows, df.drop("start_tie"), ["key"], "ts", "tie")
    assert [r.frame_seq for r in held.collect()] == [2, 2]
    points = spark.createDataFrame([("k", 12)], "key string, point long")
    cut = intervals.split_frames(df, points, ["key"]).orderBy("frame_start", "frame_end").collect()
    assert [(r.frame_seq, r.frame_start, r.frame_end) for r in cut] == [
        (1, 10, 10), (2, 10, 12), (2, 12, 20)]


@pytest.mark.parametrize("bucket", [None, 3, 1000])
def test_rows_in_overlapping_windows(spark, bucket):
    rows, events = events_of(spark, 9, 1000)
    windows = [(k, s, s + 25) for k in ("hot", None) for s in range(0, 400, 10)] + [("b", 0, 400)]
    held = intervals.rows_in_windows(
        events.df, spark.createDataFrame(windows, "key string, window_start long, window_end long"),
        ["key"], "ts", bucket_ms=bucket,
    )
    want = sorted(((r[0], r[2], w[1]) for r in rows for w in windows
                   if w[0] == r[0] and w[1] <= r[1] < w[2]), key=str)
    assert sorted(((r.key, r.tie, r.window_start) for r in held.collect()), key=str) == want


def test_windows_of_very_different_length(spark):
    rows, events = events_of(spark, 6, 1000)
    windows = [("hot", s, s + 1) for s in range(400)] + [("hot", 0, 390), ("hot", 17, 160), (None, 3, 3)]
    df = spark.createDataFrame(windows, "key string, window_start long, window_end long")
    held = intervals.rows_in_windows(events.df, df, ["key"], "ts")
    want = sorted((r[2], w[1], w[2]) for r in rows for w in windows
                  if w[0] == r[0] and w[1] <= r[1] < w[2])
    assert sorted((r.tie, r.window_start, r.window_end) for r in held.collect()) == want


@pytest.mark.parametrize("size,slide,offset", [(40, 2, 1), (60, 45, -8), (64, 4, 3)])
def test_panes_give_the_windows(spark, size, slide, offset):
    _, events = events_of(spark, 8, 1000)
    windows = events.sliding(size, slide, offset)
    total = F.round(F.sum("value"), 4).alias("s")
    plain = windows.reduce(total, F.max("ts").alias("last"))
    panes = windows.reduce_panes(
        [F.sum("value").alias("s"), F.max("ts").alias("last")],
        [F.round(F.sum("s"), 4).alias("s"), F.max("last").alias("last")],
    )
    assert sorted(map(str, plain.collect())) == sorted(map(str, panes.collect()))


def test_windows_of_panes_are_not_shuffled(spark):
    """Each row in a pane of its own and in 48 windows: what is exchanged is panes, twice at most."""
    df = spark.range(6000).selectExpr(
        "id % 20 AS key", "timestamp_millis(id * 1800000) AS ts", "id AS tie",
        "CAST(id % 7 AS double) AS value",
    )
    windows = KeyedEvents.of(df, "key", "ts", "value", "tie").sliding(48 * 3_600_000, 3_600_000)
    found = windows.sum()
    rows = found.collect()
    plain = windows.reduce(F.sum("value").alias("sum_value"), F.max("ts").alias("max_ts")).collect()
    assert sorted(rows) == sorted(plain) and len(rows) > 50_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("Final Plan"):plan.index("Initial Plan")]
    assert final.count("Exchange hash") == 2  # by pane, by stretch; none behind the spread


@pytest.mark.parametrize("size,slide,offset", [(50, 50, 0), (50, 20, 0), (50, 20, 7), (30, 20, -7),
                                               (5, 20, 3), (60, 7, 6)])
def test_time_windows(spark, size, slide, offset):
    rows, events = events_of(spark, 2, 1000)
    got = events.sliding(size, slide, offset).assign()
    want = []
    for _, ts, tie, _ in rows:
        start = (ts - offset) // slide * slide + offset
        while start > ts - size:
            want.append((tie, start, start + size))
            start -= slide
    assert sorted((r.tie, r.window_start, r.window_end) for r in got.collect()) == sorted(want)
    counts = events.sliding(size, slide, offset).sum().agg(F.sum("n_rows")).first()[0]
    assert (counts or 0) == len(want)


def test_window_arguments_are_checked(spark):
    for size, slide, offset in [(0, 1, 0), (5, 5, 5), (5, 5, -5), (5, 0, 0)]:
        with pytest.raises(ValueError):
            window_column(F.col("ts"), size, slide, offset)


def test_time_scaling_truncates_toward_zero(spark):
    df = spark.createDataFrame([(-1_999_999,), (1_999_999,)], "t long")
    got = df.select(scale_to_millis(F.col("t"), "ns"), scale_to_millis(F.col("t"), "s")).collect()
    assert [tuple(r) for r in got] == [(-1, -1_999_999_000), (1, 1_999_999_000)]


@pytest.mark.parametrize("max_rows", [1000, 13])
def test_rows_follow_their_part(spark, max_rows):
    rows, events = events_of(spark, 6, max_rows)
    rng = random.Random(6)
    points = [(rng.choice(["hot", "b", None, "none"]), rng.randrange(400)) for _ in range(60)]
    points += [points[0], (rows[0][0], rows[0][1]), ("hot", None)]
    table = events.threshold(40).split(
        spark.createDataFrame(points, "key string, point long"), F.sort_array(F.collect_list("tie")).alias("ties")
    )
    frames = {}
    for r in events.threshold(40).assign().collect():
        if r.frame_seq is not None:
            frames.setdefault((r.key, r.frame_seq), []).append((r.ts, r.tie))
    want = {}
    for (key, seq), members in frames.items():
        begun = min(members)[0]
        for ts, tie in members:
            no = 1 + len({p for k, p in points if k == key and p is not None and begun < p <= ts})
            want.setdefault((key, seq, no), []).append((ts, tie))
    got = {(r.key, r.frame_seq, r.part_no): r for r in table.collect()}
    assert set(got) == set(want)
    for place, members in want.items():
        r = got[place]
        assert r.ties == sorted(t for _, t in members) and r.n_rows == len(members)
        assert (r.first_ts, r.last_ts) == (min(members)[0], max(members)[0])
