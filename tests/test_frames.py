import random

import pytest
from pyspark.sql import functions as F

import brute
from framewise import FrameSpec, KeyedEvents, KeyLayout, frames, parse_window_params
from framewise.functions.reduce import first_value, last_value, top_row

SCHEMA = "key string, ts long, tie long, value double"

# The hand-written example, in order of arrival, as time:value.
ARRIVALS = """
1000:55 4000:56 7000:57 8000:130 10000:30 11000:120 12000:50 13000:40 14000:60 15000:130
5000:130 4500:30 9000:50 15000:130 24500:30 25500:30 26500:30 27500:30 28500:30
"""
EXAMPLE = [
    ("1", int(t), i, float(v))
    for i, (t, v) in enumerate(p.split(":") for p in ARRIVALS.split())
]
GOLDEN = {
    "threshold": """1000 4500 2 111 / 5000 10000 4 367 / 11000 13000 2 170 / 14000 24500 3 320""",
    "delta": """1000 5000 3 141 / 5000 7000 1 130 / 7000 8000 1 57 / 8000 9000 1 130 /
      9000 11000 2 80 / 11000 12000 1 120 / 12000 15000 3 150 / 15000 24500 2 260 /
      24500 28501 5 150 open""",
    "aggregate": """1000 5000 3 141 / 5000 7000 1 130 / 7000 8000 1 57 / 8000 9000 1 130 /
      9000 11000 2 80 / 11000 12000 1 120 / 12000 14000 2 90 / 14000 15000 1 60 /
      15000 15000 1 130 / 15000 24500 1 130 / 24500 28500 4 120 / 28500 28501 1 30 open""",
}
SPECS = {
    "threshold": FrameSpec.threshold(50),
    "delta": FrameSpec.delta(50),
    "aggregate": FrameSpec.aggregate("sum", 150),
}


def keyed(spark, rows, max_rows=None):
    return KeyedEvents.of(
        spark.createDataFrame(rows, SCHEMA), "key", "ts", "value", "tie", max_rows=max_rows
    )


def collect(query):
    table = query.reduce(F.round(F.sum("value"), 4).alias("s"), with_tie=True)
    rows = table.select(
        "key", "frame_seq", "frame_start", "start_tie", "frame_end", "is_closed", "n_rows", "s"
    ).collect()
    return sorted(map(tuple, rows), key=brute.order)


@pytest.mark.parametrize("max_rows", [None, 3])
@pytest.mark.parametrize("kind", sorted(SPECS))
def test_hand_written_example(spark, kind, max_rows):
    want = []
    for i, text in enumerate(GOLDEN[kind].split("/"), start=1):
        start, end, n, total, *is_open = text.split()
        want.append((i, int(start), int(end), not is_open, int(n), float(total)))
    events = keyed(spark, EXAMPLE, max_rows)
    assert events.layout.is_flat == (max_rows is None)
    got = [(r[1], r[2], r[4], r[5], r[6], r[7]) for r in collect(events.frames(SPECS[kind]))]
    assert got == want


KINDS = [
    ("threshold", 20),
    ("delta", 25),
    ("delta", 1),
    ("delta", 0),
    ("boundary", [-10, 5, 30, 30]),
    ("aggregate", ("sum", 60, 0)),
    ("aggregate", ("sum", -5, 3)),
    ("aggregate", ("max", 30, 0)),
    ("aggregate", ("max", 30, 40)),
    ("aggregate", ("min", 5, 1000)),
    ("aggregate", ("min", -45, 1000)),
    ("aggregate", ("min", 5, 0)),
    ("aggregate", ("count", 5, 0)),
    ("aggregate", ("count", 0, 3)),
]


def random_rows(seed, n=300):
    """One key holds half the rows, times tie, some keys are null or have one row."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = rng.choice(["hot"] * 6 + ["a", "b", None, f"one{i}"])
        rows.append((key, rng.randrange(n // 3), i, round(rng.uniform(-50, 60), 2)))
    rng.shuffle(rows)
    return rows


def spec_of(kind, p):
    if kind == "aggregate":
        return FrameSpec.aggregate(p[0], p[1], p[2])
    return FrameSpec.named(kind, **{"bounds" if kind == "boundary" else "limit": p})


@pytest.mark.parametrize("max_rows", [None, 17])
def test_any_order_of_arrival(spark, max_rows):
    rows = random_rows(77)
    events = keyed(spark, rows, max_rows)
    assert events.layout.is_flat == (max_rows is None)
    for kind, p in KINDS:
        assert collect(events.frames(spec_of(kind, p))) == brute.frames(rows, kind, p), (kind, p)


@pytest.mark.parametrize("max_rows", [None, 17])
def test_own_aggregate_function(spark, max_rows):
    f = lambda v, agg: agg + abs(v)
    rows = random_rows(5)
    got = collect(keyed(spark, rows, max_rows).aggregate(f, 90, 2))
    assert got == brute.frames(rows, "aggregate", (f, 90, 2))


@pytest.mark.parametrize("max_rows", [None, 9])
def test_custom_frame_skips_rows_and_closes_later(spark, max_rows):
    rows = [("k", i * 10, i, float(v)) for i, v in enumerate([5, 70, 30, 50, 25, 10, 3, 80, 41, 22] * 4)]
    query = keyed(spark, rows, max_rows).custom(
        opens=lambda v: v >= 60, start=lambda v: v,
        keeps=lambda v, s: v >= 40, closes=lambda v, s: v < 20,
    )
    want, frame = [], None
    for _, ts, tie, v in rows:
        if frame and v < 20:
            want.append((*frame[:2], ts, True, *frame[3:]))
            frame = None
        elif frame and v >= 40:
            frame = (*frame[:2], ts + 1, frame[3] + 1, frame[4] + v)
        elif not frame and v >= 60:
            frame = (ts, tie, ts + 1, 1, v)
    if frame:
        want.append((*frame[:2], frame[2], False, *frame[3:]))
    assert [r[2:] for r in collect(query)] == want


@pytest.mark.parametrize("max_rows", [None, 30])
def test_custom_frame_that_closes_at_the_first_row_it_does_not_keep(spark, max_rows):
    rows = random_rows(21)
    query = keyed(spark, rows, max_rows).custom(
        opens=lambda v: v >= 20, start=lambda v: v, keeps=lambda v, s: v >= 20)
    assert collect(query) == brute.frames(rows, "threshold", 20)


@pytest.mark.parametrize("size,limit", [(4, 1000), (50, 1000), (1, 10)])
def test_threshold_runs_of_known_length(spark, size, limit):
    i = F.col("id")
    rows = spark.range(1, 20 * (size + 1) + 1).select(
        F.lit("0").alias("key"), (i * 1000).alias("ts"), i.alias("tie"),
        F.when(i % (size + 1) == 0, limit / 2).otherwise(limit * 2.0).alias("value"),
    )
    table = KeyedEvents.of(rows, "key", "ts", "value", "tie", max_rows=33).threshold(limit).reduce()
    got = {r.frame_seq: (r.frame_start, r.frame_end, r.n_rows) for r in table.collect()}
    assert got == {
        k + 1: (1000 * (k * (size + 1) + 1), 1000 * (k * (size + 1) + size + 1), size)
        for k in range(20)
    }


@pytest.mark.parametrize("size,limit", [(50, 1000), (100, 1000), (7, 3)])
def test_constant_values_give_sum_frames_of_known_length(spark, size, limit):
    step = max(1, limit // size)
    length = max(1, -(-limit // step) - 1)
    i = F.col("id")
    rows = spark.range(1, 6 * length + 1).select(
        F.lit("0").alias("key"), (i * 1000).alias("ts"), i.alias("tie"),
        F.lit(float(step)).alias("value"),
    )
    events = KeyedEvents.of(rows, "key", "ts", "value", "tie", max_rows=40)
    table = events.aggregate("sum", limit).reduce().orderBy("frame_seq").collect()
    assert [r.n_rows for r in table] == [length] * 6
    assert [r.is_closed for r in table] == [True] * 5 + [False]


def test_delta_runs_of_known_length(spark):
    limit, size = 1000, 6
    i = F.col("id")
    run = F.floor(i / (size + 1))
    rows = spark.range(1, 8 * (size + 1)).select(
        F.lit("0").alias("key"), (i * 1000).alias("ts"), i.alias("tie"),
        F.when(run % 2 == 0, 5.0 * limit).otherwise(10.0 * limit).alias("value"),
    )
    table = KeyedEvents.of(rows, "key", "ts", "value", "tie", max_rows=10).delta(limit).reduce()
    assert [r.n_rows for r in table.orderBy("frame_seq").collect()] == [size] + [size + 1] * 7


@pytest.mark.parametrize("value,n", [(0.4, 1), (-0.9, 1), (49.9, 0), (50.0, 1), (-50.5, 0)])
def test_values_are_truncated_toward_zero(spark, value, n):
    limit = 50 if abs(value) > 1 else 0
    assert keyed(spark, [("k", 1, 1, value)]).threshold(limit).reduce().count() == n


def test_delta_frame_opened_by_zero_is_an_ordinary_frame(spark):
    rows = [("k", i, i, v) for i, v in enumerate([0.5, 3.0, 60.0, 0.0])]
    assert [r[6] for r in collect(keyed(spark, rows).delta(50))] == [2, 1, 1]


def test_no_rows_and_rows_without_value(spark):
    assert collect(keyed(spark, []).delta(5)) == []
    rows = [("k", 1, 1, None), ("k", 2, 2, 7.0), ("k", None, 3, 9.0), ("k", 4, 4, 8.0)]
    for max_rows in (None, 1):
        events = keyed(spark, rows, max_rows)
        assert [r[6] for r in collect(events.delta(5))] == [2]
        assert events.rejected().count() == 2


def test_values_without_a_whole_part_are_rejected(spark):
    rows = [("k", i, i, v) for i, v in enumerate([7.0, float("nan"), float("inf"), -1e300, 8.9, 2.0**64])]
    for max_rows in (None, 1):
        events = keyed(spark, rows, max_rows)
        assert [r[6] for r in collect(events.delta(5))] == [2]
        assert {r.tie for r in events.rejected().collect()} == {1, 2, 3, 5}


def test_assign_covers_every_row(spark):
    rows = random_rows(11)
    for max_rows in (None, 23):
        got = keyed(spark, rows, max_rows).delta(25).assign()
        assert got.columns == ["key", "ts", "tie", "value", "frame_seq"]
        assert got.count() == len(rows)
        assert got.filter("frame_seq is null").count() == 0
        assert keyed(spark, rows, max_rows).threshold(20).assign().filter(
            "(frame_seq is null) <> (value < 20)").count() == 0


def test_reductions_follow_row_order_when_times_tie(spark):
    rows = [("k", 5, i, v) for i, v in enumerate([60.0, 90.0, 90.0, 70.0])]
    for max_rows in (None, 2):
        row = keyed(spark, rows, max_rows).threshold(50).reduce(
            first_value("value").alias("first"), last_value("value").alias("last"),
            top_row("value", "tie").alias("top"),
        ).first()
        assert (row["first"], row["last"], row["top"]["tie"]) == (60.0, 70.0, 2)


def test_min_rows_last_frame_and_mapped_frames(spark):
    rows = [("k", i, i, v) for i, v in enumerate([60.0, 70.0, 1.0, 80.0, 1.0])]
    events = keyed(spark, rows)
    assert events.threshold(50).reduce(min_rows=2).count() == 1
    assert events.threshold(50).last().first()["n_rows"] == 1
    mapped = events.threshold(50).reduce(map_frame=lambda t: t.select("frame_seq", "n_rows"))
    assert mapped.columns == ["frame_seq", "n_rows"]


def test_several_key_columns_and_value_expression(spark):
    rows = spark.createDataFrame(
        [("a", 1, t, t, float(v)) for t, v in enumerate([1, 40, 2, 3])], "x string, y int, ts long, tie long, v double"
    )
    for max_rows in (None, 2):
        events = KeyedEvents.of(rows, ["x", "y"], "ts", F.col("v") * 2, "tie", max_rows=max_rows)
        assert [r.n_rows for r in events.delta(50).reduce().orderBy("frame_seq").collect()] == [1, 1, 2]


def test_text_tiebreak_in_chunks(spark):
    rows = spark.createDataFrame(
        [("a", i // 10, f"t{i:03d}", float(i % 7 * 10)) for i in range(60)],
        "key string, ts long, tie string, value double",
    )
    cut = KeyedEvents.of(rows, "key", "ts", "value", "tie", max_rows=5)
    whole = KeyedEvents.of(rows, "key", "ts", "value", "tie")
    assert not cut.layout.is_flat
    assert sorted(cut.delta(25).sum().collect()) == sorted(whole.delta(25).sum().collect())


def test_choice_by_name(spark):
    df = spark.createDataFrame(EXAMPLE, SCHEMA)
    options = dict(key="key", ts="ts", value="value", tie="tie")
    for kind, text in {"threshold": "50", "delta": "50", "aggregate": "sum;0;150"}.items():
        query = frames(df, kind, **options, **parse_window_params(kind, text))
        assert collect(query) == collect(keyed(spark, EXAMPLE).frames(SPECS[kind]))
    assert frames(df, "time", **options, **parse_window_params("time", "0;5000;1000")).reduce().count()
    with pytest.raises(ValueError):
        FrameSpec.named("session", limit=1)
    with pytest.raises(ValueError):
        FrameSpec.aggregate("median", 3)
    with pytest.raises(ValueError):
        FrameSpec.threshold(1.5)


def test_layout_bounds_every_chunk(spark):
    rows = random_rows(3, 1000)
    events = keyed(spark, rows, 40)
    tagged = events.layout.tag(events.df)
    sizes = tagged.filter("__chunk >= 0").groupBy("key", "__chunk").count().collect()
    assert sum(r["count"] for r in sizes) > 500
    assert max(r["count"] for r in sizes) <= 80
    assert KeyLayout.flat(["key"], ["ts"]).tag(events.df) is events.df


def test_value_filter_stays_above_the_scan(spark):
    rows = random_rows(8)
    assigned = keyed(spark, rows).delta(25).assign()
    full = {(r.key, r.tie): r.frame_seq for r in assigned.collect()}
    for r in assigned.filter("value > 10").collect():
        assert full[(r.key, r.tie)] == r.frame_seq
