import os
import random
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import brute
from framewise import FrameSpec, KeyedEvents
from framewise.functions.reduce import RowFold
from framewise.sources.kafka import without_sentinels
from framewise.sources.parse import parse_road_reports
from framewise.sources.sinks import stream_results
from framewise.streaming import frames
from framewise.streaming.frames import (
    late_rows,
    latest_frames,
    latest_rows,
    rejected_rows,
    stream_assign,
    stream_frames,
)
from framewise.streaming.split import stream_split_frames
from framewise.streaming.progress import ProgressLog, observed, progress_table
from framewise.streaming.windows import stream_windows

SCHEMA = "key string, ts long, tie long, value double"
CASES = {
    "threshold": (FrameSpec.threshold(30), "threshold", 30),
    "delta": (FrameSpec.delta(25), "delta", 25),
    "sum": (FrameSpec.aggregate("sum", 90), "aggregate", ("sum", 90, 0)),
    "boundary": (FrameSpec.boundary([15, 40]), "boundary", [15, 40]),
}


def arrivals(seed, n=160, disorder=40_000):
    """Rows in order of arrival, at most ``disorder`` ms behind the newest one."""
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "b"]), rng.randrange(200) * 1000, i, round(rng.uniform(0, 60), 2))
            for i in range(n)]
    return sorted(rows, key=lambda r: r[1] + rng.randrange(disorder))


def feed(spark, folder, rows, files=6):
    folder.mkdir()
    per = -(-len(rows) // files)
    for i in range(files):
        part = rows[i * per:(i + 1) * per]
        columns = list(zip(*part)) if part else [[], [], [], []]
        table = pa.table({n: pa.array(c, t) for n, c, t in zip(
            ("key", "ts", "tie", "value"), columns, (pa.string(), pa.int64(), pa.int64(), pa.float64()))})
        path = folder / f"{i}.parquet"
        pq.write_table(table, path)
        os.utime(path, (1_000 + i, 1_000 + i))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(spark, df, folder):
    query = stream_results(df, str(folder / "out"), str(folder / "cp"))
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(str(folder / "out")), query


def as_brute(table):
    return sorted(
        ((r.key, r.frame_seq, r.start_us // 1000, r.start_tie, r.end_us // 1000, r.is_closed,
          r.n_rows, round(r.sum_value, 4)) for r in table.collect()), key=brute.order)


OPTIONS = dict(keys=["key"], ts="ts", value="value", tie="tie")


@pytest.mark.parametrize("name", sorted(CASES))
def test_disorder_within_the_lateness_gives_the_frames_of_a_batch(spark, tmp_path, name):
    spec, kind, p = CASES[name]
    rows = arrivals(name)
    stream = stream_frames(feed(spark, tmp_path / "in", rows), spec, lateness_ms=40_000, early=True, **OPTIONS)
    changes, _ = run(spark, stream, tmp_path)
    assert changes.filter("op = 'late'").count() == 0
    assert changes.filter("op = 'retract'").count() > 0 or name == "threshold"
    assert as_brute(latest_frames(changes, ["key"])) == brute.frames(rows, kind, p)


def test_late_rows_are_reported_and_leave_the_frames_of_the_others(spark, tmp_path):
    rows = arrivals("late", disorder=90_000)
    spec, kind, p = CASES["delta"]
    stream = stream_frames(feed(spark, tmp_path / "in", rows), spec, lateness_ms=5_000, early=True, **OPTIONS)
    changes, query = run(spark, stream, tmp_path)
    late = {r.tie for r in late_rows(changes, ["key"]).collect()}
    assert 0 < len(late) < len(rows)
    accepted = [r for r in rows if r[2] not in late]
    assert as_brute(latest_frames(changes, ["key"])) == brute.frames(accepted, kind, p)
    by_tie = {r[2]: r for r in rows}
    for r in late_rows(changes, ["key"]).collect():
        assert (r.key, r.ts_us // 1000, r.value) == (by_tie[r.tie][0], by_tie[r.tie][1], by_tie[r.tie][3])
    progress = progress_table(spark, query)
    assert progress.agg(F.sum("input_rows"), F.sum("dropped_rows")).first()[:] == (len(rows), 0)


def test_final_frames_are_written_once_when_the_watermark_has_passed(spark, tmp_path):
    rows = arrivals("final", disorder=20_000)
    spec, kind, p = CASES["sum"]
    stream = stream_frames(feed(spark, tmp_path / "in", rows), spec, lateness_ms=20_000, **OPTIONS)
    changes, _ = run(spark, stream, tmp_path)
    mark = max(r[1] for r in rows) - 20_000
    want = [f for f in brute.frames(rows, kind, p) if f[5] and f[4] <= mark]
    assert as_brute(changes.filter("op = 'upsert'")) == want and len(want) > 10


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    rows = arrivals("again")
    spec, kind, p = CASES["delta"]
    source = feed(spark, tmp_path / "in", rows[:100], files=3)
    make = lambda: stream_frames(source, spec, lateness_ms=40_000, early=True, **OPTIONS)
    run(spark, make(), tmp_path)
    more = pa.table({n: pa.array(c, t) for n, c, t in zip(
        ("key", "ts", "tie", "value"), zip(*rows[100:]),
        (pa.string(), pa.int64(), pa.int64(), pa.float64()))})
    pq.write_table(more, tmp_path / "in" / "more.parquet")
    changes, _ = run(spark, make(), tmp_path)
    late = {r.tie for r in late_rows(changes, ["key"]).collect()}
    accepted = [r for r in rows if r[2] not in late]
    assert as_brute(latest_frames(changes, ["key"])) == brute.frames(accepted, kind, p)


def test_road_reports_to_frames(spark, tmp_path):
    """Text lines in, speed frames out; the closing row and unreadable lines take no part."""
    rng = random.Random(1)
    (tmp_path / "in").mkdir()
    rows = []
    for i in range(60):
        rows.append((str(rng.randrange(3)), 1000 * i, i, float(rng.randrange(60))))
    text = [f"[{k}, {v}, 0.0, 0, 0, 0, 2, {tie}, {ts}, {ts + 1}]" for k, ts, tie, v in rows]
    (tmp_path / "in" / "a.txt").write_text("\n".join([*text, "broken", "[-1, 0, 0.0, 0, 0, 0, 0, 0, 60000, 60001]"]))
    reports = parse_road_reports(without_sentinels(spark.readStream.text(str(tmp_path / "in"))))
    reports = observed(reports, "reports", F.count(F.lit(1)).alias("n"))
    stream = stream_frames(
        reports.filter("reject is null"), FrameSpec.aggregate("sum", 100), keys=["VID"], ts="T1",
        value="SPEED", tie="Pos", early=True,
    )
    changes, query = run(spark, stream, tmp_path)
    got = latest_frames(changes, ["VID"]).withColumnRenamed("VID", "key")
    assert as_brute(got) == brute.frames(rows, "aggregate", ("sum", 100, 0))
    assert '{"reports": {"n": 61}}' in {r.observed for r in progress_table(spark, query).collect()}


def test_row_at_the_watermark_is_late(spark, tmp_path):
    rows = [("a", 10_000, 1, 50.0), ("a", 5_000, 2, 50.0), ("a", 5_001, 3, 50.0)]
    source = feed(spark, tmp_path / "in", rows, files=3)
    stream = stream_frames(source, FrameSpec.threshold(30), lateness_ms=5_000, early=True, **OPTIONS)
    changes, _ = run(spark, stream, tmp_path)
    assert [r.tie for r in late_rows(changes, ["key"]).collect()] == [2]
    assert [r.n_rows for r in latest_frames(changes, ["key"]).collect()] == [2]


@pytest.mark.parametrize("size,slide,offset", [(10_000, 10_000, 0), (30_000, 10_000, -3_000),
                                               (4_000, 10_000, 1_000)])
def test_time_windows_are_written_when_the_watermark_passes(spark, tmp_path, size, slide, offset):
    rows = arrivals("win", disorder=10_000)
    table = stream_windows(
        feed(spark, tmp_path / "in", rows), F.round(F.sum("value"), 4).alias("s"), keys=["key"],
        ts="ts", size_ms=size, slide_ms=slide, offset_ms=offset, lateness_ms=10_000,
    )
    out, _ = run(spark, table, tmp_path)
    sums = {}
    for key, ts, _, value in rows:
        start = (ts - offset) // slide * slide + offset
        while start > ts - size:
            sums[key, start] = sums.get((key, start), 0) + value
            start -= slide
    mark = max(r[1] for r in rows) - 10_000
    # Spark drops a window when the watermark reaches the end of the window it keeps state for.
    length = max(size, slide)
    want = sorted((k, s, round(v, 4)) for (k, s), v in sums.items() if s + length <= mark)
    got = out.select("key", F.unix_millis("window_start").alias("w"), "s",
                     (F.unix_millis("result_ts") - F.unix_millis("window_start")).alias("d"))
    assert sorted((r.key, r.w, r.s) for r in got.collect()) == want and want
    assert {r.d for r in got.collect()} == {size - 1}


def test_rows_without_a_place_are_reported(spark, tmp_path):
    rows = [("a", 1_000, 1, 5.0), ("a", None, 2, 6.0), ("a", 2_000, 3, None), (None, 3_000, 4, 7.0),
            ("a", 4_000, 5, float("nan")), ("a", 5_000, 6, float("inf")), ("a", 6_000, 7, 50.0)]
    source = feed(spark, tmp_path / "in", rows, files=2)
    stream = stream_frames(source, FrameSpec.delta(25), lateness_ms=60_000, early=True, **OPTIONS)
    changes, _ = run(spark, stream, tmp_path)
    assert {r.tie for r in rejected_rows(changes, ["key"]).collect()} == {2, 3, 5, 6}
    taken = [r for r in rows if r[2] in (1, 4, 7)]
    assert as_brute(latest_frames(changes, ["key"])) == brute.frames(taken, "delta", 25)


def test_time_windows_count_rows_without_a_time(spark, tmp_path):
    rows = [("a", 1_000, 1, 5.0), ("a", None, 2, 6.0), ("a", None, 3, 6.0)]
    table = stream_windows(feed(spark, tmp_path / "in", rows, files=1), keys=["key"], ts="ts", size_ms=1_000)
    _, query = run(spark, table, tmp_path)
    counts = {r.observed for r in progress_table(spark, query).collect()}
    assert '{"windows_rejected": {"rows": 2}}' in counts


def test_progress_of_more_batches_than_spark_keeps(spark, tmp_path):
    n = 103
    source = feed(spark, tmp_path / "in", [("a", i, i, 1.0) for i in range(n)], files=n)
    log = ProgressLog(spark, str(tmp_path / "progress"), every=40, of=["many"])
    spark.streams.addListener(log)
    try:
        query = (
            source.writeStream.queryName("many").format("noop")
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        deadline = time.time() + 30
        while log.table().filter("input_rows > 0").count() < n and time.time() < deadline:
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(log)
    seen = log.table().filter("input_rows > 0")
    assert len(query.recentProgress) <= 100
    assert seen.agg(F.count("*"), F.countDistinct("batch_id"), F.sum("input_rows")).first()[:] == (n, n, n)


class FakeStates:
    """States in memory, as a processor sees them in a task."""

    class Value:
        def __init__(self):
            self.held = None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    class Map:
        def __init__(self):
            self.held = {}
            self.reads = 0

        def keys(self):
            return iter(list(self.held))

        def containsKey(self, key):
            return key in self.held

        def getValue(self, key):
            self.reads += 1
            return self.held[key]

        def updateValue(self, key, value):
            self.held[key] = value

        def removeKey(self, key):
            del self.held[key]

    def __init__(self):
        self.maps = {}
        self.timers = set()

    def getValueState(self, name, schema):
        return self.Value()

    def getMapState(self, name, key, schema):
        self.maps[name] = self.Map()
        return self.maps[name]

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def processor_of(kind, spec, early=True, bucket_us=10_000_000, reduction=None):
    fields = [f.name for f in frames._frame_fields(frames.T.DoubleType())]
    if kind is frames.RowProcessor:
        fields = ["ts_us", "tie", "value", "frame_seq"]
    args = [] if kind is frames.RowProcessor else [reduction]
    made = kind(spec, early, bucket_us, ["key", "op", "revision", *fields, *(["result"] if reduction else [])], *args)
    made.init(FakeStates())
    return made


def sends(processor, rows, mark_ms=0):
    made = [Row("__ts", "__tie", "__value", "__ok", "__payload")(t, i, v, True, None) for t, i, v in rows]
    return list(processor.handleInputRows(("a",), iter(made), Mark(mark_ms)))


SECOND = 1_000_000


@pytest.mark.parametrize("name", sorted(CASES))
def test_a_late_row_folds_its_bucket_and_what_it_changes_alone(name):
    """1,000 rows in 100 buckets; a row that comes late costs a few buckets, wherever it falls."""
    rng = random.Random(name)
    rows = [(i * SECOND, i, round(rng.uniform(0, 60), 2)) for i in range(1_000)]
    processor = processor_of(frames.FrameProcessor, CASES[name][0])
    sends(processor, rows)
    assert processor.folded == 1_000
    told = {}
    for ts in (5, 250, 612, 995):
        before, reads = processor.folded, processor.handle.maps["rows"].reads
        late = [(ts * SECOND + 500_000, 5_000 + ts, 31.0)]
        out = sends(processor, late)
        rows += late
        assert processor.folded - before <= 60, (ts, processor.folded - before)
        assert processor.handle.maps["rows"].reads - reads <= 12
        told[ts] = out
    before = processor.folded
    sends(processor, [(2_000 * SECOND, 9_999, 7.0)])
    assert processor.folded - before == 1  # rows at the head fold themselves alone


def frames_told(lines):
    """Current frames of a change log held in memory."""
    held = {}
    for r in lines:
        if r.op == "upsert":
            held[r.start_us, r.start_tie] = (
                r.frame_seq, r.start_us // 1000, r.start_tie, r.end_us // 1000, r.is_closed, r.n_rows,
                round(r.sum_value, 4))
        elif r.op == "retract":
            held.pop((r.start_us, r.start_tie))
    return sorted(held.values())


@pytest.mark.parametrize("name", sorted(CASES))
@pytest.mark.parametrize("bucket_s", [1, 7, 1_000])
def test_any_order_of_arrival_gives_the_frames_of_a_batch(name, bucket_s):
    spec, kind, p = CASES[name]
    rng = random.Random(f"{name}{bucket_s}")
    rows = [("a", rng.randrange(100) * 1000, i, round(rng.uniform(0, 60), 2)) for i in range(120)]
    processor = processor_of(frames.FrameProcessor, spec, bucket_us=bucket_s * SECOND)
    lines = []
    for at in range(0, 120, 9):
        lines += sends(processor, [(ts * 1000, tie, v) for _, ts, tie, v in rows[at:at + 9]])
        want = [f[1:] for f in brute.frames(rows[:at + 9], kind, p)]
        assert frames_told(lines) == want


@pytest.mark.parametrize("name", sorted(CASES))
def test_rows_follow_their_frames(name):
    spec, kind, p = CASES[name]
    rng = random.Random(name)
    rows = [("a", rng.randrange(100) * 1000, i, round(rng.uniform(0, 60), 2)) for i in range(90)]
    early = processor_of(frames.RowProcessor, spec, bucket_us=7 * SECOND)
    held = {}
    for at in range(0, 90, 8):
        for r in sends(early, [(ts * 1000, tie, v) for _, ts, tie, v in rows[at:at + 8]]):
            held[r.tie] = r.frame_seq
        found = {}
        for f in brute.frames(rows[:at + 8], kind, p):
            found[f[1]] = f[6]
        counts = {}
        for seq in held.values():
            if seq is not None:
                counts[seq] = counts.get(seq, 0) + 1
        assert counts == found and len(held) == min(at + 8, 90)
    # Without early every row is written once, when the watermark has reached it.
    final = processor_of(frames.RowProcessor, spec, early=False, bucket_us=7 * SECOND)
    once = []
    ordered = sorted(rows, key=lambda r: (r[1], r[2]))
    for at in range(0, 90, 8):
        mark = max(0, ordered[at][1] - 1)
        once += sends(final, [(ts * 1000, tie, v) for _, ts, tie, v in ordered[at:at + 8]], mark)
    once += sends(final, [(10**9, 10**6, 1.0)], 200_000)
    assert sorted(r.tie for r in once) == sorted(r[2] for r in rows)
    assert {r.tie: r.frame_seq for r in once} == held


def test_a_caller_reduces_rows_and_carries_columns(spark, tmp_path):
    rows = arrivals("fold")
    spec, kind, p = CASES["delta"]
    order = RowFold(init=tuple, add=lambda acc, r: (*acc, r.tie), merge=lambda a, b: a + b,
                    result=list, returns="array<long>", columns=("tie",))
    source = feed(spark, tmp_path / "in", rows[:100], files=4)
    make = lambda: stream_frames(source, spec, lateness_ms=40_000, early=True, reduction=order, **OPTIONS)
    run(spark, make(), tmp_path)
    (tmp_path / "rest").mkdir()
    more = pa.table({n: pa.array(c, t) for n, c, t in zip(
        ("key", "ts", "tie", "value"), zip(*rows[100:]),
        (pa.string(), pa.int64(), pa.int64(), pa.float64()))})
    pq.write_table(more, tmp_path / "in" / "more.parquet")
    changes, _ = run(spark, make(), tmp_path)  # accumulators outlive a restart
    late = {r.tie for r in late_rows(changes, ["key"]).collect()}
    accepted = [r for r in rows if r[2] not in late]
    ties = {}
    for r in latest_frames(changes, ["key"]).collect():
        ties[r.key, r.frame_seq] = r.result
    assert as_brute(latest_frames(changes, ["key"])) == brute.frames(accepted, kind, p)
    for key in ("a", "b"):
        own = sorted((ts, tie) for k, ts, tie, _ in accepted if k == key)
        joined = [t for (k, _), found in sorted(ties.items()) if k == key for t in found]
        assert joined == [tie for _, tie in own]


def test_whole_numbers_stay_whole(spark, tmp_path):
    big = 1 << 53
    table = pa.table({"key": ["a"] * 3, "ts": [1_000, 2_000, 3_000], "tie": [1, 2, 3],
                      "value": [big + 1, 1, big + 3]})
    (tmp_path / "in").mkdir()
    pq.write_table(table, tmp_path / "in" / "a.parquet")
    source = spark.readStream.schema("key string, ts long, tie long, value long").parquet(str(tmp_path / "in"))
    top = RowFold.top_row("value")
    stream = stream_frames(source, FrameSpec.threshold(0), early=True, reduction=top, **OPTIONS)
    changes, _ = run(spark, stream, tmp_path)
    frame = latest_frames(changes, ["key"]).first()
    assert (frame.sum_value, frame.max_value, frame.result.value) == (2 * big + 5, big + 3, big + 3)


def test_stream_assignment_after_late_rows_equals_the_batch(spark, tmp_path):
    rows = arrivals("assign")
    spec, _, _ = CASES["threshold"]
    stream = stream_assign(feed(spark, tmp_path / "in", rows), spec, lateness_ms=40_000, early=True, **OPTIONS)
    changes, _ = run(spark, stream, tmp_path)
    assert changes.groupBy("tie").count().filter("count > 1").count() > 0  # some were renumbered
    batch = KeyedEvents.of(spark.createDataFrame(rows, SCHEMA), key="key", ts="ts", value="value", tie="tie")
    want = sorted((r.key, r.tie, r.frame_seq or 0) for r in batch.frames(spec).assign().collect())
    got = sorted((r.key, r.tie, r.frame_seq or 0) for r in latest_rows(changes, ["key"]).collect())
    assert got == want


@pytest.mark.parametrize("name", ["threshold", "boundary"])
@pytest.mark.parametrize("early", [True, False])
def test_a_busy_key_lies_in_several_state_partitions(spark, tmp_path, name, early):
    """90 % of the rows on one key: the frames of a batch, from rows that no single task holds."""
    spec, kind, p = CASES[name]
    rng = random.Random(name)
    rows = [("hot" if rng.random() < 0.9 else "b", rng.randrange(400) * 1000, i, round(rng.uniform(0, 60), 2))
            for i in range(300)]
    rows = sorted(rows, key=lambda r: r[1] + rng.randrange(50_000))
    rows.append(("hot", 10**7, 1000, 5.0))  # lets the watermark pass all others
    top = RowFold.top_row("tie")
    stream = stream_split_frames(
        feed(spark, tmp_path / "in", rows), spec, chunk_ms=20_000, lateness_ms=60_000, early=early,
        reduction=top, **OPTIONS)
    changes, query = run(spark, stream, tmp_path)
    late = {r.tie for r in late_rows(changes, ["key"]).collect()}
    accepted = [r for r in rows if r[2] not in late]
    want = brute.frames(accepted, kind, p)
    if not early:
        assert changes.groupBy("key", "start_us", "start_tie").count().filter("count > 1").isEmpty()
        want = [f for f in want if f[5] and f[4] < 10**6]
        got = [f for f in as_brute(changes.filter("op = 'upsert'")) if f[4] < 10**6]
    else:
        got = as_brute(latest_frames(changes, ["key"]))
    assert got == want and len(want) > 15
    by_tie = {r[2]: r for r in accepted}
    for r in changes.filter("op = 'upsert'").collect():
        assert by_tie[r.result.tie][3] == r.max_value


def test_rows_of_a_busy_key_are_spread(spark, tmp_path):
    rows = [("hot", i * 1000, i, float(i % 60)) for i in range(200)]
    stream = stream_split_frames(feed(spark, tmp_path / "in", rows), CASES["threshold"][0], chunk_ms=10_000,
                                 lateness_ms=10**6, early=True, **OPTIONS)
    run(spark, stream, tmp_path)
    state = spark.read.format("statestore")
    for operator in (0, 1):
        try:
            held = state.option("operatorId", operator).option("stateVarName", "parts").load(str(tmp_path / "cp"))
        except Exception:  # the other operator
            continue
        assert held.select("partition_id").distinct().count() > 1 and held.count() == 20
        break
    else:
        raise AssertionError("no operator holds the rows")


def test_folds_without_a_list_of_states_are_not_split(spark, tmp_path):
    with pytest.raises(ValueError, match="no short list of states"):
        stream_split_frames(feed(spark, tmp_path / "in", [], files=1), CASES["delta"][0], chunk_ms=1_000, **OPTIONS)
