import random

import pytest
from pyspark.sql import functions as F

import brute
from framewise import FrameSpec, KeyedEvents
from framewise.operators.repair import repair_frames, repair_stored, store_frames

SCHEMA = "key string, ts long, tie long, value double"
CASES = {
    "threshold": (FrameSpec.threshold(30), "threshold", 30),
    "delta": (FrameSpec.delta(25), "delta", 25),
    "sum": (FrameSpec.aggregate("sum", 90), "aggregate", ("sum", 90, 0)),
}


def repaired(spark, stored_rows, late_rows, spec, max_rows=None, horizon=2):
    stored = KeyedEvents.of(
        spark.createDataFrame(stored_rows, SCHEMA), "key", "ts", "value", "tie", max_rows=max_rows
    )
    total = F.round(F.sum("value"), 4).alias("s")
    frames = stored.frames(spec).reduce(total, with_tie=True)
    late = spark.createDataFrame(late_rows, SCHEMA)
    table = repair_frames(frames, stored, late, spec, total, horizon=horizon)
    cells = ["key", "frame_seq", "frame_start", "start_tie", "frame_end", "is_closed", "n_rows", "s"]
    return sorted((tuple(r) for r in table.select(cells).collect()), key=brute.order)


@pytest.mark.parametrize("max_rows", [None, 15])
@pytest.mark.parametrize("name", sorted(CASES))
def test_repair_equals_a_run_over_all_rows(spark, name, max_rows):
    spec, kind, p = CASES[name]
    rng = random.Random(name)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.randrange(200), i,
             round(rng.uniform(0, 60), 2)) for i in range(220)]
    # Keys without late rows, with only late rows, and late rows before, between and after.
    late = [r for r in rows if rng.random() < 0.04] + [("new", 5, 900, 50.0), ("a", -3, 901, 44.0),
                                                         ("b", 999, 902, 10.0)]
    stored = [r for r in rows if r not in late]
    assert repaired(spark, stored, late, spec, max_rows) == brute.frames(stored + late, kind, p)


def test_late_rows_in_each_place(spark):
    """One key per place: inside a frame, in a gap, at a border, before and after all rows."""
    series = [(1000, 55.0), (2000, 56.0), (3000, 10.0), (6000, 70.0), (7000, 71.0), (8000, 5.0),
              (9000, 90.0)]
    places = [(1500, 3.0), (1500, 60.0), (4000, 60.0), (4000, 5.0), (500, 80.0), (500, 1.0),
              (2500, 2.0), (5999, 99.0), (9500, 99.0), (9500, 1.0)]
    stored = [(f"k{i}", t, t, v) for i in range(len(places)) for t, v in series]
    late = [(f"k{i}", t, 77, v) for i, (t, v) in enumerate(places)]
    got = repaired(spark, stored, late, FrameSpec.threshold(50), horizon=1)
    assert got == brute.frames(stored + late, "threshold", 50)


def test_constant_steps_never_agree_and_are_scanned_to_the_end(spark):
    # One more row shifts every later frame of a constant series.
    stored = [("k", i, i, 10.0) for i in range(60)]
    late = [("k", 5, 100, 10.0)]
    got = repaired(spark, stored, late, FrameSpec.aggregate("sum", 45))
    assert got == brute.frames(stored + late, "aggregate", ("sum", 45, 0))


def test_only_the_file_groups_of_late_keys_are_replaced(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("abcdefgh"), rng.randrange(200), i, round(rng.uniform(0, 60), 2)) for i in range(300)]
    late = [("a", 50, 900, 10.0), ("new", 5, 901, 20.0), ("c", None, 902, 1.0)]
    spec, total = FrameSpec.delta(25), F.round(F.sum("value"), 4).alias("s")
    stored = KeyedEvents.of(spark.createDataFrame(rows, SCHEMA), "key", "ts", "value", "tie")
    path = str(tmp_path / "frames")
    store_frames(stored.frames(spec).reduce(total, with_tie=True), ["key"], path, groups=8)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "frames").rglob("*.parquet")}
    replaced = repair_stored(path, stored, spark.createDataFrame(late, SCHEMA), spec, total, groups=8)
    cells = ["key", "frame_seq", "frame_start", "start_tie", "frame_end", "is_closed", "n_rows", "s"]
    got = sorted((tuple(r) for r in spark.read.parquet(path).select(cells).collect()), key=brute.order)
    assert got == brute.frames(rows + late[:2], "delta", 25)
    assert 1 <= len(replaced) <= 2
    for file, at in before.items():
        group = int(file.parent.name.split("=")[1])
        assert (file.exists() and file.stat().st_mtime_ns == at) == (group not in replaced)
    assert repair_stored(path, stored, spark.createDataFrame(late[2:], SCHEMA), spec, total, groups=8) == []


def test_keys_that_go_on_are_read_from_what_was_set_aside(spark, monkeypatch):
    """A constant series never agrees: the whole table is read in the first two rounds alone."""
    from framewise.operators import repair

    reads = []
    between = repair._rows_between
    monkeypatch.setattr(repair, "_rows_between", lambda rows, *a: reads.append(rows) or between(rows, *a))
    stored = [("k", i, i, 10.0) for i in range(800)]
    late = [("k", 5, 9_000, 10.0)]
    got = repaired(spark, stored, late, FrameSpec.aggregate("sum", 45), horizon=1)
    assert got == brute.frames(stored + late, "aggregate", ("sum", 45, 0))
    assert len(reads) >= 4 and len({id(r) for r in reads}) == 2


def test_tables_of_a_scope_go_with_it(spark):
    from pathlib import Path

    from framewise.session import scratch, store

    files = lambda df: [Path(f.removeprefix("file:").removeprefix("//")) for f in df.inputFiles()]
    with scratch(spark):
        inner, kept = store(spark.range(3)), store(spark.range(4), keep=True)
        gone, held = files(inner), files(kept)
        assert all(f.exists() for f in gone + held)
    assert not any(f.exists() for f in gone) and all(f.exists() for f in held)
    assert kept.count() == 4
