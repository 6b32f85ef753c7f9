import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from framewise import KeyedEvents, KeyLayout
from framewise.functions.spec import FrameSpec, Mergeable
from framewise.plans import transitions
from framewise.plans.transitions import delta_steps, sum_steps

NEAR = st.integers(-30, 30)
# Sums and distances of these do not fit 64 bits.
FAR = st.one_of(NEAR, st.integers(2**62 - 40, 2**62 + 40), st.integers(-(2**62) - 40, -(2**62) + 40))


def lists(of):
    return st.lists(of, min_size=1, max_size=40)


def scan(spec, state, values):
    opened = 0
    for v in values:
        state, _, opens, _ = spec.step(state, v)
        opened += opens
    return state, opened


def array(values):
    return np.array(values, dtype=np.int64)


@settings(max_examples=400, deadline=None)
@given(lists(NEAR), st.integers(-40, 40), st.integers(-2, 60))
def test_delta_steps_give_the_state_of_the_scan(values, entry, limit):
    steps = delta_steps(array(values), limit, -40, 40)
    assert steps.apply(entry) == scan(FrameSpec.delta(limit), entry, values)
    assert steps.apply(None) == scan(FrameSpec.delta(limit), None, values)


@settings(max_examples=400, deadline=None)
@given(lists(NEAR), st.integers(-40, 80), st.integers(-20, 90), st.integers(-5, 5))
def test_sum_steps_give_the_state_of_the_scan(values, entry, limit, init):
    steps = sum_steps(array(values), limit, init, -40)
    spec = FrameSpec.aggregate("sum", limit, init)
    assert steps.apply(entry) == scan(spec, entry, values)
    assert steps.apply(None) == scan(spec, None, values)


@settings(max_examples=300, deadline=None)
@given(lists(FAR), FAR, st.sampled_from([1, 50, 2**62, 2**63 + 9]))
def test_steps_of_values_near_the_ends_of_the_range(values, entry, limit):
    ends = -(2**63), 2**63
    assert delta_steps(array(values), limit, *ends).apply(entry) == scan(
        FrameSpec.delta(limit), entry, values)
    assert sum_steps(array(values), limit, 0, -(2**70)).apply(entry) == scan(
        FrameSpec.aggregate("sum", limit), entry, values)


@settings(max_examples=300, deadline=None)
@given(st.lists(lists(FAR), min_size=2, max_size=4), FAR, st.sampled_from([1, 20, 2**62]))
def test_composed_steps_are_those_of_all_rows(parts, entry, limit):
    values = [v for part in parts for v in part]
    for build, spec in (
        (lambda v: delta_steps(array(v), limit, -(2**63), 2**63), FrameSpec.delta(limit)),
        (lambda v: sum_steps(array(v), limit, 0, -(2**70)), FrameSpec.aggregate("sum", limit)),
    ):
        whole = build(parts[0])
        for part in parts[1:]:
            whole = whole.then(build(part))
        assert whole.apply(entry) == scan(spec, entry, values)
        assert whole.apply(None) == scan(spec, None, values)


def test_steps_stay_few_when_frames_are_shorter_than_the_chunk():
    rng = np.random.default_rng(1)
    n = 100_000
    rising, constant, random = np.arange(n), np.full(n, 7), rng.integers(0, 100, n)
    for values in (rising, constant, random):
        low, high = int(values.min()), int(values.max())
        for limit in (50, 10**9):
            assert len(delta_steps(values, limit, low, high).exits) <= 110
        for limit in (500, 5_000):
            assert len(sum_steps(values, limit, 0, low).exits) <= limit // 7 + 2


def test_large_values_give_the_same_frames_whole_and_cut(spark):
    rng = np.random.default_rng(2)
    rows = [("a", i, i, int(v)) for i, v in enumerate(rng.integers(-(2**62), 2**62, 300))]
    rows += [("b", i, 1_000 + i, 2**62 + i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, ts long, tie long, value long")
    for spec in (FrameSpec.aggregate("sum", 4 * 10**18), FrameSpec.aggregate("sum", -5, 2**62),
                 FrameSpec.delta(2**62)):
        whole, cut = (
            {(r.key, r.frame_seq, r.frame_start, r.frame_end, r.n_rows)
             for r in KeyedEvents.of(df, "key", "ts", "value", "tie", max_rows=m)
             .frames(spec).reduce().collect()}
            for m in (None, 40)
        )
        kind = "delta" if spec.kind == "delta" else "aggregate"
        p = spec.params["limit"] if kind == "delta" else (
            "sum", spec.params["limit"], spec.params["init"])
        loop = {(k, s, b, e, n) for k, s, b, _, e, _, n, _ in brute.frames(rows, kind, p)}
        assert whole == cut == loop


def test_many_chunks_are_joined_by_key(spark, monkeypatch):
    monkeypatch.setattr("framewise.plans.ordered.BROADCAST_CHUNKS", 0)
    rng = np.random.default_rng(3)
    rows = [("a" if i % 4 else None, i // 3, i, int(v)) for i, v in enumerate(rng.integers(0, 60, 200))]
    df = spark.createDataFrame(rows, "key string, ts long, tie long, value long")
    for spec, kind, p in ((FrameSpec.delta(25), "delta", 25), (FrameSpec.threshold(30), "threshold", 30)):
        found = KeyedEvents.of(df, "key", "ts", "value", "tie", max_rows=20).frames(spec).reduce()
        got = {(r.key, r.frame_seq, r.frame_start, r.frame_end, r.n_rows) for r in found.collect()}
        assert got == {(k, s, b, e, n) for k, s, b, _, e, _, n, _ in brute.frames(rows, kind, p)}


def skipping():
    """Opens at 20, counts rows from 10 up to three, closes below 0."""
    # Built here: tasks cannot import this module.
    return FrameSpec.custom(
        opens=lambda v: v >= 20, start=lambda v: 1, keeps=lambda v, s: v >= 10,
        fold=lambda v, s: min(s + 1, 3), closes=lambda v, s: v < 0 or (s == 3 and v > 25),
        states=[1, 2, 3],
    )


@settings(max_examples=300, deadline=None)
@given(st.lists(lists(NEAR), min_size=1, max_size=5), st.sampled_from([None, 1, 2, 3]))
def test_tables_of_a_finite_fold_give_the_state_of_the_scan(parts, entry):
    spec = skipping()
    fold = spec.mergeable
    whole = fold.summarise(parts[0])
    for part in parts[1:]:
        whole = fold.compose(whole, fold.summarise(part))
    assert fold.apply(whole, entry) == scan(spec, entry, [v for part in parts for v in part])


def test_a_state_that_was_not_named_is_an_error():
    spec = FrameSpec.custom(opens=lambda v: True, start=lambda v: v, keeps=lambda v, s: True, states=[1])
    with pytest.raises(ValueError, match="not among its states"):
        spec.mergeable.summarise([7])


def test_mergeable_folds_over_chunks_take_two_passes(spark, monkeypatch):
    """A caller's sum that never forgets, over one key in 60 chunks: no rounds, and the frames of a scan."""
    rng = random.Random(8)
    rows = [("k", i, i, float(rng.randrange(0, 30))) for i in range(600)]
    capped = lambda v, agg: agg + min(v, 20)

    def summarise(values):  # by entry sum 0..199: exit and frames, the fresh one last
        step, table = FrameSpec.aggregate(capped, 200).step, []
        for state in [*range(200), None]:
            opened = 0
            for v in values:
                state, _, opens, _ = step(state, v)
                opened += opens
            table.append((state, opened))
        return table

    fold = Mergeable(
        summarise,
        lambda a, b: [(b[-1 if s is None else s][0], n + b[-1 if s is None else s][1]) for s, n in a],
        lambda table, state: table[-1 if state is None else state],
    )
    rounds = []
    monkeypatch.setattr(transitions, "_scan_chunks", lambda *a: rounds.append(1))
    df = spark.createDataFrame(rows, "key string, ts long, tie long, value double")
    events = KeyedEvents.of(df, "key", "ts", "value", "tie", max_rows=10)
    frames = events.aggregate(capped, 200, mergeable=fold).sum().orderBy("frame_seq").collect()
    want = brute.frames(rows, "aggregate", (capped, 200, 0))
    assert [(r.frame_seq, r.n_rows, r.sum_value) for r in frames] == [(f[1], f[6], f[7]) for f in want]
    assert not rounds and len(want) > 20


@pytest.mark.parametrize("max_rows", [None, 12])
def test_closing_rows_come_from_one_scan(spark, max_rows):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), i, i, float(rng.randrange(-10, 40))) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, ts long, tie long, value double")
    events = KeyedEvents.of(df, "key", "ts", "value", "tie", max_rows=max_rows)
    spec = skipping()
    table = events.frames(spec).reduce(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    want = []
    for key in "ab":
        state, current = None, None
        for _, ts, _, v in sorted(r for r in rows if r[0] == key):
            state, member, opened, closed = spec.step(state, int(v))
            if closed:
                want.append((*current, ts, True))
            if opened:
                current = (key, len([w for w in want if w[0] == key]) + 1, 0, 0.0)
            if member:
                current = (*current[:2], current[2] + 1, current[3] + v)
                last = ts
        if state is not None:
            want.append((*current, last + 1, False))
    cells = ["key", "frame_seq", "n", "s", "frame_end", "is_closed"]
    assert sorted(tuple(r) for r in table.select(cells).collect()) == sorted(want)
    assert table.filter("n <> n_rows").isEmpty()
    if max_rows is None:
        flat = KeyedEvents.of(df, "key", "ts", "value", "tie", layout=KeyLayout.flat(["key"], ["ts", "tie"]))
        plan = flat.frames(spec).reduce(F.sum("value").alias("s"))._jdf.queryExecution().executedPlan().toString()
        by_time = [line for line in plan.splitlines() if "Sort [" in line and "ts#" in line]
        assert len(by_time) == 1 and "Join" not in plan and plan.count("Scan ExistingRDD") == 1
