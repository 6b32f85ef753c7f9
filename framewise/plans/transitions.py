"""Entry states of the chunks of a large key, for frames that depend on values.

A chunk does not know which frame is open when it begins. But a frame that opens
inside it depends on the rows after that point only, so for each row that could
be the chunk's first boundary the state at the chunk's end is fixed. Each chunk
therefore summarises itself as a step function of the entry state (built in
parallel). Neighbouring states that leave alike share a step, and states that the
key cannot reach have none. Steps are composed block by block, blocks are walked
in order, and every chunk is then scanned from its known start.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions.spec import FrameSpec, Mergeable
from framewise.plans.layout import CHUNK, join_small
from framewise.plans.ordered import OrderedRows
from framewise.session import materialize, store

ENTRY = ("__begun", "__state", "__seq_in")
ENTRY_FIELDS = "__begun boolean, __state decimal(38,0), __seq_in long"

# Sums of many 64-bit values need more than 64 bits.
WIDE = pa.decimal128(38, 0)
STEP_TYPES = {
    "lows": pa.list_(WIDE), "exits": pa.list_(WIDE), "frames": pa.list_(pa.int64()),
    "total": WIDE, "fresh_exit": WIDE, "fresh_frames": pa.int64(),
}
STEP_FIELDS = (
    "lows array<decimal(38,0)>, exits array<decimal(38,0)>, frames array<long>, "
    "total decimal(38,0), fresh_exit decimal(38,0), fresh_frames long"
)

BLOCK = "__block"
CHUNKS_PER_BLOCK = 256


@dataclass(frozen=True)
class Steps:
    """What a stretch of rows makes of the state of the frame that is open before it.

    Step ``i`` holds for states from ``lows[i - 1]`` (the first from anywhere
    below) up to the next. It gives the state after the stretch and the number
    of frames that open in it. Exit None: no frame opens and the state moves on
    by ``total``. ``fresh`` is for a stretch that no open frame precedes.
    """

    lows: list[int]
    exits: list[int | None]
    frames: list[int]
    total: int
    fresh: tuple[int, int]

    @staticmethod
    def of(
        steps: Iterable[tuple[int, int | None, int]], total: int, fresh: tuple[int, int]
    ) -> Steps:
        """From (lowest state, exit, frames) in order; equal neighbours become one."""
        lows, exits, frames = [], [], []
        for low, exit_, count in steps:
            if exits and exits[-1] == exit_ and frames[-1] == count:
                continue
            if exits:
                lows.append(low)
            exits.append(exit_), frames.append(count)
        return Steps(lows, exits, frames, total, fresh)

    def apply(self, state: int | None) -> tuple[int, int]:
        """State afterwards and frames opened."""
        if state is None:
            return self.fresh
        at = bisect_right(self.lows, state)
        exit_ = self.exits[at]
        return (state + self.total if exit_ is None else exit_), self.frames[at]

    def then(self, later: Steps) -> Steps:
        """Both stretches as one."""
        steps: list[tuple[Any, int | None, int]] = []
        for i, (exit_, count) in enumerate(zip(self.exits, self.frames)):
            low = self.lows[i - 1] if i else None
            if exit_ is not None:
                after, more = later.apply(exit_)
                steps.append((low, after, count + more))
                continue
            first = 0 if low is None else bisect_right(later.lows, low + self.total)
            last = len(later.lows)
            if i < len(self.lows):
                last = bisect_right(later.lows, self.lows[i] - 1 + self.total)
            for j in range(first, last + 1):
                start = low if j == first else later.lows[j - 1] - self.total
                steps.append((start, later.exits[j], later.frames[j]))
        after, more = later.apply(self.fresh[0])
        return Steps.of(steps, self.total + later.total, (after, self.fresh[1] + more))

    def cells(self) -> list[pa.Array]:
        values = (self.lows, self.exits, self.frames, self.total, *self.fresh)
        return [pa.array([v], t) for v, t in zip(values, STEP_TYPES.values())]

    @staticmethod
    def read(table: pa.Table) -> list[Steps]:
        return [
            Steps([int(x) for x in r["lows"]], [None if x is None else int(x) for x in r["exits"]],
                  r["frames"], int(r["total"]), (int(r["fresh_exit"]), r["fresh_frames"]))
            for r in table.select(list(STEP_TYPES)).to_pylist()
        ]


def delta_entries(rows: OrderedRows, value: str, pos: str, limit: int) -> DataFrame:
    """Entry state (first value of the open frame) of every chunk of a large key."""
    seen = rows.hot.agg(F.min(value).alias("low"), F.max(value).alias("high")).first()
    low, high = seen.low or 0, seen.high or 0
    return _entry_states(rows, value, pos, lambda v: delta_steps(v, limit, low, high))


def sum_entries(rows: OrderedRows, value: str, pos: str, limit: int, init: int) -> DataFrame:
    """Entry state (running sum of the open frame) of every chunk of a large key."""
    debts = F.least(F.col(value), F.lit(0).cast("long")).cast("decimal(38,0)")
    seen = rows.hot.agg(F.min(value).alias("low"), F.sum(debts).alias("debts")).first()
    # A sum of values that are never negative is no less than the least of them.
    lowest = init + max(seen.low or 0, 0) + int(seen.debts or 0)
    return _entry_states(rows, value, pos, lambda v: sum_steps(v, limit, init, lowest))


def delta_steps(values: np.ndarray, limit: int, lowest: int, highest: int) -> Steps:
    """Frames bounded by distance from their first value, for states from lowest to highest."""
    v = values.tolist()
    n = len(v)
    exits, frames = [0] * n, [0] * n
    # Rows ahead that no nearer row hides: rising values for the next higher
    # row, falling ones for the next lower; nearest last.
    high, high_at, low, low_at = [], [], [], []
    for i in range(n - 1, -1, -1):
        x = v[i]
        up = bisect_right(high, -(x + limit)) - 1
        down = bisect_right(low, x - limit) - 1
        nearest = min(
            high_at[up] if up >= 0 else n, low_at[down] if down >= 0 else n
        )
        if nearest < n:
            exits[i], frames[i] = exits[nearest], frames[nearest] + 1
        else:
            exits[i], frames[i] = x, 1
        while high and high[-1] >= -x:
            high.pop(), high_at.pop()
        high.append(-x), high_at.append(i)
        while low and low[-1] >= x:
            low.pop(), low_at.pop()
        low.append(x), low_at.append(i)
    up_at, down_at = _new_highs(v), _new_highs([-x for x in v])
    ups, downs = [v[i] for i in up_at], [-v[i] for i in down_at]

    def boundary(state: int) -> int:
        up, down = bisect_left(ups, state + limit), bisect_left(downs, limit - state)
        return min(up_at[up] if up < len(ups) else n, down_at[down] if down < len(downs) else n)

    starts = {x - limit + 1 for x in ups} | {limit - x for x in downs}
    starts = sorted(s for s in starts if lowest < s <= highest)
    return _steps([lowest, *starts], boundary, exits, frames, 0)


def sum_steps(values: np.ndarray, limit: int, init: int, lowest: int) -> Steps:
    """Frames bounded by their running sum, for states from lowest up."""
    n = len(values)
    p = [0, *accumulate(values.tolist())]
    exits, frames = [0] * n, [0] * n
    high, high_at = [], []
    for i in range(n - 1, -1, -1):
        ahead = bisect_right(high, -(limit - init + p[i])) - 1
        if ahead >= 0:
            j = high_at[ahead]
            exits[i], frames[i] = exits[j], frames[j] + 1
        else:
            exits[i], frames[i] = init + p[n] - p[i], 1
        end = p[i + 1]
        while high and high[-1] >= -end:
            high.pop(), high_at.pop()
        high.append(-end), high_at.append(i)
    up_at = _new_highs(p[1:])
    ups = [p[i + 1] for i in up_at]

    def boundary(state: int) -> int:
        up = bisect_left(ups, limit - state)
        return up_at[up] if up < len(ups) else n

    starts = sorted(limit - x for x in ups if limit - x > lowest)
    return _steps([lowest, *starts], boundary, exits, frames, p[n])


def _new_highs(values: list[int]) -> list[int]:
    """Rows where the running maximum takes a new value; the first row is one."""
    found, top = [], None
    for i, x in enumerate(values):
        if top is None or x > top:
            found.append(i)
            top = x
    return found


def _steps(
    starts: list[int], boundary: Callable[[int], int], exits: list[int], frames: list[int],
    total: int,
) -> Steps:
    def step(start: int) -> tuple[int, int | None, int]:
        at = boundary(start)
        return (start, exits[at], frames[at]) if at < len(exits) else (start, None, 0)

    return Steps.of(map(step, starts), total, (exits[0], frames[0]))


def _entry_states(
    rows: OrderedRows, value: str, pos: str, build: Callable[[np.ndarray], Steps]
) -> DataFrame:
    """One row per chunk: whether a frame is open before it, its state, frames so far."""
    keys = list(rows.layout.keys)
    hot = rows.hot.select(*keys, CHUNK, pos, value)
    types = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in hot.schema}
    key_fields = ", ".join(types[k] for k in keys)

    def summarise(group: pa.Table) -> pa.Table:
        ordered = group.sort_by(pos)
        return _headed(ordered, [*keys, CHUNK], build(ordered[value].to_numpy()))

    def compose(group: pa.Table) -> pa.Table:
        whole = reduce(Steps.then, Steps.read(group.sort_by(CHUNK)))
        return _headed(group, [*keys, BLOCK], whole)

    chunks = store(
        hot.groupBy(*keys, CHUNK)
        .applyInArrow(summarise, f"{key_fields}, {types[CHUNK]}, {STEP_FIELDS}")
        .withColumn(BLOCK, F.floor(F.col(CHUNK) / CHUNKS_PER_BLOCK).cast("int"))
    )
    blocks = chunks.groupBy(*keys, BLOCK).applyInArrow(
        compose, f"{key_fields}, {BLOCK} int, {STEP_FIELDS}"
    )
    before_blocks = materialize(
        blocks.groupBy(*keys).applyInArrow(
            _walk(keys, BLOCK), f"{key_fields}, {BLOCK} int, {ENTRY_FIELDS}"
        )
    )
    return materialize(
        join_small(chunks, before_blocks, [*keys, BLOCK])
        .groupBy(*keys, BLOCK)
        .applyInArrow(_walk(keys, CHUNK), f"{key_fields}, {types[CHUNK]}, {ENTRY_FIELDS}")
    )


def _headed(group: pa.Table, names: list[str], steps: Steps) -> pa.Table:
    head = group.slice(0, 1).select(names)
    return pa.Table.from_arrays(
        [*head.columns, *steps.cells()], names=[*names, *STEP_TYPES]
    )


def _walk(keys: list[str], order: str) -> Callable[[pa.Table], pa.Table]:
    """Entry states of consecutive stretches, from the state before the first if it has one."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        state, seq = None, 0
        if ENTRY[0] in group.column_names:
            begun, held, seq = (group[c][0].as_py() for c in ENTRY)
            state = int(held) if begun else None
        states, seqs = [], []
        for steps in Steps.read(group):
            states.append(state), seqs.append(seq)
            state, opened = steps.apply(state)
            seq += opened
        entry = [pa.array([s is not None for s in states]), pa.array([s or 0 for s in states], WIDE),
                 pa.array(seqs, pa.int64())]
        return pa.Table.from_arrays(
            [*group.select([*keys, order]).columns, *entry], names=[*keys, order, *ENTRY]
        )

    return run


def custom_entries(rows: OrderedRows, value: str, pos: str, spec: FrameSpec) -> DataFrame:
    """Entry states (packed) for a caller's fold, one row per chunk."""
    if spec.mergeable is not None:
        return _merged_entries(rows, value, pos, spec.mergeable)
    return _supposed_entries(rows, value, pos, spec)


def _merged_entries(rows: OrderedRows, value: str, pos: str, fold: Mergeable) -> DataFrame:
    """Entry states from summaries of all chunks, composed block by block.

    Each chunk is summarised once, whatever state it begins in, so the number
    of passes does not depend on the number of chunks or on the fold.
    """
    keys = list(rows.layout.keys)
    hot = rows.hot.select(*keys, CHUNK, pos, value)
    types = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in hot.schema}
    key_fields = ", ".join(types[k] for k in keys)
    entry = "__begun boolean, __state binary, __seq_in long"

    def headed(group: pa.Table, names: list[str], summary: Any) -> pa.Table:
        head = group.slice(0, 1).select(names)
        packed = pa.array([pickle.dumps(summary)], pa.binary())
        return pa.Table.from_arrays([*head.columns, packed], names=[*names, "__summary"])

    def summarise(group: pa.Table) -> pa.Table:
        values = group.sort_by(pos)[value].to_pylist()
        return headed(group, [*keys, CHUNK], fold.summarise(values))

    def compose(group: pa.Table) -> pa.Table:
        parts = map(pickle.loads, group.sort_by(CHUNK)["__summary"].to_pylist())
        return headed(group, [*keys, BLOCK], reduce(fold.compose, parts))

    def walk(order: str) -> Callable[[pa.Table], pa.Table]:
        def run(group: pa.Table) -> pa.Table:
            group = group.sort_by(order)
            state, seq = None, 0
            if ENTRY[0] in group.column_names:
                begun, held, seq = (group[c][0].as_py() for c in ENTRY)
                state = pickle.loads(held) if begun else None
            begun, states, seqs = [], [], []
            for packed in group["__summary"].to_pylist():
                begun.append(state is not None)
                states.append(None if state is None else pickle.dumps(state))
                seqs.append(seq)
                state, opened = fold.apply(pickle.loads(packed), state)
                seq += opened
            cells = [pa.array(begun, pa.bool_()), pa.array(states, pa.binary()), pa.array(seqs, pa.int64())]
            return pa.Table.from_arrays(
                [*group.select([*keys, order]).columns, *cells], names=[*keys, order, *ENTRY]
            )

        return run

    chunks = store(
        hot.groupBy(*keys, CHUNK)
        .applyInArrow(summarise, f"{key_fields}, {types[CHUNK]}, __summary binary")
        .withColumn(BLOCK, F.floor(F.col(CHUNK) / CHUNKS_PER_BLOCK).cast("int"))
    )
    blocks = chunks.groupBy(*keys, BLOCK).applyInArrow(
        compose, f"{key_fields}, {BLOCK} int, __summary binary"
    )
    before = store(
        blocks.groupBy(*keys).applyInArrow(walk(BLOCK), f"{key_fields}, {BLOCK} int, {entry}")
    )
    # The states are the caller's, of unknown size, so nothing is broadcast here.
    return store(
        join_small(chunks, before, [*keys, BLOCK], broadcast=False)
        .groupBy(*keys, BLOCK)
        .applyInArrow(walk(CHUNK), f"{key_fields}, {types[CHUNK]}, {entry}")
    )


def _supposed_entries(rows: OrderedRows, value: str, pos: str, spec: FrameSpec) -> DataFrame:
    """Entry states for any fold, by scanning chunks from supposed states until they agree.

    Every round scans, in parallel, the chunks whose supposed entry state
    proved wrong. The first ``r`` chunks of a key are right after ``r`` rounds,
    so the answer is exact; folds whose frames end now and then agree after two
    or three rounds.
    """
    keys = list(rows.layout.keys)
    names = [*keys, CHUNK]
    by_chunk = Window.partitionBy(*keys).orderBy(CHUNK)
    hot = store(rows.hot.select(*names, pos, value))
    known = materialize(
        hot.select(*names).distinct().withColumn("__in", F.lit(None).cast("binary"))
    )
    pending = known
    done: DataFrame | None = None
    while True:
        fresh = _scan_chunks(hot, pending, names, value, pos, spec)
        if done is not None:
            kept = done.join(
                F.broadcast(pending.select(*[F.col(c).alias(f"__p_{c}") for c in names])),
                _all_same(names), "left_anti",
            )
            fresh = kept.unionByName(fresh)
        done = materialize(fresh)
        wanted = done.withColumn("__want", F.lag("__out").over(by_chunk))
        pending = materialize(
            wanted.filter(~F.col("__want").eqNullSafe(F.col("__in")))
            .select(*names, F.col("__want").alias("__in"))
        )
        if pending.isEmpty():
            break
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    return materialize(
        done.select(
            *names,
            F.col("__in").isNotNull().alias("__begun"),
            F.col("__in").alias("__state"),
            F.coalesce(F.sum("__opened").over(before), F.lit(0)).alias("__seq_in"),
        )
    )


def _all_same(names: list[str]) -> Any:
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(name).eqNullSafe(F.col(f"__p_{name}"))
    return condition


def _scan_chunks(
    hot: DataFrame, pending: DataFrame, names: list[str], value: str, pos: str, spec: FrameSpec
) -> DataFrame:
    supposed = pending.select(*[F.col(c).alias(f"__p_{c}") for c in names], "__in")
    chosen = hot.join(F.broadcast(supposed), _all_same(names)).select(*names, "__in", pos, value)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema
                       if f.name in [*names, "__in"])

    def run(group: pa.Table) -> pa.Table:
        ordered = group.sort_by(pos)
        packed = ordered["__in"][0].as_py()
        state = None if packed is None else pickle.loads(packed)
        opened = 0
        for v in ordered[value].to_pylist():
            state, _, opens, _ = spec.step(state, v)
            opened += opens
        out = None if state is None else pickle.dumps(state)
        head = ordered.slice(0, 1).select([*names, "__in"])
        return pa.Table.from_arrays(
            [*head.columns, pa.array([out], pa.binary()), pa.array([opened], pa.int64())],
            names=[*head.column_names, "__out", "__opened"],
        )

    return chosen.groupBy(*names).applyInArrow(run, f"{schema}, __out binary, __opened long")
