"""The ordered scan of value-dependent frames, as columns over sorted rows.

Each function takes whether the row is the first of its group and the row's
value, and keeps only the open frame's state between rows and between Arrow
batches. A group that continues a key (a chunk of a large key) gets the state
it starts from in three further columns.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any, Tuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from framewise.functions.spec import FrameSpec

# Frame number of a row, negative on the row that opens the frame.
SCAN_TYPE = "long"
# Frame number as above (null outside frames) and the number of the frame that the row closes.
CUSTOM_TYPE = "struct<seq: long, closes: long>"

Batches = Iterator[Tuple[pa.Array, ...]]


def delta_scan(limit: int) -> Callable[[Batches], Iterator[pa.Array]]:
    def scan(batches: Batches) -> Iterator[pa.Array]:
        low = high = seq = 0
        for first, value, *entry in batches:
            entries = _entries(entry, first)
            out = []
            for is_first, v in zip(first.to_pylist(), value.to_pylist()):
                if is_first:
                    begun, state, seq = next(entries)
                    if begun:
                        state = int(state)
                        low, high = state - limit, state + limit
                    opens = not begun or v >= high or v <= low
                else:
                    opens = v >= high or v <= low
                if opens:
                    seq += 1
                    low, high = v - limit, v + limit
                    out.append(-seq)
                else:
                    out.append(seq)
            yield pa.array(out, pa.int64())

    return scan


def sum_scan(limit: int, init: int) -> Callable[[Batches], Iterator[pa.Array]]:
    def scan(batches: Batches) -> Iterator[pa.Array]:
        total = seq = 0
        for first, value, *entry in batches:
            entries = _entries(entry, first)
            out = []
            for is_first, v in zip(first.to_pylist(), value.to_pylist()):
                if is_first:
                    begun, total, seq = next(entries)
                    total = int(total)
                    opens = not begun or total + v >= limit
                else:
                    opens = total + v >= limit
                if opens:
                    seq += 1
                    total = init + v
                    out.append(-seq)
                else:
                    total += v
                    out.append(seq)
            yield pa.array(out, pa.int64())

    return scan


def custom_scan(spec: FrameSpec) -> Callable[[Batches], Iterator[pa.Array]]:
    step = spec.step

    def scan(batches: Batches) -> Iterator[pa.Array]:
        state, seq = None, 0
        for first, value, *entry in batches:
            entries = _entries(entry, first)
            seqs, closes = [], []
            for is_first, v in zip(first.to_pylist(), value.to_pylist()):
                if is_first:
                    begun, packed, seq = next(entries)
                    state = pickle.loads(packed) if begun else None
                state, member, opened, closed = step(state, v)
                closes.append(seq if closed else None)
                seq += opened
                seqs.append(None if not member else -seq if opened else seq)
            yield pa.StructArray.from_arrays(
                [pa.array(seqs, pa.int64()), pa.array(closes, pa.int64())], ["seq", "closes"]
            )

    return scan


def scan_column(scan: Callable[..., Any], returns: str, *args: str) -> Column:
    """Apply a scan to rows that are already grouped and sorted.

    Marked nondeterministic because its result depends on the row order:
    Catalyst then neither moves filters below it nor evaluates it twice.
    """

    def run(batches: Iterator[Tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        yield from scan(batches)

    return F.arrow_udf(run, returns).asNondeterministic()(*args)


def _entries(entry: list[pa.Array], first: pa.Array) -> Iterator[tuple[bool, Any, int]]:
    """Entry states of the groups that begin in this batch, in order."""
    if not entry:
        while True:
            yield False, 0, 0
    begins = [column.filter(first).to_pylist() for column in entry]
    for begun, state, seq in zip(*begins):
        yield (True, state, seq) if begun else (False, 0, seq or 0)
