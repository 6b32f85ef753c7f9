"""What a stretch of a key's rows does to its frames, in parts that can be put together.

A stretch is folded from the state that the rows before it leave. What it gives
depends on that state alone: a part of the frame that was open before, the
frames that begin and end in it, a part of the frame that it leaves open, and
the state behind it. So frames are numbered and joined across stretches without
folding a row again, and a stretch is folded again only if its rows or its entry
state have changed.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Row

from framewise.functions.reduce import ROW_FIELDS, RowFold
from framewise.functions.spec import FrameSpec


@dataclass
class Part:
    """Reductions of neighbouring rows of one frame."""

    n: int = 0
    total: Any = 0
    low: Any = None
    high: Any = None
    first: Any = None
    last: Any = None
    last_ts: int | None = None
    own: Any = None  # the caller's accumulator

    def plain(self) -> tuple:
        """For the state store, which holds no classes of this module."""
        return (self.n, self.total, self.low, self.high, self.first, self.last, self.last_ts, self.own)


@dataclass
class Frame:
    """A frame as far as it is known: ``end`` is None while it is open."""

    start: int
    tie: int
    part: Part
    end: int | None = None
    seq: int = 0

    def plain(self) -> tuple:
        return (self.start, self.tie, self.part.plain(), self.end, self.seq)

    @staticmethod
    def of(plain: tuple | None) -> Frame | None:
        if plain is None:
            return None
        start, tie, part, end, seq = plain
        return Frame(start, tie, Part(*part), end, seq)


@dataclass
class Stretch:
    """The effect of one stretch of rows, folded from ``entry`` to ``exit`` (packed states)."""

    entry: bytes | None
    exit: bytes | None
    head: Part | None = None  # of the frame that was open before
    head_end: int | None = None
    frames: list[Frame] = field(default_factory=list)  # begun here; only the last may be open
    places: list[int | None] = field(default_factory=list)  # per row: 0 = head, k = k-th frame here

    def plain(self) -> tuple:
        head = None if self.head is None else self.head.plain()
        frames = [f.plain() for f in self.frames]
        return (self.entry, self.exit, head, self.head_end, frames, self.places)

    @staticmethod
    def of(plain: tuple | None) -> Stretch | None:
        if plain is None:
            return None
        entry, exit_, head, head_end, frames, places = plain
        part = None if head is None else Part(*head)
        return Stretch(entry, exit_, part, head_end, [Frame.of(f) for f in frames], places)


class Folder:
    """Folds rows of one frame kind, with the caller's reduction if there is one."""

    def __init__(
        self, spec: FrameSpec, reduction: RowFold | None = None, places: bool = False
    ) -> None:
        self.spec = spec
        self.reduction = reduction
        self.places = places  # whether the frame of each row is kept
        self.columns = list(reduction.columns) if reduction else []

    def fold(self, entry: bytes | None, rows: list[tuple]) -> Stretch:
        """One pass over the rows (ts, tie, value, packed payload), which are in order."""
        state = None if entry is None else pickle.loads(entry)
        out = Stretch(entry, None, None if state is None else self._new())
        current = out.head
        make = Row(*ROW_FIELDS, *self.columns) if self.reduction else None
        for ts, tie, value, payload in rows:
            state, member, opened, closed = self.spec.step(state, int(value))
            if closed:
                if out.frames:
                    out.frames[-1].end = ts
                else:
                    out.head_end = ts
            if opened:
                current = self._new()
                out.frames.append(Frame(ts, tie, current))
            if member:
                row = make(ts, tie, value, *pickle.loads(payload)) if make else None
                self._add(current, ts, value, row)
            if self.places:
                out.places.append(len(out.frames) if member else None)
        out.exit = None if state is None else pickle.dumps(state)
        return out

    def follow(self, stretch: Stretch, before: Frame | None, seq: int) -> tuple[list[Frame], Frame | None, int]:
        """Frames that the stretch ends, the one open behind it, and the number of frames begun so far."""
        ended: list[Frame] = []
        still = before
        if before is not None and stretch.head is not None:
            still = Frame(before.start, before.tie, self._join(before.part, stretch.head), None, before.seq)
            if stretch.head_end is not None:
                still.end = stretch.head_end
                ended.append(still)
                still = None
        for own in stretch.frames:
            seq += 1
            frame = Frame(own.start, own.tie, own.part, own.end, seq)
            if frame.end is None:
                still = frame
            else:
                ended.append(frame)
        return ended, still, seq

    def _new(self) -> Part:
        return Part(own=self.reduction.init() if self.reduction else None)

    def _add(self, part: Part, ts: int, value: Any, row: Any) -> None:
        if part.n == 0:
            part.low = part.high = part.first = value
        elif value < part.low:
            part.low = value
        elif value > part.high:
            part.high = value
        part.n += 1
        part.total += value
        part.last, part.last_ts = value, ts
        if self.reduction:
            part.own = self.reduction.add(part.own, row)

    def _join(self, a: Part, b: Part) -> Part:
        if not a.n or not b.n:
            return a if a.n else b
        own = self.reduction.merge(a.own, b.own) if self.reduction else None
        return Part(a.n + b.n, a.total + b.total, min(a.low, b.low), max(a.high, b.high),
                    a.first, b.last, b.last_ts, own)
