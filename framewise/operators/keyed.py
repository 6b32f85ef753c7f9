"""Keyed events and the frames over them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions import times
from framewise.functions.reduce import POSITION, first_value, has_whole_part, statistics
from framewise.functions.scan import (
    CUSTOM_TYPE,
    SCAN_TYPE,
    custom_scan,
    delta_scan,
    scan_column,
    sum_scan,
)
from framewise.functions.spec import FrameSpec, Mergeable
from framewise.operators.intervals import rows_in_parts
from framewise.operators.timewin import TimeWindows
from framewise.plans import transitions
from framewise.plans.layout import CHUNK, KeyLayout
from framewise.plans.ordered import Lag, Lead, OrderedRows, RunningMin, RunningSum, position

VALUE = "__v"
OPENS = "__opens"
NEXT_TS = "__next_ts"
CLOSES = "__closes"
FRAME_COLUMNS = ["frame_seq", "frame_start", "frame_end", "is_closed", "n_rows"]

# Row positions of a chunked key: chunk number above, row number in the chunk below.
CHUNK_STRIDE = 1 << 40


@dataclass(frozen=True)
class KeyedEvents:
    """Events with a key, an event time, a value and a tiebreak for equal times.

    Within a key, ``(ts, tie)`` must be unique: it is the order that defines
    the frames. Rows without a time or a finite value belong to no window;
    ``rejected`` lists them.
    """

    df: DataFrame
    keys: tuple[str, ...]
    ts: str
    value: str
    tie: str
    layout_hint: KeyLayout | None = None
    max_rows: int | None = None

    @staticmethod
    def of(
        df: DataFrame,
        key: str | Column | Sequence[str],
        ts: str,
        value: str | Column,
        tie: str,
        layout: KeyLayout | None = None,
        max_rows: int | None = None,
    ) -> KeyedEvents:
        """Key a table. ``key`` and ``value`` may be expressions.

        ``layout`` reuses cut points measured before (or ``KeyLayout.flat`` when
        every key is known to be small); by default they are measured on first
        use. ``max_rows`` overrides the size at which a key is cut.
        """
        if isinstance(key, Column):
            df, key = df.withColumn("key", key), "key"
        if isinstance(value, Column):
            df, value = df.withColumn("value", value), "value"
        keys = (key,) if isinstance(key, str) else tuple(key)
        times.is_millis(df, ts)
        return KeyedEvents(df, keys, ts, value, tie, layout, max_rows)

    @cached_property
    def placed(self) -> DataFrame:
        """Rows that have a place on the key's timeline."""
        return self.df.filter(self._has_place)

    def rejected(self) -> DataFrame:
        """Rows without a time, or without a value that has a whole part (null, NaN, infinite)."""
        return self.df.filter(~self._has_place)

    @property
    def _has_place(self) -> Column:
        return F.col(self.ts).isNotNull() & has_whole_part(self.value)

    @cached_property
    def layout(self) -> KeyLayout:
        if self.layout_hint is not None:
            return self.layout_hint
        return KeyLayout.measure(self.df, self.keys, self.order, self.max_rows)

    @property
    def order(self) -> tuple[str, str]:
        return (self.ts, self.tie)

    @property
    def as_millis(self) -> bool:
        return times.is_millis(self.df, self.ts)

    def select_keys(self, condition: Column) -> KeyedEvents:
        """Keep only some keys. Unlike value or time filters this changes no frame."""
        return replace(self, df=self.df.filter(condition))

    def frames(self, spec: FrameSpec) -> Frames:
        return Frames(self, spec)

    def threshold(self, limit: int) -> Frames:
        return Frames(self, FrameSpec.threshold(limit))

    def delta(self, limit: int) -> Frames:
        return Frames(self, FrameSpec.delta(limit))

    def aggregate(
        self, how: str | Callable[[int, int], int], limit: int, init: int = 0,
        mergeable: Mergeable | None = None,
    ) -> Frames:
        return Frames(self, FrameSpec.aggregate(how, limit, init, mergeable))

    def boundary(self, bounds: Sequence[int]) -> Frames:
        return Frames(self, FrameSpec.boundary(bounds))

    def custom(self, **predicates: Any) -> Frames:
        return Frames(self, FrameSpec.custom(**predicates))

    def tumbling(self, size_ms: int, offset_ms: int = 0) -> TimeWindows:
        return self.sliding(size_ms, size_ms, offset_ms)

    def sliding(self, size_ms: int, slide_ms: int, offset_ms: int = 0) -> TimeWindows:
        return TimeWindows(self, size_ms, slide_ms, offset_ms)


def frames(
    df: DataFrame, kind: str, *, key: Any, ts: str, value: Any, tie: str, **params: Any
) -> Any:
    """Choose windows by name: a frame kind, or ``time`` with size_ms and slide_ms."""
    keyed = KeyedEvents.of(df, key, ts, value, tie)
    if kind == "time":
        return keyed.sliding(**params)
    return keyed.frames(FrameSpec.named(kind, **params))


@dataclass(frozen=True)
class Frames:
    """Frames of one kind over keyed events."""

    events: KeyedEvents
    spec: FrameSpec

    def assign(self) -> DataFrame:
        """The input rows with ``frame_seq``, the frame's number within its key.

        Null means that the row is in no frame.
        """
        return self.assigned.select(*self.events.df.columns, "frame_seq")

    def reduce(
        self,
        *aggregates: Column,
        min_rows: int = 1,
        with_tie: bool = False,
        map_frame: Callable[[DataFrame], DataFrame] | None = None,
    ) -> DataFrame:
        """One row per frame: bounds, row count and the given aggregates.

        ``frame_end`` is the time of the row that closed the frame; an open
        frame ends 1 ms after its last row. ``with_tie`` adds ``start_tie``,
        which with the key and the start identifies a frame. ``map_frame`` is
        applied to the frame table.
        """
        ev = self.events
        ts, next_ts = F.col(ev.ts), F.col(NEXT_TS)
        extra = [F.min(F.when(F.col(OPENS), F.col(ev.tie))).alias("start_tie")] if with_tie else []
        cells = [
            F.min(ts).alias("frame_start"),
            F.max(next_ts).alias("__after"),
            F.max(ts).alias("__last"),
            (F.count(next_ts) == F.count(F.lit(1))).alias("is_closed"),
            F.count(F.lit(1)).alias("n_rows"),
            *extra,
            *aggregates,
        ]
        after = F.col("__after")
        if self.spec.params.get("skips_rows"):
            table = self._with_closing_row(cells)
            after = F.col("__closing_ts")
            table = table.withColumn("is_closed", after.isNotNull())
        else:
            members = self.assigned.filter(F.col("frame_seq").isNotNull())
            table = members.groupBy(*ev.keys, "frame_seq").agg(*cells)
        end = F.when(F.col("is_closed"), after).otherwise(
            times.add_millis(F.col("__last"), 1, ev.as_millis)
        )
        named = [c for c in table.columns
                 if c not in (*ev.keys, *FRAME_COLUMNS, "__after", "__last", "__closing_ts")]
        table = table.withColumn("frame_end", end).select(*ev.keys, *FRAME_COLUMNS, *named)
        if min_rows > 1:
            table = table.filter(F.col("n_rows") >= min_rows)
        return map_frame(table) if map_frame else table

    def bounds(self) -> DataFrame:
        """The frame listing: bounds, closed, row count, sum of the values and first value."""
        return self.reduce(
            F.sum(VALUE).alias("aggregate"), first_value(VALUE).alias("aux"), with_tie=True
        )

    def stats(self) -> DataFrame:
        """count, sum, min, max, first and last of the value per frame."""
        return self.reduce(*statistics(self.events.value))

    def sum(self) -> DataFrame:
        """Sum of the value and time of the last row per frame."""
        ev = self.events
        return self.reduce(F.sum(ev.value).alias("sum_value"), F.max(ev.ts).alias("max_ts"))

    def last(self) -> DataFrame:
        """The last frame of each key."""
        table = self.sum()
        cells = [c for c in table.columns if c not in self.events.keys]
        return table.groupBy(*self.events.keys).agg(
            F.max_by(F.struct(*cells), "frame_seq").alias("__f")
        ).select(*self.events.keys, "__f.*")

    def split(
        self, points: DataFrame, *aggregates: Column, point: str = "point"
    ) -> DataFrame:
        """One row per part of a frame that ``points`` cut, reduced over its own rows.

        Each row goes to the part that holds it, so a part's aggregates are those
        of its rows alone. Parts are numbered as by ``intervals.split_frames``;
        those without rows have none here. ``first_ts`` and ``last_ts`` are the
        times of a part's first and last row.
        """
        ev = self.events
        rows = rows_in_parts(
            self.assigned.filter(F.col("frame_seq").isNotNull()), points, ev.keys, ev.ts, ev.tie,
            OPENS, point, ev.layout,
        )
        return rows.groupBy(*ev.keys, "frame_seq", "part_no").agg(
            F.min(ev.ts).alias("first_ts"), F.max(ev.ts).alias("last_ts"),
            F.count(F.lit(1)).alias("n_rows"), *aggregates,
        )

    @cached_property
    def assigned(self) -> DataFrame:
        """Rows with frame number, opening flag, next row's time and row position."""
        ev = self.events
        rows = OrderedRows.of(ev.placed, ev.layout)
        if self.spec.kind == "threshold":
            rows = self._threshold(rows)
        elif self.spec.kind == "boundary":
            rows = self._boundary(rows)
        elif self.spec.kind == "delta":
            rows = self._scanned(rows)
        elif self.spec.kind == "aggregate":
            how = self.spec.params["how"]
            native = {"max": self._max, "min": self._min, "count": self._count}
            rows = native.get(how, self._scanned)(rows)
        else:
            rows = self._scanned(rows)
        return rows.plain()

    def _base(self, rows: OrderedRows, **ops: Any) -> OrderedRows:
        """Next row's time, row position and whatever the kind looks back at.

        The truncated value is derived after the shuffle, which so carries the
        value once.
        """
        rows = rows.add(**{NEXT_TS: Lead(F.col(self.events.ts))}, **ops)
        at = F.row_number().over(rows.window).cast("long")
        if not rows.layout.is_flat:
            chunk = F.greatest(F.col(CHUNK), F.lit(0)).cast("long")
            at = chunk * F.lit(CHUNK_STRIDE) + at
        return rows.with_columns({POSITION: at, VALUE: _truncated(self.events.value)})

    def _numbered(self, rows: OrderedRows, opens: Column, member: Column | None) -> OrderedRows:
        rows = rows.with_columns({OPENS: opens})
        rows = rows.add(frame_seq=RunningSum(F.col(OPENS).cast("long")))
        if member is not None:
            rows = rows.with_columns({"frame_seq": F.when(member, F.col("frame_seq"))})
        return rows

    def _threshold(self, rows: OrderedRows) -> OrderedRows:
        limit = self.spec.params["limit"]
        rows = self._base(rows, __prev=Lag(F.col(self.events.value)))
        member = F.col(VALUE) >= limit
        opens = member & ~F.coalesce(_truncated("__prev") >= limit, F.lit(False))
        return self._numbered(rows, opens, member)

    def _boundary(self, rows: OrderedRows) -> OrderedRows:
        rows = self._base(rows, __prev=Lag(F.col(self.events.value)))
        cuts = self.spec.params["bounds"]
        now, before = (
            reduce(Column.__add__, [(v >= cut).cast("int") for cut in cuts])
            for v in (F.col(VALUE), _truncated("__prev"))
        )
        opens = ~before.eqNullSafe(now)
        return self._numbered(rows, opens, None)

    def _max(self, rows: OrderedRows) -> OrderedRows:
        # A running maximum reaches the limit at the row that holds it, and no
        # row can join after that: only this row and the one before matter.
        limit, init = self.spec.params["limit"], self.spec.params["init"]
        rows = self._base(rows, __prev=Lag(F.col(self.events.value)))
        prev = _truncated("__prev")
        opens = prev.isNull() | (F.col(VALUE) >= limit) | (prev >= limit) | F.lit(init >= limit)
        return self._numbered(rows, opens, None)

    def _min(self, rows: OrderedRows) -> OrderedRows:
        # Once a row is below the limit the running minimum stays there and the
        # frame never closes; before that every row is a frame of its own.
        limit, init = self.spec.params["limit"], self.spec.params["init"]
        rows = self._base(rows, __no=position(), __low=RunningMin(F.col(self.events.value)))
        above = (_truncated("__low") >= limit) & F.lit(init >= limit)
        opens = (F.col("__no") == 1) | above
        return self._numbered(rows, opens, None)

    def _count(self, rows: OrderedRows) -> OrderedRows:
        length = max(1, self.spec.params["limit"] - self.spec.params["init"] - 1)
        rows = self._base(rows, __no=position())
        return self._numbered(rows, (F.col("__no") - 1) % length == 0, None)

    def _scanned(self, rows: OrderedRows) -> OrderedRows:
        params = self.spec.params
        rows = self._base(rows)
        how = params.get("how")
        if self.spec.kind == "delta":
            scan = delta_scan(params["limit"])
            entries = lambda: transitions.delta_entries(rows, VALUE, POSITION, params["limit"])
        elif how == "sum":
            scan = sum_scan(params["limit"], params["init"])
            entries = lambda: transitions.sum_entries(
                rows, VALUE, POSITION, params["limit"], params["init"]
            )
        else:
            scan = custom_scan(self.spec)
            entries = lambda: transitions.custom_entries(rows, VALUE, POSITION, self.spec)
        generic = self.spec.kind == "custom" or how == "callable"
        returns = CUSTOM_TYPE if generic else SCAN_TYPE
        args = ["__first", VALUE]
        if rows.layout.is_flat:
            rows = rows.with_columns({"__first": F.col(POSITION) == 1})
        else:
            rows = rows.join_chunks(entries(), "__state" if generic else None)
            # The join keeps no order to rely on; this window sorts again.
            rows = rows.with_columns({"__first": F.row_number().over(rows.window) == 1})
            args += list(transitions.ENTRY)
        rows = rows.with_columns({"__scan": scan_column(scan, returns, *args)})
        seq = F.col("__scan.seq") if generic else F.col("__scan")
        columns = {"frame_seq": F.abs(seq), OPENS: F.coalesce(seq < 0, F.lit(False))}
        if generic:
            columns[CLOSES] = F.col("__scan.closes")
        return rows.with_columns(columns)

    def _with_closing_row(self, cells: list[Column]) -> DataFrame:
        """Frames with the closing row's time, where rows before it may have been skipped.

        A row can be in one frame and close another, so it counts for both: first
        apart, so that the caller's aggregates see members alone, then each frame
        takes the answers of its members and the time of its closing row.
        """
        ev = self.events
        roles = F.array(
            F.struct(F.col("frame_seq").alias("seq"), F.lit(True).alias("member")),
            F.struct(F.col(CLOSES).alias("seq"), F.lit(False).alias("member")),
        )
        both = (
            self.assigned.withColumn("__role", F.explode(F.filter(roles, lambda r: r["seq"].isNotNull())))
            .withColumn("frame_seq", F.col("__role.seq"))
            .withColumn("__member", F.col("__role.member"))
        )
        apart = both.groupBy(*ev.keys, "frame_seq", "__member").agg(*cells)
        names = [c for c in apart.columns if c not in (*ev.keys, "frame_seq", "__member")]
        joined = apart.groupBy(*ev.keys, "frame_seq").agg(
            F.first(F.when(F.col("__member"), F.struct(*names)), ignorenulls=True).alias("__cells"),
            F.max(F.when(~F.col("__member"), F.col("__last"))).alias("__closing_ts"),
        )
        return joined.select(*ev.keys, "frame_seq", "__cells.*", "__closing_ts")


def _truncated(name: str) -> Column:
    """A value as a whole number, truncated toward zero."""
    return F.col(name).cast("long")
