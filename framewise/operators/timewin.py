"""Tumbling and sliding event-time windows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions import times

if TYPE_CHECKING:
    from framewise.operators.keyed import KeyedEvents


# Overlap from which sums are computed by panes.
MANY_WINDOWS = 16
# Panes travel to the stretches of time that their windows start in, this many windows long.
STRETCH = 8
# Pairs of pane and window that one task reduces, about; fewer partitions would spill.
TASK_PAIRS = 4_000_000


def check_window(size_ms: int, slide_ms: int, offset_ms: int) -> None:
    if size_ms <= 0 or slide_ms <= 0 or abs(offset_ms) >= slide_ms:
        raise ValueError("time windows need size > 0, slide > 0 and abs(offset) < slide")


def window_column(ts: Column, size_ms: int, slide_ms: int, offset_ms: int = 0) -> Column:
    """The window(s) of a timestamp; one row per window when windows overlap.

    With gaps between windows (slide larger than size) this is the window of
    length ``slide`` that holds the time; the caller keeps its first part.
    """
    check_window(size_ms, slide_ms, offset_ms)
    start = f"{offset_ms % slide_ms} milliseconds"
    size = max(size_ms, slide_ms) if slide_ms > size_ms else size_ms
    return F.window(ts, f"{size} milliseconds", f"{slide_ms} milliseconds", start)


@dataclass(frozen=True)
class TimeWindows:
    """Windows of ``size_ms`` every ``slide_ms``, shifted by ``offset_ms``."""

    events: KeyedEvents
    size_ms: int
    slide_ms: int
    offset_ms: int = 0

    def __post_init__(self) -> None:
        check_window(self.size_ms, self.slide_ms, self.offset_ms)

    def assign(self) -> DataFrame:
        """One output row per input row and window that holds it."""
        ev = self.events
        return self._windowed().select(*ev.df.columns, "window_start", "window_end")

    def reduce(self, *aggregates: Column) -> DataFrame:
        """One row per key and window.

        Spark aggregates partially before the shuffle on (key, window), so a
        key with many rows is spread over its windows and over the map tasks.
        """
        ev = self.events
        return (
            self._windowed()
            .groupBy(*ev.keys, "window_start", "window_end")
            .agg(F.count(F.lit(1)).alias("n_rows"), *aggregates)
        )

    def reduce_panes(self, partial: Sequence[Column], final: Sequence[Column]) -> DataFrame:
        """As ``reduce``, for aggregates that can be merged.

        Rows are first reduced by ``partial`` in panes, the longest pieces that
        no window cuts, and then the panes of each window by ``final``. A row
        is handled once, not once per window, which pays when windows overlap
        often and panes hold several rows.

        Only panes are shuffled: by key and the stretch of time in which their
        windows start (two stretches at a border), and the windows of a stretch
        are reduced where its panes are.
        """
        ev = self.events
        pane_ms = math.gcd(self.size_ms, self.slide_ms)
        ts = times.to_timestamp(F.col(ev.ts), ev.as_millis)
        panes = (
            ev.placed.withColumn("__p", window_column(ts, pane_ms, pane_ms, self.offset_ms % pane_ms))
            .groupBy(*ev.keys, "__p")
            .agg(F.count(F.lit(1)).alias("__n"), *partial)
            .withColumn("__t", F.col("__p.start"))
        )
        span = max(self.size_ms, self.slide_ms)

        def stretch(ts: Column) -> Column:
            return window_column(ts, STRETCH * span, STRETCH * span)

        # The first window that may hold a pane starts here.
        early = times.add_millis(F.col("__t"), 1 - span, False)
        dealt = (
            panes.drop("__p")
            .withColumn("__from", stretch(early)).withColumn("__to", stretch(F.col("__t")))
            .withColumn("__at", F.explode(F.array_distinct(F.array("__from.start", "__to.start"))))
            .drop("__from", "__to")
            .repartition(self._tasks(), *ev.keys, "__at")
        )
        # A generator, unlike overlapping windows, keeps what Spark knows of the partitions.
        step = times.millis_interval(self.slide_ms)
        last = window_column(F.col("__t"), self.slide_ms, self.slide_ms, self.offset_ms)
        number = F.explode(F.sequence(F.lit(0), F.lit(self._overlap - 1)))
        end = times.add_millis(F.col("__s"), self.size_ms, False)
        spread = (
            dealt.withColumn("__last", last).withColumn("__i", number)
            .withColumn("__s", F.col("__last.start") - step * F.col("__i"))
            .filter(F.col("__t") < end)
            .withColumn("__in", stretch(F.col("__s"))).filter(F.col("__in.start") == F.col("__at"))
            .withColumns({
                "window_start": times.from_timestamp(F.col("__s"), ev.as_millis),
                "window_end": times.from_timestamp(end, ev.as_millis),
            })
        )
        return (
            spread.groupBy(*ev.keys, "__at", "window_start", "window_end")
            .agg(F.sum("__n").alias("n_rows"), *final)
            .drop("__at")
        )

    @property
    def _overlap(self) -> int:
        """The most windows that hold a time."""
        return math.ceil(self.size_ms / self.slide_ms)

    def _tasks(self) -> int:
        """Partitions for the panes: as many as the session has, more if each would hold too much."""
        spark = self.events.df.sparkSession
        pairs = self.events.placed.count() * self._overlap
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return max(least, math.ceil(pairs / TASK_PAIRS))

    def sum(self) -> DataFrame:
        """Sum of the value and time of the last row per window."""
        ev = self.events
        parts = [F.sum(ev.value).alias("sum_value"), F.max(ev.ts).alias("max_ts")]
        if self.size_ms < MANY_WINDOWS * self.slide_ms:
            return self.reduce(*parts)
        merged = [F.sum("sum_value").alias("sum_value"), F.max("max_ts").alias("max_ts")]
        return self.reduce_panes(parts, merged)

    def _windowed(self) -> DataFrame:
        ev = self.events
        return self._spread(ev.placed, times.to_timestamp(F.col(ev.ts), ev.as_millis))

    def _spread(self, rows: DataFrame, ts: Column) -> DataFrame:
        """Rows with the bounds of each window that holds ``ts``."""
        millis = self.events.as_millis
        rows = rows.withColumn(
            "__w", window_column(ts, self.size_ms, self.slide_ms, self.offset_ms)
        )
        start = F.col("__w.start")
        end = times.add_millis(start, self.size_ms, False)
        if self.slide_ms > self.size_ms:
            rows = rows.filter(ts < end)
        return rows.withColumns(
            {
                "window_start": times.from_timestamp(start, millis),
                "window_end": times.from_timestamp(end, millis),
            }
        ).drop("__w")
