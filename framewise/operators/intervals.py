"""Frames as intervals: membership, coalescing, splitting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions import times
from framewise.plans.layout import KeyLayout
from framewise.plans.ordered import LastValue, Lead, OrderedRows, RunningMax, RunningSum, position

START, END, TIE, SEQ, CLOSED = "frame_start", "frame_end", "start_tie", "frame_seq", "is_closed"

BUCKETS_PER_WINDOW = 64


def in_frame(ts: Column, start: Column, end: Column) -> Column:
    """``start <= ts < end``."""
    return (ts >= start) & (ts < end)


def coalesce_frames(
    frames: DataFrame,
    keys: Sequence[str],
    *aggregates: Column,
    touching: bool = False,
    layout: KeyLayout | None = None,
) -> DataFrame:
    """Unite the frames of a key that share some time.

    A united frame covers its parts and is closed if one of them is. With
    ``touching`` also frames that only meet are united, and a united frame
    counts as open because its end is still to be found again. ``aggregates``
    combine the parts' states. Needs ``frame_start, start_tie, frame_end,
    is_closed``; ``layout`` may be that of the events the frames came from.
    """
    keys = list(keys)
    layout = _frame_layout(frames, keys, layout)
    rows = OrderedRows.of(frames, layout).add(__reach=RunningMax(F.col(END), before=True))
    reach = F.col("__reach")
    apart = F.col(START) > reach if touching else F.col(START) >= reach
    rows = rows.with_columns({"__apart": F.coalesce(apart, F.lit(True)).cast("long")})
    rows = rows.add(__group=RunningSum(F.col("__apart")))
    closed = F.max(CLOSED)
    if touching:
        closed = F.when(F.count(F.lit(1)) == 1, closed).otherwise(F.lit(False))
    return (
        rows.df.groupBy(*keys, "__group")
        .agg(
            F.min(START).alias(START),
            F.max(END).alias(END),
            closed.alias(CLOSED),
            F.count(F.lit(1)).alias("n_frames"),
            *aggregates,
        )
        .withColumnRenamed("__group", SEQ)
    )


def split_frames(
    frames: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    point: str = "point",
    layout: KeyLayout | None = None,
) -> DataFrame:
    """Cut frames at points inside them; parts are numbered within their frame.

    All parts but the last are closed; the last keeps its frame's flag. Points
    outside every frame, or on a frame's start, cut nothing. ``layout`` is that
    of the events, if the points are event times.
    """
    keys = list(keys)
    frame = F.struct(START, END, SEQ, CLOSED)
    starts = frames.select(
        *keys, F.col(START).alias("__t"), F.lit(0).alias("__side"),
        F.col(TIE).alias("__tie"), frame.alias("__frame"),
    )
    marks = points.select(*keys, F.col(point).alias("__t")).distinct()
    both = starts.unionByName(
        marks.withColumn("__side", F.lit(1)), allowMissingColumns=True
    )
    rows = OrderedRows.of(both, _mixed_layout(both, keys, layout))
    rows = rows.add(__of=LastValue(F.col("__frame")))
    cuts = (F.col("__t") > F.col(f"__of.{START}")) & (F.col("__t") < F.col(f"__of.{END}"))
    rows = rows.map(lambda df: df.filter((F.col("__side") == 0) | cuts))
    rows = rows.add(
        __next=Lead(F.struct(F.col("__t").alias("t"), F.col(f"__of.{SEQ}").alias("seq"))),
        __no=position(),
    )
    rows = rows.add(__base=LastValue(F.when(F.col("__side") == 0, F.col("__no"))))
    inner = F.coalesce(F.col("__next.seq") == F.col(f"__of.{SEQ}"), F.lit(False))
    return rows.df.select(
        *keys,
        F.col(f"__of.{SEQ}").alias(SEQ),
        (F.col("__no") - F.col("__base") + 1).alias("part_no"),
        F.col("__t").alias(START),
        F.when(inner, F.col("__next.t")).otherwise(F.col(f"__of.{END}")).alias(END),
        (inner | F.col(f"__of.{CLOSED}")).alias(CLOSED),
    )


def rows_in_parts(
    rows: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    opens: str,
    point: str = "point",
    layout: KeyLayout | None = None,
) -> DataFrame:
    """Rows of frames with ``part_no``, the part of their frame between two points.

    ``opens`` marks the row that opens a frame. One sorted pass over rows and
    points counts the points so far; a row's part is that count from its frame's
    first row on, so parts are numbered as by ``split_frames``, those without
    rows included. A point belongs to the part that it begins. Points outside
    the frame, or at the time of its first row, cut nothing. ``layout`` is that
    of the rows.
    """
    keys = list(keys)
    others = [c for c in rows.columns if c not in keys]
    left = rows.select(
        *keys, F.col(ts).alias("__t"), F.lit(1).alias("__side"), F.col(tie).alias("__tie"),
        F.col(opens).alias("__first"), F.struct(*others).alias("__row"),
    )
    right = (
        points.select(*keys, F.col(point).alias("__t")).filter(F.col("__t").isNotNull()).distinct()
        .withColumn("__side", F.lit(0))
    )
    both = left.unionByName(right, allowMissingColumns=True)
    swept = OrderedRows.of(both, _mixed_layout(both, keys, layout)).add(
        __cuts=RunningSum((F.col("__side") == 0).cast("long"))
    )
    swept = swept.add(__base=LastValue(F.when(F.col("__first"), F.col("__cuts"))))
    part = (F.col("__cuts") - F.col("__base") + 1).alias("part_no")
    return swept.df.filter(F.col("__side") == 1).select(*keys, "__row.*", part)


def rows_in_frames(
    rows: DataFrame,
    frames: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    layout: KeyLayout | None = None,
) -> DataFrame:
    """Rows with the frame of their key that holds their time.

    The frames of a key must not overlap. One sorted pass looks back from each
    row to the latest frame start, so the work is linear whatever the lengths.
    Frames of zero length hold no time. ``layout`` is that of the rows.
    """
    keys = list(keys)
    others = [c for c in rows.columns if c not in keys]
    cells = [c for c in frames.columns if c not in keys]
    left = rows.select(
        *keys, F.col(ts).alias("__t"), F.lit(1).alias("__side"),
        F.col(tie).alias("__tie"), F.struct(*others).alias("__row"),
    )
    right = frames.filter(F.col(END) > F.col(START)).select(
        *keys, F.col(START).alias("__t"), F.lit(0).alias("__side"),
        F.struct(*cells).alias("__frame"),
    )
    both = left.unionByName(right, allowMissingColumns=True)
    swept = OrderedRows.of(both, _mixed_layout(both, keys, layout)).add(
        __of=LastValue(F.col("__frame"))
    )
    hit = (F.col("__side") == 1) & in_frame(
        F.col("__t"), F.col(f"__of.{START}"), F.col(f"__of.{END}")
    )
    return swept.df.filter(hit).select(*keys, "__row.*", "__of.*")


def rows_in_windows(
    rows: DataFrame,
    windows: DataFrame,
    keys: Sequence[str],
    ts: str,
    start: str = "window_start",
    end: str = "window_end",
    bucket_ms: int | None = None,
) -> DataFrame:
    """Rows with every window of their key that holds their time; windows may overlap.

    Time is cut into buckets so that the join is an equi-join on key and bucket
    and a large key is spread over its buckets. Windows up to 64 mean lengths
    use buckets of the mean length (or ``bucket_ms``); each further factor of
    64 has buckets 64 times longer, so that no window falls into more than 66.
    Rows look into each size of bucket; with alike windows there is one.
    """
    keys = list(keys)
    millis = times.is_millis(rows, ts)
    as_ms = (lambda c: c) if millis else (lambda c: F.unix_millis(c.cast("timestamp")))
    first, last = as_ms(F.col(start)), as_ms(F.col(end))
    windows = windows.filter(F.col(end) > F.col(start))
    sizes = windows.agg(F.avg(last - first).alias("mean"), F.max(last - first).alias("top")).first()
    base = bucket_ms or max(1, int(sizes.mean or 1))
    tops = [base * BUCKETS_PER_WINDOW]
    while tops[-1] < (sizes.top or 0):
        tops.append(tops[-1] * BUCKETS_PER_WINDOW)
    level = F.lit(0)
    for i, top in enumerate(tops[:-1], start=1):
        level = F.when(last - first > top, i).otherwise(level)
    widths = F.array(*[F.lit(top // BUCKETS_PER_WINDOW).cast("long") for top in tops])
    cells = [c for c in windows.columns if c not in keys]
    leveled = windows.withColumn("__level", level).withColumn("__width", widths[F.col("__level")])
    spread = leveled.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.struct(*cells).alias("__w"),
        F.col("__level").alias("__wl"),
        F.explode(
            F.sequence(F.floor(first / F.col("__width")), F.floor((last - 1) / F.col("__width")))
        ).alias("__wb"),
    )
    looks = [
        F.struct(F.lit(i).alias("l"), F.floor(as_ms(F.col(ts)) / F.lit(top // BUCKETS_PER_WINDOW))
                 .alias("b"))
        for i, top in enumerate(tops)
    ]
    placed = rows.withColumn("__at", F.explode(F.array(*looks)))
    condition = (
        (F.col("__at.l") == F.col("__wl"))
        & (F.col("__at.b") == F.col("__wb"))
        & in_frame(F.col(ts), F.col(f"__w.{start}"), F.col(f"__w.{end}"))
    )
    for i, key in enumerate(keys):
        condition = condition & F.col(key).eqNullSafe(F.col(f"__k{i}"))
    return placed.join(spread, condition).select(*rows.columns, "__w.*")


def _frame_layout(frames: DataFrame, keys: list[str], layout: KeyLayout | None) -> KeyLayout:
    if layout is None:
        return KeyLayout.measure(frames, keys, [START, TIE])
    return layout.with_order(START, TIE)


def _mixed_layout(both: DataFrame, keys: list[str], layout: KeyLayout | None) -> KeyLayout:
    """Order of a table that mixes frame starts (first at equal times) with rows or points."""
    if layout is None:
        layout = KeyLayout.measure(both, keys, ["__t"])
    return layout.with_order("__t", "__side", "__tie", cut_on=1)
