"""Reports over metric records and over the windows themselves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.operators.keyed import Frames
from framewise.operators.timewin import window_column
from framewise.plans.layout import KeyLayout
from framewise.plans.ordered import OrderedRows, RunningSum
from framewise.session import store

# Counters of a per-row metric record, in the order in which they are written.
COUNTERS = [
    "find_start",
    "find_end",
    "sate_size_items",
    "state_size_windows",
    "cumulative_merge",
    "cumulative_add",
    "cumulative_evict",
    "cumulative_report",
    "cumulative_emit",
]


def with_durations(df: DataFrame, **spans: tuple[str, str]) -> DataFrame:
    """Add ``end - start`` columns: ``name=(start, end)``."""
    return df.withColumns({n: F.col(end) - F.col(start) for n, (start, end) in spans.items()})


def drop_first(df: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Without the first row of the table, or of each group; ``order`` must be unique in it.

    The first row is found by one aggregation, not by sorting the table. A null
    group is a group like any other.
    """
    at = F.struct(*order)
    if not by:
        return df.filter(at > df.agg(F.min(at)).scalar())
    first = df.groupBy(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)]).agg(
        F.min(at).alias("__first")
    )
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    return df.join(first, same).filter(at > F.col("__first")).select(*df.columns)


def mean_by(df: DataFrame, size: str, *metrics: str) -> DataFrame:
    """Mean of each metric per state size."""
    return df.groupBy(size).agg(*[F.avg(m).alias(m) for m in metrics])


def means(df: DataFrame, *metrics: str) -> DataFrame:
    """Mean of each column."""
    return df.agg(*[F.avg(m).alias(m) for m in metrics])


def quantiles(
    df: DataFrame, metrics: Sequence[str], at: Sequence[float] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """Exact quantiles of several columns, linearly interpolated: ``metric, q, value``.

    Values are counted first, then ranked by running counts over their order,
    which is cut into chunks like a large key; no task sees all values.
    """
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v"))
             for m in metrics]
    long = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    # Counted once and kept, because the counts are read three times below.
    counts = store(
        long.filter(F.col("v").isNotNull()).groupBy("metric", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("metric").agg(F.sum("n").alias("total"))
    layout = KeyLayout.measure(counts, ["metric"], ["v"])
    ranked = OrderedRows.of(counts, layout).add(upto=RunningSum(F.col("n"))).plain()
    wanted = totals.select(
        "metric", F.explode(F.array(*[F.lit(float(q)) for q in at])).alias("q"), "total"
    ).withColumn("rank", F.col("q") * (F.col("total") - 1))
    # One row per metric and quantile, so the small side of this join is bounded.
    near = ranked.join(F.broadcast(wanted), "metric").filter(
        (F.col("upto") > F.floor("rank")) & (F.col("upto") - F.col("n") <= F.ceil("rank"))
    )
    low = F.min(F.when(F.col("upto") > F.floor("rank"), F.col("v")))
    high = F.max(F.when(F.col("upto") - F.col("n") <= F.ceil("rank"), F.col("v")))
    part = F.first("rank") - F.floor(F.first("rank"))
    return near.groupBy("metric", "q").agg((low + (high - low) * part).alias("value"))


def box_summary(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Quartiles and the whiskers without outliers (1.5 interquartile ranges), per column."""
    boxes = quantiles(df, metrics).groupBy("metric").agg(
        *[F.max(F.when(F.col("q") == q, F.col("value"))).alias(n)
          for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    )
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v"))
             for m in metrics]
    long = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("v") >= F.col("q1") - reach) & (F.col("v") <= F.col("q3") + reach)
    whiskers = (
        long.join(F.broadcast(boxes), "metric")
        .groupBy("metric", "q1", "median", "q3")
        .agg(F.min(F.when(inside, F.col("v"))).alias("low"),
             F.max(F.when(inside, F.col("v"))).alias("high"))
    )
    return whiskers


def throughput(df: DataFrame, ts: str, every_ms: int = 300_000) -> DataFrame:
    """Events and events per second in each interval of event time (default 5 minutes)."""
    return (
        df.groupBy(window_column(F.col(ts), every_ms, every_ms).alias("__w"))
        .agg(F.count(F.lit(1)).alias("events_count"))
        .select(
            F.col("__w.start").alias("window_start"),
            F.col("__w.end").alias("window_end"),
            "events_count",
            (F.col("events_count") * F.lit(1000.0) / F.lit(every_ms)).alias("throughput"),
        )
    )


def state_size(frames: Frames) -> DataFrame:
    """Rows held in frames and number of frames per key."""
    seq = F.col("frame_seq")
    return frames.assigned.groupBy(*frames.events.keys).agg(
        F.count(seq).alias("items"), F.coalesce(F.max(seq), F.lit(0)).alias("windows")
    )


def counters_from(column: Column) -> list[Column]:
    """Typed counters of a metric record's field map."""
    return [F.try_element_at(column, F.lit(c)).cast("long").alias(c) for c in COUNTERS]
