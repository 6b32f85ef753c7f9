"""Time windows over a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions import times
from framewise.operators.timewin import window_column


def stream_windows(
    df: DataFrame,
    *aggregates: Column,
    keys: Sequence[str],
    ts: str,
    size_ms: int,
    slide_ms: int | None = None,
    offset_ms: int = 0,
    lateness_ms: int = 0,
) -> DataFrame:
    """Windows per key. Write in ``append`` mode to get each once, when the
    watermark passes its end, or in ``update`` mode to get it again on every
    change, late rows included. State is dropped when the watermark passes. Rows
    without a time are in no window; progress counts them as ``windows_rejected``."""
    slide_ms = slide_ms or size_ms
    at = times.to_timestamp(F.col(ts), times.is_millis(df, ts)).cast("timestamp")
    rows = (
        df.observe("windows_rejected", F.count_if(F.col(ts).isNull()).alias("rows"))
        .filter(F.col(ts).isNotNull())
        .withColumn("__at", at)
        .withWatermark("__at", f"{lateness_ms} milliseconds")
    )
    window = window_column(F.col("__at"), size_ms, slide_ms, offset_ms)
    if slide_ms > size_ms:
        shift, past = offset_ms % slide_ms, F.unix_micros("__at")
        into = F.pmod(past - shift * 1_000, F.lit(slide_ms * 1_000).cast("long"))
        rows = rows.filter(into < size_ms * 1_000)
    table = rows.groupBy(*keys, window.alias("__w")).agg(
        F.count(F.lit(1)).alias("n_rows"), *aggregates
    )
    end = times.add_millis(F.col("__w.start"), size_ms, False)
    cells = [c for c in table.columns if c not in (*keys, "__w")]
    return table.select(
        *keys,
        F.col("__w.start").alias("window_start"),
        end.alias("window_end"),
        times.add_millis(end, -1, False).alias("result_ts"),
        *cells,
    )
