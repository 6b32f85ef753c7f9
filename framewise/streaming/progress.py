"""Throughput and state size of a running or finished query."""

from __future__ import annotations

import json
from collections.abc import Sequence
from threading import Lock
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import (
    QueryProgressEvent,
    QueryStartedEvent,
    QueryTerminatedEvent,
    StreamingQueryListener,
)

PROGRESS_SCHEMA = (
    "name string, batch_id long, at string, input_rows long, rows_per_second double, "
    "state_rows long, state_bytes long, dropped_rows long, watermark string, observed string"
)


def observed(df: DataFrame, name: str, *aggregates: Column) -> DataFrame:
    """The same rows; each micro-batch also reports the aggregates of those it passed on."""
    return df.observe(name, *aggregates)


def progress_table(spark: SparkSession, query: StreamingQuery, name: str = "") -> DataFrame:
    """One row per recent micro-batch (Spark keeps the last hundred); ``ProgressLog`` keeps all."""
    return spark.createDataFrame([_row(name, p) for p in query.recentProgress], PROGRESS_SCHEMA)


class ProgressLog(StreamingQueryListener):
    """Appends one row per micro-batch of the session's streams to a Parquet table.

    Register it with ``spark.streams.addListener`` before the streams start.
    Rows are written ``every`` batches and when a stream ends; ``flush`` writes
    what is held. ``of`` keeps only the streams of these names.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 20, of: Sequence[str] = ()) -> None:
        self.spark, self.path, self.every, self.of = spark, path, every, set(of)
        self.held: list[tuple] = []
        self.lock = Lock()

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        row = _row("", event.progress)
        if self.of and row[0] not in self.of:
            return
        with self.lock:
            self.held.append(row)
            full = len(self.held) >= self.every
        if full:
            self.flush()

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self.flush()

    def flush(self) -> None:
        with self.lock:
            if self.held:
                rows = self.spark.createDataFrame(self.held, PROGRESS_SCHEMA)
                rows.coalesce(1).write.mode("append").parquet(self.path)
                self.held = []

    def table(self) -> DataFrame:
        """All rows written so far."""
        self.flush()
        return self.spark.read.schema(PROGRESS_SCHEMA).parquet(self.path)


def _row(name: str, progress: Any) -> tuple:
    states = progress["stateOperators"]
    return (
        name or str(progress["name"] or ""),
        int(progress["batchId"]),
        progress["timestamp"],
        int(progress["numInputRows"]),
        float(progress["processedRowsPerSecond"] or 0.0),
        sum(int(s["numRowsTotal"]) for s in states),
        sum(int(s["memoryUsedBytes"]) for s in states),
        sum(int(s["numRowsDroppedByWatermark"]) for s in states),
        dict(progress["eventTime"] or {}).get("watermark"),
        json.dumps(
            {name: row.asDict() for name, row in dict(progress["observedMetrics"] or {}).items()},
            default=str,
        ),
    )
