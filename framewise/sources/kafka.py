"""Kafka topics of road reports: options, bounded runs, sentinel rows.

The Kafka connector is a package of its own that the cluster must provide.
"""

from __future__ import annotations

import time
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader, StreamingQuery

from framewise.sources.parse import END_OF_STREAM, fields_of
from framewise.sources.sinks import write_batch


def source_options(
    servers: str, topic: str, rows_per_trigger: int | None = None, group: str | None = None
) -> dict[str, str]:
    """Read a topic from its earliest offset, at most so many rows per micro-batch."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
    }
    if rows_per_trigger:
        options["maxOffsetsPerTrigger"] = str(rows_per_trigger)
    if group:
        options["kafka.group.id"] = group
    return options


def stream_lines(spark: SparkSession, **source: Any) -> DataFrame:
    """The topic's records as text lines in ``value``."""
    reader: DataStreamReader = spark.readStream.format("kafka").options(**source_options(**source))
    return reader.load().select(F.col("value").cast("string").alias("value"))


def without_sentinels(lines: DataFrame) -> DataFrame:
    """Drop the closing rows that mark the end of a bounded run."""
    return lines.filter(~F.get(fields_of(F.col("value")), F.lit(0)).eqNullSafe(END_OF_STREAM))


def run_bounded(query: StreamingQuery, max_minutes: float) -> bool:
    """Let a query run for at most ``max_minutes``; True if it ended by itself."""
    ended = query.awaitTermination(max_minutes * 60)
    if not ended:
        query.stop()
    return bool(ended)


def run_to_closing(
    lines: DataFrame,
    partitions: int,
    path: str,
    checkpoint: str,
    partition: str = "partition",
    every_ms: int = 500,
    max_minutes: float | None = None,
) -> bool:
    """Write a stream of lines until the closing row of every partition has come; True if it did.

    ``partition`` names the column that tells where a line comes from. Lines go
    to ``path``/rows without the closing rows, a folder per batch; the closed
    partitions of a batch go to ``path``/closed, so a run that starts again
    knows those from before. A batch that runs again replaces what it wrote.
    Lines behind a partition's closing row in the same batch are still written.
    """
    spark = lines.sparkSession
    closes = F.get(fields_of(F.col("value")), F.lit(0)).eqNullSafe(END_OF_STREAM)
    schema = T.StructType([lines.schema[partition]])

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        write_batch(batch.filter(~closes), number, f"{path}/rows")
        # One row per partition at most, whatever the batch holds.
        write_batch(batch.filter(closes).select(partition).distinct(), number, f"{path}/closed")
        batch.unpersist()

    def all_closed() -> bool:
        try:
            seen = spark.read.schema(schema).parquet(f"{path}/closed")
            return seen.select(partition).distinct().count() >= partitions
        except AnalysisException:  # no batch yet
            return False

    query = (
        lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(processingTime=f"{every_ms} milliseconds").start()
    )
    deadline = None if max_minutes is None else time.monotonic() + 60 * max_minutes
    closed = False
    while not closed and query.isActive and (deadline is None or time.monotonic() < deadline):
        if query.awaitTermination(every_ms / 1000):
            break
        closed = all_closed()
    if query.exception() is not None:
        raise query.exception()
    query.stop()
    return closed or all_closed()


def records_of(lines: DataFrame, limit: int | None = None, partitions: int = 1) -> DataFrame:
    """Key, value and partition of the records to send: car number and line, then a closing row each.

    ``limit`` sends the first lines by report time and text only. A car's lines
    go to one of ``partitions`` by its number. Every partition gets its own
    closing row, stamped one second after the last report of all, and each task
    sends its partitions in order, by report time and the closing row last.
    """
    fields = fields_of(F.col("value"))
    rows = lines.select(
        fields.getItem(0).alias("key"), "value", fields.getItem(8).cast("long").alias("__t")
    )
    if limit is not None:
        rows = rows.orderBy("__t", "value").limit(limit)
    last = F.max("__t") + 1000
    # The form of the closing row.
    closing = rows.agg(last.alias("__t")).select(
        F.lit(END_OF_STREAM).alias("key"),
        F.concat(
            F.lit(f"[{END_OF_STREAM}, 0, 0.0, 0, 0, 0, 0, 0, "),
            F.col("__t").cast("string"), F.lit(", "), (F.col("__t") + 1).cast("string"), F.lit("]"),
        ).alias("value"),
        "__t", F.explode(F.sequence(F.lit(0), F.lit(partitions - 1))).alias("partition"),
        F.lit(True).alias("__closing"),
    )
    dealt = rows.withColumn(
        "partition", F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int")
    ).withColumn("__closing", F.lit(False))
    return (
        dealt.unionByName(closing)
        .repartition("partition")
        .sortWithinPartitions("partition", "__closing", "__t", "value")
        .select("key", "value", "partition")
    )


def write_records(records: DataFrame, servers: str, topic: str) -> None:
    (
        records.write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )
