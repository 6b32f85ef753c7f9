"""Writing results, metrics and throughput reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Columns of the throughput report, in order (fixed by its readers).
THROUGHPUT_COLUMNS = [
    "type",
    "experiment",
    "platform",
    "on_cluster",
    "start_time",
    "current_time",
    "events_count",
    "implementation",
    "parallelism",
]


def write_results(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Replace the results at ``path``; ``text`` takes a one-column table."""
    df.write.mode("overwrite").format(form).save(path)


def stream_results(
    df: DataFrame,
    path: str,
    checkpoint: str,
    form: str = "parquet",
    mode: str = "append",
    every_ms: int | None = None,
) -> StreamingQuery:
    """Append a stream to ``path``: all that is there and stop, or again every ``every_ms``."""
    trigger = {"processingTime": f"{every_ms} milliseconds"} if every_ms else {"availableNow": True}
    return (
        df.writeStream.outputMode(mode)
        .format(form)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def run_report(
    spark: SparkSession, kind: str, experiment: str, platform: str, on_cluster: bool,
    events_count: int, start_ms: int, now_ms: int, implementation: str, parallelism: int,
) -> DataFrame:
    """One report row: events so far, milliseconds taken and events per second."""
    counted = spark.createDataFrame(
        [(kind, experiment, platform, on_cluster, start_ms, now_ms, events_count, implementation,
          parallelism)],
        "type string, experiment string, platform string, on_cluster boolean, start_time long, "
        "current_time long, events_count long, implementation string, parallelism long",
    )
    duration = F.col("current_time") - F.col("start_time")
    rate = F.col("events_count") * 1000.0 / F.nullif(duration, F.lit(0).cast("long"))
    return counted.withColumns({"duration": duration, "throughput": rate})


def append_throughput(report: DataFrame, path: str) -> None:
    """Add rows to a throughput report in CSV files with a header; derived columns are left out."""
    report.select(*THROUGHPUT_COLUMNS).write.mode("append").option("header", True).csv(path)


def write_batch(batch: DataFrame, batch_id: int, path: str, form: str = "parquet") -> None:
    """Write a micro-batch to a folder of its own, so that a batch that runs again is not there twice.

    For ``foreachBatch``. After a failure Spark runs the last batch again under
    the same number: what that number has written is replaced.
    """
    batch.write.mode("overwrite").format(form).save(f"{path}/batch={batch_id}")


def stream_batches(
    df: DataFrame, path: str, checkpoint: str, form: str = "parquet", every_ms: int | None = None
) -> StreamingQuery:
    """As ``stream_results``, each batch once whatever fails; the table has a column ``batch``."""
    trigger = {"processingTime": f"{every_ms} milliseconds"} if every_ms else {"availableNow": True}
    return (
        df.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, path, form))
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )
