"""Reading event, road-report and metric files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.sources.parse import parse_road_reports, parse_speeds

EVENT_SCHEMA = "ts LONG, key LONG, value DOUBLE"


def read_events(spark: SparkSession, path: str, max_records: int | None = None) -> DataFrame:
    """Event CSV files with a header; blank and malformed lines are left out.

    ``max_records`` keeps exactly that many rows, the first by time and key.
    """
    events = (
        spark.read.schema(EVENT_SCHEMA)
        .option("header", True)
        .option("mode", "DROPMALFORMED")
        .csv(path)
        .dropna()
    )
    return first_rows(events, max_records, "ts", "key", "value")


def stream_events(
    spark: SparkSession, path: str, files_per_trigger: int | None = None
) -> DataFrame:
    """Event CSV files as a stream; ``files_per_trigger`` limits the rate."""
    reader = (
        spark.readStream.schema(EVENT_SCHEMA)
        .option("header", True)
        .option("mode", "DROPMALFORMED")
    )
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.csv(path).dropna()


def read_lines(spark: SparkSession, path: str, header: str | None = None) -> DataFrame:
    """Text files, also gzip ones; lines equal to ``header`` and blank lines are left out."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    return lines.filter(F.col("value") != header) if header else lines


def read_road_reports(spark: SparkSession, path: str) -> DataFrame:
    """Bracketed road reports with all fields; unreadable lines in ``reject``."""
    return parse_road_reports(_road_lines(spark, path))


def read_speeds(spark: SparkSession, path: str, max_records: int | None = None) -> DataFrame:
    """Road reports as speed events ``key, ts, value``."""
    speeds = parse_speeds(_road_lines(spark, path)).filter(F.col("reject").isNull()).drop("reject")
    return first_rows(speeds, max_records, "ts", "key", "value")


def read_metric_lines(spark: SparkSession, folder: str, prefix: str = "metrics") -> DataFrame:
    """Lines of all files of a folder whose names begin with ``prefix``, with the file name."""
    return spark.read.text(f"{folder.rstrip('/')}/{prefix}*").withColumn(
        "file", F.input_file_name()
    )


def first_rows(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first ``n`` rows of an order; all rows when ``n`` is None."""
    return df if n is None else df.orderBy(*order).limit(n)


def _road_lines(spark: SparkSession, path: str) -> DataFrame:
    # Every file starts with a header; it is the only line that begins with the name VID.
    return read_lines(spark, path).filter(~F.col("value").startswith("VID"))
