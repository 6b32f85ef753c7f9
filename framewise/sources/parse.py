"""Text records to columns and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions.times import scale_to_millis
from framewise.operators.metrics import COUNTERS, counters_from

# Fields of a road report, in the order in which they are written.
ROAD_FIELDS = {
    "VID": "string",
    "SPEED": "double",
    "ACCEL": "double",
    "XWay": "int",
    "Lane": "int",
    "Dir": "int",
    "Seg": "int",
    "Pos": "long",
    "T1": "long",
    "T2": "long",
}
DISORDERED_FIELDS = len(ROAD_FIELDS) + 2
END_OF_STREAM = "-1"


def strip_brackets(line: Column) -> Column:
    return F.translate(line, "[]", "")


def fields_of(line: Column) -> Column:
    """Comma-separated fields without brackets and surrounding blanks."""
    return F.transform(F.split(strip_brackets(line), ","), lambda field: F.trim(field))


def parse_events(df: DataFrame, line: str = "value") -> DataFrame:
    """``ts,key,value`` lines to typed columns; lines that do not fit go to ``reject``."""
    return _typed(df, line, F.split(F.col(line), ","), {
        "ts": (0, "long"), "key": (1, "long"), "value": (2, "double"),
    })


def format_events(df: DataFrame, ts: str = "ts", key: str = "key", value: str = "value") -> DataFrame:
    """One ``ts,key,value`` line per row."""
    return df.select(F.concat_ws(",", *[F.col(c).cast("string") for c in (ts, key, value)])
                     .alias("value"))


def parse_road_reports(df: DataFrame, line: str = "value") -> DataFrame:
    """All fields of a road report; lines that do not fit go to ``reject``."""
    return _typed(df, line, fields_of(F.col(line)), {
        name: (i, kind) for i, (name, kind) in enumerate(ROAD_FIELDS.items())
    })


def parse_speeds(df: DataFrame, line: str = "value") -> DataFrame:
    """Road reports as events ``key, ts, value`` with the speed as value."""
    return _road_events(df, line, "SPEED")


def parse_accelerations(df: DataFrame, line: str = "value") -> DataFrame:
    """Road reports as events ``key, ts, value`` with the acceleration as value."""
    return _road_events(df, line, "ACCEL")


def rewrite_disordered(df: DataFrame, line: str = "value") -> DataFrame:
    """Turn disordered rows back into road reports stamped with their arrival time.

    A disordered row has arrival time and event time in front and a comma
    behind. Blank lines are skipped; rows of another shape go to ``reject``.
    """
    text = F.col(line)
    parts = F.split(text.substr(F.lit(1), F.length(text) - 1), ",")
    fits = F.size(parts) == DISORDERED_FIELDS
    t1 = list(ROAD_FIELDS).index("T1")
    report = F.concat(F.slice(parts, 3, t1), F.slice(parts, 1, 1),
                      F.slice(parts, t1 + 4, len(ROAD_FIELDS) - t1 - 1))
    report = F.concat(F.lit("["), F.array_join(report, ","), F.lit("]"))
    return (
        df.filter(F.length(text) > 0)
        .select(F.when(fits, report).alias("value"), F.when(~fits, text).alias("reject"))
    )


def select_key_range(
    df: DataFrame,
    start: int,
    end: int,
    key: str = "-1",
    line: str = "value",
    separator: str = ",",
    key_at: int = 0,
    time_at: int = 2,
    unit: str = "ms",
) -> DataFrame:
    """Rows of one key (``-1``: all) with time in ``(start, end]``, as two-clock records.

    Rows of three fields or fewer are skipped. Times are scaled to milliseconds
    after the range test.
    """
    values = F.split(F.col(line), separator)
    rows = df.select(values.alias("values")).filter(F.size("values") > 3).select(
        F.trim(F.get("values", F.lit(key_at))).alias("key"),
        "values",
        F.trim(F.get("values", F.lit(time_at))).try_cast("long").alias("__t"),
    )
    rows = rows.filter((F.col("__t") > start) & (F.col("__t") <= end))
    if key != "-1":
        rows = rows.filter(F.col("key") == key)
    scaled = scale_to_millis(F.col("__t"), unit)
    return rows.select("key", "values", scaled.alias("event_time"), scaled.alias("process_time"))


def format_disordered(df: DataFrame) -> DataFrame:
    """Two-clock records as lines: both clocks, then the fields, each with a comma behind."""
    clocks = F.array(F.col("process_time").cast("string"), F.col("event_time").cast("string"))
    text = F.array_join(F.concat(clocks, F.col("values")), ",")
    return df.select(F.concat(text, F.lit(",")).alias("value"))


def sort_by_arrival(df: DataFrame, *tie: str, arrival: str = "process_time") -> DataFrame:
    """Rows in order of arrival. ``tie`` columns also split a crowded arrival time."""
    return df.orderBy(arrival, *tie)


def parse_metric_lines(df: DataFrame, line: str = "value") -> DataFrame:
    """``method=m k=v,k=v,... nanos`` lines to ``method``, counters and ``timestamp``."""
    parts = df.select(F.split(F.trim(F.col(line)), r"\s+").alias("parts"))
    tag, pairs, nanos = (F.get("parts", F.lit(i)) for i in range(3))
    mapped = parts.select(
        F.when(tag.startswith("method="), F.substring_index(tag, "=", -1)).alias("method"),
        nanos.try_cast("long").alias("timestamp"),
        F.str_to_map(F.rtrim(pairs, F.lit(",")), F.lit(","), F.lit("=")).alias("fields"),
    )
    return mapped.select("method", *counters_from(F.col("fields")), "timestamp", "fields")


def format_metric_lines(df: DataFrame) -> DataFrame:
    """Metric columns back to one line per record."""
    pairs = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in COUNTERS]
    return df.select(
        F.concat_ws(" ", F.concat(F.lit("method="), F.col("method")),
                    F.concat_ws(",", *pairs), F.col("timestamp").cast("string")).alias("value")
    )


def _road_events(df: DataFrame, line: str, value: str) -> DataFrame:
    names = list(ROAD_FIELDS)
    return _typed(df, line, fields_of(F.col(line)), {
        "key": (names.index("VID"), "string"),
        "ts": (names.index("T1"), "long"),
        "value": (names.index(value), "double"),
    })


def _typed(
    df: DataFrame, line: str, fields: Column, wanted: dict[str, tuple[int, str]]
) -> DataFrame:
    """Cast fields; a line with a missing or unreadable field has nulls and the text in ``reject``."""
    cells = {
        name: F.trim(F.get(fields, F.lit(i))).try_cast(kind)
        for name, (i, kind) in wanted.items()
    }
    fits = F.lit(True)
    for cell in cells.values():
        fits = fits & cell.isNotNull()
    return df.select(
        *[F.when(fits, cell).alias(name) for name, cell in cells.items()],
        F.when(~fits, F.col(line)).alias("reject"),
    )
