"""Every operator as a query over the driver's ``events`` table.

Keys are users, times and values are those of the events, the event id breaks
ties. Times are reported as whole microseconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise import FrameSpec, KeyedEvents
from framewise.functions.spec import Mergeable
from framewise.functions.reduce import RowFold, last_value, top_row
from framewise.functions.times import scale_to_millis, scale_to_seconds
from framewise.operators import compare, intervals, metrics, repair
from framewise.session import shared_dir, store, use_utc
from framewise.sources import parse
from framewise.sources.files import first_rows
from framewise.streaming.frames import latest_frames, latest_rows, stream_assign, stream_frames
from framewise.streaming.windows import stream_windows

Query = Callable[[SparkSession, str], DataFrame]

HOUR = 3_600_000
DAY = 24 * HOUR

USER = ["user_id"]


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/events.parquet")


def keyed(spark: SparkSession, sf_dir: str) -> KeyedEvents:
    return KeyedEvents.of(load_events(spark, sf_dir), "user_id", "ts", "value", "event_id")


def micros(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


def whole_times(df: DataFrame) -> DataFrame:
    """Timestamp columns as microseconds, summed values rounded to cents."""
    columns = []
    for field in df.schema:
        kind = field.dataType.simpleString()
        column = F.col(field.name)
        if kind.startswith("timestamp"):
            column = micros(field.name)
        elif kind == "double":
            column = F.round(column, 2)
        columns.append(column.alias(field.name))
    return df.select(*columns)


# Frames ---------------------------------------------------------------------


def frame_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_times(keyed(spark, sf_dir).threshold(50).sum())


def frame_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_times(keyed(spark, sf_dir).delta(50).sum())


def frame_aggregate_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_times(keyed(spark, sf_dir).aggregate("sum", 150).sum())


def _by_type_in_chunks(spark: SparkSession, sf_dir: str) -> KeyedEvents:
    """Four large keys, cut into chunks of a few hundred rows."""
    events = load_events(spark, sf_dir)
    return KeyedEvents.of(events, "event_type", "ts", "value", "event_id", max_rows=400)


def frame_delta_large_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_times(_by_type_in_chunks(spark, sf_dir).delta(50).sum())


def frame_aggregate_sum_large_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_times(_by_type_in_chunks(spark, sf_dir).aggregate("sum", 150).sum())


def frame_aggregate_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_times(keyed(spark, sf_dir).aggregate("max", 100).sum())


def frame_aggregate_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_times(keyed(spark, sf_dir).aggregate("min", 5, init=1_000).sum())


def frame_aggregate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_times(keyed(spark, sf_dir).aggregate("count", 6).sum())


def frame_aggregate_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's own aggregate: the sum of the values, each counted as at most 40."""
    return whole_times(keyed(spark, sf_dir).aggregate(lambda v, agg: agg + min(v, 40), 150).sum())


def frame_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_times(keyed(spark, sf_dir).boundary([20, 50, 100]).sum())


def frame_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opens at 60, takes values from 40, skips lower ones, closes below 20."""
    frames = keyed(spark, sf_dir).custom(
        opens=lambda v: v >= 60,
        start=lambda v: v,
        keeps=lambda v, state: v >= 40,
        closes=lambda v, state: v < 20,
    )
    return whole_times(frames.sum())


def frame_custom_large_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames over large keys; the one state there is makes the fold mergeable."""
    frames = _by_type_in_chunks(spark, sf_dir).custom(
        opens=lambda v: v >= 60,
        start=lambda v: "open",
        keeps=lambda v, state: v >= 40,
        closes=lambda v, state: v < 20,
        states=["open"],
    )
    return whole_times(frames.sum())


def frame_function_large_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's own aggregate over large keys: the number of rows, up to 3 of each 7 counted."""
    turns = Mergeable.finite(
        FrameSpec.aggregate(lambda v, agg: agg + (v % 7 < 3), 5).step, range(5)
    )
    return whole_times(
        _by_type_in_chunks(spark, sf_dir)
        .aggregate(lambda v, agg: agg + (v % 7 < 3), 5, mergeable=turns).sum()
    )


def frame_min_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = keyed(spark, sf_dir).threshold(30).reduce(
        F.sum("value").alias("sum_value"), min_rows=3
    )
    return whole_times(table)


def frame_threshold_maxrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = keyed(spark, sf_dir).threshold(50).reduce(
        top_row("value", "event_id", "ts", "value").alias("top")
    )
    return whole_times(
        table.select(
            "user_id", "frame_seq", "n_rows",
            F.col("top.event_id").alias("top_event_id"),
            F.col("top.ts").alias("top_ts"),
            F.col("top.value").alias("top_value"),
        )
    )


def frame_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = whole_times(keyed(spark, sf_dir).delta(50).stats())
    names = {n: f"{n}_value" for n in ("count", "sum", "min", "max", "first", "last")}
    return table.withColumnsRenamed(names)


def frame_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_times(keyed(spark, sf_dir).delta(50).bounds())


def last_frame_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_times(keyed(spark, sf_dir).delta(50).last())


def assign_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(spark, sf_dir).threshold(50).assign().select("event_id", "user_id", "frame_seq")


def assign_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(spark, sf_dir).delta(50).assign().select("event_id", "user_id", "frame_seq")


def state_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.state_size(keyed(spark, sf_dir).threshold(50))


# Frames as intervals ---------------------------------------------------------


def events_in_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = keyed(spark, sf_dir)
    frames = ev.threshold(50).reduce().select("user_id", "frame_seq", "frame_start", "frame_end")
    rows = ev.df.select("user_id", "event_id", "ts", "value")
    held = intervals.rows_in_frames(rows, frames, USER, "ts", "event_id", ev.layout)
    return held.select("user_id", "event_id", "frame_seq")


def events_in_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High-value events with every window of their user that saw an error, 7 days by 1 day."""
    ev = keyed(spark, sf_dir)
    errors = KeyedEvents.of(
        ev.df.filter(F.col("event_type") == "error"), "user_id", "ts", "value", "event_id", ev.layout
    )
    windows = errors.sliding(7 * DAY, DAY).reduce().withColumnRenamed("n_rows", "n_errors")
    rows = ev.df.filter(F.col("value") >= 50).select("user_id", "event_id", "ts")
    held = intervals.rows_in_windows(rows, windows, USER, "ts")
    return whole_times(held.select("user_id", "event_id", "window_start", "n_errors"))


def _frames_by_type(ev: KeyedEvents) -> DataFrame:
    """Threshold frames of each kind of event of a user; these overlap."""
    by_type = KeyedEvents.of(ev.df, ["user_id", "event_type"], "ts", "value", "event_id")
    return by_type.threshold(50).bounds()


def _coalesced(spark: SparkSession, sf_dir: str, touching: bool) -> DataFrame:
    ev = keyed(spark, sf_dir)
    table = intervals.coalesce_frames(
        _frames_by_type(ev),
        USER,
        F.sum("aggregate").alias("aggregate"),
        F.min_by("aux", F.struct("frame_start", "start_tie")).alias("aux"),
        touching=touching,
        layout=ev.layout,
    )
    return whole_times(table)


def coalesce_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coalesced(spark, sf_dir, touching=False)


def coalesce_frames_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of high values united with runs of low ones where they meet."""
    ev = keyed(spark, sf_dir)
    low = KeyedEvents.of(
        ev.df.withColumn("value", -F.col("value")), USER, "ts", "value", "event_id", layout=ev.layout
    )
    table = intervals.coalesce_frames(
        ev.threshold(60).bounds().unionByName(low.threshold(-40).bounds()),
        USER, F.sum("aggregate").alias("aggregate"), touching=True, layout=ev.layout,
    )
    return whole_times(table)


def split_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold frames cut at the user's purchases."""
    ev = keyed(spark, sf_dir)
    points = ev.df.filter(F.col("event_type") == "purchase").select(
        "user_id", F.col("ts").alias("point")
    )
    return whole_times(
        intervals.split_frames(ev.threshold(30).bounds(), points, USER, layout=ev.layout)
    )


def split_frames_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same parts, each reduced over its own rows."""
    ev = keyed(spark, sf_dir)
    points = ev.df.filter(F.col("event_type") == "purchase").select(
        "user_id", F.col("ts").alias("point")
    )
    return whole_times(ev.threshold(30).split(
        points, F.sum("value").alias("sum_value"), last_value("value").alias("last_value")
    ))


def _repaired(spark: SparkSession, sf_dir: str, spec: FrameSpec) -> DataFrame:
    """Frames stored without the error events, brought up to date when these come late."""
    events = load_events(spark, sf_dir)
    stored = KeyedEvents.of(
        events.filter(F.col("event_type") != "error"), "user_id", "ts", "value", "event_id"
    )
    late = events.filter(F.col("event_type") == "error")
    extra = [F.sum("value").alias("sum_value")]
    frames = store(stored.frames(spec).reduce(*extra, with_tie=True))
    return whole_times(repair.repair_frames(frames, stored, late, spec, *extra))


def repair_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir, FrameSpec.delta(50))


def repair_threshold_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir, FrameSpec.threshold(50))


# Time windows -----------------------------------------------------------------


def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_times(keyed(spark, sf_dir).tumbling(DAY).sum())


def window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_times(keyed(spark, sf_dir).sliding(7 * DAY, DAY).sum())


def window_sliding_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that overlap forty-eightfold."""
    return whole_times(keyed(spark, sf_dir).sliding(2 * DAY, HOUR).sum())


def window_sliding_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_times(keyed(spark, sf_dir).sliding(3 * DAY, DAY, -6 * HOUR).sum())


def window_sliding_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_times(keyed(spark, sf_dir).sliding(6 * HOUR, DAY).sum())


def assign_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(spark, sf_dir).sliding(3 * DAY, DAY).assign()
    return whole_times(rows.select("event_id", "user_id", "window_start", "window_end"))


# Text records -----------------------------------------------------------------


def _event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ts,key,value`` lines; those of error events lack the value."""
    full = F.concat_ws(",", (micros("ts") / 1000).cast("long").cast("string"),
                       F.col("user_id").cast("string"), F.col("value").cast("string"))
    short = F.concat_ws(",", (micros("ts") / 1000).cast("long").cast("string"),
                        F.col("user_id").cast("string"))
    line = F.when(F.col("event_type") == "error", short).otherwise(full)
    return load_events(spark, sf_dir).select(line.alias("value"))


def _road_lines(spark: SparkSession, sf_dir: str, separator: str = ", ") -> DataFrame:
    """Events as bracketed road reports."""
    millis = (micros("ts") / 1000).cast("long")
    fields = [F.col("user_id"), F.col("value"), F.col("value") / 2, F.lit(0), F.lit(1), F.lit(0),
              F.length("event_type"), F.col("event_id"), millis, millis + 1]
    text = F.concat_ws(separator, *[f.cast("string") for f in fields])
    return load_events(spark, sf_dir).select(
        F.concat(F.lit("["), text, F.lit("]")).alias("value")
    )


def parse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_events(_event_lines(spark, sf_dir))


def format_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load_events(spark, sf_dir).select(
        (micros("ts") / 1000).cast("long").alias("ts"), F.col("user_id").alias("key"), "value"
    )
    return parse.format_events(events).withColumnRenamed("value", "line")


def parse_linear_road(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _road_lines(spark, sf_dir)
    speeds = parse.parse_speeds(lines).withColumn("kind", F.lit("speed"))
    accelerations = parse.parse_accelerations(lines).withColumn("kind", F.lit("acceleration"))
    return speeds.unionByName(accelerations).drop("reject")


def strip_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _road_lines(spark, sf_dir)
    return lines.select(parse.strip_brackets(F.col("value")).alias("line"))


def rewrite_disordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with both clocks in front and a comma behind; error events have a field too few."""
    millis = (micros("ts") / 1000).cast("long")
    fields = [millis - 1500, millis, F.col("user_id"), F.col("value"), F.lit("0.0"), F.lit(0),
              F.lit(1), F.lit(0), F.length("event_type"), F.col("event_id"), millis]
    text = F.concat_ws(",", *[f.cast("string") for f in fields])
    tail = F.when(F.col("event_type") == "error", F.lit(",")).otherwise(
        F.concat(F.lit(","), (millis + 1).cast("string"), F.lit(","))
    )
    lines = load_events(spark, sf_dir).select(F.concat(text, tail).alias("value"))
    return parse.rewrite_disordered(lines).withColumnRenamed("value", "line")


def scale_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load_events(spark, sf_dir).select("event_id", micros("ts").alias("t"))
    units = ("ps", "ns", "ms", "s", "other")
    return events.select(
        "event_id",
        *[scale_to_millis(F.col("t"), u).alias(f"{u}_to_ms") for u in units],
        *[scale_to_seconds(F.col("t"), u).alias(f"{u}_to_s") for u in units],
    )


def select_key_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-clock records of all keys between two times; error events have too few fields."""
    nanos = (micros("ts") * 1000).cast("string")
    full = F.concat_ws(",", F.col("user_id").cast("string"), F.col("value").cast("string"), nanos,
                       F.col("event_type"))
    short = F.concat_ws(",", F.col("user_id").cast("string"), F.col("value").cast("string"), nanos)
    line = F.when(F.col("event_type") == "error", short).otherwise(full)
    lines = load_events(spark, sf_dir).select(line.alias("value"))
    picked = parse.select_key_range(
        lines, start=1_704_844_800_000_000_000, end=1_706_140_800_000_000_000, unit="ns"
    )
    return picked.select(
        "key", "event_time", "process_time", F.array_join("values", "|").alias("fields")
    )


def sort_by_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events by arrival, with their place in that order; purchases arrive an hour late."""
    delay = F.when(F.col("event_type") == "purchase", F.lit(3_600_000_000)).otherwise(F.lit(0))
    events = load_events(spark, sf_dir).select(
        "event_id", "user_id", (micros("ts") + delay).alias("process_time")
    )
    placed = compare.join_by_position([events], [["process_time", "event_id"]], "arrival_no")
    return parse.sort_by_arrival(placed, "event_id")


def limit_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load_events(spark, sf_dir).select("event_id", "user_id", "ts", "value")
    return whole_times(first_rows(events, 100, "ts", "event_id"))


# Metrics ------------------------------------------------------------------------


def _metric_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric counters made from the events."""
    start, v = micros("ts"), F.col("value").cast("long")
    return load_events(spark, sf_dir).select(
        F.when(F.col("event_type") == "error", "onEventTime").otherwise("processElement")
        .alias("method"),
        start.alias("find_start"),
        (start + v * 10).alias("find_end"),
        F.col("user_id").alias("sate_size_items"),
        F.length("event_type").cast("long").alias("state_size_windows"),
        (v * 2).alias("cumulative_merge"),
        (v * 3).alias("cumulative_add"),
        (v * 5).alias("cumulative_evict"),
        (v * 7).alias("cumulative_report"),
        (v * 11).alias("cumulative_emit"),
        F.col("event_id").alias("timestamp"),
    )


def _parsed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = parse.format_metric_lines(_metric_records(spark, sf_dir))
    return parse.parse_metric_lines(lines).drop("fields")


def parse_metric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed_metrics(spark, sf_dir)


def metric_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time to find the frame, without the first record of each method."""
    rest = metrics.drop_first(_parsed_metrics(spark, sf_dir), ["find_start", "timestamp"], ["method"])
    timed = metrics.with_durations(rest, cumulative_scope=("find_start", "find_end"))
    return timed.select("method", "timestamp", "cumulative_scope")


def metric_durations_untagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``metric_durations`` where one method's records carry no method."""
    tagged = F.when(F.col("method") != "processElement", F.col("method"))
    records = _parsed_metrics(spark, sf_dir).withColumn("method", tagged)
    rest = metrics.drop_first(records, ["find_start", "timestamp"], ["method"])
    timed = metrics.with_durations(rest, cumulative_scope=("find_start", "find_end"))
    return timed.select("method", "timestamp", "cumulative_scope")


def metric_mean_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = metrics.with_durations(
        _parsed_metrics(spark, sf_dir), cumulative_scope=("find_start", "find_end")
    )
    table = metrics.mean_by(timed, "state_size_windows", "cumulative_scope", "cumulative_emit")
    return _rounded(table, "cumulative_scope", "cumulative_emit")


def metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column means without the very first record."""
    rest = metrics.drop_first(_parsed_metrics(spark, sf_dir), ["find_start", "timestamp"])
    names = ["cumulative_add", "cumulative_evict", "cumulative_emit", "sate_size_items"]
    return _rounded(metrics.means(rest, *names), *names)


def metric_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = metrics.quantiles(
        _parsed_metrics(spark, sf_dir), ["cumulative_add", "cumulative_emit", "sate_size_items"]
    )
    return _rounded(table, "value")


def metric_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.box_summary(
        _parsed_metrics(spark, sf_dir), ["cumulative_add", "cumulative_emit"]
    )


def metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by id and events by time side by side: first with first, second with second."""
    events = load_events(spark, sf_dir)
    by_id = events.select(F.col("event_id").alias("id_event"), F.col("value").alias("id_value"))
    by_time = events.select(
        F.col("event_id").alias("time_event"), F.col("value").alias("time_value"), "ts"
    )
    paired = compare.join_by_position([by_id, by_time], [["id_event"], ["ts", "time_event"]])
    return paired.drop("ts")


def metric_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of both methods' files in one table."""
    records = _parsed_metrics(spark, sf_dir)
    files = [records.filter(F.col("method") == m).select("timestamp", "method", "cumulative_add")
             for m in ("processElement", "onEventTime")]
    return files[0].unionByName(files[1])


def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = metrics.throughput(load_events(spark, sf_dir), "ts")
    return table.select(
        micros("window_start").alias("window_start"), micros("window_end").alias("window_end"),
        "events_count", F.round("throughput", 6).alias("throughput"),
    )


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def diff_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and bounds of boundary frames that are no threshold frames, duplicates kept."""
    ev = keyed(spark, sf_dir)

    def lines(table: DataFrame) -> DataFrame:
        cells = [F.col("user_id"), micros("frame_start"), F.col("n_rows")]
        return table.select(F.concat_ws(",", *[c.cast("string") for c in cells]).alias("line"))

    a = lines(ev.boundary([50]).reduce()).unionByName(lines(ev.boundary([50, 100]).reduce()))
    return compare.missing_rows(a, lines(ev.threshold(50).reduce()))


# Streams --------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = load_events(spark, sf_dir).schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )


def _run(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into a table in the shared folder."""
    from uuid import uuid4

    spark = df.sparkSession
    place = f"{shared_dir(spark)}/stream-{uuid4().hex}"
    query = (
        df.writeStream.outputMode(mode).format("parquet")
        .option("path", f"{place}/table").option("checkpointLocation", f"{place}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{place}/table")


def _streamed_frames(spark: SparkSession, sf_dir: str, spec: FrameSpec) -> DataFrame:
    changes = stream_frames(
        _event_stream(spark, sf_dir), spec, keys=USER, ts="ts", value="value", tie="event_id",
        lateness_ms=30 * DAY, early=True,
    )
    table = latest_frames(_run(changes), USER)
    return table.select(
        "user_id", "frame_seq", F.col("start_us").alias("frame_start"),
        F.col("end_us").alias("frame_end"), "is_closed", "n_rows",
        F.round("sum_value", 2).alias("sum_value"), F.col("last_us").alias("max_ts"),
    )


def stream_frame_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed_frames(spark, sf_dir, FrameSpec.threshold(50))


def stream_frame_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed_frames(spark, sf_dir, FrameSpec.delta(50))


def stream_frame_aggregate_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed_frames(spark, sf_dir, FrameSpec.aggregate("sum", 150))


def stream_frame_maxrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row with the largest value of each frame, kept while the frame may still change."""
    changes = stream_frames(
        _event_stream(spark, sf_dir), FrameSpec.threshold(50), keys=USER, ts="ts", value="value",
        tie="event_id", lateness_ms=30 * DAY, early=True,
        reduction=RowFold.top_row("event_id", "ts", "value", "event_type"),
    )
    return latest_frames(_run(changes), USER).select(
        "user_id", "frame_seq", "n_rows", F.col("result.event_id").alias("top_event_id"),
        F.unix_micros(F.col("result.ts").cast("timestamp")).alias("top_ts"),
        F.round("result.value", 2).alias("top_value"),
        F.col("result.event_type").alias("top_event_type"),
    )


def stream_frame_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's own reduction: the number of event types in each frame."""
    kinds = RowFold(
        init=frozenset, add=lambda seen, row: seen | {row.event_type},
        merge=lambda a, b: a | b, result=len, returns="long", columns=("event_type",),
    )
    changes = stream_frames(
        _event_stream(spark, sf_dir), FrameSpec.delta(50), keys=USER, ts="ts", value="value",
        tie="event_id", lateness_ms=30 * DAY, early=True, reduction=kinds,
    )
    return latest_frames(_run(changes), USER).select(
        "user_id", "frame_seq", "n_rows", F.col("result").alias("n_types")
    )


def _assigned_stream(spark: SparkSession, sf_dir: str, spec: FrameSpec) -> DataFrame:
    changes = stream_assign(
        _event_stream(spark, sf_dir), spec, keys=USER, ts="ts", value="value", tie="event_id",
        lateness_ms=30 * DAY, early=True,
    )
    return latest_rows(_run(changes), USER).select(
        "user_id", F.col("tie").alias("event_id"), "frame_seq"
    )


def stream_assign_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned_stream(spark, sf_dir, FrameSpec.threshold(50))


def stream_assign_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned_stream(spark, sf_dir, FrameSpec.delta(50))


def stream_window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has passed, 3 days by 1 day, 1 day of lateness."""
    table = stream_windows(
        _event_stream(spark, sf_dir), F.sum("value").alias("sum_value"), keys=USER, ts="ts",
        size_ms=3 * DAY, slide_ms=DAY, lateness_ms=DAY,
    )
    return whole_times(_run(table))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        frame_threshold, frame_delta, frame_aggregate_sum, frame_delta_large_key,
        frame_aggregate_sum_large_key, frame_aggregate_max,
        frame_aggregate_min, frame_aggregate_count, frame_aggregate_function, frame_boundary,
        frame_custom, frame_custom_large_key, frame_function_large_key, frame_min_rows, frame_threshold_maxrow, frame_stats, frame_bounds,
        last_frame_per_key, assign_threshold, assign_delta, state_size,
        events_in_frames, events_in_windows, coalesce_frames, coalesce_frames_touching,
        split_frames, split_frames_rows, repair_frames, repair_threshold_frames,
        window_tumbling, window_sliding, window_sliding_panes, window_sliding_offset, window_sliding_gap, assign_sliding,
        parse_events, format_events, parse_linear_road, strip_brackets, rewrite_disordered,
        scale_time, select_key_range, sort_by_arrival, limit_n,
        parse_metric_lines, metric_durations, metric_durations_untagged, metric_mean_by_state, metric_means,
        metric_quartiles, metric_box, metric_join, metric_union, throughput, diff_outputs,
        stream_frame_threshold, stream_frame_delta, stream_frame_aggregate_sum,
        stream_frame_maxrow, stream_frame_reduce, stream_assign_threshold, stream_assign_delta,
        stream_window_sliding,
    )
}
