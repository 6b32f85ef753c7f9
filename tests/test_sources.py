import gzip
from collections import Counter

import pytest
from pyspark.sql import functions as F

from framewise.operators import compare, metrics
from framewise.sources import files, kafka, parse, sinks

ROAD = """VID,SPEED,ACCEL,XWay,Lane,Dir,Seg,Pos,T1,T2
[116, 32, 0.0, 0, 0, 0, 2, 10580, 2000, 2001]
[103, 30, 0.5, 0, 0, 0, 4, 21157, 3000, 3001]
"""


def lines(spark, *text):
    return spark.createDataFrame([(t,) for t in text], "value string")


def test_event_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("ts,key,value\n1000,1,2.5\n\n2000,x,3\n3000,2\n4000,1,7\n500,9,1\n")
    events = files.read_events(spark, str(tmp_path / "e.csv"))
    assert sorted(map(tuple, events.collect())) == [(500, 9, 1.0), (1000, 1, 2.5), (4000, 1, 7.0)]
    assert [r.ts for r in files.read_events(spark, str(tmp_path / "e.csv"), 2).collect()] == [500, 1000]


def test_event_stream_reads_all_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.csv").write_text(f"ts,key,value\n{i},1,2.5\nbad\n")
    stream = files.stream_events(spark, str(tmp_path / "in"), files_per_trigger=1)
    query = sinks.stream_results(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert sorted(r.ts for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]


def test_road_report_files(spark, tmp_path):
    (tmp_path / "road.csv").write_text(ROAD + "\n[1, 2]\n")
    with gzip.open(tmp_path / "road.txt.gz", "wt") as out:
        out.write(ROAD)
    speeds = files.read_speeds(spark, str(tmp_path / "road.csv"))
    assert sorted(map(tuple, speeds.collect())) == [("103", 3000, 30.0), ("116", 2000, 32.0)]
    assert files.read_speeds(spark, str(tmp_path / "road.csv"), 1).first().key == "116"
    reports = files.read_road_reports(spark, str(tmp_path / "road.csv"))
    assert reports.filter("reject is null").count() == 2
    assert reports.filter("reject is not null").first().reject == "[1, 2]"
    header = ROAD.splitlines()[0]
    assert files.read_lines(spark, str(tmp_path / "road.txt.gz"), header).count() == 2


def test_parsing_keeps_bad_lines_apart(spark):
    got = parse.parse_events(lines(spark, "1,2,3.5", "", "1,2", "a,2,3", " 4 , 5 , 6 ")).collect()
    assert [tuple(r)[:3] for r in got if r.reject is None] == [(1, 2, 3.5), (4, 5, 6.0)]
    assert [r.reject for r in got if r.reject is not None] == ["", "1,2", "a,2,3"]
    road = lines(spark, *ROAD.splitlines()[1:])
    assert [tuple(r)[:3] for r in parse.parse_accelerations(road).collect()] == [
        ("116", 2000, 0.0), ("103", 3000, 0.5)]


def test_disordered_rows(spark):
    good = "900,1000,7,32,0.0,0,0,0,2,10580,1000,1001,"
    got = parse.rewrite_disordered(lines(spark, good, "", "1,2,3,")).collect()
    assert [tuple(r) for r in got] == [("[7,32,0.0,0,0,0,2,10580,900,1001]", None), (None, "1,2,3,")]


def test_key_range_and_two_clock_lines(spark):
    text = lines(spark, "7,a,1000,x", "7,a,2000,x", "8,b,2000,y", "7,a,3000,x", "7,short", "7,a,bad,x")
    picked = parse.select_key_range(text, 1000, 3000, key="7")
    assert [(r.key, r.event_time) for r in picked.orderBy("event_time").collect()] == [("7", 2000), ("7", 3000)]
    assert parse.select_key_range(text, 1000, 3000).count() == 3
    out = parse.format_disordered(picked.orderBy("event_time")).first().value
    assert out == "2000,2000,7,a,2000,x,"


def test_metric_files(spark, tmp_path):
    record = ("method=processElement find_start=10,find_end=25,sate_size_items=3,state_size_windows=1,"
              "cumulative_merge=1,cumulative_add=2,cumulative_evict=3,cumulative_report=4,cumulative_emit=5 99")
    short = "method=onEventTime find_start=7,emit_start=8, 100"
    (tmp_path / "metrics-a").write_text(record + "\n")
    (tmp_path / "metrics-b").write_text(short + "\nno metric\n")
    (tmp_path / "other").write_text(record + "\n")
    raw = files.read_metric_lines(spark, str(tmp_path))
    assert raw.count() == 3 and raw.filter(F.col("file").contains("other")).count() == 0
    got = {r.timestamp: r for r in parse.parse_metric_lines(raw).collect()}
    assert (got[99].method, got[99].find_end, got[99].cumulative_emit) == ("processElement", 25, 5)
    assert (got[100].method, got[100].find_start, got[100].find_end) == ("onEventTime", 7, None)
    assert got[100].fields["emit_start"] == "8" and got[None].method is None


def test_missing_rows_keeps_copies(spark, monkeypatch):
    monkeypatch.setattr(compare, "COPIES_PER_ROW", 4)
    a = ["x"] * 11 + ["y"] * 3 + [None] * 2 + ["z"]
    got = compare.missing_rows(lines(spark, *a), lines(spark, "y", "y", "w")).collect()
    assert Counter(r.value for r in got) == Counter({"x": 11, None: 2, "z": 1})
    got = compare.missing_rows(lines(spark, *a), lines(spark, None)).collect()
    assert Counter(r.value for r in got) == Counter({"x": 11, "y": 3, "z": 1})


@pytest.mark.parametrize("max_rows", ["1000", "6"])
def test_positions_and_quantiles_of_cut_tables(spark, max_rows):
    import numpy as np

    spark.conf.set("spark.framewise.maxRowsPerChunk", max_rows)
    try:
        a = spark.createDataFrame([(i * 3 % 31,) for i in range(31)], "a long")
        b = spark.createDataFrame([(i * 5 % 23,) for i in range(23)], "b long")
        got = compare.join_by_position([a, b], [["a"], ["b"]]).collect()
        assert sorted(map(tuple, got)) == [(i + 1, i, i) for i in range(23)]
        values = [float(i % 9) ** 2 for i in range(50)] + [1000.0]
        df = spark.createDataFrame([(v, -v) for v in values], "m double, n double")
        table = {(r.metric, r.q): r.value for r in metrics.quantiles(df, ["m", "n"]).collect()}
        for q in (0.25, 0.5, 0.75):
            assert table["m", q] == pytest.approx(np.quantile(values, q))
            assert table["n", q] == pytest.approx(np.quantile([-v for v in values], q))
        box = {r.metric: r for r in metrics.box_summary(df, ["m"]).collect()}["m"]
        assert (box.low, box.high) == (0.0, 64.0)
    finally:
        spark.conf.unset("spark.framewise.maxRowsPerChunk")


def test_metric_means(spark):
    df = spark.createDataFrame([("f", 1, 5, 9), ("f", 2, 7, 10), ("g", 3, 1, 2), ("g", 4, 3, 8)],
                               "file string, i long, s long, e long")
    timed = metrics.with_durations(df, took=("s", "e"))
    assert metrics.drop_first(timed, ["i"]).count() == 3
    assert sorted(r.i for r in metrics.drop_first(timed, ["i"], ["file"]).collect()) == [2, 4]
    untagged = timed.sparkSession.createDataFrame([(1, None), (2, None), (3, "x"), (4, "x")], "i int, m string")
    assert sorted(r.i for r in metrics.drop_first(untagged, ["i"], ["m"]).collect()) == [2, 4]
    assert metrics.means(timed, "took").first().took == 3.25
    assert {r.file: r.took for r in metrics.mean_by(timed, "file", "took").collect()} == {"f": 3.5, "g": 3.0}


def test_topic_options_and_records(spark):
    options = kafka.source_options("h:9092", "cars", rows_per_trigger=500)
    assert options["startingOffsets"] == "earliest" and options["maxOffsetsPerTrigger"] == "500"
    text = lines(spark, *ROAD.splitlines()[1:])
    sent = kafka.records_of(text)
    assert sent.filter("key = '-1'").first().value == "[-1, 0, 0.0, 0, 0, 0, 0, 0, 4000, 4001]"
    assert kafka.records_of(text, limit=1).filter("key = '-1'").first().value.endswith("3000, 3001]")
    back = kafka.without_sentinels(sent.select("value"))
    assert sorted(r.value for r in back.collect()) == sorted(ROAD.splitlines()[1:])


def test_sinks(spark, tmp_path):
    place = str(tmp_path / "out")
    sinks.write_results(lines(spark, "a"), place, "text")
    sinks.write_results(lines(spark, "b"), place, "text")
    assert [r.value for r in spark.read.text(place).collect()] == ["b"]
    report = sinks.run_report(spark, "agg", "e1", "spark", True, 10_000, 1_000, 6_000, "scan", 8)
    for _ in range(2):
        sinks.append_throughput(report, str(tmp_path / "report"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "report")).collect()
    assert len(rows) == 2 and rows[0].events_count == "10000" and rows[0].parallelism is not None
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).columns == [
        "type", "experiment", "platform", "on_cluster", "start_time", "current_time", "events_count",
        "implementation", "parallelism",
    ]


def test_every_partition_is_closed_by_its_last_row(spark):
    lines = [f"[{k}, 50, 0.0, 0, 0, 0, 0, 1, {t}, {t + 1}]" for t in range(0, 9000, 1000) for k in (7, 8, 9)]
    sent = kafka.records_of(spark.createDataFrame([(x,) for x in lines], "value string"), partitions=3)
    parts = {}
    for rows in sent.rdd.glom().collect():
        for r in rows:
            parts.setdefault(r.partition, []).append((r.key, r.value))
    assert set(parts) == {0, 1, 2}
    for rows in parts.values():
        assert [k for k, _ in rows].index("-1") == len(rows) - 1
        assert rows[-1][1].endswith("9000, 9001]")
        times = [int(v.split(", ")[8]) for _, v in rows]
        assert times == sorted(times)
    assert sorted(v for rows in parts.values() for k, v in rows if k != "-1") == sorted(lines)


def test_a_batch_that_runs_again_is_there_once(spark, tmp_path):
    first = spark.range(5)
    for _ in range(2):
        sinks.write_batch(first, 0, str(tmp_path / "out"))
    sinks.write_batch(spark.range(5, 7), 1, str(tmp_path / "out"))
    table = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.id for r in table.collect()) == list(range(7))
    assert {r.batch for r in table.collect()} == {0, 1}


def test_a_run_ends_when_every_partition_is_closed(spark, tmp_path):
    import shutil

    folder, out, cp = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    folder.mkdir()
    line = lambda k, t: f"[{k}, 50, 0.0, 0, 0, 0, 0, 1, {t}, {t + 1}]"

    def feed(name, rows):
        spark.createDataFrame(rows, "value string, partition int").coalesce(1).write.parquet(str(tmp_path / name))
        part = next((tmp_path / name).glob("part-*.parquet"))
        shutil.copy(part, folder / f"{name}.parquet")

    def lines():
        return (
            spark.readStream.schema("value string, partition int").option("maxFilesPerTrigger", 1)
            .parquet(str(folder))
        )

    feed("a", [(line(1, 1000), 0), (line(2, 1000), 1)])
    feed("b", [(line(-1, 2000), 0), (line(2, 1500), 1)])
    # Partition 1 is still open: the run is stopped by the clock.
    assert not kafka.run_to_closing(lines(), 2, str(out), str(cp), every_ms=100, max_minutes=0.15)
    feed("c", [(line(2, 1800), 1), (line(-1, 2000), 1)])
    # A new run goes on behind the old one and knows the partition that was closed then.
    assert kafka.run_to_closing(lines(), 2, str(out), str(cp), every_ms=100, max_minutes=1)
    rows = spark.read.parquet(str(out / "rows"))
    assert sorted(r.value for r in rows.collect()) == sorted(
        [line(1, 1000), line(2, 1000), line(2, 1500), line(2, 1800)])


def test_results_again_and_again(spark, tmp_path):
    """``every_ms``: the query stays and writes what comes later."""
    (tmp_path / "in").mkdir()
    spark.range(3).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    query = sinks.stream_results(stream, str(tmp_path / "out"), str(tmp_path / "cp"), every_ms=100)
    try:
        query.processAllAvailable()
        spark.range(3, 5).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(5))
