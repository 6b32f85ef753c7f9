"""The registered queries in SQL, for DuckDB.

Each text reads the whole ``events`` table. Value-dependent frames are folded
row by row in a recursive query; threshold and boundary frames are islands.
"""

from __future__ import annotations

DAY = 86_400_000_000
HOUR = 3_600_000_000

# Rows in order within their user, values truncated toward zero.
EV = """ev AS MATERIALIZED (
  SELECT *, CAST(trunc(value) AS BIGINT) AS v, epoch_us(ts) AS us,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
         lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt
  FROM {source})"""


def _ev(source: str = "events") -> str:
    return EV.format(source=source)


def _islands(member: str, opens: str, partition: str = "user_id") -> str:
    """Frames found by comparing a row with the one before: ``asg`` has ``seq`` per row."""
    return f"""marked AS (
  SELECT *, {member} AS member, {opens} AS opens FROM ev
  WINDOW w AS (PARTITION BY {partition} ORDER BY rn)),
asg AS (
  SELECT *, CASE WHEN member THEN
           sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY {partition} ORDER BY rn)
         END AS seq FROM marked)"""


def _threshold(limit: int, partition: str = "user_id") -> str:
    return _islands(f"v >= {limit}", f"v >= {limit} AND coalesce(lag(v) OVER w, {limit - 1}) < {limit}",
                    partition)


def _boundary(*bounds: int) -> str:
    bucket = " + ".join(f"CAST(v >= {b} AS INT)" for b in bounds)
    lagged = " + ".join(f"CAST(lag(v) OVER w >= {b} AS INT)" for b in bounds)
    return _islands("TRUE", f"lag(v) OVER w IS NULL OR ({bucket}) <> ({lagged})")


def _fold(state: str, keep: str, folded: str) -> str:
    """Frames folded row by row: first state, keep test and next state over e.v and d.s."""
    return f"""d AS (
  SELECT user_id, rn, CAST({state} AS BIGINT) AS s, CAST(1 AS BIGINT) AS seq FROM ev e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, CAST(CASE WHEN {keep} THEN {folded} ELSE {state} END AS BIGINT),
         CASE WHEN {keep} THEN d.seq ELSE d.seq + 1 END
  FROM d JOIN ev e ON e.user_id = d.user_id AND e.rn = d.rn + 1),
asg AS (SELECT ev.*, d.seq FROM ev JOIN d USING (user_id, rn))"""


DELTA = _fold("e.v", "abs(d.s - e.v) < 50", "d.s")
SUM = _fold("e.v", "d.s + e.v < 150", "d.s + e.v")
MAX = _fold("greatest(e.v, 0)", "greatest(d.s, e.v) < 100", "greatest(d.s, e.v)")
MIN = _fold("least(e.v, 1000)", "least(d.s, e.v) < 5", "least(d.s, e.v)")
COUNT = _fold("1", "d.s + 1 < 6", "d.s + 1")
SEVENTHS = _fold("CASE WHEN (e.v % 7 + 7) % 7 < 3 THEN 1 ELSE 0 END",
                 "d.s + CASE WHEN (e.v % 7 + 7) % 7 < 3 THEN 1 ELSE 0 END < 5",
                 "d.s + CASE WHEN (e.v % 7 + 7) % 7 < 3 THEN 1 ELSE 0 END")
CAPPED = _fold("least(e.v, 40)", "d.s + least(e.v, 40) < 150", "d.s + least(e.v, 40)")

BOUNDS = """min(us) AS frame_start,
  CASE WHEN count(nxt) = count(*) THEN max(nxt) ELSE max(us) + 1000 END AS frame_end,
  count(nxt) = count(*) AS is_closed, count(*) AS n_rows"""
SUMS = "round(sum(value), 2) AS sum_value, max(us) AS max_ts"


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts)


def _frames(assign: str, extra: str = SUMS, source: str = "events", having: str = "") -> str:
    return f"""{_with(_ev(source), assign)}
SELECT user_id, CAST(seq AS BIGINT) AS frame_seq, {BOUNDS}, {extra}
FROM asg WHERE seq IS NOT NULL GROUP BY user_id, seq {having}"""


CUSTOM = f"""{_with(_ev(), '''d AS (
  SELECT user_id, rn, v >= 60 AS opened, v >= 60 AS member, FALSE AS closed,
         CAST(v >= 60 AS BIGINT) AS seq FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn,
         CASE WHEN d.opened THEN e.v >= 20 ELSE e.v >= 60 END,
         CASE WHEN d.opened THEN e.v >= 40 ELSE e.v >= 60 END,
         d.opened AND e.v < 20,
         d.seq + CASE WHEN NOT d.opened AND e.v >= 60 THEN 1 ELSE 0 END
  FROM d JOIN ev e ON e.user_id = d.user_id AND e.rn = d.rn + 1)''',
'asg AS (SELECT ev.*, d.seq, d.member, d.closed FROM ev JOIN d USING (user_id, rn))')}
SELECT user_id, seq AS frame_seq, min(CASE WHEN member THEN us END) AS frame_start,
  coalesce(max(CASE WHEN closed THEN us END), max(CASE WHEN member THEN us END) + 1000) AS frame_end,
  bool_or(closed) AS is_closed, count(CASE WHEN member THEN 1 END) AS n_rows,
  round(sum(CASE WHEN member THEN value END), 2) AS sum_value,
  max(CASE WHEN member THEN us END) AS max_ts
FROM asg WHERE seq > 0 AND (member OR closed) GROUP BY user_id, seq"""

TOP_ROW = f"""{_with(_ev(), _threshold(50))}
SELECT user_id, CAST(seq AS BIGINT) AS frame_seq, count(*) OVER p AS n_rows,
       event_id AS top_event_id, us AS top_ts, round(value, 2) AS top_value
FROM asg WHERE seq IS NOT NULL
WINDOW p AS (PARTITION BY user_id, seq)
QUALIFY row_number() OVER (PARTITION BY user_id, seq ORDER BY value DESC, rn DESC) = 1"""

STATS = """count(value) AS count_value, round(sum(value), 2) AS sum_value,
  min(value) AS min_value, max(value) AS max_value,
  arg_min(value, rn) AS first_value, arg_max(value, rn) AS last_value"""

STATE = "CAST(sum(v) AS BIGINT) AS aggregate, arg_min(v, rn) AS aux"

LAST_FRAME = f"""SELECT * FROM ({_frames(DELTA)})
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY frame_seq DESC) = 1"""

STATE_SIZE = f"""{_with(_ev(), _threshold(50))}
SELECT user_id, count(seq) AS items, CAST(coalesce(max(seq), 0) AS BIGINT) AS windows
FROM asg GROUP BY user_id"""


def _assigned(assign: str) -> str:
    return f"""{_with(_ev(), assign)}
SELECT event_id, user_id, CAST(seq AS BIGINT) AS frame_seq FROM asg"""


EVENTS_IN_FRAMES = f"""WITH f AS ({_frames(_threshold(50))})
SELECT e.user_id, e.event_id, f.frame_seq FROM events e JOIN f
ON e.user_id = f.user_id AND epoch_us(e.ts) >= f.frame_start AND epoch_us(e.ts) < f.frame_end"""


def _windows(size: int, slide: int, offset: int = 0) -> str:
    """Every event with every window that holds it."""
    copies = max(1, -(-size // slide))
    return f"""SELECT e.*, epoch_us(ts) AS us, w.start AS window_start, w.start + {size} AS window_end
FROM events e, range({copies}) AS k(i),
LATERAL (SELECT CAST(floor((epoch_us(ts) - ({offset})) / {slide}.0) AS BIGINT) * {slide}
                + ({offset}) - i * {slide} AS start) w
WHERE w.start <= epoch_us(ts) AND epoch_us(ts) < w.start + {size}"""


def _window_sums(size: int, slide: int, offset: int = 0) -> str:
    return f"""SELECT user_id, window_start, window_end, count(*) AS n_rows, {SUMS}
FROM ({_windows(size, slide, offset)}) GROUP BY user_id, window_start, window_end"""


EVENTS_IN_WINDOWS = f"""WITH w AS (
SELECT user_id, window_start, window_end, count(*) AS n_errors FROM ({_windows(7 * DAY, DAY)})
WHERE event_type = 'error' GROUP BY user_id, window_start, window_end)
SELECT e.user_id, e.event_id, w.window_start, w.n_errors FROM events e JOIN w
ON e.user_id = w.user_id AND epoch_us(e.ts) >= w.window_start AND epoch_us(e.ts) < w.window_end
WHERE e.value >= 50"""

COALESCE = f"""WITH ev AS (
  SELECT *, CAST(trunc(value) AS BIGINT) AS v, epoch_us(ts) AS us,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn,
         lead(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nxt
  FROM events),
{_threshold(50, "user_id, event_type")},
f AS (SELECT user_id, event_type, {BOUNDS}, sum(v) AS aggregate, arg_min(v, rn) AS aux,
             min(event_id) AS start_tie
      FROM asg WHERE seq IS NOT NULL GROUP BY user_id, event_type, seq),
r AS (SELECT *, max(frame_end) OVER (PARTITION BY user_id ORDER BY frame_start, start_tie
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR frame_start >= reach THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY frame_start, start_tie) AS grp FROM r)
SELECT user_id, CAST(grp AS BIGINT) AS frame_seq, min(frame_start) AS frame_start,
  max(frame_end) AS frame_end, bool_or(is_closed) AS is_closed, count(*) AS n_frames,
  CAST(sum(aggregate) AS BIGINT) AS aggregate, arg_min(aux, frame_start) AS aux
FROM g GROUP BY user_id, grp"""

LOW = _islands("v <= 40", "v <= 40 AND coalesce(lag(v) OVER w, 41) > 40")
FIRST = "arg_min(event_id, rn) AS start_tie"

COALESCE_TOUCHING = f"""WITH high AS ({_frames(_threshold(60), f"{FIRST}, CAST(sum(v) AS BIGINT) AS aggregate")}),
low AS ({_frames(LOW, f"{FIRST}, CAST(-sum(v) AS BIGINT) AS aggregate")}),
f AS (SELECT * FROM high UNION ALL SELECT * FROM low),
r AS (SELECT *, max(frame_end) OVER (PARTITION BY user_id ORDER BY frame_start, start_tie
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR frame_start > reach THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY frame_start, start_tie) AS grp FROM r)
SELECT user_id, CAST(grp AS BIGINT) AS frame_seq, min(frame_start) AS frame_start,
  max(frame_end) AS frame_end, count(*) = 1 AND bool_or(is_closed) AS is_closed,
  count(*) AS n_frames, CAST(sum(aggregate) AS BIGINT) AS aggregate
FROM g GROUP BY user_id, grp"""

SPLIT = f"""WITH f AS ({_frames(_threshold(30))}),
p AS (SELECT DISTINCT user_id, epoch_us(ts) AS point FROM events WHERE event_type = 'purchase'),
s AS (SELECT user_id, frame_seq, frame_start, frame_end, is_closed, frame_start AS part FROM f
      UNION ALL
      SELECT f.user_id, frame_seq, frame_start, frame_end, is_closed, point FROM f JOIN p
      ON f.user_id = p.user_id AND point > frame_start AND point < frame_end)
SELECT user_id, frame_seq, row_number() OVER w AS part_no, part AS frame_start,
  coalesce(lead(part) OVER w, frame_end) AS frame_end,
  lead(part) OVER w IS NOT NULL OR is_closed AS is_closed
FROM s WINDOW w AS (PARTITION BY user_id, frame_seq ORDER BY part)"""

SPLIT_ROWS = f"""{_with(_ev(), _threshold(30))},
p AS (SELECT DISTINCT user_id, epoch_us(ts) AS point FROM events WHERE event_type = 'purchase'),
f AS (SELECT user_id, seq, min(us) AS begun FROM asg WHERE seq IS NOT NULL GROUP BY user_id, seq),
x AS (SELECT a.user_id, a.seq, a.us, a.rn, a.value, 1 + count(p.point) AS part_no
      FROM asg a JOIN f ON f.user_id = a.user_id AND f.seq = a.seq
      LEFT JOIN p ON p.user_id = a.user_id AND p.point > f.begun AND p.point <= a.us
      GROUP BY a.user_id, a.seq, a.us, a.rn, a.value)
SELECT user_id, CAST(seq AS BIGINT) AS frame_seq, part_no, min(us) AS first_ts, max(us) AS last_ts,
  count(*) AS n_rows, round(sum(value), 2) AS sum_value, round(arg_max(value, rn), 2) AS last_value
FROM x GROUP BY user_id, seq, part_no"""

REPAIRED = "arg_min(event_id, rn) AS start_tie, round(sum(value), 2) AS sum_value"

ASSIGN_SLIDING = f"""SELECT event_id, user_id, window_start, window_end
FROM ({_windows(3 * DAY, DAY)})"""

MS = "(epoch_us(ts) // 1000)"

PARSE_EVENTS = f"""SELECT CASE WHEN ok THEN {MS} END AS ts, CASE WHEN ok THEN user_id END AS key,
  CASE WHEN ok THEN value END AS value,
  CASE WHEN NOT ok THEN {MS}::VARCHAR || ',' || user_id::VARCHAR END AS reject
FROM (SELECT *, event_type <> 'error' AS ok FROM events)"""

FORMAT_EVENTS = f"""SELECT {MS}::VARCHAR || ',' || user_id::VARCHAR || ',' || value::VARCHAR AS line
FROM events"""

PARSE_ROAD = f"""SELECT user_id::VARCHAR AS key, {MS} AS ts, value, 'speed' AS kind FROM events
UNION ALL
SELECT user_id::VARCHAR, {MS}, value / 2, 'acceleration' FROM events"""

STRIP = f"""SELECT concat_ws(', ', user_id, value, value / 2, 0, 1, 0, length(event_type), event_id,
  {MS}, {MS} + 1) AS line FROM events"""

REWRITE = f"""SELECT CASE WHEN event_type <> 'error' THEN
    '[' || concat_ws(',', user_id, value, '0.0', 0, 1, 0, length(event_type), event_id,
                     {MS} - 1500, {MS} + 1) || ']' END AS line,
  CASE WHEN event_type = 'error' THEN
    concat_ws(',', {MS} - 1500, {MS}, user_id, value, '0.0', 0, 1, 0, length(event_type),
              event_id, {MS}) || ',' END AS reject
FROM events"""

SCALE = """SELECT event_id, t // 1000000000 AS ps_to_ms, t // 1000000 AS ns_to_ms, t AS ms_to_ms,
  t * 1000 AS s_to_ms, t AS other_to_ms, t // 1000000000 // 1000 AS ps_to_s,
  t // 1000000 // 1000 AS ns_to_s, t // 1000 AS ms_to_s, t AS s_to_s, t // 1000 AS other_to_s
FROM (SELECT event_id, epoch_us(ts) AS t FROM events)"""

SELECT_RANGE = """SELECT user_id::VARCHAR AS key, epoch_us(ts) // 1000 AS event_time,
  epoch_us(ts) // 1000 AS process_time,
  concat_ws('|', user_id, value, epoch_us(ts) * 1000, event_type) AS fields
FROM events WHERE event_type <> 'error'
  AND epoch_us(ts) > 1704844800000000 AND epoch_us(ts) <= 1706140800000000"""

ARRIVAL = f"""WITH a AS (SELECT event_id, user_id,
  epoch_us(ts) + CASE WHEN event_type = 'purchase' THEN {HOUR} ELSE 0 END AS process_time FROM events)
SELECT *, row_number() OVER (ORDER BY process_time, event_id) AS arrival_no
FROM a ORDER BY process_time, event_id"""

LIMIT = """SELECT event_id, user_id, epoch_us(ts) AS ts, round(value, 2) AS value
FROM events ORDER BY events.ts, event_id LIMIT 100"""

METRICS = """m AS (SELECT
  CASE WHEN event_type = 'error' THEN 'onEventTime' ELSE 'processElement' END AS method,
  epoch_us(ts) AS find_start, epoch_us(ts) + v * 10 AS find_end, user_id AS sate_size_items,
  length(event_type) AS state_size_windows, v * 2 AS cumulative_merge, v * 3 AS cumulative_add,
  v * 5 AS cumulative_evict, v * 7 AS cumulative_report, v * 11 AS cumulative_emit,
  event_id AS "timestamp"
FROM (SELECT *, CAST(trunc(value) AS BIGINT) AS v FROM events))"""

DURATIONS = f"""WITH {METRICS}
SELECT method, "timestamp", find_end - find_start AS cumulative_scope FROM m
QUALIFY row_number() OVER (PARTITION BY method ORDER BY find_start, "timestamp") > 1"""

DURATIONS_UNTAGGED = f"""WITH {METRICS}, u AS (
SELECT nullif(method, 'processElement') AS method, "timestamp", find_start, find_end FROM m)
SELECT method, "timestamp", find_end - find_start AS cumulative_scope FROM u
QUALIFY row_number() OVER (PARTITION BY method ORDER BY find_start, "timestamp") > 1"""

MEAN_BY = f"""WITH {METRICS}
SELECT state_size_windows, round(avg(find_end - find_start), 6) AS cumulative_scope,
  round(avg(cumulative_emit), 6) AS cumulative_emit FROM m GROUP BY state_size_windows"""

MEANS = f"""WITH {METRICS}, r AS (
SELECT * FROM m QUALIFY row_number() OVER (ORDER BY find_start, "timestamp") > 1)
SELECT round(avg(cumulative_add), 6) AS cumulative_add,
  round(avg(cumulative_evict), 6) AS cumulative_evict,
  round(avg(cumulative_emit), 6) AS cumulative_emit,
  round(avg(sate_size_items), 6) AS sate_size_items FROM r"""

LONG = """l AS (SELECT 'cumulative_add' AS metric, CAST(cumulative_add AS DOUBLE) AS x FROM m
  UNION ALL SELECT 'cumulative_emit', CAST(cumulative_emit AS DOUBLE) FROM m
  UNION ALL SELECT 'sate_size_items', CAST(sate_size_items AS DOUBLE) FROM m)"""

QUARTILES = f"""WITH {METRICS}, {LONG}
SELECT metric, q, round(CASE q WHEN 0.25 THEN a WHEN 0.5 THEN b ELSE c END, 6) AS value
FROM (SELECT metric, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.5) AS b,
             quantile_cont(x, 0.75) AS c FROM l GROUP BY metric),
     (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) AS t(q)"""

BOX = f"""WITH {METRICS}, {LONG},
b AS (SELECT metric, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
             quantile_cont(x, 0.75) AS q3 FROM l
      WHERE metric IN ('cumulative_add', 'cumulative_emit') GROUP BY metric)
SELECT metric, q1, median, q3, min(x) AS low, max(x) AS high FROM l JOIN b USING (metric)
WHERE x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) GROUP BY metric, q1, median, q3"""

METRIC_JOIN = """WITH i AS (SELECT event_id AS id_event, value AS id_value,
  row_number() OVER (ORDER BY event_id) AS row_no FROM events),
t AS (SELECT event_id AS time_event, value AS time_value,
  row_number() OVER (ORDER BY ts, event_id) AS row_no FROM events)
SELECT row_no, id_event, id_value, time_event, time_value FROM i JOIN t USING (row_no)"""

METRIC_UNION = f"""WITH {METRICS} SELECT "timestamp", method, cumulative_add FROM m"""

THROUGHPUT = """SELECT w * 300000000 AS window_start, (w + 1) * 300000000 AS window_end,
  count(*) AS events_count, round(count(*) / 300.0, 6) AS throughput
FROM (SELECT epoch_us(ts) // 300000000 AS w FROM events) GROUP BY w"""

DIFF = f"""WITH a AS (SELECT user_id, frame_start, n_rows FROM ({_frames(_boundary(50))})
  UNION ALL SELECT user_id, frame_start, n_rows FROM ({_frames(_boundary(50, 100))})),
b AS (SELECT user_id, frame_start, n_rows FROM ({_frames(_threshold(50))}))
SELECT concat_ws(',', user_id, frame_start, n_rows) AS line FROM a
WHERE concat_ws(',', user_id, frame_start, n_rows) NOT IN
  (SELECT concat_ws(',', user_id, frame_start, n_rows) FROM b)"""

STREAM_WINDOWS = f"""SELECT user_id, window_start, window_end, window_end - 1000 AS result_ts,
  count(*) AS n_rows, round(sum(value), 2) AS sum_value
FROM ({_windows(3 * DAY, DAY)})
WHERE window_end <= (SELECT (max(epoch_us(ts)) // 1000) * 1000 - {DAY} FROM events)
GROUP BY user_id, window_start, window_end"""

SQL: dict[str, str] = {
    "frame_threshold": _frames(_threshold(50)),
    "frame_delta": _frames(DELTA),
    "frame_aggregate_sum": _frames(SUM),
    "frame_delta_large_key": _frames(DELTA).replace("user_id", "event_type"),
    "frame_aggregate_sum_large_key": _frames(SUM).replace("user_id", "event_type"),
    "frame_aggregate_max": _frames(MAX),
    "frame_aggregate_min": _frames(MIN),
    "frame_aggregate_count": _frames(COUNT),
    "frame_aggregate_function": _frames(CAPPED),
    "frame_boundary": _frames(_boundary(20, 50, 100)),
    "frame_custom": CUSTOM,
    "frame_custom_large_key": CUSTOM.replace("user_id", "event_type"),
    "frame_function_large_key": _frames(SEVENTHS).replace("user_id", "event_type"),
    "frame_min_rows": _frames(
        _threshold(30), "round(sum(value), 2) AS sum_value", having="HAVING count(*) >= 3"
    ),
    "frame_threshold_maxrow": TOP_ROW,
    "frame_stats": _frames(DELTA, STATS),
    "frame_bounds": _frames(DELTA, f"arg_min(event_id, rn) AS start_tie, {STATE}"),
    "last_frame_per_key": LAST_FRAME,
    "assign_threshold": _assigned(_threshold(50)),
    "assign_delta": _assigned(DELTA),
    "state_size": STATE_SIZE,
    "events_in_frames": EVENTS_IN_FRAMES,
    "events_in_windows": EVENTS_IN_WINDOWS,
    "coalesce_frames": COALESCE,
    "coalesce_frames_touching": COALESCE_TOUCHING,
    "split_frames": SPLIT,
    "split_frames_rows": SPLIT_ROWS,
    "repair_frames": _frames(DELTA, REPAIRED),
    "repair_threshold_frames": _frames(_threshold(50), REPAIRED),
    "window_tumbling": _window_sums(DAY, DAY),
    "window_sliding": _window_sums(7 * DAY, DAY),
    "window_sliding_panes": _window_sums(2 * DAY, HOUR),
    "window_sliding_offset": _window_sums(3 * DAY, DAY, -6 * HOUR),
    "window_sliding_gap": _window_sums(6 * HOUR, DAY),
    "assign_sliding": ASSIGN_SLIDING,
    "parse_events": PARSE_EVENTS,
    "format_events": FORMAT_EVENTS,
    "parse_linear_road": PARSE_ROAD,
    "strip_brackets": STRIP,
    "rewrite_disordered": REWRITE,
    "scale_time": SCALE,
    "select_key_range": SELECT_RANGE,
    "sort_by_arrival": ARRIVAL,
    "limit_n": LIMIT,
    "parse_metric_lines": f"WITH {METRICS} SELECT * FROM m",
    "metric_durations": DURATIONS,
    "metric_durations_untagged": DURATIONS_UNTAGGED,
    "metric_mean_by_state": MEAN_BY,
    "metric_means": MEANS,
    "metric_quartiles": QUARTILES,
    "metric_box": BOX,
    "metric_join": METRIC_JOIN,
    "metric_union": METRIC_UNION,
    "throughput": THROUGHPUT,
    "diff_outputs": DIFF,
    "stream_frame_threshold": _frames(_threshold(50)),
    "stream_frame_delta": _frames(DELTA),
    "stream_frame_aggregate_sum": _frames(SUM),
    "stream_frame_maxrow": TOP_ROW.replace(
        "round(value, 2) AS top_value", "round(value, 2) AS top_value, event_type AS top_event_type"
    ),
    "stream_frame_reduce": f"""{_with(_ev(), DELTA)}
SELECT user_id, CAST(seq AS BIGINT) AS frame_seq, count(*) AS n_rows,
  count(DISTINCT event_type) AS n_types FROM asg GROUP BY user_id, seq""",
    "stream_assign_threshold": _assigned(_threshold(50)),
    "stream_assign_delta": _assigned(DELTA),
    "stream_window_sliding": STREAM_WINDOWS,
}
