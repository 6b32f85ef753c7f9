"""Frames over a stream, with late rows.

A frame is a fold over a key's rows in time order, so whatever happened up to
the watermark can no longer change. State per key is one folded prefix and the
rows above it in time buckets. Each bucket also keeps what its rows do to the
frames from the state before it (``stretches``). A row that comes late is put
into its bucket, which is folded again; the buckets behind it only as far as
their entry state has changed. Those behind that are not even read if the frame
that is open there, and its number, are the same as before. So a batch costs
what it brings, not the length of the lateness. Rows at or below the watermark
are late and are reported, not folded. The fold is that of the batch operators,
so the stream ends at the frames of a batch run over the rows it accepted.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framewise.functions import times
from framewise.functions.reduce import RowFold, has_whole_part
from framewise.functions.spec import FrameSpec
from framewise.session import ROCKSDB_PROVIDER
from framewise.streaming.stretches import Folder, Frame, Stretch

PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"

UPSERT, RETRACT, LATE, REJECT = "upsert", "retract", "late", "reject"

# Microseconds; an open frame ends 1 ms after its last row.
OPEN_TAIL = 1_000

PREFIX_SCHEMA = "packed binary"
BUCKET_KEY = "bucket long"
ROWS_KEY = "bucket long, part long"


def _frame_fields(number: T.DataType) -> list[T.StructField]:
    return [
        T.StructField("frame_seq", T.LongType()),
        T.StructField("start_us", T.LongType()),
        T.StructField("start_tie", T.LongType()),
        T.StructField("end_us", T.LongType()),
        T.StructField("is_closed", T.BooleanType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("sum_value", number),
        T.StructField("min_value", number),
        T.StructField("max_value", number),
        T.StructField("first_value", number),
        T.StructField("last_value", number),
        T.StructField("last_us", T.LongType()),
    ]


def frame_fields(df: DataFrame, number: T.DataType, reduction: RowFold | None) -> list[T.StructField]:
    """The columns of a frame, and ``result`` if there is a reduction of the caller."""
    fields = _frame_fields(number)
    if reduction is not None:
        missing = [c for c in reduction.columns if c not in df.columns]
        if missing:
            raise ValueError(f"the stream has no columns {missing}")
        fields.append(T.StructField("result", reduction.returned(df.schema)))
    return fields


def stream_frames(
    df: DataFrame,
    spec: FrameSpec,
    *,
    keys: Sequence[str],
    ts: str,
    value: str,
    tie: str,
    lateness_ms: int = 0,
    early: bool = False,
    bucket_ms: int | None = None,
    reduction: RowFold | None = None,
) -> DataFrame:
    """The frames of a stream as an append-only change log.

    Without ``early`` a frame is written once, when the row that closes it is at
    or below the watermark. With ``early`` every micro-batch also writes the
    frames that can still change, and takes back those that late rows split,
    shifted or removed; ``latest_frames`` reads the result. ``lateness_ms`` is
    how far behind the newest row a row may come. Late rows appear with
    ``op = 'late'``. Rows without a time or a finite value belong to no frame and
    appear with ``op = 'reject'``; their time, tiebreak and value are those of the row.

    ``reduction`` adds a column ``result`` with the caller's reduction of each
    frame; the columns it names are carried with the rows. Whole-number values
    stay whole, so they are exact beyond 2^53 as in the batch operators.
    """
    fields = frame_fields(df, number_type(df, value), reduction)
    rows = keyed_rows(df, keys, ts, value, tie, lateness_ms, Folder(spec, reduction).columns)
    names = [*keys, "op", "revision", *[f.name for f in fields]]
    processor = FrameProcessor(spec, early, _bucket_us(bucket_ms, lateness_ms), names, reduction)
    return _processed(rows, df, keys, processor, fields)


def stream_assign(
    df: DataFrame,
    spec: FrameSpec,
    *,
    keys: Sequence[str],
    ts: str,
    value: str,
    tie: str,
    lateness_ms: int = 0,
    early: bool = False,
    bucket_ms: int | None = None,
) -> DataFrame:
    """The rows of a stream with the number of their frame, as an append-only change log.

    Without ``early`` a row is written once, when the watermark has reached it.
    With ``early`` every micro-batch writes its rows, and again those whose frame
    a late row split, joined or renumbered; ``latest_rows`` reads the result.
    frame_seq is null for a row in no frame. Late and rejected rows appear as in
    ``stream_frames``.
    """
    number = number_type(df, value)
    fields = [T.StructField("ts_us", T.LongType()), T.StructField("tie", T.LongType()),
              T.StructField("value", number), T.StructField("frame_seq", T.LongType())]
    rows = keyed_rows(df, keys, ts, value, tie, lateness_ms, [])
    names = [*keys, "op", "revision", *[f.name for f in fields]]
    processor = RowProcessor(spec, early, _bucket_us(bucket_ms, lateness_ms), names)
    return _processed(rows, df, keys, processor, fields)


def number_type(df: DataFrame, value: str) -> T.DataType:
    whole = isinstance(df.schema[value].dataType, T.IntegralType)
    return T.LongType() if whole else T.DoubleType()


def _bucket_us(bucket_ms: int | None, lateness_ms: int) -> int:
    return 1_000 * (bucket_ms or max(1_000, lateness_ms // 16))


def keyed_rows(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, tie: str, lateness_ms: int,
    payload: Sequence[str],
) -> DataFrame:
    """Keys, time, tiebreak, value and payload of the rows, with a watermark on the time."""
    if ts not in df.columns or value not in df.columns:
        raise ValueError(f"the stream needs columns {ts} and {value}")
    spark = df.sparkSession
    if spark.conf.get(PROVIDER_CONF, None) != ROCKSDB_PROVIDER:
        spark.conf.set(PROVIDER_CONF, ROCKSDB_PROVIDER)
    at = times.to_timestamp(F.col(ts), times.is_millis(df, ts)).cast("timestamp")
    # The watermark column itself is not passed on: Spark would then drop rows
    # below the watermark before the processor could report them.
    return (
        df.withColumn("__ok", F.col(ts).isNotNull() & has_whole_part(value))
        .withColumn("__at", F.coalesce(at, F.lit("0001-01-01").cast("timestamp")))
        .withWatermark("__at", f"{lateness_ms} milliseconds")
        .select(
            *keys,
            F.when(F.col(ts).isNotNull(), F.unix_micros("__at")).alias("__ts"),
            F.col(tie).cast("long").alias("__tie"),
            F.col(value).cast(number_type(df, value)).alias("__value"),
            F.col("__ok"),
            F.struct(*payload).alias("__payload") if payload else F.lit(None).cast("string").alias("__payload"),
        )
    )


def _processed(
    rows: DataFrame, df: DataFrame, keys: Sequence[str], processor: StatefulProcessor,
    fields: list[T.StructField],
) -> DataFrame:
    schema = T.StructType(
        [*[T.StructField(k, df.schema[k].dataType) for k in keys],
         T.StructField("op", T.StringType()), T.StructField("revision", T.LongType()), *fields]
    )
    return rows.groupBy(*keys).transformWithState(processor, schema, "append", "EventTime")


def latest_frames(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Current frames of a change log: the last revision of each, unless taken back."""
    place = [*keys, "revision", "start_us", "start_tie"]
    cells = [c for c in changes.columns if c not in place]
    latest = (
        changes.filter(F.col("op").isin(UPSERT, RETRACT))
        .groupBy(*keys, "start_us", "start_tie")
        .agg(F.max_by(F.struct(*cells), "revision").alias("__f"))
    )
    return (
        latest.select(*keys, "start_us", "start_tie", "__f.*")
        .filter(F.col("op") == UPSERT)
        .drop("op")
        .withColumn("result_us", F.col("end_us") - OPEN_TAIL)
    )


def latest_rows(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Current rows of a change log of ``stream_assign``, each with the number of its frame."""
    return (
        changes.filter(F.col("op") == UPSERT)
        .groupBy(*keys, "ts_us", "tie")
        .agg(F.max_by(F.struct("value", "frame_seq"), "revision").alias("__r"))
        .select(*keys, "ts_us", "tie", "__r.*")
    )


def late_rows(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that came too late: time, tiebreak and value."""
    return _set_aside(changes, keys, LATE)


def rejected_rows(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows without a time or a finite value: time, tiebreak and value."""
    return _set_aside(changes, keys, REJECT)


def _set_aside(changes: DataFrame, keys: Sequence[str], op: str) -> DataFrame:
    chosen = changes.filter(F.col("op") == op)
    if "ts_us" in changes.columns:
        return chosen.select(*keys, "ts_us", "tie", "value")
    return chosen.select(
        *keys, F.col("start_us").alias("ts_us"), F.col("start_tie").alias("tie"),
        F.col("first_value").alias("value"),
    )


@dataclass
class Prefix:
    """A key's state below its buckets, and what is known of it as a whole."""

    state: bytes | None = None
    frame: Frame | None = None
    seq: int = 0
    revision: int = 0
    timer: int | None = None
    told: int = -(1 << 62)  # without ``early``: everything up to here is written
    open_sent: dict[tuple, bytes] = field(default_factory=dict)

    def pack(self) -> bytes:
        frame = self.frame.plain() if self.frame else None
        return pickle.dumps((self.state, frame, self.seq, self.revision, self.timer, self.told, self.open_sent))

    @staticmethod
    def unpack(packed: bytes) -> Prefix:
        state, frame, *rest = pickle.loads(packed)
        return Prefix(state, Frame.of(frame), *rest)


@dataclass
class Bucket:
    """What is kept of a bucket besides its rows, which are stored in one part per arrival."""

    parts: int = 0
    stretch: Stretch | None = None  # None: its rows have changed
    before: bytes | None = None  # open frame and its number, in front of the bucket
    after: tuple[Frame | None, int] = (None, 0)
    sent: dict[tuple, Any] = field(default_factory=dict)

    def pack(self) -> bytes:
        stretch = self.stretch.plain() if self.stretch else None
        return pickle.dumps((self.parts, stretch, self.before, _at(*self.after), self.sent))

    @staticmethod
    def unpack(packed: bytes) -> Bucket:
        parts, stretch, before, (frame, seq), sent = pickle.loads(packed)
        return Bucket(parts, Stretch.of(stretch), before, (Frame.of(frame), seq), sent)


def _at(frame: Frame | None, seq: int) -> tuple[tuple | None, int]:
    return (frame.plain() if frame else None, seq)


class BucketProcessor(StatefulProcessor):
    """Keeps a key's rows above the watermark in buckets, each with its effect on the frames."""

    keeps_places = False

    def __init__(
        self, spec: FrameSpec, early: bool, bucket_us: int, names: list[str],
        reduction: RowFold | None = None,
    ) -> None:
        self.names = names
        self.folder = Folder(spec, reduction, self.keeps_places)
        self.early = early
        self.bucket_us = bucket_us
        self.folded = 0  # rows folded so far, again and again ones included

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.prefix = handle.getValueState("prefix", PREFIX_SCHEMA)
        self.buckets = handle.getMapState("buckets", BUCKET_KEY, PREFIX_SCHEMA)
        self.rows = handle.getMapState("rows", ROWS_KEY, PREFIX_SCHEMA)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        mark = watermark_us(timerValues)
        out: list[Row] = []
        prefix = self._load()
        fresh: dict[int, list[tuple]] = {}
        columns = self.folder.columns
        for row in rows:
            ts, tie, value, ok, payload = row[-5:]
            if not ok or ts <= mark:
                prefix.revision += 1
                out.append(self.aside(key, REJECT if not ok else LATE, prefix.revision, ts, tie, value))
            else:
                packed = pickle.dumps(tuple(payload[c] for c in columns)) if columns else b""
                fresh.setdefault(ts // self.bucket_us, []).append((ts, tie, value, packed))
        for number, added in fresh.items():
            bucket = self._bucket(number)
            self.rows.updateValue((number, bucket.parts), (pickle.dumps(added),))
            bucket.parts += 1
            bucket.stretch = None
            self._keep(number, bucket)
        out += self._advance(key, prefix, mark, set(fresh))
        return iter(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        prefix = self._load()
        prefix.timer = None
        return iter(self._advance(key, prefix, watermark_us(timerValues), set()))

    def close(self) -> None:
        pass

    def _load(self) -> Prefix:
        held = self.prefix.get()
        return Prefix() if held is None else Prefix.unpack(bytes(held[0]))

    def _bucket(self, number: int) -> Bucket:
        if not self.buckets.containsKey((number,)):
            return Bucket()
        return Bucket.unpack(bytes(self.buckets.getValue((number,))[0]))

    def _keep(self, number: int, bucket: Bucket) -> None:
        self.buckets.updateValue((number,), (bucket.pack(),))

    def _rows_of(self, number: int, bucket: Bucket) -> list[tuple]:
        rows: list[tuple] = []
        for part in range(bucket.parts):
            rows += pickle.loads(bytes(self.rows.getValue((number, part))[0]))
        return sorted(rows)

    def _advance(self, key: Any, prefix: Prefix, mark: int, changed: set[int]) -> list[Row]:
        """Bring the buckets up to date from each changed one on; write what is different."""
        numbers = sorted(k[0] for k in self.buckets.keys())
        held = {n: self._bucket(n) for n in numbers if n * self.bucket_us <= mark}
        state, frame, seq = prefix.state, prefix.frame, prefix.seq
        walked: list[tuple[int, Bucket, list[Frame]]] = []
        i = 0
        jump = self.early  # to the next changed bucket
        while i < len(numbers):
            if jump:
                i = next((j for j in range(i, len(numbers)) if numbers[j] in changed), len(numbers))
                if i == len(numbers):
                    break
                if i:
                    ahead = held.get(numbers[i - 1]) or self._bucket(numbers[i - 1])
                    state, (frame, seq) = ahead.stretch.exit, ahead.after
                jump = False
            n = numbers[i]
            if not self.early and n * self.bucket_us > mark:
                break
            bucket = held.setdefault(n, held.get(n) or self._bucket(n))
            before = pickle.dumps(_at(frame, seq))
            if bucket.stretch is None or bucket.stretch.entry != state:
                bucket.stretch = self.effect(n, bucket, state)
            elif self.early and bucket.before == before:
                jump = True  # nothing is different from here to the next changed bucket
                continue
            ended, frame, seq = self.folder.follow(bucket.stretch, frame, seq)
            state = bucket.stretch.exit
            bucket.before, bucket.after = before, (frame, seq)
            walked.append((n, bucket, ended))
            i += 1
        settled = jump or not walked
        out = self.changes(key, prefix, walked, None if settled else (frame,), mark)
        for n, bucket, _ in walked:
            self._keep(n, bucket)
        left = self._pass(prefix, numbers, held, mark)
        self._set_timer(prefix, self._next_time(walked, left, mark))
        self.prefix.update((prefix.pack(),))
        return out

    def effect(self, number: int, bucket: Bucket, state: bytes | None) -> Stretch:
        """What the bucket's rows do from this state on."""
        rows = self._rows_of(number, bucket)
        self.folded += len(rows)
        return self.folder.fold(state, rows)

    def _pass(self, prefix: Prefix, numbers: list[int], held: dict[int, Bucket], mark: int) -> list[int]:
        """Buckets that the watermark has passed become part of the prefix."""
        while numbers and (numbers[0] + 1) * self.bucket_us - 1 <= mark:
            number = numbers.pop(0)
            bucket = held[number]
            prefix.state, (prefix.frame, prefix.seq) = bucket.stretch.exit, bucket.after
            for part in range(bucket.parts):
                self.rows.removeKey((number, part))
            self.buckets.removeKey((number,))
        return numbers

    def _next_time(self, walked: list, left: list[int], mark: int) -> int | None:
        """When there is something to do even if no row comes."""
        times_ahead = [(left[0] + 1) * self.bucket_us - 1] if left else []
        if not self.early:
            times_ahead += [n * self.bucket_us for n in left if n * self.bucket_us > mark][:1]
            times_ahead += [t for n, b, ended in walked if n in left for t in self.due(n, b, ended) if t > mark]
        return min(times_ahead, default=None)

    def _set_timer(self, prefix: Prefix, at: int | None) -> None:
        wanted = None if at is None else max(1, -(-at // 1_000))
        if wanted == prefix.timer:
            return
        if prefix.timer is not None:
            self.handle.deleteTimer(prefix.timer)
        if wanted is not None:
            self.handle.registerTimer(wanted)
        prefix.timer = wanted

    def line(self, key: Any, op: str, revision: int, *cells: Any) -> Row:
        return Row(*self.names)(*key, op, revision, *cells)


class FrameProcessor(BucketProcessor):
    """Writes frames."""

    def changes(
        self, key: Any, prefix: Prefix, walked: list[tuple[int, Bucket, list[Frame]]],
        last: tuple[Frame | None] | None, mark: int,
    ) -> list[Row]:
        """Lines for the frames of the walked buckets; ``last`` is the open frame if that may be new."""
        if not self.early:
            done = [f for _, _, ended in walked for f in ended if prefix.told < f.end <= mark]
            prefix.told = max(prefix.told, mark)
            if done:
                prefix.revision += 1
            return [self._frame(key, prefix.revision, f) for f in done]
        sent: dict[tuple, bytes] = {}
        now: dict[tuple, Frame] = {}
        for _, bucket, ended in walked:
            sent.update(bucket.sent)
            now.update({(f.start, f.tie): f for f in ended})
            bucket.sent = {(f.start, f.tie): _digest(f) for f in ended}
        if last is not None:
            sent.update(prefix.open_sent)
            opened = [f for f in last if f is not None]
            now.update({(f.start, f.tie): f for f in opened})
            prefix.open_sent = {(f.start, f.tie): _digest(f) for f in opened}
        prefix.revision += 1
        out = [
            self.line(key, RETRACT, prefix.revision, None, *place, *[None] * (len(self.names) - len(key) - 5))
            for place in sent if place not in now
        ]
        return out + [
            self._frame(key, prefix.revision, f) for place, f in now.items() if sent.get(place) != _digest(f)
        ]

    def due(self, number: int, bucket: Bucket, ended: list[Frame]) -> list[int]:
        return [f.end for f in ended]

    def aside(self, key: Any, op: str, revision: int, ts: int | None, tie: int | None, value: Any) -> Row:
        blank = [None] * (len(self.names) - len(key) - 2)
        blank[1], blank[2], blank[9] = ts, tie, value
        return self.line(key, op, revision, *blank)

    def _frame(self, key: Any, revision: int, f: Frame) -> Row:
        p = f.part
        end = p.last_ts + OPEN_TAIL if f.end is None else f.end
        whole = self.folder.reduction
        result = [whole.answer(p.own)] if whole else []
        return self.line(key, UPSERT, revision, f.seq, f.start, f.tie, end, f.end is not None, p.n,
                         p.total, p.low, p.high, p.first, p.last, p.last_ts, *result)


class RowProcessor(BucketProcessor):
    """Writes rows with the number of their frame."""

    keeps_places = True

    def changes(
        self, key: Any, prefix: Prefix, walked: list[tuple[int, Bucket, list[Frame]]],
        last: tuple[Frame | None] | None, mark: int,
    ) -> list[Row]:
        prefix.revision += 1
        out = []
        for number, bucket, _ in walked:
            open_frame, seq = pickle.loads(bucket.before)
            frame = Frame.of(open_frame)
            now = {}
            for (ts, tie, value, _), place in zip(self._rows_of(number, bucket), bucket.stretch.places):
                own = None if place is None else frame.seq if place == 0 else seq + place
                now[ts, tie] = (own, value)
            for (ts, tie), (own, value) in now.items():
                new = prefix.told < ts <= mark if not self.early else bucket.sent.get((ts, tie)) != (own,)
                if new:
                    out.append(self.line(key, UPSERT, prefix.revision, ts, tie, value, own))
            if self.early:
                bucket.sent = {at: (own,) for at, (own, _) in now.items()}
        prefix.told = max(prefix.told, mark)
        return out

    def due(self, number: int, bucket: Bucket, ended: list[Frame]) -> list[int]:
        return [ts for ts, *_ in self._rows_of(number, bucket)]

    def aside(self, key: Any, op: str, revision: int, ts: int | None, tie: int | None, value: Any) -> Row:
        return self.line(key, op, revision, ts, tie, value, None)


def _digest(frame: Frame) -> bytes:
    return hashlib.blake2b(pickle.dumps(frame.plain()), digest_size=8).digest()


def watermark_us(timer_values: Any) -> int:
    """Watermark in microseconds; Spark reports 0 until there is one, and nothing is late then."""
    millis = timer_values.getCurrentWatermarkInMs()
    return millis * 1_000 if millis > 0 else -(1 << 62)
