"""Frames over a stream in which one key may hold most rows.

Two stateful steps. The first is keyed by key and stretch of time, so the rows of
a busy key lie in many state partitions; it folds its rows from every state that
the fold knows and hands on what they do to the frames, one table per stretch.
The second is keyed by key alone, holds these tables instead of rows, and walks
them in order: each stretch's effect is looked up by the state before it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framewise.functions.reduce import RowFold
from framewise.functions.spec import FrameSpec
from framewise.streaming.frames import (
    LATE,
    PREFIX_SCHEMA,
    REJECT,
    Bucket,
    FrameProcessor,
    frame_fields,
    keyed_rows,
    number_type,
    watermark_us,
)
from framewise.streaming.stretches import Folder, Stretch

CHUNK = "__chunk"
TABLE, FINAL = "table", "final"


def stream_split_frames(
    df: DataFrame,
    spec: FrameSpec,
    *,
    keys: Sequence[str],
    ts: str,
    value: str,
    tie: str,
    chunk_ms: int,
    lateness_ms: int = 0,
    early: bool = False,
    reduction: RowFold | None = None,
) -> DataFrame:
    """As ``stream_frames``, with the rows of a key spread over stretches of ``chunk_ms``.

    For folds of few states: threshold and boundary frames, and custom ones with
    ``states``. A batch costs the stretches that it touches, each folded once per
    state; the second step holds parts of frames, not rows.
    """
    states = spec.mergeable.states if spec.mergeable else None
    if states is None:
        raise ValueError(f"a {spec.kind} fold has no short list of states to split a key by")
    number = number_type(df, value)
    fields = frame_fields(df, number, reduction)
    payload = list(reduction.columns) if reduction else []
    chunk_us = 1_000 * chunk_ms
    rows = keyed_rows(df, keys, ts, value, tie, lateness_ms, payload).withColumn(
        CHUNK, F.floor(F.col("__ts") / chunk_us)
    )
    key_fields = [T.StructField(k, df.schema[k].dataType) for k in keys]
    handed = T.StructType([
        *key_fields, T.StructField("chunk", T.LongType()), T.StructField("kind", T.StringType()),
        T.StructField("mark", T.LongType()), T.StructField("packed", T.BinaryType()),
        T.StructField("ts", T.LongType()), T.StructField("tie", T.LongType()),
        T.StructField("value", number),
    ])
    tables = rows.groupBy(*keys, CHUNK).transformWithState(
        ChunkProcessor(spec, states, chunk_us, handed.names, reduction), handed, "append", "EventTime"
    )
    schema = T.StructType([
        *key_fields, T.StructField("op", T.StringType()), T.StructField("revision", T.LongType()), *fields
    ])
    return tables.groupBy(*keys).transformWithState(
        TableProcessor(spec, early, chunk_us, schema.names, reduction), schema, "append", "None"
    )


class ChunkProcessor(StatefulProcessor):
    """Holds the rows of one stretch of a key until the watermark has passed it."""

    def __init__(
        self, spec: FrameSpec, states: Sequence[Any], chunk_us: int, names: list[str],
        reduction: RowFold | None,
    ) -> None:
        self.folder = Folder(spec, reduction)
        self.entries = [None, *map(pickle.dumps, states)]
        self.chunk_us = chunk_us
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getValueState("parts", "n long")
        self.rows = handle.getMapState("rows", "part long", PREFIX_SCHEMA)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        mark = watermark_us(timerValues)
        columns, fresh, out = self.folder.columns, [], []
        for row in rows:
            ts, tie, value, ok, payload = (row[f"__{c}"] for c in ("ts", "tie", "value", "ok", "payload"))
            if not ok or ts <= mark:
                kind = LATE if ok else REJECT
                out.append(self._line(key, kind, mark, None, ts, tie, value))
            else:
                packed = pickle.dumps(tuple(payload[c] for c in columns)) if columns else b""
                fresh.append((ts, tie, value, packed))
        if fresh:
            held = self.parts.get()
            n = held[0] if held else 0
            if not n:
                self.handle.registerTimer(max(1, -(-((key[-1] + 1) * self.chunk_us) // 1_000)))
            self.rows.updateValue((n,), (pickle.dumps(fresh),))
            self.parts.update((n + 1,))
            every = sorted(r for i in range(n + 1) for r in pickle.loads(bytes(self.rows.getValue((i,))[0])))
            table = {entry: self.folder.fold(entry, every).plain() for entry in self.entries}
            out.append(self._line(key, TABLE, mark, pickle.dumps(table)))
        return iter(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        held = self.parts.get()
        for i in range(held[0] if held else 0):
            self.rows.removeKey((i,))
        self.parts.clear()
        return iter([self._line(key, FINAL, watermark_us(timerValues), None)])

    def close(self) -> None:
        pass

    def _line(self, key: Any, kind: str, mark: int, packed: bytes | None, *row: Any) -> Row:
        return Row(*self.names)(*key, kind, mark, packed, *(row or (None, None, None)))


class TableProcessor(FrameProcessor):
    """Walks the tables of a key's stretches; what is late or rejected is handed through."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.seen = handle.getValueState("seen", "mark long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.seen.get()
        mark = held[0] if held else -(1 << 62)
        prefix, out, changed = self._load(), [], set()
        for row in rows:
            mark = max(mark, row["mark"])
            if row["kind"] in (LATE, REJECT):
                prefix.revision += 1
                out.append(self.aside(key, row["kind"], prefix.revision, row["ts"], row["tie"], row["value"]))
            elif row["kind"] == TABLE:
                number = row["chunk"]
                bucket = self._bucket(number)
                bucket.parts, bucket.stretch = 1, None
                self.rows.updateValue((number, 0), (bytes(row["packed"]),))
                self._keep(number, bucket)
                changed.add(number)
        out += self._advance(key, prefix, mark, changed)
        self.seen.update((mark,))
        return iter(out)

    def effect(self, number: int, bucket: Bucket, state: bytes | None) -> Stretch:
        table = pickle.loads(bytes(self.rows.getValue((number, 0))[0]))
        return Stretch.of(table[state])

    def _set_timer(self, prefix: Any, at: int | None) -> None:
        """The first step's lines say when a stretch has passed."""
