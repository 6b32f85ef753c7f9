"""How the rows of each key are spread over tasks.

Frame operators need a key's rows in time order. A key that fits one task is
kept whole. A key with more rows than that is cut, at points of its own order,
into chunks of bounded size; the operators then carry the little they need from
chunk to chunk. Cut points are fixed values, so every pass over the data, and
every retry of a lost task, sees the same chunks.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any, Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = "__chunk"
COLD = -1

MAX_ROWS_CONF = "spark.framewise.maxRowsPerChunk"
DEFAULT_MAX_ROWS = 2_000_000
# Tables of one row per chunk are joined by broadcast up to this many chunks, else by key.
BROADCAST_CHUNKS = 200_000
SAMPLES_PER_CHUNK = 64


@dataclass(frozen=True)
class KeyLayout:
    """Cut points of the keys that are too large for one task."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    hot_keys: DataFrame | None = None
    cuts: list[list[tuple[Any, ...]]] = field(default_factory=list)
    cut_on: int = 0

    @property
    def is_flat(self) -> bool:
        """True when every key fits one task."""
        return self.hot_keys is None

    @property
    def group(self) -> list[str]:
        """Columns whose groups fit one task."""
        return list(self.keys) if self.is_flat else [*self.keys, CHUNK]

    @property
    def n_chunks(self) -> int:
        """Chunks of all cut keys together."""
        return sum(len(points) + 1 for points in self.cuts)

    @staticmethod
    def flat(keys: Sequence[str], order: Sequence[str]) -> KeyLayout:
        return KeyLayout(tuple(keys), tuple(order))

    @staticmethod
    def measure(
        df: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int | None = None
    ) -> KeyLayout:
        """Count rows per key and choose cut points for the large ones.

        One pass reads only the key columns. Only when a key is too large do
        two more passes read the key and order columns, to pick the cuts.
        """
        if max_rows is None:
            conf = df.sparkSession.conf.get(MAX_ROWS_CONF, str(DEFAULT_MAX_ROWS))
            max_rows = int(conf)
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        top = counts.agg(F.max("__n").alias("top")).first().top
        if top is None or top <= max_rows:
            return KeyLayout.flat(keys, order)
        return _cut(df, keys, order, counts.filter(F.col("__n") > max_rows), max_rows)

    def with_order(self, *order: str, cut_on: int = 0) -> KeyLayout:
        """The same cuts for another table of the same keys.

        ``order`` names that table's columns; with ``cut_on`` only so many of
        them are compared with the cuts and rows equal in these stay together.
        """
        cut_on = cut_on or self.cut_on or len(self.order)
        cuts = [[point[:cut_on] for point in points] for points in self.cuts]
        return KeyLayout(self.keys, order, self.hot_keys, cuts, cut_on)

    def tag(self, df: DataFrame) -> DataFrame:
        """Add the chunk number, ``COLD`` for keys that are kept whole."""
        if self.is_flat:
            return df
        marked = join_small(df, self.hot_keys, self.keys, "left").withColumn(
            "__hot", F.coalesce("__hot", F.lit(COLD))
        )
        return self._chunked(marked)

    def tag_hot(self, df: DataFrame) -> DataFrame:
        """Only the rows of keys that are cut, with the chunk number."""
        return self._chunked(join_small(df, self.hot_keys, self.keys))

    def _chunked(self, marked: DataFrame) -> DataFrame:
        lookup = F.arrow_udf(_chunk_lookup(self.cuts), "int")
        chunk = lookup("__hot", *self.order[: self.cut_on or None])
        return marked.withColumn(CHUNK, chunk).drop("__hot")


def join_small(
    df: DataFrame, table: DataFrame, names: Sequence[str], how: str = "inner",
    broadcast: bool = True,
) -> DataFrame:
    """Bring a table of one row per ``names`` to the rows; a null key equals a null key."""
    renamed = table.select(
        *[F.col(c).alias(f"__j{i}") for i, c in enumerate(names)],
        *[c for c in table.columns if c not in names],
    )
    condition = F.col(names[0]).eqNullSafe(F.col("__j0"))
    for i, name in enumerate(names[1:], start=1):
        condition = condition & F.col(name).eqNullSafe(F.col(f"__j{i}"))
    joined = df.join(F.broadcast(renamed) if broadcast else renamed, condition, how)
    return joined.drop(*[f"__j{i}" for i in range(len(names))])


def _cut(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], hot: DataFrame, limit: int
) -> KeyLayout:
    spark = df.sparkSession
    rows = hot.collect()  # each stands for more than `limit` rows
    schema = T.StructType(
        [T.StructField(k, hot.schema[k].dataType) for k in keys]
        + [T.StructField("__hot", T.IntegerType())]
    )
    hot_keys = spark.createDataFrame(
        [(*(r[k] for k in keys), i) for i, r in enumerate(rows)], schema
    )
    # A sample, chosen by hash so that it is the same on every run, only places
    # the cuts; all rows are processed whatever the cuts are.
    every = max(1, limit // SAMPLES_PER_CHUNK)
    names = [f"__o{i}" for i in range(len(order))]
    sample = (
        join_small(df.select(*{*keys, *order}), hot_keys, keys)
        .select("__hot", *[F.col(c).alias(n) for c, n in zip(order, names)])
        .filter(F.col(names[0]).isNotNull() & (F.pmod(F.xxhash64(*names), F.lit(every)) == 0))
    )
    rank = F.row_number().over(Window.partitionBy("__hot").orderBy(*names))
    picked = (
        sample.withColumn("__r", rank)
        .filter(F.col("__r") % min(SAMPLES_PER_CHUNK, limit) == 0)
        .select("__hot", *names)
        .toArrow()
    )
    cuts: list[list[tuple[Any, ...]]] = [[] for _ in rows]
    columns = [_comparable(picked[n].combine_chunks()) for n in names]
    for owner, *point in zip(picked["__hot"].to_pylist(), *columns):
        cuts[owner].append(tuple(point))
    for points in cuts:
        points.sort(key=_nulls_first)
    return KeyLayout(tuple(keys), tuple(order), hot_keys, cuts)


def _comparable(column: pa.Array | pa.ChunkedArray) -> Any:
    """Values that compare as Spark orders them; times as whole microseconds."""
    if pa.types.is_timestamp(column.type):
        column = column.cast(pa.int64())
    if pa.types.is_integer(column.type) and column.null_count == 0:
        return column.to_numpy(zero_copy_only=False).astype(np.int64)
    return column.to_pylist()


def _nulls_first(point: tuple[Any, ...]) -> tuple[Any, ...]:
    return tuple((v is not None, v) for v in point)


def _chunk_lookup(cuts: list[list[tuple[Any, ...]]]) -> Callable[..., Any]:
    """Number of cut points at or before a row, by binary search."""
    ranked = [[_nulls_first(p) for p in points] for points in cuts]
    first_column = [
        np.array([p[0] for p in points], dtype=np.int64)
        if points and all(isinstance(p[0], (int, np.integer)) for p in points)
        else None
        for points in cuts
    ]

    def lookup(batches: Iterator[Tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for hot, *order in batches:
            owners = hot.to_numpy(zero_copy_only=False)
            chunks = np.full(len(owners), COLD, dtype=np.int32)
            columns = [_comparable(c) for c in order]
            for owner in np.unique(owners[owners != COLD]).tolist():
                at = np.flatnonzero(owners == owner)
                lead, points = first_column[owner], ranked[owner]
                if lead is not None and isinstance(columns[0], np.ndarray):
                    values = columns[0][at]
                    chunks[at] = np.searchsorted(lead, values, side="left")
                    tied = np.searchsorted(lead, values, side="right") != chunks[at]
                    at = at[tied]
                for i in at.tolist():
                    row = _nulls_first(tuple(c[i] for c in columns))
                    chunks[i] = bisect_right(points, row)
            yield pa.array(chunks, pa.int32())

    return lookup
