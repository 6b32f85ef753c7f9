"""Functions over the rows of a key in order, exact for keys of any size.

Each function is a window expression inside a group that fits one task plus,
for keys cut into chunks, a value carried in from the chunks before or after.
The carried values come from one partial aggregation per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from framewise.plans.layout import BROADCAST_CHUNKS, CHUNK, KeyLayout, join_small
from framewise.session import materialize

BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class RunningSum:
    """Sum of the rows up to and with this one; nulls count as zero."""

    expr: Column

    def local(self, w: WindowSpec) -> Column:
        return F.sum(F.coalesce(self.expr, F.lit(0))).over(_upto(w))

    def summary(self, order: Column) -> Column:
        return F.sum(F.coalesce(self.expr, F.lit(0)))

    def carry(self, summary: Column, w: WindowSpec) -> Column:
        return F.sum(summary).over(_before(w))

    def merge(self, local: Column, carried: Column) -> Column:
        return local + F.coalesce(carried, F.lit(0))


@dataclass(frozen=True)
class RunningMax:
    """Largest value up to this row, with or without the row itself."""

    expr: Column
    before: bool = False

    def local(self, w: WindowSpec) -> Column:
        return F.max(self.expr).over(_before(w) if self.before else _upto(w))

    def summary(self, order: Column) -> Column:
        return F.max(self.expr)

    def carry(self, summary: Column, w: WindowSpec) -> Column:
        return F.max(summary).over(_before(w))

    def merge(self, local: Column, carried: Column) -> Column:
        return F.greatest(local, carried)


@dataclass(frozen=True)
class RunningMin:
    """Smallest value up to and with this row."""

    expr: Column

    def local(self, w: WindowSpec) -> Column:
        return F.min(self.expr).over(_upto(w))

    def summary(self, order: Column) -> Column:
        return F.min(self.expr)

    def carry(self, summary: Column, w: WindowSpec) -> Column:
        return F.min(summary).over(_before(w))

    def merge(self, local: Column, carried: Column) -> Column:
        return F.least(local, carried)


@dataclass(frozen=True)
class LastValue:
    """Latest value that is not null, up to and with this row."""

    expr: Column

    def local(self, w: WindowSpec) -> Column:
        return F.last(self.expr, ignorenulls=True).over(_upto(w))

    def summary(self, order: Column) -> Column:
        return F.max_by(self.expr, F.when(self.expr.isNotNull(), order))

    def carry(self, summary: Column, w: WindowSpec) -> Column:
        return F.last(summary, ignorenulls=True).over(_before(w))

    def merge(self, local: Column, carried: Column) -> Column:
        return F.coalesce(local, carried)


@dataclass(frozen=True)
class Lag:
    """Value of the row before; null on the key's first row."""

    expr: Column

    def local(self, w: WindowSpec) -> Column:
        return F.lag(self.expr).over(w)

    def summary(self, order: Column) -> Column:
        return F.max_by(self.expr, order)

    def carry(self, summary: Column, w: WindowSpec) -> Column:
        return F.lag(summary).over(w)

    def merge(self, local: Column, carried: Column) -> Column:
        return F.coalesce(local, carried)


@dataclass(frozen=True)
class Lead:
    """Value of the row after; null on the key's last row."""

    expr: Column

    def local(self, w: WindowSpec) -> Column:
        return F.lead(self.expr).over(w)

    def summary(self, order: Column) -> Column:
        return F.min_by(self.expr, order)

    def carry(self, summary: Column, w: WindowSpec) -> Column:
        return F.lead(summary).over(w)

    def merge(self, local: Column, carried: Column) -> Column:
        return F.coalesce(local, carried)


Op = RunningSum | RunningMax | RunningMin | LastValue | Lag | Lead


def position() -> RunningSum:
    """Row number within the key, from 1."""
    return RunningSum(F.lit(1).cast("long"))


@dataclass(frozen=True)
class OrderedRows:
    """Rows with the layout of their keys.

    ``hot`` holds the rows of cut keys once more (lazily, like ``df``): what is
    carried from chunk to chunk is computed from these alone.

    ``Lag`` and ``Lead`` fall back to the neighbouring chunk when the neighbour
    in the chunk is missing, so their expression must not be null on any row.
    """

    df: DataFrame
    layout: KeyLayout
    hot: DataFrame | None = None

    @staticmethod
    def of(df: DataFrame, layout: KeyLayout) -> OrderedRows:
        if layout.is_flat:
            return OrderedRows(df, layout)
        return OrderedRows(layout.tag(df), layout, layout.tag_hot(df))

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.layout.group).orderBy(*self.layout.order)

    def add(self, **ops: Op) -> OrderedRows:
        """Add one column per function; all share one shuffle and one sort."""
        if self.hot is None:
            columns = [op.local(self.window).alias(name) for name, op in ops.items()]
            return self.map(lambda df: df.select("*", *columns))
        keys = list(self.layout.keys)
        order = F.struct(*self.layout.order)
        chunks = self.hot.groupBy(*keys, CHUNK).agg(
            *[op.summary(order).alias(name) for name, op in ops.items()]
        )
        by_chunk = Window.partitionBy(*keys).orderBy(CHUNK)
        carried = materialize(
            chunks.select(
                *keys,
                CHUNK,
                *[op.carry(F.col(n), by_chunk).alias(f"__in_{n}") for n, op in ops.items()],
            )
        )
        own = self.df.columns
        columns = [
            op.merge(op.local(self.window), F.col(f"__in_{name}")).alias(name)
            for name, op in ops.items()
        ]
        return self.join_chunks(carried).map(lambda df: df.select(*own, *columns))

    def join_chunks(self, table: DataFrame, sized: str | None = None) -> OrderedRows:
        """Bring a table of one row per chunk to the rows.

        ``sized`` names a column whose values can be of any size; they are
        measured before the table is broadcast.
        """
        names = [*self.layout.keys, CHUNK]
        few = self.layout.n_chunks <= BROADCAST_CHUNKS
        if few and sized is not None:
            held = table.agg(F.sum(F.octet_length(sized)).alias("n")).first().n or 0
            few = held <= BROADCAST_BYTES
        return self.map(lambda df: join_small(df, table, names, "left", broadcast=few))

    def map(self, change: Callable[[DataFrame], DataFrame]) -> OrderedRows:
        """Change the rows without moving them between keys or chunks."""
        hot = None if self.hot is None else change(self.hot)
        return OrderedRows(change(self.df), self.layout, hot)

    def with_columns(self, columns: dict[str, Column]) -> OrderedRows:
        return self.map(lambda df: df.withColumns(columns))

    def plain(self, *drop: str) -> DataFrame:
        """The rows without helper columns."""
        return self.df.drop(CHUNK, *drop)


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "row_no",
    layout: KeyLayout | None = None,
) -> DataFrame:
    """Row numbers from 1 within each key, also for keys larger than one task."""
    layout = layout or KeyLayout.measure(df, keys, order)
    return OrderedRows.of(df, layout).add(**{name: position()}).plain()


def _upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)
