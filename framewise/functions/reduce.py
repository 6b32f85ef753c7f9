"""Reductions of a window's rows, as aggregate columns.

Any Spark aggregate works. The helpers below depend on the order of rows in a
frame and read its hidden row position, so they are exact when times tie.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType, _parse_datatype_string

POSITION = "__pos"
ROW_FIELDS = ("at_us", "at_tie", "at_value")


def first_value(name: str) -> Column:
    """Value on the frame's first row."""
    return F.min_by(F.col(name), F.col(POSITION))


def last_value(name: str) -> Column:
    """Value on the frame's last row."""
    return F.max_by(F.col(name), F.col(POSITION))


def top_row(value: str, *columns: str) -> Column:
    """The row with the largest value, the later one on ties, as a struct of ``columns``."""
    return F.max_by(F.struct(*columns), F.struct(F.col(value), F.col(POSITION)))


def statistics(value: str) -> list[Column]:
    """count, sum, min, max, first and last of a value."""
    column = F.col(value)
    return [
        F.count(column).alias("count"),
        F.sum(column).alias("sum"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
        first_value(value).alias("first"),
        last_value(value).alias("last"),
    ]


def has_whole_part(value: str) -> Column:
    """True for a value that truncates to a 64-bit whole number: not null, NaN, infinite or larger.

    The double 2^63 counts as 2^63 - 1, as in Spark's own cast.
    """
    return F.col(value).isNotNull() & F.col(value).try_cast("long").isNotNull()


@dataclass(frozen=True)
class RowFold:
    """A caller's reduction of a frame's rows, in parts that can be merged.

    ``init()`` is the accumulator of no rows, ``add(acc, row)`` takes the next
    row, ``merge(left, right)`` joins the parts of two neighbouring stretches,
    ``result(acc)`` is the frame's answer, of the type ``returns``. A row has
    the fields ``ROW_FIELDS`` (time in microseconds, tiebreak and value) and
    ``columns``. Accumulators must be picklable. With ``returns`` None the answer is a row, given as a struct
    of ``columns``.
    """

    init: Callable[[], Any]
    add: Callable[[Any, Any], Any]
    merge: Callable[[Any, Any], Any]
    result: Callable[[Any], Any]
    returns: str | None = None
    columns: tuple[str, ...] = ()

    @staticmethod
    def pairs(function: Callable[[Any, Any], Any], *columns: str) -> RowFold:
        """Reduce the rows with an associative function of two neighbours that gives a row."""

        def join(left: Any, right: Any) -> Any:
            return right if left is None else left if right is None else function(left, right)

        return RowFold(lambda: None, join, join, lambda row: row, None, columns)

    @staticmethod
    def top_row(*columns: str) -> RowFold:
        """The row with the largest value, the later one on ties."""
        return RowFold.pairs(lambda a, b: b if b.at_value >= a.at_value else a, *columns)

    def returned(self, schema: StructType) -> DataType:
        """The type of the answer over rows of ``schema``."""
        if self.returns is not None:
            return _parse_datatype_string(self.returns)
        return StructType([schema[c] for c in self.columns])

    def answer(self, acc: Any) -> Any:
        """What goes into the result column."""
        found = self.result(acc)
        if self.returns is not None or found is None:
            return found
        return tuple(getattr(found, c) for c in self.columns)
