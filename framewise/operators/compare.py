"""Comparing and pairing result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.plans.layout import KeyLayout
from framewise.plans.ordered import number_rows

COPIES_PER_ROW = 1_000


def missing_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` that are not in ``b``, as often as ``a`` has them.

    Equal rows are counted before the shuffle and written out again after it,
    so neither a much repeated row nor its copies gather in one task.
    """
    names = a.columns
    counted = a.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    other = {c: f"__b{i}" for i, c in enumerate(names)}
    known = b.select(*names).distinct().withColumnsRenamed(other)
    condition = F.lit(True)
    for mine, theirs in other.items():
        condition = condition & F.col(mine).eqNullSafe(F.col(theirs))
    lone = counted.join(known, condition, "left_anti")
    full = F.call_function("div", F.col("__n") - 1, F.lit(COPIES_PER_ROW).cast("long"))
    pieces = lone.withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), full)))
    size = F.least(
        F.lit(COPIES_PER_ROW).cast("long"), F.col("__n") - F.col("__piece") * COPIES_PER_ROW
    )
    spread = pieces.withColumn("__size", size).hint("rebalance")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__size")))
    return spread.withColumn("__copy", copies).select(*names)


def join_by_position(
    tables: Sequence[DataFrame], orders: Sequence[Sequence[str]], name: str = "row_no"
) -> DataFrame:
    """Pair the first rows of all tables, the second rows, and so on.

    A table has no order of its own, so each brings one. Column names must
    differ between the tables. Ends with the shortest table.
    """
    numbered = [_numbered(t, list(o), name) for t, o in zip(tables, orders)]
    joined = numbered[0]
    for table in numbered[1:]:
        joined = joined.join(table, name)
    return joined


def _numbered(table: DataFrame, order: list[str], name: str) -> DataFrame:
    one = table.withColumn("__all", F.lit(1))
    layout = KeyLayout.measure(one, ["__all"], order)
    return number_rows(one, ["__all"], order, name, layout).drop("__all")
