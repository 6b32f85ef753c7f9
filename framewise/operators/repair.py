"""Bring a stored frame table up to date with rows that came late."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions.reduce import has_whole_part
from framewise.functions.spec import FrameSpec
from framewise.operators.keyed import KeyedEvents
from framewise.session import materialize, store

FIRST_HORIZON = 16
GROWTH = 8  # of the horizon, from round to round
FILE_GROUPS = 64
FILE_GROUP = "file_group"


def repair_frames(
    frames: DataFrame,
    stored: KeyedEvents,
    late: DataFrame,
    spec: FrameSpec,
    *aggregates: Column,
    horizon: int = FIRST_HORIZON,
) -> DataFrame:
    """Frames of the stored and late rows together, recomputed only where they change.

    ``frames`` is the stored result of ``reduce(*aggregates, with_tie=True)``
    of ``spec`` over ``stored``. The start of a stored frame is a state that a
    scan can begin in, so per key with late rows scanning starts again at the
    frame hit by the first late row. It goes on until, ``horizon`` frames past
    the last late row, a stored frame begins at the same row as a new one; keys
    where none does are scanned further, GROWTH times as far each time. The rows
    of such keys are set aside in the second round, so the whole table is read
    twice at most. Frames before and after are kept, the latter renumbered.
    """
    keys, ts, tie = list(stored.keys), stored.ts, stored.tie
    rows = stored.df.unionByName(late)
    changed = todo = materialize(_spots(frames, stored, late))
    done: list[DataFrame] = []
    aside = False
    while True:
        plan = _with_horizon(frames, todo, keys, horizon)
        span = _rows_between(rows, plan, keys, ts, tie)
        scanned = KeyedEvents(
            span, stored.keys, ts, stored.value, tie, max_rows=stored.max_rows
        )
        fresh = store(scanned.frames(spec).reduce(*aggregates, with_tie=True))
        agreed = materialize(_agreed(plan, fresh, keys))
        done.append(_assemble(frames, fresh, agreed, keys))
        rest = _anti(todo, agreed, keys)
        if rest.isEmpty():
            break
        todo = materialize(rest)
        horizon *= GROWTH
        if not aside:
            open_end = todo.withColumn("__stop", F.lit(None).cast(plan.schema["__stop"].dataType))
            rows, aside = store(_rows_between(rows, open_end, keys, ts, tie)), True
    untouched = _anti(frames, changed, keys)
    return fold(DataFrame.unionByName, done, untouched)


def store_frames(
    frames: DataFrame, keys: Sequence[str], path: str, groups: int = FILE_GROUPS
) -> None:
    """Write a frame table in file groups by key, for ``repair_stored``."""
    (
        frames.withColumn(FILE_GROUP, _group_of(keys, groups))
        .repartition(FILE_GROUP).write.mode("overwrite").partitionBy(FILE_GROUP).parquet(path)
    )


def repair_stored(
    path: str, stored: KeyedEvents, late: DataFrame, spec: FrameSpec, *aggregates: Column,
    groups: int = FILE_GROUPS, horizon: int = FIRST_HORIZON,
) -> list[int]:
    """Bring the frame table at ``path`` up to date; the file groups that were replaced.

    Frames and rows of other groups are not read, and their files stay as they
    are. The new frames are complete in the shared folder before any file of
    the table is replaced.
    """
    spark, keys = late.sparkSession, list(stored.keys)
    group = _group_of(keys, groups)
    placed = late.filter(F.col(stored.ts).isNotNull() & has_whole_part(stored.value))
    hit = sorted(r[0] for r in placed.select(group).distinct().collect())  # ``groups`` at most
    if not hit:
        return []
    frames = spark.read.parquet(path).filter(F.col(FILE_GROUP).isin(hit)).drop(FILE_GROUP)
    touched = replace(stored, df=stored.df.filter(group.isin(hit)))
    new = store(repair_frames(frames, touched, late, spec, *aggregates, horizon=horizon))
    (
        new.withColumn(FILE_GROUP, group).repartition(FILE_GROUP)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(FILE_GROUP).parquet(path)
    )
    return hit


def _group_of(keys: Sequence[str], groups: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int")


def _spots(frames: DataFrame, stored: KeyedEvents, late: DataFrame) -> DataFrame:
    """Per key with late rows: the frame hit by the first one and by the last one."""
    keys = list(stored.keys)
    at = F.struct(F.col(stored.ts).alias("ts"), F.col(stored.tie).alias("tie"))
    placed = late.filter(F.col(stored.ts).isNotNull() & has_whole_part(stored.value))
    span = placed.groupBy(*keys).agg(F.min(at).alias("__from"), F.max(at).alias("__to"))
    start = F.struct(F.col("frame_start").alias("ts"), F.col("start_tie").alias("tie"))
    joined = _join(frames, span, keys)
    hits = joined.groupBy(*keys).agg(
        F.max(F.when(start <= F.col("__from"), F.struct(start.alias("at"), "frame_seq"))).alias(
            "__hit"
        ),
        F.coalesce(F.max(F.when(start <= F.col("__to"), F.col("frame_seq"))), F.lit(0)).alias(
            "__last"
        ),
    )
    return _join(span, hits, keys, "left").select(
        *keys,
        F.col("__hit.at").alias("__start"),
        F.coalesce("__hit.frame_seq", F.lit(1)).alias("__seq"),
        F.coalesce("__last", F.lit(0)).alias("__last"),
    )


def _with_horizon(frames: DataFrame, spots: DataFrame, keys: list[str], ahead: int) -> DataFrame:
    """Add the stored frame at which a scan of each key may stop, if there is one."""
    stops = frames.select(
        *keys,
        F.struct(F.col("frame_start").alias("ts"), F.col("start_tie").alias("tie")).alias("__stop"),
        F.col("frame_seq").alias("__stop_seq"),
    )
    stops = _join(stops, spots.select(*keys, "__last"), keys).filter(
        F.col("__stop_seq") == F.col("__last") + ahead
    )
    return _join(spots, stops.drop("__last"), keys, "left")


def _rows_between(
    rows: DataFrame, plan: DataFrame, keys: list[str], ts: str, tie: str
) -> DataFrame:
    at = F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"))
    begun = F.col("__start").isNull() | (at >= F.col("__start"))
    ended = F.col("__stop").isNull() | (at <= F.col("__stop"))
    joined = _join(rows, plan.select(*keys, "__start", "__stop"), keys)
    return joined.filter(begun & ended).select(*rows.columns)


def _agreed(plan: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose scan met a stored frame start, or ran to the key's end."""
    start = F.struct(F.col("frame_start").alias("ts"), F.col("start_tie").alias("tie"))
    counted = _join(fresh, plan, keys, "right").groupBy(*keys).agg(
        F.first("__seq").alias("__seq"),
        F.first("__stop_seq").alias("__stop_seq"),
        F.count("frame_seq").alias("__n"),
        F.max(F.when(start == F.col("__stop"), F.col("frame_seq"))).alias("__met"),
    )
    return counted.filter(F.col("__stop_seq").isNull() | F.col("__met").isNotNull())


def _assemble(
    frames: DataFrame, fresh: DataFrame, agreed: DataFrame, keys: list[str]
) -> DataFrame:
    """Kept frames before, new frames, kept frames after, numbered through."""
    old = _join(frames, agreed, keys)
    before = old.filter(F.col("frame_seq") < F.col("__seq"))
    new = _join(fresh, agreed, keys).filter(
        F.col("__met").isNull() | (F.col("frame_seq") < F.col("__met"))
    )
    new = new.withColumn("frame_seq", F.col("frame_seq") + F.col("__seq") - 1)
    after = old.filter(F.col("frame_seq") >= F.col("__stop_seq")).withColumn(
        "frame_seq", F.col("frame_seq") - F.col("__stop_seq") + F.col("__seq") + F.col("__met") - 1
    )
    return before.unionByName(new).unionByName(after).select(*frames.columns)


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on the keys, null equal to null, keeping one set of key columns."""
    names = {k: f"__r{i}" for i, k in enumerate(keys)}
    renamed = right.withColumnsRenamed(names)
    condition = F.lit(True)
    for key, other in names.items():
        condition = condition & F.col(key).eqNullSafe(F.col(other))
    joined = left.join(renamed, condition, how)
    if how == "right":
        kept = [c for c in left.columns if c not in keys]
        rest = [c for c in right.columns if c not in keys]
        return joined.select(*[F.col(o).alias(k) for k, o in names.items()], *kept, *rest)
    return joined.drop(*names.values())


def _anti(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    names = {k: f"__r{i}" for i, k in enumerate(keys)}
    condition = F.lit(True)
    for key, other in names.items():
        condition = condition & F.col(key).eqNullSafe(F.col(other))
    return left.join(right.select(*keys).withColumnsRenamed(names), condition, "left_anti")
