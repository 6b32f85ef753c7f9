"""Mixing sources to target weights by pivotal rounding of copy probabilities."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.llm.common import fresh_names, row_key, store

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # words of the mix per word of input
MOST = 2.0  # copies a document may have
ROWS_PER_GROUP = 2_000
FAN_IN = 256


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(
    sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """Add the target of each source to (source, source_size).

    Sources in code-point order, null last, take the weights in turn and share
    ``share`` times all words. A target stops at ``most`` times its source's
    size and what is over goes to the others by weight, until none is above.
    Each round is one sum over the sources; only the level comes to the driver.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = store(
        sources.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), turn + 1))
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    )
    total = share * (weighed.agg(F.sum("source_size").alias("n")).first().n or 0)
    level = 0.0
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        row = weighed.agg(
            F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("given"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        rise = (total - row.given) / row.open if row.open else math.inf
        if not rise > level:
            break
        level = rise
        if not math.isfinite(level):
            break
    reach = F.lit(level) * F.col("weight")
    return weighed.select(
        "source", "source_size", F.least(F.col("cap"), reach).alias("target")
    )


def mix(
    docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id",
    weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 42,
    rows_per_group: int = ROWS_PER_GROUP,
) -> DataFrame:
    """Copies of each document: doc_id, row_key, rows, size, source_size, target, copies.

    One row stands for ``rows`` input rows that are equal in every column. Of
    such rows as many as their fractions add up to are rounded up for certain;
    at most one is left to chance, and may have a row of its own here. A document's expected number of copies is
    target / source_size; the whole part is certain, the fraction is rounded
    by the pivotal method. Two documents of a source move mass between each
    other, in words, until one has no fraction left; the direction is random
    with the odds that keep both expectations. Groups of about
    ``rows_per_group`` documents do this side by side and each leaves at most
    one fraction; these meet in groups of FAN_IN, level by level, until one per
    source is left and is drawn. So a source misses its target by less than one
    document. Draws depend on the seed and the rows alone: reruns agree.
    Null texts and texts without words have size 0 and no copies.
    """
    units = store(
        docs.select(
            F.col(id_col).alias("doc_id"), row_key(docs).alias("row_key"),
            F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"),
        ).groupBy("doc_id", "row_key", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    )
    sums = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("units")
    )
    sums = store(sums)
    aims = targets(sums.select("source", "source_size"), weights, share, most)
    aims = aims.join(sums.select("source", "units"), aims.source.eqNullSafe(sums.source)).select(
        aims.source, aims.source_size, "target", "units"
    )
    aims = store(aims.select(
        F.col("source").alias("of_source"), "source_size", "target",
        F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("source_id"),
        F.ceil(F.col("units") / rows_per_group).cast("long").alias("groups"),
    ))
    joined = units.join(aims, units.source.eqNullSafe(aims.of_source)).drop("of_source", "source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ratio = F.when(F.col("size") > 0, ratio).otherwise(0.0)
    opened = joined.withColumn("copies", F.floor(ratio).cast("long")).withColumn(
        "part", ratio - F.floor(ratio)
    ).withColumn("node", F.pmod(F.xxhash64("row_key", F.lit(seed)), F.col("groups")))
    up = F.floor(F.col("part") * F.col("rows")).cast("long")
    rest = F.col("part") * F.col("rows") - up
    one = (rest > 1e-9).cast("long")
    shares = F.array(
        F.struct(up.alias("rows"), (F.col("copies") + 1).alias("copies"), F.lit(0.0).alias("part")),
        F.struct((F.col("rows") - up - one).alias("rows"), "copies", F.lit(0.0).alias("part")),
        F.struct(one.alias("rows"), "copies", rest.alias("part")),
    )
    opened = opened.withColumn("share", F.explode(F.filter(shares, lambda s: s["rows"] > 0)))
    opened = opened.drop("rows", "copies", "part").select("*", "share.*").drop("share")
    schema = opened.select(
        "doc_id", "row_key", "rows", "size", "source_size", "target", "source_id", "copies",
        "part", "node",
    ).schema
    names = schema.fieldNames()

    certain = opened.filter("part <= 0").select(*names)
    step = _rounder(seed)
    level = store(
        opened.filter("part > 0").select(*names).groupBy("source_id", "node").applyInPandas(step, schema)
    )
    width = aims.agg(F.max("groups").alias("n")).first().n or 1
    done = [certain, level.filter("part = 0")]
    while width > 1:
        width = math.ceil(width / FAN_IN)
        level = store(
            level.filter("part > 0")
            .withColumn("node", F.floor(F.col("node") / FAN_IN))
            .groupBy("source_id", "node").applyInPandas(step, schema)
        )
        done.append(level.filter("part = 0"))
    chance = F.pmod(F.xxhash64("row_key", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)
    last = level.filter("part > 0").withColumn(
        "copies", F.col("copies") + F.when(chance < F.col("part"), 1).otherwise(0).cast("long")
    )
    out = last
    for part in done:
        out = out.unionByName(part)
    return out.select("doc_id", "row_key", "rows", "size", "source_size", "target", "copies")


def _rounder(seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rows = rows.sort_values("row_key", kind="stable", ignore_index=True)
        rng = np.random.default_rng(
            [seed, int(rows.source_id[0]) & (2**63 - 1), int(rows.node[0]), len(rows)]
        )
        draws = rng.random(len(rows)).tolist()
        mass = (rows["size"] * rows["rows"]).astype(float).tolist()
        part = rows["part"].tolist()
        up = [0] * len(rows)
        held = 0  # the one that still has a fraction
        for j in range(1, len(rows)):
            i = held
            scale = mass[j] / mass[i]
            rise = min(1 - part[i], part[j] * scale)  # i up, j down
            fall = min(part[i], (1 - part[j]) * scale)  # i down, j up
            move = rise if draws[j] * (rise + fall) < fall else -fall
            part[i] += move
            part[j] -= move / scale
            for k in (i, j):
                if part[k] < 1e-9:
                    part[k] = 0.0
                elif part[k] > 1 - 1e-9:
                    part[k], up[k] = 0.0, up[k] + 1
            held = j if part[i] == 0.0 else i
        rows["part"] = part
        rows["copies"] += up
        return rows

    return run


def mixed(docs: DataFrame, id_col: str = "doc_id", **params: object) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as its copies.

    Rows equal in every column are written out from one of them, as often as all
    of them together.
    """
    names = ("key", "copy", "of_id", "of_key", "rows", "taken")
    key, copy, of_id, of_key, rows, taken = fresh_names(docs, *names).values()
    plan = store(
        mix(docs, id_col=id_col, **params)
        .groupBy(F.col("doc_id").alias(of_id), F.col("row_key").alias(of_key))
        .agg(F.sum("rows").alias(rows), F.sum(F.col("rows") * F.col("copies")).alias(taken))
        .filter(F.col(taken) > 0)
    )
    keyed = docs.withColumn(key, row_key(docs))

    def written(chosen: DataFrame, units: DataFrame) -> DataFrame:
        same = (F.col(key) == F.col(of_key)) & F.col(id_col).eqNullSafe(F.col(of_id))
        times = F.sequence(F.lit(1).cast("long"), F.col(taken).cast("long"))
        return (
            chosen.join(units, same).withColumn(copy, F.explode(times)).select(*docs.columns)
        )

    single, repeated = plan.filter(F.col(rows) == 1), plan.filter(F.col(rows) > 1)
    out = written(keyed, single)
    if not repeated.isEmpty():
        wanted = repeated.select(F.col(of_key).alias(copy))
        first = keyed.join(wanted, F.col(key) == F.col(copy), "left_semi").dropDuplicates([key, id_col])
        out = out.unionByName(written(first, repeated))
    return out
