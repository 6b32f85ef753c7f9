"""Connected components of links that Spark holds, in a few joins per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import store


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the component's smallest node.

    Alternates two steps until the links are stars around their roots: every
    node hands its larger neighbours, then its smaller ones, to its smallest
    neighbour. Minima are combined before each shuffle, and the joins are
    between stored tables, so that a node with very many links is split by the
    skew join. Each step is a written table: a lost executor costs no round.
    Null ends and loops are ignored; no links give no rows.
    """
    edges = store(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    seen = _signature(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = store(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = store(
            both.join(low, "u")
            .filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        low = store(large.groupBy("u").agg(F.min("v").alias("m")))
        handed = large.join(low, "u").filter(F.col("v") != F.col("m"))
        edges = store(
            handed.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.withColumnRenamed("m", "v"))
            .distinct()
        )
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")
    ).first()
    return row.n, row.h
