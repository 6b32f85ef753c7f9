"""Nearest neighbours by inner product: a forest of random-projection trees, exact rerank."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewise.llm.common import Batches, store
from framewise.llm.vectors import matrix, one_width, sample, usable

SAMPLE_ROWS = 16_384
TREES = 16
LEAF_SAMPLE = 8  # fitted vectors per leaf at least
LEAF_ROWS = 256  # rows per leaf at most, as long as the sample allows
# Rows that a query's leaves hold together, as a share of all rows; a row counts in each tree.
# Isotropic vectors need this much for a recall of 0.95; clustered ones are found with far less.
BUDGET = 1.0
LEAST_BUDGET = 4_000
CHUNK = 32_768


@dataclass
class Forest:
    """Complete binary trees: node n has children 2n+1 and 2n+2; leaves are numbered from 0."""

    directions: np.ndarray  # trees x inner nodes x width
    cuts: np.ndarray  # trees x inner nodes
    depth: int
    top: float  # largest norm: the extra coordinate turns inner products into distances

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top**2 - (vectors**2).sum(axis=1), 0.0))
        return np.hstack([vectors, rest[:, None]])

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """rows x trees: the leaf that each vector belongs to."""
        lifted = self.lift(vectors)
        out = np.empty((len(vectors), len(self.cuts)), np.int64)
        for t in range(len(self.cuts)):
            node = np.zeros(len(vectors), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", lifted, self.directions[t, node]) >= self.cuts[t, node]
                node = 2 * node + 1 + side
            out[:, t] = node - (2**self.depth - 1)
        return out


def grow(vectors: np.ndarray, top: float, depth: int, trees: int, seed: int = 42) -> Forest:
    """Trees on a sample; each node cuts at the median along the difference of two of its vectors."""
    rng = np.random.default_rng(seed)
    nodes = 2**depth - 1
    forest = Forest(np.zeros((trees, nodes, vectors.shape[1] + 1)), np.zeros((trees, nodes)), depth, top)
    lifted = forest.lift(vectors)
    for t in range(trees):
        held = {0: np.arange(len(lifted))}
        for node in range(nodes):
            mine = held.pop(node)
            way = rng.standard_normal(lifted.shape[1])
            if len(mine) > 1:
                a, b = rng.choice(mine, 2, replace=False)
                if (lifted[a] != lifted[b]).any():
                    way = lifted[a] - lifted[b]
            way = way / np.linalg.norm(way)
            along = lifted[mine] @ way
            cut = float(np.median(along)) if len(mine) else 0.0
            forest.directions[t, node], forest.cuts[t, node] = way, cut
            held[2 * node + 1], held[2 * node + 2] = mine[along < cut], mine[along >= cut]
    return forest


def probe(forest: Forest, query: np.ndarray, sizes: np.ndarray, budget: float) -> list[tuple[int, int]]:
    """(tree, leaf) pairs in the order of one queue over all trees, until they hold ``budget`` rows.

    The queue is ordered by how far the query lies on the wrong side of the
    cuts on the way; a leaf on the right side of all has distance 0.
    """
    import heapq

    lifted = np.append(query, 0.0)
    sides = forest.directions @ lifted - forest.cuts  # trees x nodes
    first_leaf = 2**forest.depth - 1
    queue = [(0.0, t, 0) for t in range(len(forest.cuts))]
    out, held = [], 0
    while queue and held < budget:
        wrong, t, node = heapq.heappop(queue)
        if node >= first_leaf:
            leaf = node - first_leaf
            out.append((t, leaf))
            held += sizes[t, leaf]
            continue
        side = sides[t, node]
        near, far = (2 * node + 2, 2 * node + 1) if side >= 0 else (2 * node + 1, 2 * node + 2)
        heapq.heappush(queue, (wrong, t, near))
        heapq.heappush(queue, (max(wrong, abs(side)), t, far))
    return out


def search(
    df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id",
    vector_col: str = "embedding", trees: int = TREES, leaf_rows: int = LEAF_ROWS,
    budget: float = BUDGET, least_budget: int = LEAST_BUDGET, sample_rows: int = SAMPLE_ROWS,
    chunk: int = CHUNK, seed: int = 42,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for each query.

    The trees are fitted on at most ``sample_rows`` vectors; every row of ``df``
    is indexed in every tree. A query takes leaves from all trees through one
    queue until they hold ``budget`` of the rows (``least_budget`` at least);
    all rows of these leaves are scored with the original vectors in double
    precision, ties to the smaller id. A row is never its query's own
    neighbour: rows with the query's id are left out. Unusable vectors (null,
    empty, zero, null or non-finite numbers) and null ids take no part, as
    queries or as candidates. Queries with fewer candidates get fewer rows.
    Neighbouring leaves of a tree make up groups of about ``chunk`` rows (a leaf
    with more is split by a hash); a group is scored against the queries that
    ask for leaves of it in its own task, and each keeps its k best of it.
    """
    empty = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def usable_rows(frame: DataFrame) -> DataFrame:
        return frame.select(
            F.col(id_col).cast("long").alias("vec_id"),
            F.col(vector_col).alias("vector"),
        ).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))

    rows, asked = usable_rows(df), usable_rows(queries)
    if one_width(rows, "vector") is None:
        return empty
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(square)).alias("top")).first()
    fitted = sample(rows, "vec_id", "vector", sample_rows)
    depth = max(0, min(
        math.floor(math.log2(max(1, len(fitted) / LEAF_SAMPLE))),
        math.ceil(math.log2(max(1, total.n / leaf_rows))),
    ))
    forest = grow(fitted, total.top, depth, trees, seed)
    # Planes of at most sample_rows / LEAF_SAMPLE nodes per tree, whatever the table's size.
    known = df.sparkSession.sparkContext.broadcast(forest)

    def place(column: pa.Array) -> pa.Array:
        found = known.value.leaves(matrix(column)) if len(column) else np.zeros((0, trees), int)
        offsets = np.arange(len(column) + 1, dtype=np.int32) * trees
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel().astype(np.int32)))

    placed = store(
        rows.withColumn("leaves", F.arrow_udf(place, "array<int>")("vector"))
        .select("vec_id", "vector", F.posexplode("leaves").alias("tree", "leaf"))
    )
    counts = placed.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n"))
    sizes = np.zeros((trees, 2**depth), np.int64)
    for row in counts.toLocalIterator():  # one number per leaf
        sizes[row.tree, row.leaf] = row.n
    wanted = max(least_budget, budget * total.n) * 1.0
    parts = np.maximum(1, -(-sizes // chunk))
    group = (np.cumsum(sizes, axis=1) - sizes) // chunk
    sized = df.sparkSession.sparkContext.broadcast((sizes, group, parts))

    def ask(batches: Batches) -> Batches:
        sizes, group, parts = sized.value
        for batch in batches:
            vectors = matrix(batch["vector"])
            at, where, leaves = [], [], []
            for q in range(len(vectors)):
                wants: dict[tuple[int, int, int], list[int]] = {}
                for t, leaf in probe(known.value, vectors[q], sizes, wanted):
                    for part in range(parts[t, leaf]):
                        wants.setdefault((t, int(group[t, leaf]), part), []).append(leaf)
                at += [q] * len(wants)
                where += wants.keys()
                leaves += wants.values()
            if at:
                tree, of, part = (pa.array(c, pa.int32()) for c in zip(*where))
                pick = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [batch["vec_id"].take(pick), batch["vector"].take(pick),
                     pa.array(leaves, pa.list_(pa.int32())), tree, of, part],
                    ["query_id", "query", "leaves", "q_tree", "q_group", "q_part"],
                )

    vector_type = asked.schema["vector"].dataType.simpleString()
    probes = asked.mapInArrow(
        ask, f"query_id long, query {vector_type}, leaves array<int>, q_tree int, q_group int, "
        "q_part int"
    )

    def spot(tree: pa.Array, leaf: pa.Array, mixed: pa.Array) -> pa.Array:
        _, group, parts = sized.value
        t, v = np.asarray(tree), np.asarray(leaf)
        return pa.StructArray.from_arrays(
            [pa.array(group[t, v].astype(np.int32)),
             pa.array((np.asarray(mixed) % parts[t, v]).astype(np.int32))], ["group", "part"]
        )

    spots = F.arrow_udf(spot, "struct<group: int, part: int>")("tree", "leaf", F.xxhash64("vec_id"))
    grouped = placed.withColumn("spot", spots).select(
        "vec_id", "vector", "tree", "leaf", "spot.group", "spot.part"
    )
    scored = (
        grouped.groupBy("tree", "group", "part")
        .cogroup(probes.groupBy("q_tree", "q_group", "q_part"))
        .applyInArrow(_best(k), "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _best(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if rows.num_rows and queries.num_rows:
            vectors, ids = matrix(rows["vector"]), rows["vec_id"].to_numpy()
            asked, names = matrix(queries["query"]), queries["query_id"].to_numpy()
            leaf = rows["leaf"].to_numpy()
            lists = queries["leaves"].to_pylist()
            for begin in range(0, len(asked), 64):
                some, known = asked[begin : begin + 64], names[begin : begin + 64]
                wanted = np.zeros((len(some), int(leaf.max()) + 1), bool)
                for q, mine in enumerate(lists[begin : begin + 64]):
                    wanted[q, [x for x in mine if x < wanted.shape[1]]] = True
                rough = some @ vectors.T
                rough[~wanted[:, leaf]] = -np.inf
                rough[known[:, None] == ids[None, :]] = -np.inf
                width = min(k + 8, len(ids))
                top = np.argpartition(-rough, width - 1, axis=1)[:, :width]
                value = np.sort(np.take_along_axis(rough, top, axis=1), axis=1)[:, ::-1]
                # Rounding of the product must not cut off a tie with the k-th.
                slack = 1e-9 * np.maximum(1.0, np.abs(value[:, 0]))
                least = value[:, min(k, width) - 1]
                tied = (width < len(ids)) & ~np.isneginf(least) & (value[:, -1] >= least - slack)
                exact = (vectors[top] * some[:, None, :]).sum(axis=2)
                exact[np.isneginf(np.take_along_axis(rough, top, axis=1))] = -np.inf
                order = np.lexsort((ids[top], -exact), axis=1)[:, :k]
                found = np.take_along_axis(exact, order, axis=1)
                names_of = np.take_along_axis(ids[top], order, axis=1)
                good = ~np.isneginf(found) & ~tied[:, None]
                owner = np.broadcast_to(known[:, None], found.shape)
                parts.append((owner[good], names_of[good], found[good]))
                for q in np.flatnonzero(tied):
                    mine = np.flatnonzero(rough[q] >= least[q] - slack[q])
                    score = (vectors[mine] * some[q]).sum(axis=1)
                    best = np.lexsort((ids[mine], -score))[:k]
                    parts.append((np.full(len(best), known[q]), ids[mine][best], score[best]))
        query, vec, score = (
            map(np.concatenate, zip(*parts)) if parts else (np.array([], int),) * 2 + (np.array([]),)
        )
        return pa.table([pa.array(query, pa.int64()), pa.array(vec, pa.int64()),
                         pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])

    return run
