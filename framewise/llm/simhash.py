"""SimHash near-duplicates through tables of distances to reference fingerprints."""

from __future__ import annotations

from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import blobs, fresh_names, row_key, store
from framewise.llm.graph import components

WORDS = 3  # words of a shingle
SEED = 42
PIVOTS = 16
REACH = 2  # bits in which linked fingerprints may differ
BLOCKS = 4  # of 16 bits; two of them are equal in any linked pair
DENSE = 32  # fingerprints of one candidate group that are paired one by one
MASKS = [(i, j) for i in range(BLOCKS) for j in range(i + 1, BLOCKS)]


def bit_counts(hashes: Any) -> Any:
    """How many of the 64-bit hashes have each bit set."""
    import numpy as np

    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def majority(counts: Any, n: int) -> int:
    """The fingerprint as a signed long: the bits set in over half of ``n`` hashes."""
    import numpy as np

    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, words: int = WORDS, seed: int = SEED) -> Column:
    """64-bit SimHash of a text's word shingles as a long.

    A-Z are lower-cased, words are cut at ASCII white space, shingles count as
    often as they occur. Fewer words than a shingle give one shingle of all of
    them; no word, or a null text, gives zero.
    """

    def run(texts: pa.Array) -> pa.Array:
        from itertools import accumulate

        import numpy as np
        import xxhash

        digest = xxhash.xxh64_intdigest

        def one(blob: bytes | None) -> int:
            tokens = blob.lower().split() if blob else []
            if not tokens:
                return 0
            line = b" ".join(tokens)
            ends = list(accumulate(len(t) + 1 for t in tokens))
            starts = [0, *ends]
            k = min(words, len(tokens))
            counts = np.zeros(64, np.int64)
            n = len(tokens) - k + 1
            for at in range(0, n, 65536):
                stop = min(n, at + 65536)
                hashes = np.fromiter(
                    (digest(line[a : b - 1], seed)
                     for a, b in zip(starts[at:stop], ends[at + k - 1 : stop + k - 1])),
                    np.uint64, stop - at,
                )
                counts += bit_counts(hashes)
            return majority(counts, n)

        return pa.array([one(b) for b in blobs(texts)], pa.int64())

    return F.arrow_udf(run, "long")(text)


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _block(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))


def _pivots(prefix: str, fp: Column, n: int) -> list[Column]:
    """Distances to ``n`` reference fingerprints, which are hashes of 0, 1, 2, ..."""
    return [
        F.bit_count(fp.bitwiseXOR(F.xxhash64(F.lit(i)))).cast("byte").alias(f"{prefix}{i}")
        for i in range(n)
    ]


def equal_blocks(fp: Column) -> Column:
    """Array of (band, key): two of the four blocks, under which equal ones meet."""
    return F.array(*[
        F.struct(
            F.lit(n).cast("byte").alias("band"),
            _block(fp, i).bitwiseOR(F.shiftleft(_block(fp, j), 16)).alias("key"),
        )
        for n, (i, j) in enumerate(MASKS)
    ])


def _pivots_allow(reach: int, pivots: int) -> Column:
    """No coordinate of the pivot tables (p0, ... and q0, ...) differs by more than ``reach``."""
    apart = F.greatest(*[F.abs(F.col(f"p{i}") - F.col(f"q{i}")) for i in range(pivots)])
    return apart <= reach


def _bits_apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def within(pairs: DataFrame, a: str, b: str, reach: int, pivots: int = PIVOTS) -> DataFrame:
    """The pairs whose fingerprints ``a`` and ``b`` differ in ``reach`` bits at most.

    Pairs whose pivot tables rule that out go first, the others are compared bit by bit.
    """
    tables = pairs.select(
        *pairs.columns, *_pivots("p", F.col(a), pivots), *_pivots("q", F.col(b), pivots)
    )
    return (
        tables.filter(_pivots_allow(reach, pivots))
        .filter(_bits_apart(F.col(a), F.col(b)) <= reach)
        .select(*pairs.columns)
    )


def linked_fingerprints(fps: DataFrame, pivots: int = PIVOTS, dense: int = DENSE) -> DataFrame:
    """Links (a, b), a < b, that connect what is within REACH bits, from distinct fingerprints.

    Candidates share two of four 16-bit blocks: two differing bits leave at
    least two blocks untouched. Pairs of a group are discarded when any
    coordinate of their pivot tables (distance to a reference fingerprint)
    differs by more than REACH, which the triangle inequality rules out for
    linked pairs; survivors are verified bit by bit.

    A group of more than ``dense`` fingerprints isn't paired. Each member is
    listed under itself and the 32 fingerprints that differ from it in one bit
    outside the shared blocks. Members at most two bits apart meet under one of
    these, where at most 33 fingerprints can ever meet, and each is linked to
    the smallest there. So not every pair is returned, but every pair within
    REACH stays connected and no group grows with the square of its size.
    """
    keyed = fps.select("fp", F.explode(equal_blocks(F.col("fp"))).alias("x")).select(
        "fp", "x.band", "x.key"
    )
    sizes = store(keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = store(keyed.join(sizes, ["band", "key"]))

    tables = members.filter(F.col("n") <= dense).select(
        "band", "key", "fp", *_pivots("p", F.col("fp"), pivots)
    )
    left = tables.toDF("band", "key", "a", *[f"p{i}" for i in range(pivots)])
    right = tables.toDF("band", "key", "b", *[f"q{i}" for i in range(pivots)])
    pairs = left.join(right, ["band", "key"]).filter("a < b")

    free = [
        [b for b in range(64) if b // 16 not in mask] for mask in MASKS
    ]
    flips = F.element_at(
        F.array(*[
            F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in bits]) for bits in free
        ]),
        F.col("band") + 1,
    )
    near = (
        members.filter(F.col("n") > dense)
        .select("band", "key", "fp", F.explode(flips).alias("flip"))
        .select("band", "key", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    )
    # At most 33 fingerprints share a z within a band, whatever the data.
    heads = near.groupBy("band", "key", "z").agg(
        F.min("fp").alias("a"), F.collect_list("fp").alias("all")
    )
    stars = (
        heads.filter(F.size("all") > 1)
        .select("a", F.explode("all").alias("b"))
        .filter("a <> b")
        .distinct()
        .select("a", "b", *_pivots("p", F.col("a"), pivots), *_pivots("q", F.col("b"), pivots))
    )
    candidates = pairs.drop("band", "key").unionByName(stars)
    survivors = candidates.filter(_pivots_allow(REACH, pivots))
    return survivors.filter(_bits_apart(F.col("a"), F.col("b")) <= REACH).select("a", "b")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pivots: int = PIVOTS,
    dense: int = DENSE,
) -> DataFrame:
    """One row per input row: doc_id, row_key, fp (long), component_id.

    component_id is the smallest id that links reach. Rows of equal fingerprint
    form one class before any link is sought, so copies cost no pairs. Rows
    with a null id take part but never name a component (null if no id is
    known in it); repeated rows each get a row; an empty table gives none.
    """
    prints = store(
        docs.select(
            F.col(id_col).alias("doc_id"),
            row_key(docs).alias("row_key"),
            fingerprint(F.col(text_col)).alias("fp"),
        )
    )
    classes = store(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = store(components(linked_fingerprints(classes.select("fp"), pivots, dense)))
    placed = store(
        classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "least_id", F.coalesce("root", "fp").alias("root")
        )
    )
    least = store(placed.groupBy("root").agg(F.min("least_id").alias("component_id")))
    named = store(placed.join(least, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", "row_key", "fp", "component_id")


def keep_one(docs: DataFrame, **params: Any) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document with the smallest id.

    Equal rows count once. Rows without an id stay only if their component has
    no id at all (then each different text of it stays).
    """
    return keep_least(docs, near_duplicates(docs, **params), params.get("id_col", "doc_id"))


def keep_least(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that name their component in ``found`` (doc_id, row_key, component_id)."""
    key = fresh_names(docs, "key")["key"]
    kept = store(
        found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select("doc_id", "row_key").distinct()
    )
    keyed = docs.withColumn(key, row_key(docs))
    same = (keyed[key] == kept["row_key"]) & keyed[id_col].eqNullSafe(kept["doc_id"])
    return (
        keyed.join(kept, same, "left_semi").dropDuplicates([key, id_col]).select(*docs.columns)
    )
