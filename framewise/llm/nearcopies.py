"""Near copies: SimHash prints with pivot tables select pairs, exact Jaccard similarity decides.

The prints are those of ``simhash`` over sets of word shingles. At a similarity of
0.8 two of them differ in about ten of 64 bits, so that most such pairs share no two
blocks; bands of hash minima stand beside the blocks to find these as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import blobs, row_key, store
from framewise.llm.graph import components
from framewise.llm.simhash import PIVOTS, bit_counts, equal_blocks, keep_least, majority, within

WORDS = 5  # words of a shingle
SIMILARITY = 0.8  # Jaccard similarity of linked documents, at least
SEED = 42
# Bits in which the prints of similar sets may differ. By the binomial law a pair of
# similarity 0.8 is beyond that once in 14 million (4 shingles of 5), larger sets more rarely.
REACH = 30
BANDS = 32  # a pair of similarity 0.8 shares no band once in 20 million times
ROWS = 4  # hash minima of a band
DENSE = 4  # classes of one bucket that are paired one by one
SPREAD = 64  # tasks over which the pairs of one class are spread


def shingle_set(blob: bytes | None, words: int, seed: int = SEED) -> Any:
    """The distinct shingles of a text as a sorted array of 64-bit hashes.

    A-Z are lower-cased, words are cut at ASCII white space. Fewer words than a
    shingle give one shingle of all of them, no word gives none.
    """
    import numpy as np
    import xxhash

    tokens = blob.lower().split() if blob else []
    k = min(words, len(tokens))
    if not k:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(t, seed) for t in tokens), np.uint64, len(tokens)
    )
    n = len(tokens) - k + 1
    mixed = np.full(n, k, np.uint64)
    for i in range(k):
        mixed = (mixed ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed * np.uint64(0xBF58476D1CE4E5B9))


def signature(text: Column, words: int, bands: int, rows: int, seed: int = SEED) -> Column:
    """Struct of class (hash of the shingle set), size of the set, print, and a bucket key per band."""

    def run(texts: pa.Array) -> pa.Array:
        import numpy as np
        import xxhash

        draw = np.random.default_rng(seed)
        factors = draw.integers(0, 1 << 32, (bands * rows, 1), np.uint32) | np.uint32(1)
        shifts = draw.integers(0, 1 << 32, (bands * rows, 1), np.uint32)
        classes, sizes, prints, keys = [], [], [], []
        for blob in blobs(texts):
            found = shingle_set(blob, words, seed)
            classes.append(xxhash.xxh64_intdigest(found.tobytes(), seed) - (1 << 63))
            sizes.append(len(found))
            counts = np.zeros(64, np.int64)
            for at in range(0, len(found), 65536):
                counts += bit_counts(found[at : at + 65536])
            prints.append(majority(counts, len(found)))
            if not len(found):
                keys.append([])
                continue
            short = (found >> np.uint64(32)).astype(np.uint32)
            least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
            for at in range(0, len(short), 2048):
                part = factors * short[at : at + 2048] + shifts
                np.minimum(least, part.min(axis=1), out=least)
            keys.append([
                xxhash.xxh64_intdigest(band.tobytes(), i) - (1 << 63)
                for i, band in enumerate(least.reshape(bands, rows))
            ])
        return pa.StructArray.from_arrays(
            [pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()),
             pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
            ["cls", "n", "fp", "keys"],
        )

    return F.arrow_udf(run, "struct<cls: long, n: long, fp: long, keys: array<long>>")(text)


def _packed_set(text: Column, words: int) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(b, words).tobytes() for b in blobs(texts)], pa.binary())

    return F.arrow_udf(run, "binary")(text)


def _jaccard(a: Column, b: Column) -> Column:
    def run(lefts: pa.Array, rights: pa.Array) -> pa.Array:
        import numpy as np

        found = []
        for x, y in zip(lefts.to_pylist(), rights.to_pylist()):
            one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shared = len(np.intersect1d(one, two, assume_unique=True))
            found.append(shared / (len(one) + len(two) - shared))
        return pa.array(found, pa.float64())

    return F.arrow_udf(run, "double")(a, b)


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the similarity.

    The set of a class goes once to each of at most SPREAD parts of its pairs,
    so that a class with very many pairs is not the work of one task.
    """
    parted = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(SPREAD)))
    heads = parted.select("a", "part").distinct().join(
        sets.select(F.col("cls").alias("a"), F.col("set").alias("one")), "a"
    )
    others = parted.join(sets.select(F.col("cls").alias("b"), F.col("set").alias("two")), "b")
    return (
        others.join(heads, ["a", "part"])
        .filter(_jaccard(F.col("one"), F.col("two")) >= similarity)
        .select("a", "b")
    )


def _shared_prefixes(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(cls, n, fp, root, odd, at, shingle): the shingles by which ``members`` (cls, n, fp, root, odd) meet.

    A set of n shingles that is similar to another one has at least
    similarity * n of its shingles in common with it. So both have one in
    common among their first n - ceil(similarity * n) + 1 shingles, in any
    order that is the same for all sets; here the rarest come first. Shingles of
    one member alone use up places of a prefix but meet nothing. ``at`` is a
    shingle's place in that order: only the n - at shingles from there on can
    be shared by two sets whose first shared one this is.
    """

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            held = [np.frombuffer(b, np.int64) for b in batch.column("set").to_pylist()]
            cls = np.repeat(batch.column("cls").to_numpy(), [len(x) for x in held])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cls), pa.array(np.concatenate(held) if held else cls)], ["cls", "shingle"]
            )

    posted = store(
        sets.join(members.select("cls"), "cls").select("cls", "set")
        .mapInArrow(flat, "cls long, shingle long")
    )
    often = store(
        posted.groupBy("shingle").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    )
    ranked = posted.join(often, "shingle").groupBy("cls").agg(
        F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("shared")
    )
    wanted = F.expr(f"n - CAST(ceil({similarity!r}D * n - 1e-9D) AS INT) + 1 - (n - size(shared))")
    return (
        members.join(ranked, "cls").withColumn("wanted", wanted.cast("int"))
        .filter("wanted > 0")
        .withColumn("alone", F.expr("n - size(shared)"))
        .select("cls", "n", "fp", "root", "odd", "alone",
                F.posexplode(F.expr("slice(shared, 1, wanted).shingle")).alias("at", "shingle"))
        .withColumn("at", F.col("alone") + F.col("at")).drop("alone")
    )


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
    similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, dense: int = DENSE,
    reach: int = REACH, pivots: int = PIVOTS,
) -> DataFrame:
    """One row per input row: doc_id, row_key, component_id.

    Documents are linked if the Jaccard similarity of their sets of shingles is
    ``similarity`` or more; component_id is the smallest id that links reach.
    Equal sets form one class before any link is sought. Classes that share a
    bucket (two blocks of the SimHash print, or a band of hash minima) are
    candidates. Of these, pairs go whose prints differ in more than ``reach``
    bits: first those for which the distances to ``pivots`` reference prints
    show it, then the others bit by bit. Whole sets decide about the rest.

    In a bucket of more than ``dense`` classes all are compared with its head,
    the class that the most crowded buckets hold, which is the one most like
    all others. Where this leaves several components in a bucket, the classes
    outside its largest are joined with the members of all such buckets by the
    rarest shingles of both (``_shared_prefixes``). That finds every similar
    pair, and nothing for texts that have only a passage in common, so no
    bucket's members are paired with each other.

    Null ids take part but never name a component; texts without words are one
    class, not linked with others; an empty table gives no rows.
    """
    prints = store(
        docs.select(
            F.col(id_col).alias("doc_id"),
            row_key(docs).alias("row_key"),
            signature(F.col(text_col), words, bands, rows).alias("s"),
        ).select("doc_id", "row_key", "s.*")
    )
    classes = store(prints.groupBy("cls").agg(
        F.min("doc_id").alias("least_id"), F.min("row_key").alias("rep"),
        F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"),
    ))
    blocks = F.transform(equal_blocks(F.col("fp")), lambda x: F.xxhash64(x["band"], x["key"]))
    keyed = classes.filter("n > 0").select(
        "cls", "n", "fp", F.explode(F.concat("keys", blocks)).alias("key")
    )
    buckets = store(
        keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    )
    members = store(keyed.join(buckets, "key"))

    def sized(pairs: DataFrame) -> DataFrame:
        """Distinct pairs whose sizes and prints allow the similarity."""
        fits = F.least("m", "n") >= similarity * F.greatest("m", "n") - 1e-9
        return within(pairs.filter(fits), "fp_a", "fp_b", reach, pivots).select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        ).distinct()

    small = members.filter(F.col("members") <= dense)
    every = small.select(
        "key", F.col("cls").alias("a"), F.col("n").alias("m"), F.col("fp").alias("fp_a")
    ).join(
        small.select("key", F.col("cls").alias("b"), "n", F.col("fp").alias("fp_b")), "key"
    ).filter("a < b")
    large = members.filter(F.col("members") > dense)
    crowds = large.groupBy("cls").agg(F.sum("members").alias("crowd"))
    large = store(large.join(crowds, "cls").select("key", "cls", "n", "fp", "crowd"))
    heads = large.groupBy("key").agg(F.max(F.struct("crowd", "cls", "n", "fp")).alias("head"))
    stars = large.join(heads, "key").select(
        "key", F.col("head.cls").alias("a"), F.col("head.n").alias("m"),
        F.col("head.fp").alias("fp_a"), F.col("cls").alias("b"), "n", F.col("fp").alias("fp_b"),
    ).filter("a <> b")
    pairs = store(sized(every.unionByName(stars)))

    wanted = members.select("cls").distinct().join(classes, "cls").select("cls", "rep")
    texts = docs.select(F.col(text_col).alias("text"), row_key(docs).alias("rep"))
    sets = store(
        texts.join(wanted, "rep").dropDuplicates(["cls"])
        .select("cls", _packed_set(F.col("text"), words).alias("set"))
    )
    links = store(_alike(pairs, sets, similarity))
    roots = store(components(links))

    # What the heads of large buckets did not join.
    placed = store(
        large.select("key", "cls", "n", "fp")
        .join(roots.withColumnRenamed("node", "cls"), "cls", "left")
        .withColumn("root", F.coalesce("root", "cls"))
    )
    shares = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("held"))
    main = store(
        shares.groupBy("key")
        .agg(F.max(F.struct("held", "root")).alias("top"), F.count(F.lit(1)).alias("roots"))
        .filter("roots > 1")
        .select("key", F.col("top.root").alias("main"))
    )
    if not main.isEmpty():
        split = store(
            placed.join(main, "key").groupBy("cls", "n", "fp", "root")
            .agg(F.bool_or(F.col("root") != F.col("main")).alias("odd"))
        )
        posted = store(_shared_prefixes(split, sets, similarity))
        one = posted.filter("odd").select(
            "shingle", F.col("cls").alias("a"), F.col("n").alias("m"), F.col("root").alias("from"),
            F.col("at").alias("at_a"), F.col("fp").alias("fp_a"),
        )
        # The most that two sets can share, against what the similarity asks of their sizes.
        most = F.least(F.col("m") - F.col("at_a"), F.col("n") - F.col("at"))
        least = similarity / (1 + similarity) * (F.col("m") + F.col("n")) - 1e-9
        across = one.join(
            posted.select("shingle", F.col("cls").alias("b"), "n", "root", "at", F.col("fp").alias("fp_b")),
            "shingle",
        ).filter((F.col("from") != F.col("root")) & (most >= least))
        more = store(_alike(store(sized(across)), sets, similarity))
        roots = store(components(links.unionByName(more)))

    named = store(
        classes.select("cls", "least_id").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
        .select("cls", "least_id", F.coalesce("root", "cls").alias("root"))
    )
    least = store(named.groupBy("root").agg(F.min("least_id").alias("component_id")))
    found = store(named.join(least, "root").select("cls", "component_id"))
    return prints.join(found, "cls").select("doc_id", "row_key", "component_id")


def keep_one(docs: DataFrame, **params: Any) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near copies that with the smallest id."""
    return keep_least(docs, near_copies(docs, **params), params.get("id_col", "doc_id"))
