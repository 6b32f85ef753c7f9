"""Shards of a corpus by jump consistent hashing: written in order, numbered without gaps, read back."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from framewise.llm.common import fresh_names, row_id, store
from framewise.session import shared_dir

PIECE_BYTES = 256 << 20  # of text in one piece of a shard
LEAST_PIECES = 16  # of a shard, so that small tables use several tasks as well
OFTEN = 4096  # equal rows beyond which they travel as one
FEW = 65_536  # at most so many different rows do
CHUNK = 1024  # copies that are written out together


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, from 0, of a 64-bit key: no table, only the key and the number of shards.

    With one more shard a key stays where it is or goes to the new shard, and
    one in (shards + 1) keys goes. A null key is an error of the caller.
    """

    def run(keys: pa.Array) -> pa.Array:
        import numpy as np

        state = keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).copy()
        found = np.zeros(len(state), np.int64)
        jump = np.zeros(len(state), np.int64)
        moving = np.arange(len(state)) if shards > 1 else np.zeros(0, np.int64)
        while len(moving):
            found[moving] = jump[moving]
            # One step of the 64-bit linear congruential generator that the method fixes.
            state[moving] = state[moving] * np.uint64(2862933555777941757) + np.uint64(1)
            draw = (state[moving] >> np.uint64(33)).astype(np.float64) + 1.0
            jump[moving] = ((found[moving] + 1) * (2147483648.0 / draw)).astype(np.int64)
            moving = moving[jump[moving] < shards]
        return pa.array(found, pa.int32())

    if shards < 1:
        raise ValueError("shards must be at least 1")
    return F.arrow_udf(run, "int")(key)


def stable_key(*columns: Column) -> Column:
    """A 64-bit key of values, the same for whole numbers of any width and on every run."""
    return F.xxhash64(*[F.coalesce(c.cast("string"), F.lit("\0null")) for c in columns])


def added_names(docs: DataFrame) -> dict[str, str]:
    """Names of the added columns; a name that the table has gets underscores until it is new."""
    return fresh_names(docs, "shard", "slot", "grown_shard")


def place(
    docs: DataFrame, shards: int, keys: Sequence[str] = ("doc_id",), text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` with shard, slot and grown_shard (see ``added_names``).

    ``keys`` and the number of shards decide a row's shard, so equal keys share
    one; grown_shard is that with one more shard. Keys that are the text put
    equal texts together. Slots number the rows of a shard from 0 without a
    gap; they depend on the rows alone, not on files or tasks. Null keys share
    a shard, repeated rows have a slot each, an empty table gives no rows.

    The rows cross the network once. A shard is cut into pieces by a hash of
    the whole row, so neither a large shard nor a key with a third of all rows
    is the work of one task; pieces grow in number with the bytes. Where a
    piece starts is a running sum over one row per piece. Rows equal in every
    column are counted first; those that recur more often than OFTEN, and than
    one in FEW of all rows, travel as one row and are multiplied in chunks.
    """
    added = added_names(docs)
    inner = fresh_names(docs, *added, "id", "key", "copies", "start", "piece", "held", "n")
    id_, key, copies, start, piece, held, n = list(inner.values())[len(added) :]
    shard, slot, grown = added.values()
    hashed = docs.select(
        "*", row_id(docs).alias(id_), stable_key(*[docs[c] for c in keys]).alias(key)
    )
    counted = store(
        hashed.select(id_, key, F.octet_length(docs[text_col]).alias(n))
        .groupBy(id_, key).agg(F.count(F.lit(1)).alias(copies), F.sum(n).alias(n))
    )
    total = counted.agg(F.sum(copies).alias("rows"), F.sum(n).alias("bytes")).first()
    rows, size = total["rows"] or 0, total["bytes"] or 0
    pieces = max(LEAST_PIECES, -(-size // (shards * PIECE_BYTES)))
    often = F.col(copies) > max(OFTEN, rows // FEW)
    # Fewer than FEW different rows can each be a FEW-th of all.
    hot = F.broadcast(counted.filter(often).select(id_, copies))
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1, F.lit(CHUNK)))

    def dealt(df: DataFrame) -> DataFrame:
        """Adds the piece of a row or chunk and the shard of its key."""
        return df.withColumn(
            piece, F.pmod(F.xxhash64(f"{id_}.a", f"{id_}.b", start), F.lit(pieces)).cast("int")
        ).withColumn(shard, jump_hash(F.col(key), shards))

    first = F.lit(0).cast("long").alias(start)
    sizes = dealt(
        counted.filter(~often).select(id_, key, first, F.col(copies).alias(n)).unionByName(
            counted.filter(often).select(id_, key, copies, chunks.alias(start)).select(
                id_, key, start, F.least(F.lit(CHUNK), F.col(copies) - F.col(start)).alias(n)
            )
        )
    ).groupBy(shard, piece).agg(F.sum(n).alias(n))
    ahead = F.sum(n).over(Window.partitionBy(shard).orderBy(piece)) - F.col(n)
    starts = store(sizes.select(shard, piece, ahead.alias(n)))

    single = hashed.join(hot, id_, "left_anti").select("*", first)
    many = (
        hashed.join(hot.select(id_), id_, "left_semi")
        .groupBy(id_, key).agg(F.first(F.struct(*docs.columns)).alias(held))
        .join(hot, id_)
        .select(id_, key, copies, held, chunks.alias(start))
        .repartition(id_, start)
        .withColumn(copies, F.explode(F.sequence(
            F.lit(1).cast("long"), F.least(F.lit(CHUNK), F.col(copies) - F.col(start)))))
        .select(*[F.col(held)[c].alias(c) for c in docs.columns], id_, key, start)
    )
    in_piece = Window.partitionBy(shard, piece).orderBy(key, f"{id_}.a", f"{id_}.b", start)
    return (
        dealt(single.unionByName(many))
        .withColumn(grown, jump_hash(F.col(key), shards + 1))
        .withColumn(held, F.row_number().over(in_piece) - 1)
        .join(starts, [shard, piece])
        .select(*docs.columns, shard, (F.col(n) + F.col(held)).alias(slot), grown)
    )


def write(placed: DataFrame, path: str, shard: str = "shard") -> DataFrame:
    """Write the rows of ``place`` as one folder per shard, and read them back."""
    placed.write.partitionBy(shard).parquet(path)
    # The reader puts the folder's column last.
    files = StructType([f for f in placed.schema if f.name != shard] + [placed.schema[shard]])
    return placed.sparkSession.read.schema(files).parquet(path).select(*placed.columns)


def shard_table(
    docs: DataFrame, shards: int, keys: Sequence[str] = ("doc_id",), text_col: str = "text"
) -> DataFrame:
    """``place``, written to the cluster's shared folder and read back from the shards."""
    path = f"{shared_dir(docs.sparkSession)}/shards-{uuid4().hex}"
    return write(place(docs, shards, keys, text_col), path, added_names(docs)["shard"])
