"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from framewise.session import store

__all__ = [
    "blobs", "buckets_for", "fresh_names", "pack", "read", "row_id", "row_key", "store", "unpack",
]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def blobs(texts: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a text column, without decoding it."""
    return texts.cast(pa.binary()).to_pylist()


def _parts(df: DataFrame) -> list[Column]:
    """What tells rows apart: each column as text, and whether it is null (hashes skip nulls)."""
    parts = []
    for field in df.schema:
        column = df[field.name]
        if isinstance(field.dataType, (ArrayType, MapType, StructType)):
            shown = F.to_json(F.struct(column), {"ignoreNullFields": "false"})
        else:
            shown = column.cast("string")
        parts += [shown, column.isNull()]
    return parts


def row_key(df: DataFrame) -> Column:
    """Hash of a whole row: rows that are equal in every column share it.

    64 bits are no proof of equality: whoever drops rows by it goes by the id as well.
    """
    return F.xxhash64(*_parts(df))


def row_id(df: DataFrame) -> Column:
    """As ``row_key`` in 128 bits, a struct of two longs, where no id tells rows apart."""
    return F.struct(
        F.xxhash64(*_parts(df)).alias("a"), F.xxhash64(F.lit("again"), *_parts(df)).alias("b")
    )


def fresh_names(df: DataFrame, *wanted: str) -> dict[str, str]:
    """Names for added columns: the wanted ones, with underscores behind where the table has them."""
    taken = {c.lower() for c in df.columns}
    names = {}
    for name in wanted:
        free = name
        while free.lower() in taken:
            free += "_"
        names[name] = free
        taken.add(free.lower())
    return names


def pack(text: Column) -> Column:
    """Texts travel through a shuffle in compressed form (null stays null)."""

    def run(texts: pa.Array) -> pa.Array:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        return pa.array([None if b is None else squeeze(b) for b in blobs(texts)], pa.binary())

    return F.arrow_udf(run, "binary")(text)


def unpack() -> Callable[[bytes | None], bytes | None]:
    """The way back from ``pack``, for use inside a task."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    return lambda packed: None if packed is None else expand(packed)


def buckets_for(df: DataFrame, text: str, bucket_bytes: int) -> int:
    """How many buckets of about ``bucket_bytes`` of text the table needs."""
    total = df.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0
    return int(total // bucket_bytes) + 1


Batches = Iterator[pa.RecordBatch]
