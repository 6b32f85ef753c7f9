"""Session settings and the shared folder for data that must outlive an executor."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session,
    where driver and executors are one process, may fall back to a temporary
    folder.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by the cluster")
        named = tempfile.mkdtemp(prefix="framewise-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame, keep: bool = False) -> DataFrame:
    """As ``materialize`` for tables that grow with the data: written by column, read back.

    The table stays until an enclosing ``scratch`` ends, or with ``keep`` beyond that.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid4().hex}"
    made = _made.get()
    if made is not None and not keep:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that are stored inside, at the end.

    Results that are still to be computed from them must be written, or stored
    with ``keep``, before that.
    """
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in made:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def use_utc(spark: SparkSession) -> SparkSession:
    """Event times without a zone are read as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
