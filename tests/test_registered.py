"""Every registered query against its SQL, on the smallest data."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, rows_of

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no driver data")

LARGE_KEY_PLANS = ["frame_threshold", "frame_delta", "frame_custom", "coalesce_frames",
                   "split_frames", "events_in_frames", "sort_by_arrival", "metric_quartiles"]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def agree(spark, db, name):
    df = queries()[name](spark, SF)
    relation = db.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(relation.columns)
    got, want = rows_of(df.columns, df.collect()), rows_of(relation.columns, relation.fetchall())
    assert want and got == want


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, db, name):
    agree(spark, db, name)


@pytest.mark.parametrize("name", LARGE_KEY_PLANS)
def test_large_key_plan_equals_the_sql(spark, db, name):
    spark.conf.set("spark.framewise.maxRowsPerChunk", "20")
    try:
        agree(spark, db, name)
    finally:
        spark.conf.unset("spark.framewise.maxRowsPerChunk")


def test_entry_and_registration(spark):
    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())
