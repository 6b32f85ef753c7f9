"""The pipeline's stages and the registration of the queries."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import queries
from framewise.llm.common import read, store
from framewise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no driver data")


def test_stages_keep_the_columns_and_clean_documents(spark):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, store(stage(spark, docs, SF))
        assert docs.columns == columns
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        if name == "near_dedup":
            assert docs.groupBy("doc_id").count().filter("count > 1").count() == 0
        if name == "quality":
            labels = read(spark, SF, "labels").filter("toxic = 1")
            assert docs.join(labels, "doc_id", "left_semi").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and last.filter(~F.col("round_trip")).count() == 0


def test_all_queries_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert len([n for n in QUERIES if n.startswith("op")]) == 13
