"""The training-data pipeline: five stages over ``documents``, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm import mixing, nearcopies, quality, spm, substring
from framewise.llm.common import read, store
from framewise.llm.queries import PIECE_MODEL
from framewise.session import scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; null and empty texts get the score 0."""
    return quality.graded(docs, read(spark, sf_dir, "labels")).filter("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies that with the smallest id stays.

    SimHash prints of five-word shingles and their pivot tables select the pairs,
    a Jaccard similarity of 0.8 or more of the shingle sets links them.
    """
    return nearcopies.keep_one(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages leave the texts; documents of which nothing is left go.

    Null and empty texts lose nothing and stay, as do documents without an id.
    """
    found = substring.remove_repeats(docs)
    if "n_chars" in docs.columns:
        shorter = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", shorter.cast(docs.schema["n_chars"].dataType))
    emptied = (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_words"))
    return found.filter(~emptied).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until each source has its share of words.

    Documents without words, null texts among them, have no copies. Documents
    without a source are one source.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix."""
    return spm.encode(docs, spm.load_pieces(PIECE_MODEL))


STAGES: list[tuple[str, Stage]] = [
    ("quality", classify),
    ("near_dedup", near_dedup),
    ("substring_dedup", drop_repeats),
    ("mix", mix),
    ("encode", encode),
]

# Sampling, fingerprints and tokenizers are beyond SQL; tests/llm holds brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; tables inside a stage go when it is written."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs = store(stage(spark, docs, sf_dir), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
