"""The registered queries of this subpackage over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm import (
    alignment,
    audit,
    itq,
    licenses,
    mixing,
    oracle,
    quality,
    rpforest,
    sharding,
    simhash,
    spm,
    substring,
    tokencount,
    warc,
)
from framewise.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def op1_sentencepiece(
    spark: SparkSession, sf_dir: str, model_file: str = PIECE_MODEL
) -> DataFrame:
    found = spm.encode(read(spark, sf_dir, "documents"), spm.load_pieces(model_file))
    return found.select("doc_id", F.size("ids").alias("n_pieces"), "ids", "round_trip")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.graded(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "expected_grade", "tail_prob", "kept")



def moved_words(text: Column, doc_id: Column) -> Column:
    """Two edits per document: 40 characters move from one place to another, chosen by the id."""
    n = F.coalesce(F.char_length(text), F.lit(0))
    one = F.pmod(F.xxhash64(doc_id), n + 1).cast("int")
    two = F.pmod(F.xxhash64(doc_id, F.lit(1)), n + 1).cast("int")
    return F.array(
        F.struct(one.alias("at"), F.lit(40).alias("removed"), F.lit("").alias("inserted")),
        F.struct(two.alias("at"), F.lit(0).alias("removed"),
                 F.substring(text, one + 1, F.lit(40)).alias("inserted")),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str, ranks_file: str = RANKS) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = tokencount.recount(
        docs, moved_words(F.col("text"), F.col("doc_id")), tokencount.load_vocabulary(ranks_file)
    )
    return found.select(
        "doc_id", "n_pretokens", "n_tokens", "edited_pretokens", "edited_tokens",
        "encoded_pretokens",
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(read(spark, sf_dir, "documents"))
    taken = (F.col("copies") * F.col("size")).cast("long")
    again = F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))
    return plan.select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"), again.alias("__row")
    ).drop("__row")


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "license.*")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive(read(spark, sf_dir, "pages"))
    return found.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
        "urlkey", "range", "position",
    )


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return rpforest.search(rows, rows.filter(F.col("vec_id") % 20 == 0))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(read(spark, sf_dir, "embeddings"))


def op11_alignment(
    spark: SparkSession, sf_dir: str, byte_file: str = BYTE_VOCABULARY, piece_file: str = PIECE_MODEL
) -> DataFrame:
    coders = alignment.load_coders(byte_file, piece_file)
    return alignment.scored(read(spark, sf_dir, "documents"), coders)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.failures(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return audit.audit(found)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    names = sharding.added_names(docs)
    text = F.coalesce("text", F.lit(""))
    return sharding.shard_table(docs, 16).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        *[F.col(own).alias(name) for name, own in names.items()],
    )


QUERIES: dict[str, Query] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_quality": op2_quality,
    "op3_token_counts": op3_token_counts,
    "op4_simhash": op4_simhash,
    "op5_neighbours": op5_neighbours,
    "op6_licenses": op6_licenses,
    "op7_mixing": op7_mixing,
    "op8_substring": op8_substring,
    "op9_warc": op9_warc,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_alignment": op11_alignment,
    "op12_filter_audit": op12_filter_audit,
    "op13_sharding": op13_sharding,
}

# Operators that SQL can express over whole tables.
SQL: dict[str, str] = {
    "op8_substring": oracle.SUBSTRING,
    "op10_embedding_dedup": oracle.VECTOR_COPIES,
    "op12_filter_audit": audit.audit_sql(),
}
