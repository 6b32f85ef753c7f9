"""Shards against a plain jump hash: the law, gapless slots, nothing lost, hot rows spread."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from framewise.llm import sharding
from framewise.llm.common import read, row_id, row_key
from framewise.llm.queries import op13_sharding

SF = "/root/testdata/sf0.001"


def plain_jump(key, shards):
    at, jump = -1, 0
    while jump < shards:
        at = jump
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        jump = int((at + 1) * (2**31 / ((key >> 33) + 1)))
    return at


def test_jump_hash_equals_the_plain_one_and_moves_only_to_new_shards(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("k"))
    sizes = [1, 2, 3, 16, 17, 1000]
    found = keys.select("k", *[sharding.jump_hash(F.col("k"), n).alias(f"n{n}") for n in sizes]).collect()
    for row in found:
        assert [row[f"n{n}"] for n in sizes] == [plain_jump(row.k % 2**64, n) for n in sizes]
        assert row.n17 in (row.n16, 16) and row.n3 in (row.n2, 2)
    counts = Counter(r.n16 for r in found)
    assert len(counts) == 16 and max(counts.values()) < 2 * 3000 / 16
    with pytest.raises(ValueError):
        sharding.jump_hash(F.col("k"), 0)


def odd_docs(spark):
    rows = [(i, f"text {i % 50}", i % 3, "q", [i], None) for i in range(400)]
    rows += [(7, None, 1, None, None, None), (8, "", 1, "q", [None], "x"), (8, "", 1, "q", [None], None)]
    rows += [(None, "no id", None, "q", [], None)] * 3 + [(9, "hot", 1, "z", [1], None)] * 300
    rows += [(None, f"hot null {i}", 1, "z", None, None) for i in range(100)]
    return rows, spark.createDataFrame(
        rows, "doc_id long, text string, shard int, slot string, copies array<int>, id_ string"
    ).repartition(4)


@pytest.mark.parametrize("often", [10, 10_000])
def test_rows_are_kept_and_slots_have_no_gap(spark, monkeypatch, often):
    monkeypatch.setattr(sharding, "OFTEN", often)  # 10: the hot rows travel as one
    monkeypatch.setattr(sharding, "CHUNK", 16)
    rows, docs = odd_docs(spark)
    names = sharding.added_names(docs)
    assert names == {"shard": "shard_", "slot": "slot_", "grown_shard": "grown_shard"}
    found = sharding.shard_table(docs, 5).collect()
    assert sorted(map(str, (tuple(r)[:6] for r in found))) == sorted(map(str, rows))
    slots, of_id = defaultdict(list), defaultdict(set)
    for r in found:
        slots[r.shard_].append(r.slot_)
        of_id[r.doc_id].add((r.shard_, r.grown_shard))
        assert r.grown_shard in (r.shard_, 5)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_id.values())
    again = sharding.shard_table(docs.repartition(7), 5).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_texts_as_keys_stay_together(spark):
    _, docs = odd_docs(spark)
    found = sharding.place(docs, 4, ["text"]).groupBy("text").agg(F.countDistinct("shard_").alias("n"))
    assert found.filter("n <> 1").count() == 0


def test_query_equals_plain_python(spark):
    docs = read(spark, SF, "documents")
    found = op13_sharding(spark, SF)
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    key = {r.doc_id: r.k for r in docs.select("doc_id", sharding.stable_key(F.col("doc_id")).alias("k")).collect()}
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows = found.collect()
    assert sorted(r.doc_id for r in rows) == sorted(text)
    for r in rows:
        assert (r.size, r.text_crc32, r.law) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]), "key")
        k = key[r.doc_id] % 2**64
        assert (r.shard, r.grown_shard) == (plain_jump(k, 16), plain_jump(k, 17))


def test_empty_table(spark):
    _, docs = odd_docs(spark)
    assert sharding.shard_table(docs.limit(0), 3).count() == 0


def test_rows_that_differ_in_nulls_have_different_keys(spark):
    rows = [(5, None, "a", [None]), (None, "5", "a", [None]), (5, None, "a", ["null"]), (5, "", "a", None)]
    df = spark.createDataFrame(rows, "x long, y string, z string, w array<string>")
    assert df.select(row_key(df)).distinct().count() == df.select(row_id(df)).distinct().count() == 4
