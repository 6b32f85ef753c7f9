"""Clashing column names, rows that differ in nulls alone, repeated rows and ids."""

import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from framewise.llm import itq, mixing, nearcopies, quality, simhash, spm, substring
from framewise.llm.queries import PIECE_MODEL

NAMES = ["__key", "key", "__copies", "copies", "__copy", "copy", "__text", "__doc", "__rk", "__bucket",
         "bucket", "__score", "score", "c0", "c1", "id", "rows", "row_key", "unit", "cls", "shard"]


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents that also have a column of every name that the operators use inside."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefghij", k=rng.randint(1, 60))) for _ in range(40)]
    texts += [texts[0], texts[1] + " z", None, ""]
    rows = [(i, t, f"s{i % 3}", *[f"{n}{i}" for n in NAMES]) for i, t in enumerate(texts)]
    columns = ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {columns}")


def same_cells(found, given):
    """Every row of ``found`` has the cells that its document has in ``given``."""
    assert [c for c in found.columns if c in given.columns] == given.columns
    cells = ["doc_id", "source", *NAMES]
    assert found.select(*cells).join(given.select(*cells), cells, "left_anti").count() == 0


def test_columns_of_inner_names_come_back_as_they_were(clashing):
    for kept in (simhash.keep_one(clashing), nearcopies.keep_one(clashing), mixing.mixed(clashing)):
        same_cells(kept, clashing)
    assert simhash.keep_one(clashing).count() < clashing.count()
    stripped = substring.remove_repeats(clashing, buckets=3)
    same_cells(stripped, clashing)
    assert stripped.count() == clashing.count()
    labels = clashing.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"),
                             F.lit(0).alias("toxic"))
    same_cells(quality.graded(clashing, labels), clashing)


def test_rows_that_differ_in_nulls_alone_both_stay(spark):
    rows = [(5, None, "a b c d e f"), (5, "5", None), (6, None, "q r s t u v"), (6, "", "w x y z 1 2")]
    docs = spark.createDataFrame(rows, "doc_id long, note string, text string")
    for keep in (simhash.keep_one, nearcopies.keep_one):
        kept = keep(docs).collect()
        assert sorted(map(str, kept)) == sorted(map(str, docs.collect()))
    pair = spark.createDataFrame([(5, None, "a"), (None, "5", "a")], "doc_id long, note string, text string")
    assert [tuple(r) for r in simhash.keep_one(pair).collect()] == [(5, None, "a")]


def test_repeated_ids_and_vectors_are_counted_apart(spark):
    base = np.random.default_rng(1).standard_normal((3, 16))
    near = (base[0] + 0.001).tolist()
    rows = [(1, base[0].tolist(), 0), (1, near, 0), (2, base[1].tolist(), 0)]  # one id, two vectors
    rows += [(7, base[2].tolist(), 1), (7, base[2].tolist(), 2), (8, base[2].tolist(), 1)]  # two labels
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in itq.near_duplicates(df).collect())
    assert found == [(1, 1, 1), (1, 1, 1), (2, 0, 2), (7, 0, 7), (7, 1, 7), (8, 1, 7)]


def test_repeated_rows_are_rounded_one_by_one(spark):
    """A third of a source is one row many times over; the source still meets its target."""
    rows = [(1, "w " * 9, "s")] * 50 + [(i, "w " * 9, "s") for i in range(2, 102)]
    rows += [(500 + i, "w " * 40, "t") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix(docs).collect()
    for source, ids in (("s", range(1, 102)), ("t", range(500, 530))):
        own = [r for r in plan if r.doc_id in ids]
        taken = sum(r.copies * r["size"] * r.rows for r in own)
        assert abs(taken - own[0].target) <= max(r["size"] for r in own), source
    out = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    want = Counter()
    for r in plan:
        want[r.doc_id] += r.copies * r.rows
    assert out == +want and sum(r.rows for r in plan) == len(rows)


def test_buckets_that_share_a_partition_keep_their_units(spark):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(30)) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts * 2)], "doc_id long, text string, unit string")
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    found = spm.encode(docs, spm.load_pieces(PIECE_MODEL), buckets=37).collect()
    assert len(found) == 400
    for r in found:
        assert list(r.ids) == model.encode(texts[r.doc_id % 200]) and r.round_trip
