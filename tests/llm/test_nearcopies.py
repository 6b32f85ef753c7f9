"""The near-copy stage of the pipeline against all pairs."""

import random

import pytest

import corpus_pipeline
from framewise.llm import nearcopies


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def kept_by_all_pairs(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if (len(sets[i] & sets[j]) / both if both else 1.0) >= 0.8:
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return sorted({rows[find(i)][0] for i in range(len(rows))})


def planted():
    """Texts of 30 to 300 words, each with copies of a few changed words; chains and one large group."""
    draw = random.Random(5)
    texts = []

    def changed(words, n):
        out = list(words)
        for at in draw.sample(range(len(out)), n):
            out[at] = f"new{draw.randrange(10**6)}"
        return out

    for n in (1, 3, 5, 30, 60, 100, 100, 300):
        base = [f"w{draw.randrange(5000)}" for _ in range(n)]
        texts.append(base)
        texts += [changed(base, k) for k in (1, 2, 3, 5, 8, 20) if k < n]
    chain = [f"c{i}" for i in range(100)]
    for _ in range(6):
        texts.append(chain)
        chain = changed(chain, 2)
    base = [f"g{i}" for i in range(200)]
    texts += [changed(base, draw.randrange(1, 6)) for _ in range(60)]
    draw.shuffle(texts)
    return [*enumerate(map(" ".join, texts)), (900, None), (901, "")]


@pytest.mark.parametrize("dense", [2, 32])
def test_copies_of_a_few_changed_words_go(spark, dense):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in nearcopies.keep_one(docs, dense=dense).collect())
    assert kept == kept_by_all_pairs(rows)
    assert len(kept) < len(rows) - 50


def test_the_stage_drops_a_copy_with_one_changed_word(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:50], "other", *words[51:]])), (3, "else")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_empty_table(spark):
    assert nearcopies.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pairs_come_through_prints_and_pivot_tables(spark):
    """Each step decides: the blocks alone find a copy, and a reach of 0 links equal prints only."""
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, " ".join(words[:360]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def kept(**params):
        return sorted(r.doc_id for r in nearcopies.keep_one(docs, **params).collect())

    prints = {
        r.doc_id: r.s.fp
        for r in docs.select("doc_id", nearcopies.signature(docs.text, 5, 1, 1).alias("s")).collect()
    }
    for i, text in rows:
        held = nearcopies.shingle_set(text.encode(), 5)
        bits = [sum(int(h) >> b & 1 for h in held) * 2 > len(held) for b in range(64)]
        assert prints[i] % (1 << 64) == sum(1 << b for b, on in enumerate(bits) if on)
    apart = {b: (prints[1] ^ prints[b]) % (1 << 64) for b in (2, 3)}
    assert 0 < apart[3].bit_count() <= nearcopies.REACH
    assert kept() == [1]
    assert kept(reach=apart[3].bit_count() - 1) == [1, 3]  # the prints discard what is alike
    assert kept(bands=0) in ([1], [1, 3])  # equal blocks without any band of minima
    assert kept(bands=0, reach=0) == ([1, 3] if not apart[2] else [1, 2, 3])
