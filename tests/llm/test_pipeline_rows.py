"""The pipeline's stages on a small corpus against plain Python, stage by stage."""

import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from test_nearcopies import kept_by_all_pairs

import corpus_pipeline
from framewise.llm.common import store
from framewise.llm.queries import PIECE_MODEL

WINDOW = 20


def without_repeats(rows):
    """Texts by id without the words of windows that start earlier somewhere."""
    first = {}
    ordered = sorted(rows)
    for doc_id, text in ordered:
        words = (text or "").split()
        for at in range(len(words) - WINDOW + 1):
            first.setdefault(tuple(words[at:at + WINDOW]), (doc_id, at))
    out = {}
    for doc_id, text in ordered:
        words = (text or "").split()
        gone = set()
        for at in range(len(words) - WINDOW + 1):
            if first[tuple(words[at:at + WINDOW])] < (doc_id, at):
                gone.update(range(at, at + WINDOW))
        out[doc_id] = " ".join(w for i, w in enumerate(words) if i not in gone) if gone else text
        if gone and len(gone) == len(words):
            del out[doc_id]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good prose, junk, toxic documents, exact and near copies, and a passage that many share."""
    rng = random.Random(11)
    common = [f"word{i}" for i in range(300)]
    prose = lambda n: [rng.choice(common) for _ in range(n)]
    junk = lambda n: [f"zz{rng.randrange(50)}!!" for _ in range(n)]
    texts, quality, toxic = [], [], []

    def add(words, good, bad=0):
        texts.append(" ".join(words))
        quality.append(good)
        toxic.append(bad)

    for _ in range(60):
        add(prose(rng.randint(60, 150)), 1)
    for _ in range(40):
        add(junk(rng.randint(30, 80)), 0)
    for _ in range(40):
        add(prose(40) + ["hate", "kill"] * 10, 0, 1)
    for i in range(0, 30, 3):
        words = texts[i].split()
        add(words, 1)
        words[len(words) // 2] = "changed"
        add(words, 1)
    passage = prose(70)
    for _ in range(12):
        add(prose(40) + passage + prose(20), 1)
    order = list(range(len(texts)))
    rng.shuffle(order)
    at = tmp_path_factory.mktemp("corpus")
    docs = [(i, texts[k], "en", f"s{k % 4}", len(texts[k])) for i, k in enumerate(order)]
    spark.createDataFrame(
        docs, "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(str(at / "documents.parquet"))
    marks = [(i, quality[k], toxic[k]) for i, k in enumerate(order)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    return str(at), docs, {i: (q, t) for i, q, t in marks}


def test_each_stage_equals_plain_python(spark, folder):
    path, rows, marks = folder
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns

    graded = store(stages["quality"](spark, docs, path))
    kept = {r.doc_id for r in graded.collect()}
    good = {i for i, (q, t) in marks.items() if q and not t}
    assert not {i for i, (_, t) in marks.items() if t} & kept
    assert len(good - kept) <= 0.05 * len(good) and graded.columns == columns

    unique = store(stages["near_dedup"](spark, graded, path))
    plain = [(r.doc_id, r.text) for r in graded.collect()]
    left = [(r.doc_id, r.text) for r in unique.collect()]
    assert sorted(i for i, _ in left) == kept_by_all_pairs(sorted(plain)) and len(left) < len(plain) - 15

    stripped = store(stages["substring_dedup"](spark, unique, path))
    want = without_repeats(left)
    assert {r.doc_id: r.text for r in stripped.collect()} == want
    assert sum(len(t.split()) for t in want.values()) < sum(len(t.split()) for _, t in left) - 600

    mixed = store(stages["mix"](spark, stripped, path))
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times) <= set(want) and max(times.values()) <= 2 and mixed.columns == columns
    source = {i: s for i, _, _, s, _ in rows}
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, text in want.items():
        sizes[source[i]] += len(text.split())
        taken[source[i]] += times[i] * len(text.split())
    # Weights 5, 2, 1, 5 of 150 % of all words, at most twice a source.
    weights = dict(zip(sorted(sizes), (5, 2, 1, 5)))
    target, open_, left_words = {}, set(sizes), 1.5 * sum(sizes.values())
    while open_:
        share = {s: left_words * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left_words -= target[s]
        open_ -= over
    longest = max(len(t.split()) for t in want.values())
    assert all(abs(taken[s] - target[s]) <= longest for s in sizes)

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    encoded = stages["encode"](spark, mixed, path).collect()
    assert Counter(r.doc_id for r in encoded) == times
    assert all(list(r.ids) == model.encode(want[r.doc_id]) and r.round_trip for r in encoded)


def test_run_strings_the_stages_together(spark, folder):
    path, rows, _ = folder
    found = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in found} <= {r[0] for r in rows} and len(found) > 60
    assert all(r.round_trip for r in found)
