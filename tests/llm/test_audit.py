"""Filter audit against regular expressions and a plain run of every order."""

import random
import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framewise.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = ["p" * 30, "p" * 29 + "q", "p" * 12 + "z" + "p" * 17, "p" * 8 + "q" + "p" * 21]
ODD = [
    None, "", " ", "\t\n\x0b\x0c\r", "\x1c\x85 ", "a", "a a", "a\xa0b a", "é日本😀 É", "A#b$%&*|",
    " ".join(LONG * 2), "w" * 5000, "x y " * 3000, " ".join(f"w{i}" for i in range(120)),
    " ".join(f"W{i % 90}" for i in range(100)), " ".join(f"w{i % 80}" for i in range(100)),
]


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    return (len(words), len(set(words)), len(re.findall("[A-Z]", text)),
            len(re.findall(r"[#$%&*|]", text)), len(text))


def measured(texts):
    data = [(t or "").encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    found = audit.measured(np.frombuffer(b"".join(data), np.uint8), offsets)
    return list(zip(*(found[m].tolist() for m in audit.MEASURES)))


@pytest.mark.parametrize("block", [1, 2, 7, 1 << 22])
def test_one_pass_equals_regular_expressions(block, monkeypatch):
    monkeypatch.setattr(audit, "BLOCK_BYTES", block)
    rng = random.Random(2)
    texts = ODD[:10] + ["".join(rng.choices("ab é日A# \n\t", k=rng.randint(0, 30))) for _ in range(80)]
    assert measured(texts) == [plain(t) for t in texts]
    assert measured([]) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=" \n\taAé#😀\x85", max_size=30), max_size=8))
def test_any_texts(texts):
    assert measured(texts) == [plain(t) for t in texts]


def test_long_odd_texts():
    assert measured(ODD) == [plain(t) for t in ODD]


def test_equal_hashes_are_told_apart_by_their_bytes(monkeypatch):
    import xxhash

    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda *_: 1)
    assert measured([" ".join(LONG * 2)]) == [plain(" ".join(LONG * 2))]


def docs_and_labels(spark):
    rng = random.Random(4)
    texts = ODD + [" ".join(rng.choices(LONG + ["A", "b#", "c"], k=rng.randint(1, 130))) for _ in range(60)]
    texts += [texts[14]] * 40 + [None, "", texts[20]]
    rng.shuffle(texts)
    rows = [(i, t, rng.choice(["en", "de", None, ""]), "x", 1) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[5], "fr", "y", 2), (rows[0][0], texts[9], "de", "z", 3)]
    rng.shuffle(rows)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 90, 2)]
    labels += [(4, 1, 0), (4, 0, 1), (None, 1, 1), (10_000, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, part string, n long")
    return rows, labels, docs.repartition(5), spark.createDataFrame(
        labels, "doc_id long, quality int, toxic int"
    )


def by_hand(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for doc_id, text, lang, *_ in rows:
        words, distinct, capitals, symbols, points = plain(text)
        fails = {
            "A": words < 100, "B": 100 * distinct < 80 * words, "C": 100 * capitals > 10 * points,
            "D": symbols > 0,
            "E": any((t or "") == (text or "") and i is not None and doc_id is not None and i < doc_id
                     for i, t, *_ in rows),
        }
        parts[lang or ""].append(({x for x in fails if fails[x]}, doc_id in good, doc_id in toxic))
    out = []
    for part, found in parts.items():
        shapley = defaultdict(int)
        steps = []
        for order in permutations("ABCDE"):
            left = list(found)
            for k, letter in enumerate(order, 1):
                gone = [f for f in left if letter in f[0]]
                left = [f for f in left if letter not in f[0]]
                shapley[letter] += len(gone)
                redundant = sum(letter in f[0] for f in found) - len(gone)
                steps.append((part, "".join(order), k, letter, len(left), len(gone), redundant,
                              sum(f[0] == {letter} for f in found), sum(f[1] for f in gone),
                              sum(f[2] for f in gone)))
        out += [(*s[:3], *s[4:], shapley[s[3]]) for s in steps]
    return sorted(out)


def test_every_order_equals_a_plain_run(spark):
    rows, labels, docs, marks = docs_and_labels(spark)
    found = audit.audit(audit.failures(docs, marks))
    assert found.columns == [
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
        "good_lost", "toxic_lost", "shapley",
    ]
    assert sorted(tuple(r) for r in found.collect()) == by_hand(rows, labels)


def test_empty_tables(spark):
    _, _, docs, marks = docs_and_labels(spark)
    assert audit.audit(audit.failures(docs.limit(0), marks)).count() == 0
    assert audit.audit(audit.failures(docs, marks.limit(0))).agg({"good_lost": "sum"}).first()[0] == 0


def test_null_entries_with_bytes_behind_them():
    raw = pa.array(["abc", "de", "f"]).cast(pa.binary())
    assert list(audit._runs(raw)) == [(0, 3)]
