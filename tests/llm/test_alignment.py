"""Cross-tokenizer alignment against whole-text encoding and a plain scan."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framewise.llm import alignment
from framewise.llm.common import read
from framewise.llm.queries import BYTE_VOCABULARY, PIECE_MODEL

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  ", "a ", " a", "\n", "\n\t ", "a\n\nb", "a \n b", "a\r\n  b", "x  y", "x 　 y",
    "  z", "\x1c z", "!\x1c!", "\x85 q", "᠎ q", "▁", "a▁b", "a ▁ b", "<|endoftext|>", "<s> </s><unk>",
    "日本語の長い行" * 80, "é😀 \x00\x01 z", "it's they'll 'S 12345 ½", "y" * 3000, "word, word. " * 400,
    "� ퟿ \U0010ffff", "​ ‍", "  two  blanks   three ",
]


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(BYTE_VOCABULARY)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


def encoded(sides, text):
    """Ids and byte strings of both sides for a whole text, or None."""
    if not text:
        return None
    a, b = sides
    letters = alignment.byte_letters()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [
        bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
        else b.id_to_piece(i).replace("▁", " ").encode()
        for i in ids_b
    ]
    raw = (" " + text).encode()
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return None
    return ids_a, ids_b, list(accumulate(map(len, bytes_a))), list(accumulate(map(len, bytes_b)))


def plain(sides, rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    parts, corpus = [], Counter()
    for doc_id, text in rows:
        found = encoded(sides, text)
        if not found:
            parts.append((doc_id, 0, 0, [], ""))
            continue
        a, b, ends_a, ends_b = found
        links, i, j = [], 0, 0
        while i < len(a):
            links.append((a[i], b[j]))
            step_a, step_b = ends_a[i] <= ends_b[j], ends_b[j] <= ends_a[i]
            i, j = i + step_a, j + step_b
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            m, n = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
            groups.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
            i, j = m, n
        corpus.update(links)
        parts.append((doc_id, len(a), len(b), links, ";".join(groups)))
    top = Counter()
    for (_, b), n in corpus.items():
        top[b] = max(top[b], n)
    return sorted(
        (
            (doc_id, n_a, n_b, groups.count(";") + bool(groups), len(links),
             sum(corpus[p] == top[p[1]] for p in links), sum(corpus[p] for p in links),
             hashlib.sha256(groups.encode()).hexdigest() if groups else "")
            for doc_id, n_a, n_b, links, groups in parts
        ), key=str,
    )


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def odd_docs(spark):
    rng = random.Random(5)
    letters = "ab é日\n\t.,'1▁ " + "  x "
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(300)]
    rows = [(i, t, "a", [1], 7) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, "no id here", "b", [], None)]
    return rows, spark.createDataFrame(
        rows, "doc_id long, text string, a string, times array<int>, row long"
    ).repartition(3)


@pytest.mark.parametrize("common", [alignment.COMMON, 40, 0])
def test_odd_texts_equal_a_plain_scan(spark, sides, common, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_BYTES", 500)
    rows, docs = odd_docs(spark)
    coders = alignment.load_coders(BYTE_VOCABULARY, PIECE_MODEL)
    found = alignment.scored(docs, coders, common=common)  # 40: some pairs are joined, 0: all
    assert rows_of(found) == plain(sides, [r[:2] for r in rows])


def test_documents_equal_a_plain_scan(spark, sides):
    docs = read(spark, SF, "documents")
    coders = alignment.load_coders(BYTE_VOCABULARY, PIECE_MODEL)
    expected = plain(sides, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert rows_of(alignment.scored(docs, coders)) == expected


def test_groups_are_the_texts_own_ids(spark, sides):
    docs = spark.createDataFrame([(1, "one two, three")], "doc_id long, text string")
    coders = alignment.load_coders(BYTE_VOCABULARY, PIECE_MODEL)
    row = alignment.align(docs, coders).first()
    a, b, *_ = encoded(sides, "one two, three")
    pairs = [g.split("|") for g in row.groups.split(";")]
    assert [int(i) for x, _ in pairs for i in x.split(",")] == a
    assert [int(i) for _, y in pairs for i in y.split(",")] == b
    assert sum(row.times) == row.n_links and len(row.a) == len(row.b) == len(row.times)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    coders = alignment.load_coders(BYTE_VOCABULARY, PIECE_MODEL)
    assert rows_of(alignment.scored(docs, coders)) == []


def test_every_code_point_is_whitespace_where_either_side_says_so(sides):
    """Units are cut only where both sides cut, whatever stands before the blank."""
    a, b = sides
    worker = alignment.Aligner(alignment.load_coders(BYTE_VOCABULARY, PIECE_MODEL))
    points = [*range(1, 0x3100), *range(0xFE00, 0x10000), 0x1F600, 0xE0001]
    for code in points:
        text = f"q{chr(code)}  r"
        units = worker.units(text)
        if len(units) > 1 and chr(code) != "▁":
            whole = a.encode(" " + text, add_special_tokens=False).ids
            assert whole == [i for u in units for i in a.encode(u, add_special_tokens=False).ids], code
            assert b.encode(text) == [i for u in units for i in b.encode(u[1:])], code


def test_leaf_groups_of_random_ends():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 60)
        last = 100
        a = sorted({*rng.sample(range(1, 100), min(n, 40)), last})
        b = sorted({*rng.sample(range(1, 100), rng.randint(0, 40)), last})
        stops = alignment.leaf_groups(a, b)
        assert [a[i - 1] for i, _ in stops] == [b[j - 1] for _, j in stops] == sorted({*a} & {*b})
        pairs, at = [], (0, 0)
        for stop in stops:
            pairs += alignment.overlaps(a, b, at, stop)
            at = stop
        starts_a, starts_b = [0, *a], [0, *b]
        assert sorted(pairs) == [
            (i, j) for i in range(len(a)) for j in range(len(b))
            if max(starts_a[i], starts_b[j]) < min(a[i], b[j])
        ]
    assert alignment.leaf_groups([], []) == []
