"""Text operators against brute force, with nulls, empty and long texts, ties and clashing names."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from framewise.llm import licenses, mixing, quality, simhash, spm, substring, tokencount
from framewise.llm.graph import components
from framewise.llm.queries import PIECE_MODEL, RANKS, moved_words

ODD = [None, "", " ", "\n\t", "one", "one two", "x " * 3000, "y" * 400, "ab  c\r\né 日本 ￿"]


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, shared passages, odd texts, repeated rows, clashing extra columns."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(60)]
    shared = " ".join(word() for _ in range(40))
    texts += [texts[0]] * 4 + [texts[1] + " " + word() for _ in range(4)]
    texts += [f"{word()} {shared} {word()}" for _ in range(5)] + ODD
    rows = [(i, t, "bucket", f"s{i % 4}" if i % 9 else None, 5) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id here", "x", "s1", None)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, bucket string, source string, n long"
    ).repartition(3)


EMPTY = "doc_id long, text string, bucket string, source string, n long"


def words(text):
    return (text or "").encode().split()


def roots(ids, linked):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 30)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    pairs += [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    links = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    pairs = [p for p in pairs if p[0] != p[1]]
    want = roots({i for p in pairs for i in p}, pairs)
    assert {r.node: r.root for r in components(links).collect()} == want
    assert components(links.limit(0)).count() == 0


def fingerprint(text):
    tokens = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [b" ".join(tokens[i : i + 3]) for i in range(max(1, len(tokens) - 2))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("dense", [2, 32])
def test_simhash_equals_brute_force(docs, dense):
    got = simhash.near_duplicates(docs, dense=dense).withColumn("hex", simhash.hex_of(F.col("fp")))
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    prints = {i: fingerprint(t) for i, t in rows}
    linked = [(a, b) for a in prints for b in prints if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = roots(prints, linked)
    found = got.filter("doc_id is not null").collect()
    assert len(found) == len(rows)
    assert all(r.hex == f"{prints[r.doc_id]:016x}" for r in found)
    assert {r.doc_id: r.component_id for r in found} == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted(set(want.values()))


@pytest.mark.parametrize("buckets", [1, 4])
def test_repeats_equal_brute_force(docs, buckets):
    rows = {(r.doc_id if r.doc_id is not None else 10**9, r.text) for r in docs.collect()}
    seen, want = set(), {}
    for ident, text in sorted(rows, key=lambda r: r[0]):
        tokens = words(text)
        gone = [False] * len(tokens)
        for i in range(len(tokens) - 19):
            key = tuple(tokens[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        left = b" ".join(w for w, g in zip(tokens, gone) if not g)
        want[ident] = len(tokens), sum(gone), hashlib.sha256(left).hexdigest()
    got = substring.remove_repeats(docs, buckets=buckets)
    assert got.columns == [*docs.columns, "n_words", "n_removed", "kept_sha256"]
    found = got.collect()
    assert len(found) == docs.count()
    for r in found:
        ident = r.doc_id if r.doc_id is not None else 10**9
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[ident]


def test_pieces_equal_the_library(docs):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    pieces = spm.load_pieces(PIECE_MODEL)
    got = spm.encode(docs, pieces, buckets=3)
    texts = {r.doc_id: r.text for r in docs.collect()}
    back = got.withColumn("back", spm.decode(F.col("ids"), pieces)).collect()
    assert len(back) == docs.count()
    for r in back:
        assert list(r.ids) == (model.encode(texts[r.doc_id]) if texts[r.doc_id] else [])
        assert r.back == (texts[r.doc_id] or "") and r.round_trip


def test_viterbi_equals_all_paths(spark):
    scores = {"a": -1.0, "b": -1.5, "ab": -2.0, "ba": -2.2, "aba": -3.1, " ": -1.0, " a": -1.9}
    pieces = spm.Pieces(
        "unigram", {p: (i, s) for i, (p, s) in enumerate(scores.items())},
        [p.encode() for p in scores] + [b"?"], (), len(scores),
    )
    units = [" aba", "abab", "bbaab", "axb", "a"]
    table = spark.createDataFrame([(u, 1) for u in units], "unit string, bucket int")
    cuts = {r.unit: r.cuts for r in spm.segment(table, ["bucket"], pieces).collect()}
    lowest = min(scores.values()) - 10

    def best(text):
        if not text:
            return 0.0
        return max(
            best(text[:-k]) + scores.get(text[-k:], lowest if k == 1 else float("-inf"))
            for k in range(1, len(text) + 1)
        )

    for unit in units:
        stops = [i for i in range(len(unit) + 1) if cuts[unit] >> i & 1]
        parts = [unit[a:b] for a, b in zip(stops, stops[1:])]
        assert sum(scores.get(p, lowest) for p in parts) == pytest.approx(best(unit))
        assert "".join(unit[a:b] for a, b in zip([0, *spm.long_stops(unit, pieces)],
                                                 spm.long_stops(unit, pieces))) == unit


def test_counts_follow_edits(docs):
    tiktoken = pytest.importorskip("tiktoken")
    vocabulary = tokencount.load_vocabulary(RANKS)
    encoding = tiktoken.Encoding("t", pat_str=vocabulary.pattern,
                                 mergeable_ranks=vocabulary.ranks, special_tokens={})
    got = tokencount.recount(docs, moved_words(F.col("text"), F.col("doc_id")), vocabulary, leaf=4)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in got.collect():
        assert r.n_tokens == len(encoding.encode_ordinary(texts[r.doc_id]))
        assert r.edited_tokens == len(encoding.encode_ordinary(r.edited_text))


def test_edits_anywhere():
    pattern, count = tokencount._counter(tokencount.load_vocabulary(RANKS))
    rng, letters = random.Random(5), "ab '  \n\t.,1é’s"
    for _ in range(300):
        body = "".join(rng.choice(letters) for _ in range(rng.randint(0, 80)))
        tree = tokencount.SumTree.build(tokencount._leaves(pattern.findall(body), count, 3))
        for _ in range(4):
            change = {"at": rng.randint(0, 90), "removed": rng.choice([0, 1, 5, 50, None]),
                      "inserted": "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 30])))}
            body, _ = tokencount._edit(body, tree, change, pattern, count)
            parts = pattern.findall(body)
            assert tree.totals == (len(body), len(parts), sum(map(count, parts)))


def test_mix_meets_targets_and_repeats(docs):
    plan = mixing.mix(docs, rows_per_group=3).collect()
    assert sum(r.rows for r in plan) == docs.count()
    sources, key = {}, {r.doc_id: r.source for r in docs.collect()}
    for r in plan:
        assert 0 <= r.copies <= 2 and (r["size"] or not r.copies)
        entry = sources.setdefault(key[r.doc_id], [r.target, 0, 0, r.source_size])
        entry[1] += r.copies * r["size"] * r.rows
        entry[2] = max(entry[2], r["size"] * r.rows)
    total = sum(e[3] for e in sources.values())
    assert sum(e[0] for e in sources.values()) == pytest.approx(1.5 * total)
    assert all(abs(taken - target) <= most for target, taken, most, _ in sources.values())
    again = mixing.mix(docs.repartition(5), rows_per_group=3).collect()
    pick = lambda rows: sorted((r.row_key, r.copies) for r in rows)
    assert pick(again) == pick(plan)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns


def test_licenses_equal_brute_force(spark, docs):
    texts = ["Under the MIT license; under the mit License", "cc-by-nc 4.0", "nothing", None,
             "This work is licensed under the GNU General Public License, version 3."]
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    found = {r.doc_id: r.license for r in licenses.scan(rows).collect()}
    for ident, text in ((r.doc_id, r.text) for r in rows.collect()):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        tokens = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places, labels = [], set()
        for phrase, label in licenses.PHRASES:
            want = phrase.split()
            for i in range(len(tokens)):
                if tokens[i : i + len(want)] == want:
                    places.append(i)
                    labels.add(label)
        r = found[ident]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            len(tokens), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert found[1004].labels == "gpl-3" and found[1002].labels == ""


@pytest.mark.parametrize("files", [1, 3, 40])
def test_licenses_that_most_files_have_are_found(spark, files):
    text = licenses.TEMPLATES[0][2]
    rows = [(i, f"{text} {i}" if i % 4 < 3 else "nothing") for i in range(files)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.license.labels for r in found if r.doc_id % 4 < 3} == {"mit"}
    assert {r.license.score for r in found if r.doc_id % 4 < 3} == {1.0}


def test_licenses_equal_a_scan_over_all_templates(spark):
    rng = random.Random(3)
    bodies = [t[2] for t in licenses.TEMPLATES]
    vocab = sorted({w for b in bodies for w in b.split()})
    texts = [*bodies, " filler ".join(bodies), f"{bodies[0]} x {bodies[6]} y {bodies[-1]}", "", None]
    for _ in range(60):
        parts = []
        for body in rng.sample(bodies, rng.randint(1, 4)):
            cut = [w if rng.random() > 0.2 else "zzz" for w in body.split()]
            parts += [*cut[rng.randint(0, 3):], *rng.sample(vocab, rng.randint(0, 20))]
        texts.append(" ".join(parts))
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    for r in licenses.scan(docs).collect():
        tokens = (r.text or "").split()
        labels = set(filter(None, r.license.base_labels.split(",")))
        best = 1.0 if labels else 0.0
        for label, must, body in licenses.TEMPLATES:
            body = body.split()
            for start in range(-len(body), len(tokens)):
                lo, hi = max(start, 0), min(start + len(body), len(tokens))
                share = sum(tokens[i] == body[i - start] for i in range(lo, hi)) / len(body)
                if share >= licenses.COVERED and f" {must} " in f" {' '.join(tokens[lo:hi])} ":
                    labels.add(label)
                    best = max(best, share)
        assert (r.license.labels, r.license.score) == (",".join(sorted(labels)), best), r.text


def test_many_phrases_in_one_text_take_linear_time(spark):
    import time

    took = []
    for n in (5_000, 80_000):
        docs = spark.createDataFrame([(1, "cc by nc " * n)], "doc_id long, text string")
        begun = time.time()
        row = licenses.scan(docs).first().license
        took.append(time.time() - begun)
        assert (row.n_base, row.first_word, row.last_word) == (n, 0, 3 * (n - 1))
    assert took[1] < 16 * took[0] + 5


def test_classifier_orders_grades_and_holds_out(spark):
    rng = random.Random(3)
    words_of = [["scum", "idiot"], ["LOUD!!", "###"], ["calm", "fine"]]
    rows = []
    for i in range(300):
        grade = i % 3
        text = " ".join(rng.choice(words_of[grade] + ["of", "the", "and"] * 2) for _ in range(30))
        rows.append((i, text, 0 if grade == 1 else 1, int(grade == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    labels = table.filter("doc_id < 200").select("doc_id", "quality", "toxic")
    docs = table.select("doc_id", "text", F.lit(1).alias("kept"))
    got = quality.graded(docs, labels).filter("doc_id >= 200").collect()
    assert all(r.kept == (r.doc_id % 3 == 2) for r in got)
    mean = lambda g: sum(r.expected_grade for r in got if r.doc_id % 3 == g)
    assert mean(0) < mean(1) < mean(2)
    none = quality.graded(docs, labels.limit(0)).collect()
    assert all(r.kept for r in none)


@pytest.mark.parametrize("call", [
    lambda d: simhash.keep_one(d), lambda d: substring.remove_repeats(d), lambda d: mixing.mixed(d),
    lambda d: spm.encode(d, spm.load_pieces(PIECE_MODEL)), lambda d: licenses.scan(d),
])
def test_empty_tables(spark, call):
    assert call(spark.createDataFrame([], EMPTY)).count() == 0


def test_other_units_leave_once_and_in_small_batches(monkeypatch):
    """A bucket's units come once, however many batches of texts it has; few are held at a time."""
    import zstandard

    monkeypatch.setattr(spm, "UNIT_ROWS", 10)
    squeeze = zstandard.ZstdCompressor().compress
    texts = [" ".join(f"u{(7 * i + j) % 60}" for j in range(5)) for i in range(40)]
    ready = type("Ready", (), {"value": ({" u0": b"", " u7": b""}, set())})
    batches = [
        pa.RecordBatch.from_arrays(
            [pa.array([i % 2 for i in range(at, at + 8)] + [0], pa.int32()),
             pa.array([squeeze(x.encode()) for x in texts[at : at + 8]] + [None], pa.binary())],
            ["bucket", "text"],
        )
        for at in range(0, 40, 8)
    ]
    found = list(spm._other_units(ready)(iter(batches)))
    assert max(b.num_rows for b in found) < 10 + 5
    rows = [(r["bucket"], r["unit"]) for b in found for r in b.to_pylist()]
    want = {(i % 2, f" {w}") for i, x in enumerate(texts) for w in x.split()}
    assert len(rows) == len(set(rows)) and set(rows) == {r for r in want if r[1] not in (" u0", " u7")}


def test_units_reach_the_lattice_in_parts():
    """Units are cut where no piece can cross: parts come once, whatever stands beside them."""
    import zstandard

    scores = {" a": -1.0, "ab": -2.0, " ab": -3.0, ",%": -4.0, "b": -5.0}
    pieces = spm.Pieces("bpe", {p: (i, s) for i, (p, s) in enumerate(scores.items())},
                        [p.encode() for p in scores], (), len(scores))
    assert pieces.parts()(" abb,%a") == [" ab", "b", ",%", "a"]
    texts = ["ab,% ab ab%", "ab,", "abab,%" * 40]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0, 0, 1], pa.int32()),
         pa.array([zstandard.ZstdCompressor().compress(x.encode()) for x in texts], pa.binary())],
        ["bucket", "text"],
    )
    ready, known = (type("Value", (), {"value": v}) for v in (({" ab": b""}, set()), pieces))
    rows = [(r["bucket"], r["unit"])
            for b in spm._other_units(ready, known)(iter([batch])) for r in b.to_pylist()]
    assert sorted(rows) == [(0, ",%"), (1, ",%"), (1, "ab")]


def test_scorer_keeps_only_features_of_the_model():
    """The cache of a task holds the slots of the model, not every slot of every word."""
    every = quality._features(quality.SPACE, quality.PREFIX)
    text = "Mixing, mixing words, 12 Words and words²"
    wanted = dict.fromkeys(sorted(every(text))[::2], 1.0)
    some = quality._features(quality.SPACE, quality.PREFIX, wanted)
    assert list(some(text).items()) == [(s, v) for s, v in every(text).items() if s in wanted]
