"""Vector and archive operators against brute force."""

import base64
import hashlib
import random

import numpy as np
import pytest

from framewise.llm import itq, rpforest, warc

INF = float("inf")


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    rows += [(100 + i, (base[0] + 0.03 * rng.standard_normal(16)).tolist(), 0) for i in range(25)]
    rows += [(200 + i, base[1].tolist(), 1) for i in range(6)] + [(210, (2 * base[1]).tolist(), 1)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [INF] + [1.0] * 15, 1),
             (303, base[2].tolist(), None), (304, [None] + [1.0] * 15, 1), (None, base[3].tolist(), 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def good(rows, label=True):
    return [r for r in rows if r.vec_id is not None and (r.label is not None or not label)
            and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding)
            and any(r.embedding)]


@pytest.mark.parametrize("chunk", [4, 512])
def test_vector_copies_equal_brute_force(vectors, chunk):
    rows = vectors.collect()
    links = {r.vec_id: set() for r in rows if r.vec_id is not None}
    usable = good(rows)
    for a in usable:
        for b in usable:
            x, y = np.array(a.embedding), np.array(b.embedding)
            if a.vec_id != b.vec_id and a.label == b.label and (
                    x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98):
                links[a.vec_id].add(b.vec_id)
    found = {r.vec_id: r for r in itq.near_duplicates(
        vectors, bits=32, tables=40, key_bits=8, chunk=chunk).collect()}
    assert len(found) == len(rows)
    for ident, linked in links.items():
        reach, todo = {ident}, [ident]
        while todo:
            new = links[todo.pop()] - reach
            reach |= new
            todo += new
        r = found[ident]
        assert (r.n_links, r.component_id, r.kept) == (len(linked), min(reach), min(reach) == ident)
    assert not itq.near_duplicates(vectors.limit(0)).count()


def test_neighbours_reach_the_recall(vectors):
    rows = good(vectors.collect(), label=False)
    got = {}
    for r in rpforest.search(vectors, vectors.filter("vec_id % 5 = 0"), k=7, leaf_rows=8, chunk=10,
                             least_budget=400).collect():
        got.setdefault(r.query_id, {})[r.rank] = r
    hits = total = 0
    for q in (r for r in rows if r.vec_id % 5 == 0):
        exact = sorted((-float((np.array(q.embedding) * np.array(r.embedding)).sum()), r.vec_id)
                       for r in rows if r.vec_id != q.vec_id)[:7]
        mine = got[q.vec_id]
        assert sorted(mine) == list(range(1, 8))
        order = [(-mine[k].score, mine[k].vec_id) for k in sorted(mine)]
        assert order == sorted(order)
        hits += len({i for _, i in exact} & {i for _, i in order})
        total += 7
    assert set(got) == {r.vec_id for r in rows if r.vec_id % 5 == 0}
    assert hits / total >= 0.9
    assert not rpforest.search(vectors.limit(0), vectors).count()


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(2)
    bodies = ["", "same", "same\r\n\r\n", "é" * 5000, None, "x" * 300_000]
    urls = ["http://b.example/1", "https://A.example.org/p?q=1 2", None, "no url", "http://b.example/1"]
    rows = [(i, rng.choice(urls), rng.choice(bodies), "clash") for i in range(60)]
    rows += [rows[5], (None, "http://b.example/1", "same", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    found = warc.archive(pages.repartition(4), str(tmp_path / "w"), rows_per_range=20).collect()
    assert len(found) == len(rows)
    payload = {r[0]: (r[2] or "").encode() for r in rows}
    top = {}
    for r in rows:
        top[payload[r[0]]] = max(top.get(payload[r[0]], -1), -1 if r[0] is None else r[0])
    for r in found:
        body = payload[r.page_id]
        revisit = top[body] != r.page_id
        assert r.payload_bytes == len(body)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (r.record_type, r.refers_to) == (
            ("revisit", top[body]) if revisit else ("response", None))
    order = [(r.urlkey, r.ts) for r in sorted(found, key=lambda r: (r.range, r.position))]
    assert order == sorted(order)
    assert not warc.archive(pages.limit(0), str(tmp_path / "e")).count()


def test_loser_tree_merges():
    rng = random.Random(9)
    for k in range(1, 9):
        runs = [sorted(rng.randint(0, 30) for _ in range(rng.randint(0, 12))) for _ in range(k)]
        assert [runs[r][i] for r, i in warc.LoserTree(runs)] == sorted(sum(runs, []))
    assert list(warc.LoserTree([])) == []
