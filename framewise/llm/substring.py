"""Removal of repeated passages: recurring phrases, class by class, found again by automata."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import Batches, buckets_for, pack, row_key, store, unpack

WINDOW = 20  # words
PHRASE = 6  # words of the phrase that stands for a window
BUCKET_BYTES = 6 << 20
CHUNK_WORDS = 1 << 18
OPENING = 8  # words of a passage that its automaton looks for; the rest is compared
OTHER = 2 * chr(0x10FFFF)  # of a word that is in no passage
LATE = (float("inf"),)
LAST = (1 << 63) - 1  # order of documents without an id: after all others


def _scanner(window: int, phrase: int) -> Callable[[list[bytes | None]], Iterator[dict[str, Any]]]:
    """Per chunk of documents: their runs of windows that share a smallest phrase.

    Each window is represented by the phrase in it with the smallest hash, the
    leftmost of equal ones. Equal windows have equal representatives at equal
    places, so a window can only recur where its representative does.
    """
    from itertools import chain

    import numpy as np
    import xxhash

    digest = xxhash.xxh64_intdigest
    base = np.uint64(0x9E3779B97F4A7C15)

    class Known(dict):
        def __missing__(self, word: bytes) -> int:
            if len(self) > 400_000:
                self.clear()
            self[word] = found = digest(word)
            return found

    known = Known()
    width = window - phrase + 1

    def mix(h):  # noqa: ANN001, ANN202
        h = h ^ (h >> np.uint64(29))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def grams(a, k: int):  # noqa: ANN001, ANN202
        n = len(a) - k + 1
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = h * base + a[j : n + j]
        return mix(h)

    def one(first: int, docs: list[list[bytes]]) -> dict[str, Any] | None:
        sizes = np.array([len(d) for d in docs])
        ends = np.cumsum(sizes)
        total = int(ends[-1])
        if total < window:
            return None
        every = chain.from_iterable(docs)
        a = np.fromiter(map(known.__getitem__, every), np.uint64, total)
        h = grams(a, phrase)
        low = np.uint64(32)
        least = (h >> low << low) | np.arange(len(h), dtype=np.uint64)
        reach = 1
        while reach < width:
            step = min(reach, width - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        owner = np.repeat(np.arange(len(docs)), sizes)[: len(place)]
        at = np.flatnonzero(np.arange(len(place)) + window <= ends[owner])
        if not len(at):
            return None
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(place[at]) != 0) | (np.diff(owner[at]) != 0)
        begins = np.flatnonzero(new)
        lo = at[begins]
        return {
            "doc": owner[lo] + first, "lo": lo - (ends - sizes)[owner[lo]], "at": lo,
            "count": np.diff(np.append(begins, len(at))), "h": h[place[lo]].view(np.int64),
            "windows": lambda: grams(a, window), "mix": mix, "base": base,
        }

    def scan(docs: list[bytes | None]) -> Iterator[dict[str, Any]]:
        first, held, size = 0, [], 0
        for i, doc in enumerate(docs):
            held.append((doc or b"").split())
            size += len(held[-1])
            if size >= CHUNK_WORDS or i == len(docs) - 1:
                if (found := one(first, held)) is not None:
                    yield found
                first, held, size = i + 1, [], 0

    return scan


def _phrases(window: int, phrase: int) -> Callable[[Batches], Batches]:
    """(h, bucket, n): representatives of a batch, counted."""

    def run(batches: Batches) -> Batches:
        import numpy as np

        from framewise.llm.common import blobs

        scan = _scanner(window, phrase)
        for batch in batches:
            bucket = batch["__bucket"].to_numpy()
            for found in scan(blobs(batch["__text"])):
                pairs = np.stack([found["h"], bucket[found["doc"]].astype(np.int64)])
                pairs, n = np.unique(pairs, axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[0]), pa.array(pairs[1].astype(np.int32)),
                     pa.array(n.astype(np.int32))], ["h", "bucket", "n"])

    return run


def _classes(window: int, phrase: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Runs of a bucket whose phrase recurs: one row per distinct run, at its first place here."""

    def run(docs: pa.Table, recurring: pa.Table) -> pa.Table:
        import numpy as np

        names = ["bucket", "h", "ctx", "doc", "rk", "lo", "count", "n", "windows"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(),
                 pa.int32(), pa.int64(), pa.binary()]
        wanted = np.sort(recurring["h"].to_numpy())
        open_ = unpack()
        texts = [open_(b) for b in docs["__text"].to_pylist()]
        ids, rows = docs["__doc"].to_numpy(), docs["__rk"].to_numpy()
        parts: list[list[Any]] = [[] for _ in names]
        if len(wanted):
            for found in _scanner(window, phrase)(texts):
                near = np.searchsorted(wanted, found["h"]).clip(max=len(wanted) - 1)
                use = np.flatnonzero(wanted[near] == found["h"])
                if not len(use):
                    continue
                at, count, h = found["at"][use], found["count"][use], found["h"][use]
                digests = found["windows"]()
                last = digests[at + count - 1]
                ctx = found["mix"](digests[at] * found["base"] + last * found["base"]
                                   * found["base"] + count.astype(np.uint64)).view(np.int64)
                doc = found["doc"][use]
                for out, column in zip(parts[1:8], (
                        h, ctx, ids[doc], rows[doc], found["lo"][use], count, np.ones_like(at))):
                    out.append(column)
                raw = digests.tobytes()
                parts[8].extend(raw[8 * i : 8 * (i + c)] for i, c in zip(at.tolist(), count.tolist()))
        if not parts[1]:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        columns = [np.concatenate(p) for p in parts[1:8]]
        h, ctx, doc, rk, lo = columns[:5]
        order = np.lexsort((lo, rk, doc, ctx, h))
        h, ctx = h[order], ctx[order]
        head = np.ones(len(order), bool)
        head[1:] = (np.diff(h) != 0) | (np.diff(ctx) != 0)
        heads = np.flatnonzero(head)
        n = np.diff(np.append(heads, len(order)))
        pick = order[heads]
        columns = [c[pick] for c in columns]
        columns[6] = n
        bucket = docs["__bucket"][0].as_py()
        arrays = [pa.array(np.full(len(pick), bucket), kinds[0])]
        arrays += [pa.array(c, k) for c, k in zip(columns, kinds[1:8])]
        arrays.append(pa.array([parts[8][i] for i in pick.tolist()], pa.binary()))
        return pa.table(arrays, names=names)

    return run


def _strip(window: int, fields: list[str], text: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Locate the passages of a bucket in all its documents and take repeated words out."""

    def run(docs: pa.Table, passages: pa.Table) -> pa.Table:
        import hashlib
        from itertools import repeat

        import ahocorasick
        import numpy as np

        open_ = unpack()
        texts = [open_(b) for b in docs["__text"].to_pylist()]
        words = [(t or b"").split() for t in texts]
        # A word is two symbols from separate ranges: matches keep to word borders, and no
        # node of the automaton has as many children as the bucket has words. Words that
        # are in no passage share one code.
        class Codes(dict):
            def __missing__(self, word: bytes) -> str:
                high, low = divmod(len(self), 256)
                self[word] = found = chr(low) + chr(256 + high)
                return found

        codes = Codes()
        place = {k: i for i, k in enumerate(zip(docs["__doc"].to_pylist(), docs["__rk"].to_pylist()))}
        automaton = ahocorasick.Automaton()
        openings: dict[str, dict[int, dict[str, Any]]] = {}
        rows = passages.to_pydict() if passages.num_rows else None
        if rows:
            for doc, rk, lo, count, hd, hr, hl, mask in zip(*[rows[c] for c in (
                    "doc", "rk", "lo", "count", "head_doc", "head_rk", "head_lo", "mask")]):
                size = count + window - 1
                key = "".join(map(codes.__getitem__, words[place[doc, rk]][lo : lo + size]))
                by_size = openings.setdefault(key[: 2 * OPENING], {})
                by_size.setdefault(size, {})[key] = (hd, hr, hl), mask
            for opening, by_size in openings.items():
                automaton.add_word(opening, by_size)
            automaton.make_automaton()
        kept_text, removed, digests = [], [], []
        for ws, doc, rk, original in zip(
                words, docs["__doc"].to_pylist(), docs["__rk"].to_pylist(), texts):
            gone = np.zeros(len(ws), bool)
            if rows and len(ws) >= window:
                code = "".join(map(codes.get, ws, repeat(OTHER)))
                hits = (
                    (end // 2 + 1 - OPENING, size, table)
                    for end, by_size in automaton.iter(code) for size, table in by_size.items()
                )
                for start, size, table in hits:
                    stop = start + size
                    head, mask = table.get(code[2 * start : 2 * stop], (LATE, 0))
                    if head < (doc, rk, start):
                        gone[start:stop] = True
                    if head != (doc, rk, start):
                        continue  # before the head: the run there has a class of its own
                    while mask:
                        j = (mask & -mask).bit_length() - 1
                        gone[start + j : start + j + window] = True
                        mask &= mask - 1
            out = int(gone.sum())
            left = b" ".join([w for w, g in zip(ws, gone.tolist()) if not g] if out else ws)
            digests.append(hashlib.sha256(left).hexdigest())
            removed.append(out)
            kept_text.append(None if original is None else (left if out else original).decode())
        columns = [
            pa.array(kept_text, pa.string()) if f == text else docs[f] for f in fields
        ]
        return pa.table(
            [*columns, pa.array([len(w) for w in words], pa.int64()),
             pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
            names=[*fields, "n_words", "n_removed", "kept_sha256"],
        )

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
    phrase: int = PHRASE, buckets: int | None = None, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``docs`` with repeated words taken out of the text, and n_words, n_removed, kept_sha256.

    A word goes if a window of ``window`` words over it also starts earlier:
    in a document of smaller id, or earlier in the same one. Windows are judged
    on the input. Texts that lose nothing stay as they are, others become the
    kept words joined by blanks.

    1. Every window is represented by its smallest phrase; phrases that occur
       once are set aside (no window with such a phrase recurs).
    2. In the buckets that hold a recurring phrase, runs of windows with one
       representative become passages; equal passages form a class, and the
       first place of each class is kept. Passages that share a phrase but not
       all their words are compared window by window, class against class.
    3. Each bucket compiles its confirmed passages to an automaton over words
       and streams all its documents through it. Every place behind a
       class's first is a repeat; at the first, those windows that another
       class has earlier.

    Texts cross the network twice, compressed; else only hashes and places do.
    Documents without an id come after all others. Rows equal in every column
    are one document and get the same result; rows that share only the id are
    ordered by a hash of the row. Null texts have no words and stay null; an
    empty table gives an empty one. Columns of the added names are replaced.
    """
    if not 0 < phrase <= window <= phrase + 63:
        raise ValueError("a window has 1 to 64 phrases")
    given = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_sha256")]
    # Inside, columns have names that clash with nothing.
    fields = [f"c{i}" for i in range(len(given))]
    id_col, text_col = (fields[given.index(c)] for c in (id_col, text_col))
    docs = docs.select(*given).toDF(*fields)
    n = buckets or buckets_for(docs, text_col, bucket_bytes) + 1
    keyed = docs.select(
        *[F.col(c) for c in fields if c != text_col],
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("__doc"),
        row_key(docs).alias("__rk"),
        F.col(text_col).alias("__text"),
    ).withColumn("__bucket", F.pmod(F.xxhash64("__doc", "__rk"), F.lit(n)).cast("int"))

    counted = store(keyed.select("__bucket", "__text").mapInArrow(
        _phrases(window, phrase), "h long, bucket int, n int"
    ))
    recurring = store(counted.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"))
    where = counted.select("h", "bucket").join(recurring, "h", "left_semi")

    packed = keyed.withColumn("__text", pack(F.col("__text")))
    texts = packed.select("__bucket", "__doc", "__rk", "__text").repartition(n, "__bucket")
    runs = store(
        texts.groupBy("__bucket").cogroup(where.groupBy("bucket")).applyInArrow(
            _classes(window, phrase),
            "bucket int, h long, ctx long, doc long, rk long, lo long, count int, n long, "
            "windows binary",
        )
    )
    classes = store(
        runs.groupBy("h", "ctx").agg(
            F.min(F.struct("doc", "rk", "lo")).alias("head"), F.sum("n").alias("n"),
            F.max("windows").alias("windows"),
        )
    )
    shared = store(classes.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h"))
    steps = F.sequence(F.lit(0), (F.octet_length("windows") / 8).cast("int") - 1)
    single = (
        classes.join(shared, "h", "left_semi")
        .select("h", "ctx", "head", "windows", F.explode(steps).alias("j"))
        .select(
            "h", "ctx", "j", F.expr("substring(windows, 8 * j + 1, 8)").alias("d"),
            F.expr("struct(head.doc AS doc, head.rk AS rk, head.lo + j AS lo)").alias("pos"),
        )
    )
    single = store(single)
    first = store(
        single.groupBy("h", "d").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("c"))
        .filter("c > 1").select("h", "d", "first")
    )
    masks = (
        single.join(first, ["h", "d"]).filter("first < pos")
        .groupBy("h", "ctx").agg(F.expr("bit_or(shiftleft(1L, j))").alias("mask"))
    )
    passages = store(
        classes.select("h", "ctx", "head", "n").join(masks, ["h", "ctx"], "left")
        .filter("n > 1 OR mask IS NOT NULL")
        .select("h", "ctx", F.col("head.doc").alias("head_doc"), F.col("head.rk").alias("head_rk"),
                F.col("head.lo").alias("head_lo"), F.coalesce("mask", F.lit(0)).alias("mask"))
    )
    placed = runs.select("bucket", "h", "ctx", "doc", "rk", "lo", "count").join(
        passages, ["h", "ctx"]
    ).drop("h", "ctx")
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([f"`{c}` {types[c]}" for c in fields])
    whole = packed.repartition(n, "__bucket")
    return (
        whole.groupBy("__bucket").cogroup(placed.groupBy("bucket"))
        .applyInArrow(_strip(window, fields, text_col),
                      f"{schema}, n_words long, n_removed long, kept_sha256 string")
        .toDF(*given, "n_words", "n_removed", "kept_sha256")
    )
