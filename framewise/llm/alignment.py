"""Alignment of two tokenizers over the same text, by divide and conquer at shared cuts."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate, chain
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import store

# A text is first cut before blanks that follow a visible character: there tokens of both
# sides end always (``Coders`` checks that the vocabularies agree with this).
UNIT = re.compile(r" *[^ ]+(?:(?<=\s) +[^ ]+)*| +")
SLICE_BYTES = 2 << 20  # text that is aligned at once
KNOWN_BYTES = 24 << 20  # text of the units that a worker remembers
COMMON = 1_000_000  # pairs that hold at least this share of all links are looked up in memory


@dataclass(frozen=True)
class Coders:
    """The files of a byte-level BPE tokenizer (A) and a piece model (B), as shipped to tasks."""

    byte_json: str
    piece_model: bytes


def load_coders(byte_file: str, piece_file: str) -> Coders:
    """Read both files on the driver."""
    with open(byte_file, encoding="utf-8") as f, open(piece_file, "rb") as g:
        return Coders(f.read(), g.read())


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: visible Latin-1 as it is, others from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def leaf_groups(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Where the groups of two token sequences stop, as (tokens of a, tokens of b).

    ``a`` and ``b`` are the ends of the tokens in bytes, strictly rising and with
    the same last one. A common end near the middle is sought outward by
    bisection and both halves are cut in the same way; an interval without a
    common end is a group. What a search has passed is not searched again, so
    the whole takes n bisections.
    """
    stops: list[tuple[int, int]] = []
    # (first and last token of the interval, ends of a that may still be common)
    todo = [(0, len(a), 0, len(b), 0, len(a) - 1)] if a else []
    while todo:
        a0, a1, b0, b1, low, high = todo.pop()
        while low < high:
            right = (low + high) // 2
            left = right - 1
            cut = -1
            while left >= low or right < high:
                if right < high:
                    j = bisect_left(b, a[right], b0, b1)
                    if b[j] == a[right]:
                        cut = right
                        right += 1
                        break
                    right += 1
                if left >= low:
                    j = bisect_left(b, a[left], b0, b1)
                    if b[j] == a[left]:
                        cut = left
                        left -= 1
                        break
                    left -= 1
            if cut < 0:
                break
            todo.append((cut + 1, a1, j + 1, b1, right, high))
            a1, b1, high = cut + 1, j + 1, left + 1
        stops.append((a1, b1))
    return stops


def overlaps(
    a: Sequence[int], b: Sequence[int], first: tuple[int, int], stop: tuple[int, int]
) -> Iterator[tuple[int, int]]:
    """The pairs of tokens of a group that share bytes, in order."""
    (i, j), (m, n) = first, stop
    while i < m and j < n:
        yield i, j
        end_a, end_b = a[i], b[j]
        i += end_a <= end_b
        j += end_b <= end_a


class Aligner:
    """Both tokenizers and the alignment of the units met so far; one per Python worker."""

    def __init__(self, coders: Coders) -> None:
        import json

        import numpy as np
        import sentencepiece
        from tokenizers import Tokenizer

        self.np = np
        self.a = Tokenizer.from_str(coders.byte_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=coders.piece_model)
        letters = byte_letters()
        names = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = {i: bytes(letters[c] for c in name) for name, i in names.items()}
        self.b_bytes = []
        crossing = False
        for i in range(self.b.get_piece_size()):
            name = self.b.id_to_piece(i)
            text = name.replace("▁", " ")
            crossing |= " " in text.lstrip(" ")
            self.b_bytes.append(bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else text.encode())
        self.a_size = {i: len(spelt) for i, spelt in self.a_bytes.items()}
        self.b_size = list(map(len, self.b_bytes))
        self.shown = list(map(str, range(max(max(self.a_bytes, default=-1) + 1, len(self.b_bytes)))))
        self.blank = self.b.piece_to_id("▁")
        before = json.loads(coders.byte_json)["pre_tokenizer"] or {}
        cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True)
        self.cuts = cuts and not crossing  # else a whole text is one unit
        self.forget()

    def forget(self) -> None:
        np = self.np
        self.number: dict[str, int] = {}
        self.size = 0
        self.texts: list[str | None] = []  # groups of a unit; None: a side does not spell it
        self.pair_number: dict[tuple[int, int], int] = {}
        self.pairs = np.zeros((0, 2), np.int32)
        # tokens of a, tokens of b, groups, links of each unit, and where its links start
        self.counts = np.zeros((0, 4), np.int64)
        self.links = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)

    def units(self, text: str) -> list[str]:
        return UNIT.findall(" " + text) if self.cuts else [" " + text]

    def spelled(self, units: list[str]) -> Iterator[tuple[list[str], list[int], list[int]]]:
        """Runs of units with their ids on both sides; a unit that a side does not spell is left out."""
        if not units:
            return
        whole = "".join(units)
        a = self.a.encode(whole, add_special_tokens=False).ids
        b = self.b.encode(whole[1:]) if len(whole) > 1 else [self.blank]
        raw = whole.encode()
        if "▁" not in whole and all(
            b"".join(map(known.__getitem__, ids)) == raw
            for known, ids in ((self.a_bytes, a), (self.b_bytes, b))
        ):
            yield units, a, b
        elif len(units) > 1:
            half = len(units) // 2
            yield from self.spelled(units[:half])
            yield from self.spelled(units[half:])

    def learn(self, units: Iterable[str]) -> None:
        """Align units that are not known yet, many at once: their borders are shared cuts."""
        np = self.np
        new = list(dict.fromkeys(units))
        if self.size > KNOWN_BYTES:
            raise RuntimeError("forget() comes before learn()")
        counts, links = [], []
        numbers, number = self.pair_number, self.pair_number.setdefault
        spelt: set[str] = set()
        # A unit that ends in blanks, as at the end of a text, would run into the next.
        joined = [u for u in new if not u[-1].isspace()]
        alone = [[u] for u in new if u[-1].isspace()]
        for run, a, b in chain.from_iterable(map(self.spelled, [joined, *alone])):
            ends_a = list(accumulate(map(self.a_size.__getitem__, a)))
            ends_b = list(accumulate(map(self.b_size.__getitem__, b)))
            stops = iter(leaf_groups(ends_a, ends_b))
            shown_a = list(map(self.shown.__getitem__, a))
            shown_b = list(map(self.shown.__getitem__, b))
            i = j = end = 0
            for unit in run:
                end += len(unit) if unit.isascii() else len(unit.encode())
                i0, j0, groups, before = i, j, [], len(links)
                while not i or ends_a[i - 1] < end:
                    m, n = next(stops)
                    if m - i == 1:  # all of b's tokens lie within the one of a
                        if n - j == 1:
                            groups.append(f"{shown_a[i]}|{shown_b[j]}")
                            links.append(number((a[i], b[j]), len(numbers)))
                        else:
                            groups.append(f"{shown_a[i]}|{','.join(shown_b[j:n])}")
                            for y in b[j:n]:
                                links.append(number((a[i], y), len(numbers)))
                    else:
                        groups.append(f"{','.join(shown_a[i:m])}|{','.join(shown_b[j:n])}")
                        for x, y in overlaps(ends_a, ends_b, (i, j), (m, n)):
                            links.append(number((a[x], b[y]), len(numbers)))
                    i, j = m, n
                if ends_a[i - 1] != end:
                    raise ValueError(f"tokens cross the border of the unit {unit!r}")
                self.number[unit] = len(self.texts)
                self.texts.append(";".join(groups))
                counts.append((i - i0, j - j0, len(groups), len(links) - before))
                spelt.add(unit)
        for unit in new:
            self.size += len(unit)
            if unit not in spelt:
                self.number[unit] = len(self.texts)
                self.texts.append(None)
                counts.append((0, 0, 0, 0))
        added = np.array(counts, np.int64).reshape(-1, 4)
        first = len(self.links) + np.cumsum(added[:, 3]) - added[:, 3]
        self.counts = np.concatenate([self.counts, added])
        self.starts = np.concatenate([self.starts, first])
        self.links = np.concatenate([self.links, np.array(links, np.int32)])
        fresh = list(self.pair_number)[len(self.pairs) :]
        self.pairs = np.concatenate([self.pairs, np.array(fresh, np.int32).reshape(-1, 2)])

    def align(self, texts: list[str | None]) -> tuple[list[str], Any, Any]:
        """Per text its groups as text and its four counts; then (text, pair a, pair b, links) of all."""
        np = self.np
        cut = [self.units(t) if t else [] for t in texts]
        if self.size > KNOWN_BYTES:
            self.forget()
        self.learn(u for units in cut for u in units if u not in self.number)
        numbers = [list(map(self.number.__getitem__, units)) for units in cut]
        groups: list[str] = []
        for i, own in enumerate(numbers):
            parts = [self.texts[u] for u in own]
            if None in parts:
                parts, numbers[i] = [], []
            groups.append(";".join(parts))  # type: ignore[arg-type]
        sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
        flat = np.fromiter((u for own in numbers for u in own), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(numbers)), sizes)
        sums = np.zeros((len(numbers), 4), np.int64)
        filled = sizes > 0
        if filled.any():
            at = (np.cumsum(sizes) - sizes)[filled]
            sums[filled] = np.add.reduceat(self.counts[flat], at, axis=0)
        n_links = self.counts[flat, 3]
        ahead = np.cumsum(n_links) - n_links
        places = np.repeat(self.starts[flat] - ahead, n_links) + np.arange(int(n_links.sum()))
        key = np.repeat(owner, n_links) * max(len(self.pairs), 1) + self.links[places]
        key, times = np.unique(key, return_counts=True)
        text, pair = np.divmod(key, max(len(self.pairs), 1))
        return groups, sums, (text, self.pairs[pair, 0], self.pairs[pair, 1], times)


_ALIGNERS: dict[int, Aligner] = {}


def aligner(coders: Coders) -> Aligner:
    """The worker's aligner; it outlives a task."""
    key = hash((coders.byte_json, coders.piece_model))
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(coders)
    return _ALIGNERS[key]


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``most`` bytes of text, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)


LINKED = "n_a long, n_b long, n_groups long, n_links long, {groups} string, a array<int>, b array<int>, times array<int>"


def align(
    docs: DataFrame, coders: Coders, id_col: str = "doc_id", text_col: str = "text",
    digest: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, groups, and its linked id pairs.

    Both tokenizers encode a blank and the text, without special tokens.
    ``groups`` is `a1,a2|b1;a3|b2`: the ids between neighbouring shared cuts.
    ``a``, ``b`` and ``times`` list the different pairs of ids whose bytes
    overlap, and how often. Null and empty texts, and texts that a side does not
    spell byte by byte, have no tokens: zeros, '' and empty lists. Repeated rows
    and null ids each get a row, other columns are not read. With ``digest``,
    groups_sha256 takes the place of groups ('' without tokens).
    """
    known = docs.sparkSession.sparkContext.broadcast(coders)  # a vocabulary
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    name = "groups_sha256" if digest else "groups"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        worker = aligner(known.value)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                groups, sums, (text, a, b, times) = worker.align(part.column("text").to_pylist())
                if digest:
                    groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                offsets = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)), pa.int32())
                lists = [
                    pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (a, b, times)
                ]
                counts = [pa.array(sums[:, i], pa.int64()) for i in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *counts, pa.array(groups, pa.string()), *lists],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", name, "a", "b", "times"],
                )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, {LINKED.format(groups=name)}")


def _flat(batch: pa.RecordBatch) -> tuple[Any, Any, Any]:
    """Rows, pair keys (a, then b, in one long) and times of all pairs of a batch."""
    import numpy as np

    a, b, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("a", "b", "times"))
    sizes = np.diff(batch.column("a").offsets.to_numpy())
    key = (a.astype(np.int64) << 32) | b
    return np.repeat(np.arange(batch.num_rows), sizes), key, times.astype(np.int64)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best): links of each id pair over all texts; best if no other a has more with this b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            _, key, times = _flat(batch)
            pairs, place = np.unique(key, return_inverse=True)
            n = np.bincount(place, times, len(pairs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (pairs >> 32, pairs & 0xFFFFFFFF, n)], ["a", "b", "n"]
            )

    counted = store(
        aligned.select("a", "b", "times").mapInArrow(run, "a long, b long, n long")
        .groupBy("a", "b").agg(F.sum("n").alias("n"))
    )
    tops = counted.groupBy("b").agg(F.max("n").alias("top"))  # a row per entry of B's vocabulary
    return counted.join(F.broadcast(tops), "b").select(
        "a", "b", "n", (F.col("n") == F.col("top")).alias("best")
    )


def scored(
    docs: DataFrame, coders: Coders, id_col: str = "doc_id", text_col: str = "text",
    common: int = COMMON,
) -> DataFrame:
    """``align`` with groups_sha256, and how well each text's links fit the corpus: n_best, count_sum.

    n_best counts the links whose pair no other A id outdoes for the same B id
    over all texts, ties included; count_sum adds the pairs' counts. Pairs
    that hold a ``common``-th of all links or more, so at most ``common`` of
    them, are looked up in the task; all others are joined by the pair.
    """
    aligned = store(
        align(docs, coders, id_col, text_col, digest=True)
        .withColumn("row", F.monotonically_increasing_id())
    )
    counts = store(pair_counts(aligned))
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    often = F.col("n") * common >= total
    top = counts.filter(often).toArrow()
    known = docs.sparkSession.sparkContext.broadcast(_table(top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        keys, n, best = known.value
        for batch in batches:
            row, key, times = _flat(batch)
            at = np.searchsorted(keys, key)
            at[at == len(keys)] = 0
            hit = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            sums = [
                _sums(row[hit], w, batch.num_rows)
                for w in (times[hit] * best[at[hit]], times[hit] * n[at[hit]])
            ]
            row, key, times = row[~hit], key[~hit], times[~hit]
            offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            rest = pa.StructArray.from_arrays(
                [pa.array(x) for x in (key >> 32, key & 0xFFFFFFFF, times)], ["a", "b", "times"]
            )
            kept = [c for c in batch.schema.names if c not in ("a", "b", "times")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *map(pa.array, sums),
                 pa.ListArray.from_arrays(offsets, rest)],
                [*kept, "n_best", "count_sum", "rest"],
            )

    kept = ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema
        if f.name not in ("a", "b", "times")
    )
    partial = store(aligned.mapInArrow(
        run, f"{kept}, n_best long, count_sum long, rest array<struct<a: long, b: long, times: long>>"
    ))
    rare = (
        partial.select("row", F.explode("rest").alias("p")).select("row", "p.*")
        .join(counts.filter(~often), ["a", "b"])
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"),
             F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    )
    return partial.join(rare, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )


def _table(counts: pa.Table) -> tuple[Any, Any, Any]:
    """Sorted pair keys with their counts and best marks."""
    import numpy as np

    a, b, n, best = (counts[c].to_numpy() for c in ("a", "b", "n", "best"))
    key = (a.astype(np.int64) << 32) | b.astype(np.int64)
    order = np.argsort(key)
    return key[order], n[order].astype(np.int64), best[order].astype(np.int64)


def _sums(row: Any, weight: Any, n: int) -> Any:
    """Exact sums of whole numbers by row; rows rise."""
    import numpy as np

    ahead = np.concatenate([[0], np.cumsum(weight)])
    edges = np.searchsorted(row, np.arange(n + 1))
    return (ahead[edges[1:]] - ahead[edges[:-1]]).astype(np.int64)
