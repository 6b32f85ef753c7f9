"""SentencePiece encoding over a relational lattice of substrings and pieces, and decoding."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm.common import buckets_for, pack, store, unpack

BUCKET_BYTES = 4 << 20  # of text; a bucket's lattice is sorted in one task's memory
# Units that recur in so many buckets of text get their cuts once for all buckets. Only
# the choice of these units rests on a sample, and their number bounds what is broadcast.
COMMON_BUCKETS = 8
COMMON_UNITS = 400_000
UNIT_ROWS = 20_000  # units that a task sends off at once
LATTICE_CHARS = 62  # longest unit whose cuts fit a long
EDGE = 6  # bits of a place in such a unit
# Units never merge with each other: no piece has a blank after another character, or these two.
ALONE = "\n\t"
UNIT = r"[\n\t]| *[^ \n\t]+| +"


@dataclass(frozen=True)
class Pieces:
    """The piece table of a model file; blanks are blanks, not their visible sign."""

    kind: str  # "bpe": best-ranked merge first; "unigram": best sum of scores
    pieces: dict[str, tuple[int, float]]  # text -> (id, score)
    bytes_of: list[bytes]  # id -> bytes that it stands for
    byte_ids: tuple[int, ...]  # of the 256 bytes; empty without byte fallback
    unknown: int

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    @cached_property
    def neighbours(self) -> set[str]:
        """Pairs of characters that stand together in some piece."""
        return {text[i : i + 2] for text in self.pieces for i in range(len(text) - 1)}

    @cached_property
    def faithful(self) -> bool:
        """Whether the ids of any unit spell it: no piece is unknown or stands for other bytes."""
        if any(self.bytes_of[i] != text.encode() for text, (i, _) in self.pieces.items()):
            return False
        return bool(self.byte_ids) and all(
            self.bytes_of[i] == bytes([b]) for b, i in enumerate(self.byte_ids)
        )

    def parts(self) -> Callable[[str], list[str]]:
        """Cuts a unit between two neighbours that stand together in no piece: nothing merges there."""
        inside = self.neighbours

        def run(unit: str) -> list[str]:
            found, at = [], 0
            for i in range(1, len(unit)):
                if unit[i - 1 : i + 1] not in inside:
                    found.append(unit[at:i])
                    at = i
            found.append(unit[at:])
            return found

        return run

    def base_ids(self, char: str) -> list[int]:
        """A single character: its piece, else its bytes, else the unknown piece."""
        known = self.pieces.get(char)
        if known:
            return [known[0]]
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unknown]


def load_pieces(model_file: str, kind: str = "bpe") -> Pieces:
    """Read a model file on the driver; a vocabulary is of bounded size."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces: dict[str, tuple[int, float]] = {}
    bytes_of, byte_ids = [], {}
    for i in range(model.get_piece_size()):
        name = model.id_to_piece(i)
        text = name.replace("▁", " ")
        if model.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
            bytes_of.append(bytes([int(name[3:5], 16)]))
        elif model.is_control(i):
            bytes_of.append(b"")
        elif model.is_unknown(i):
            bytes_of.append(" ⁇ ".encode())
        else:
            if not model.is_unused(i):
                pieces[text] = (i, model.get_score(i))
            bytes_of.append(text.encode())
    for text in pieces:
        if len(text) > 1 and (" " in text.lstrip(" ") or any(c in text for c in ALONE)):
            raise ValueError(f"piece {text!r} crosses the borders of units")
    ids = tuple(byte_ids[b] for b in range(256)) if len(byte_ids) == 256 else ()
    return Pieces(kind, pieces, bytes_of, ids, model.unk_id())


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """(piece, score, rank, late): pieces that can be an edge of the lattice, the best of rank 0.

    As long as nothing crosses the ends of a piece's place in a unit, merges
    within it are those of the piece's text alone. So a piece that its own text
    doesn't merge to is never formed, and one whose last merge ranks behind the
    merges of its two parts comes up in rank order. The others are ``late``.
    """
    order = sorted(pieces.pieces, key=lambda text: (-pieces.pieces[text][1], pieces.pieces[text][0]))
    rank = {text: i for i, text in enumerate(order)}
    rows = [("", 0.0, -1, False)]
    for text, (_, score) in pieces.pieces.items():
        if pieces.kind != "bpe":
            rows.append((text, float(score), rank[text], False))
        elif len(text) > 1:
            merges: list[tuple[float, int, int, int]] = []
            if len(long_stops(text, pieces, merges)) == 1:
                parts = [m[0] for m in merges[:-1]]
                late = bool(parts) and -score <= max(parts)
                rows.append((text, float(score), rank[text], late))
    return spark.createDataFrame(rows, "piece string, score double, rank long, late boolean")


def lattice(
    units: DataFrame, keys: list[str], pieces: Pieces, table: DataFrame | None = None
) -> DataFrame:
    """(keys, unit, edges, late): the pieces that occur in each unit, from a join of its substrings.

    Edges of a merge model are whole numbers of rank, start and stop (``EDGE``),
    in rank order; else (weight, start, stop). The piece table is a model's
    vocabulary and so of bounded size. A unit's edges are grouped by its number
    within the partition, which is faster to sort than its text.
    """
    table = table or store(piece_table(units.sparkSession, pieces))
    shortest = 2 if pieces.kind == "bpe" else 1
    n = F.char_length("unit")
    starts = (
        units.filter(n.between(shortest, LATTICE_CHARS))
        .withColumn("number", F.monotonically_increasing_id())
        .select("number", *keys, "unit", F.explode(F.sequence(F.lit(0), n - shortest)).alias("start"))
        .withColumn("head", F.expr(f"substring(unit, start + 1, {shortest + 1})"))
    )
    # Only sizes that some piece with the same first characters has.
    heads = (
        table.filter(F.char_length("piece") > shortest)
        .groupBy(F.substring("piece", 1, shortest + 1).alias("head"))
        .agg(F.collect_set(F.char_length("piece")).alias("sizes"))
    )
    sizes = F.concat(F.array(F.lit(shortest)), F.coalesce("sizes", F.array().cast("array<int>")))
    spans = (
        starts.join(F.broadcast(heads), "head", "left")
        .select("number", *keys, "unit", "start", F.explode(sizes).alias("size"))
        .filter(F.expr("start + size <= char_length(unit)"))
        .withColumn("piece", F.expr("substring(unit, start + 1, size)"))
    )
    found = spans.join(F.broadcast(table), "piece")
    edge = F.expr("struct(-score AS weight, start, start + size AS stop)")
    if pieces.kind == "bpe":
        edge = F.expr(f"shiftleft(rank, {2 * EDGE}) + shiftleft(start, {EDGE}) + start + size")
    return found.groupBy("number", *keys).agg(
        F.first("unit").alias("unit"), F.sort_array(F.collect_list(edge)).alias("edges"),
        F.max("late").alias("late"),
    ).select(*keys, "unit", "edges", "late")


def merged_cuts() -> Column:
    """Cuts of a unit after all merges, best rank first and leftmost among equals.

    Starts from a cut between any two characters. An edge can be applied when
    both its ends are cuts and exactly one cut lies between: then two
    neighbours join into a piece, and that cut goes. Edges are in rank order,
    so that one pass over them does all merges; a unit with a ``late`` edge
    looks for the best edge anew at each step.
    """
    def inner(e: str) -> str:
        return f"(shiftleft(1L, {stop.format(e)}) - shiftleft(2L, {start.format(e)}))"

    low = (1 << EDGE) - 1
    start, stop = f"CAST(shiftright({{}}, {EDGE}) & {low}L AS INT)", f"CAST({{}} & {low}L AS INT)"
    fits = (f"(shiftrightunsigned(cuts, {start.format('e')}) & 1L) = 1L AND "
            f"(shiftrightunsigned(cuts, {stop.format('e')}) & 1L) = 1L AND "
            f"bit_count(cuts & {inner('e')}) = 1")
    best = f"get(filter(edges, e -> {fits}), 0)"
    return F.expr(f"""IF(late,
        aggregate(sequence(1, char_length(unit) - 1), shiftleft(2L, char_length(unit)) - 1L,
            (cuts, i) -> coalesce(cuts & ~{inner(best)}, cuts)),
        aggregate(edges, shiftleft(2L, char_length(unit)) - 1L,
            (cuts, e) -> IF({fits}, cuts & ~{inner('e')}, cuts)))""")


def viterbi_cuts(unknown_score: float) -> Column:
    """Cuts of the path with the largest sum of scores; an unknown character costs a fixed score."""
    best = f"""aggregate(
        sequence(1, char_length(unit)), array(struct(0D AS total, 0 AS prev)),
        (best, at) -> concat(best, array(array_max(concat(
            array(struct(best[at - 1].total + {unknown_score!r}D AS total, at - 1 AS prev)),
            transform(filter(edges, e -> e.stop = at),
                e -> struct(best[e.start].total - e.weight AS total, e.start AS prev)))))))"""
    return F.expr(f"""aggregate(
        sequence(1, char_length(unit)),
        struct({best} AS best, char_length(unit) AS at, shiftleft(1L, char_length(unit)) AS cuts),
        (s, i) -> IF(s.at = 0, s, struct(s.best AS best, s.best[s.at].prev AS at,
            s.cuts | shiftleft(1L, s.best[s.at].prev) AS cuts)),
        s -> s.cuts)""")


def segment(
    units: DataFrame, keys: list[str], pieces: Pieces, table: DataFrame | None = None
) -> DataFrame:
    """(keys, unit, cuts) for the units that have edges; others are cut at every character."""
    edges = lattice(units, keys, pieces, table)
    if pieces.kind == "bpe":
        return edges.select(*keys, "unit", merged_cuts().alias("cuts"))
    lowest = min((s for _, s in pieces.pieces.values()), default=0.0)
    return edges.select(*keys, "unit", viterbi_cuts(lowest - 10.0).alias("cuts"))


def encode(
    docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text",
    buckets: int | None = None, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """(doc_id, ids, round_trip): the piece ids of each text, one row per input row.

    Texts are dealt to buckets by a hash and shuffled once, compressed. Within a
    bucket the distinct units (a run of blanks with the characters after it) get
    their lattice and cuts, and the texts are put together from them. Besides the
    texts only a bucket's units are exchanged. Common units get lattice and cuts
    once, before that, and every bucket looks them up. The others go to the
    lattice in parts, cut where no piece of the vocabulary can cross, so that
    parts that many units share come up once. Parts longer than LATTICE_CHARS
    are encoded where the texts are put together, by the same rule. Null and empty texts get no ids; repeated rows are encoded each;
    the visible blank sign counts as a blank; round_trip
    tells whether decoding the ids restores the text (it does without that sign).
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    n = buckets or buckets_for(docs, "text", bucket_bytes) + 1
    bucketed = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    dealt = bucketed.withColumn("text", pack(F.col("text"))).repartition(n, "bucket")
    table = store(piece_table(docs.sparkSession, pieces))
    sample = bucketed.filter(F.col("bucket") < COMMON_BUCKETS)
    common = store(
        sample.select(F.explode(_units()).alias("unit")).groupBy("unit").count()
        .filter((F.col("count") > 1) & (F.char_length("unit") <= LATTICE_CHARS))
        .orderBy(F.desc("count"), "unit").limit(COMMON_UNITS).select("unit")
    )
    context = docs.sparkSession.sparkContext
    ready = context.broadcast(_common_ids(common, segment(common, [], pieces, table), pieces))
    known = context.broadcast(pieces)  # a vocabulary
    # All columns of the dealt texts are read, so that their readers share one exchange.
    other = dealt.mapInArrow(_other_units(ready, known), "bucket int, unit string")
    cuts = segment(other.repartition(n, "bucket"), ["bucket"], pieces, table)
    cuts = cuts.withColumnRenamed("bucket", "cut_bucket")
    id_type = dealt.schema["doc_id"].dataType.simpleString()
    return (
        dealt.groupBy("bucket").cogroup(cuts.groupBy("cut_bucket"))
        .applyInArrow(_assemble(known, ready), f"doc_id {id_type}, ids array<int>, round_trip boolean")
    )


def _units() -> Column:
    """The units of ``text``."""
    shown = F.when(
        F.col("text") != "", F.replace(F.concat(F.lit(" "), "text"), F.lit("▁"), F.lit(" "))
    )
    return F.regexp_extract_all(shown, F.lit(UNIT), F.lit(0))


def _other_units(
    ready: Any, known: Any = None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(bucket, unit): the units that need a lattice of their own, each once per bucket and task.

    With a vocabulary (``known``) the parts of such units take their place. They
    leave in small batches, so that neither side holds those of many texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re
        from collections import defaultdict

        open_ = unpack()
        findall = re.compile(UNIT).findall
        common, _ = ready.value
        parts_of = known.value.parts() if known else None
        seen: dict[int, set[str]] = defaultdict(set)
        sent: dict[int, set[str]] = defaultdict(set)
        buckets: list[int] = []
        units: list[str] = []

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(buckets, pa.int32()), pa.array(units, pa.string())], ["bucket", "unit"]
            )
            buckets.clear()
            units.clear()
            return made

        for batch in batches:
            for packed, bucket in zip(batch["text"], batch["bucket"].to_pylist()):
                text = open_(packed.as_py()).decode() if packed.is_valid else ""
                if not text:
                    continue
                own = set(findall(" " + text.replace("▁", " "))) - seen[bucket]
                seen[bucket].update([u for u in own if len(u) <= LATTICE_CHARS])
                own = own.difference(common)
                if parts_of:
                    own = {p for u in own for p in parts_of(u) if len(p) > 1}.difference(common)
                    own -= sent[bucket]
                    sent[bucket].update(own)
                new = [u for u in own if len(u) <= LATTICE_CHARS]
                buckets += [bucket] * len(new)
                units += new
                if len(units) >= UNIT_ROWS:
                    yield batch_of()
        yield batch_of()

    return run


def _common_ids(
    common: DataFrame, cuts: DataFrame, pieces: Pieces
) -> tuple[dict[str, bytes], set[str]]:
    """Packed ids of the common units, at most COMMON_UNITS of LATTICE_CHARS at most, and the altered ones."""
    ids: dict[str, bytes] = {}
    for batch in common.join(cuts, "unit", "left").select("unit", "cuts").toArrow().to_batches(10_000):
        for unit, mask in zip(batch["unit"].to_pylist(), batch["cuts"].to_pylist()):
            ids[unit] = _ids_of(unit, _stops(unit, mask), pieces)
    return ids, {u for u, packed in ids.items() if not _spells(u, packed, pieces)}


def _spells(unit: str, packed: bytes, pieces: Pieces) -> bool:
    return b"".join(map(pieces.bytes_of.__getitem__, array("i", packed))) == unit.encode()


def _stops(unit: str, mask: int | None) -> list[int]:
    """Ends of a unit's pieces; without cuts, after every character."""
    if mask is None:
        return list(range(1, len(unit) + 1))
    stops, mask = [], mask & -2
    while mask:
        low = mask & -mask
        stops.append(low.bit_length() - 1)
        mask ^= low
    return stops


def _ids_of(unit: str, stops: list[int], pieces: Pieces) -> bytes:
    """Packed ids of the pieces of a unit."""
    ids, at, table = [], 0, pieces.pieces
    for stop in stops:
        known = table.get(unit[at:stop])
        if known is None:
            ids += pieces.base_ids(unit[at])
        else:
            ids.append(known[0])
        at = stop
    return array("i", ids).tobytes()


def _assemble(known: Any, ready: Any) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(texts: pa.Table, cuts: pa.Table) -> pa.Table:
        import re

        import numpy as np

        pieces: Pieces = known.value
        common, altered = ready.value
        altered = set(altered)  # units that their ids do not spell
        units, parts_of = re.compile(UNIT), pieces.parts()
        cut_of = dict(zip(cuts["unit"].to_pylist(), cuts["cuts"].to_pylist()))

        faithful = pieces.faithful

        def ids_of(unit: str, stops: list[int]) -> bytes:
            found = _ids_of(unit, stops, pieces)
            if not faithful and not _spells(unit, found, pieces):
                altered.add(unit)
            return found

        class Encoded(dict):
            def __missing__(self, unit: str) -> bytes:
                mask = cut_of.get(unit)
                if mask is not None:  # a part
                    found = ids_of(unit, _stops(unit, mask))
                elif len(own := parts_of(unit)) > 1:
                    found = b"".join([get(u) or self[u] for u in own])
                    if altered and not altered.isdisjoint(own):
                        altered.add(unit)
                else:
                    far = len(unit) > LATTICE_CHARS
                    found = ids_of(unit, long_stops(unit, pieces) if far else _stops(unit, None))
                if len(unit) <= LATTICE_CHARS:  # others are not kept: they may be large
                    self[unit] = found
                return found

        encoded = Encoded()
        get = common.get
        chunks, sizes, same = [], [], []
        open_ = unpack()
        for packed in texts["text"].to_pylist():
            parts: list[bytes] = []
            kept = True
            text = open_(packed).decode() if packed else ""
            if text:
                own = units.findall(" " + text.replace("▁", " "))
                parts = [get(u) or encoded[u] for u in own]
                kept = "▁" not in text and (not altered or altered.isdisjoint(own))
            chunks.append(b"".join(parts))
            sizes.append(len(chunks[-1]) // 4)
            same.append(kept)
        offsets = np.zeros(len(sizes) + 1, np.int32)
        np.cumsum(sizes, out=offsets[1:])
        flat = pa.array(np.frombuffer(b"".join(chunks), np.int32), pa.int32())
        ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
        return pa.table([texts["doc_id"], ids, pa.array(same, pa.bool_())],
                        names=["doc_id", "ids", "round_trip"])

    return run


def long_stops(
    unit: str, pieces: Pieces, merges: list[tuple[float, int, int, int]] | None = None
) -> list[int]:
    """Cuts of a unit too long for the lattice's bits, by a queue of merges or a running best.

    ``merges`` gets the merges in their order, (weight, start, middle, stop).
    """
    import heapq

    table, n = pieces.pieces, len(unit)
    if pieces.kind != "bpe":
        lowest = min((s for _, s in table.values()), default=0.0) - 10.0
        best = [(0.0, 0)] + [(float("-inf"), 0)] * n
        for stop in range(1, n + 1):
            options = [(best[stop - 1][0] + lowest, stop - 1)]
            for start in range(max(0, stop - pieces.longest), stop):
                if (known := table.get(unit[start:stop])):
                    options.append((best[start][0] + known[1], start))
            best[stop] = max(options)
        stops = [n]
        while best[stops[-1]][1]:
            stops.append(best[stops[-1]][1])
        return stops[::-1]
    after = list(range(1, n + 1))  # end of the symbol that starts here
    before = list(range(-1, n - 1))  # start of the symbol to the left
    alive = [True] * n
    queue: list[tuple[float, int, int, int]] = []

    def offer(left: int) -> None:
        middle = after[left]
        if middle < n and (known := table.get(unit[left : after[middle]])):
            heapq.heappush(queue, (-known[1], left, middle, after[middle]))

    for left in range(n - 1):
        offer(left)
    while queue:
        merge = heapq.heappop(queue)
        _, left, middle, stop = merge
        if not alive[left] or after[left] != middle or not alive[middle] or after[middle] != stop:
            continue
        if merges is not None:
            merges.append(merge)
        alive[middle] = False
        after[left] = stop
        if stop < n:
            before[stop] = left
            offer(left)
        if before[left] >= 0:
            offer(before[left])
    return [after[i] for i in range(n) if alive[i]]


def _spell(pieces: Pieces, ids: list[int]) -> bytes:
    text = b"".join(map(pieces.bytes_of.__getitem__, ids))
    return text[1:] if text[:1] == b" " else text


def decode(ids: Column, pieces: Pieces) -> Column:
    """The text of a list of ids; null gives null, bytes that are no UTF-8 give U+FFFD."""

    def run(lists: pa.Array) -> pa.Array:
        return pa.array(
            [None if x is None else _spell(pieces, x).decode("utf-8", "replace")
             for x in lists.to_pylist()], pa.string()
        )

    return F.arrow_udf(run, "string")(ids)
