"""How text filters interact: every order of them, from one table-driven pass over the bytes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20  # text whose words share one hash table
BLOCK_BYTES = 4 << 20  # bytes that the transducer takes at a time

# Classes of bytes, states, and what a step tells.
BLANK, CAPITAL, SYMBOL, INNER, OTHER = range(5)
OUTSIDE, IN_WORD = range(2)
OPENS, CLOSES, IS_CAPITAL, IS_SYMBOL, IS_POINT = (1 << i for i in range(5))
MARKS = b"#$%&*|"


def tables() -> tuple[Any, Any, Any]:
    """Class of each byte; next state and tokens of each (state, class).

    A state is left by every class for the same next one whatever it was, so
    the state before a byte follows from the byte before it alone, and a block
    is a table lookup instead of a loop.
    """
    import numpy as np

    classes = np.full(256, OTHER, np.uint8)
    classes[[0x20, *range(0x09, 0x0E)]] = BLANK
    classes[0x41:0x5B] = CAPITAL
    classes[list(MARKS)] = SYMBOL
    classes[0x80:0xC0] = INNER  # inside a UTF-8 sequence
    state = np.array([[OUTSIDE if c == BLANK else IN_WORD for c in range(5)]] * 2, np.uint8)
    emits = np.zeros((2, 5), np.uint8)
    emits[IN_WORD, BLANK] |= CLOSES
    emits[OUTSIDE, [CAPITAL, SYMBOL, INNER, OTHER]] |= OPENS
    emits[:, CAPITAL] |= IS_CAPITAL
    emits[:, SYMBOL] |= IS_SYMBOL
    emits[:, [BLANK, CAPITAL, SYMBOL, OTHER]] |= IS_POINT
    return classes, state, emits


def transduce(data: Any, offsets: Any) -> dict[int, Any]:
    """Places where the pass over ``data`` (bytes of texts in a row) tells something, by what it tells.

    Text i is data[offsets[i]:offsets[i + 1]]. A text starts outside of words;
    a word that is open at its end closes there.
    """
    import numpy as np

    classes, state, emits = tables()
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    found: dict[int, list[Any]] = {k: [] for k in (OPENS, CLOSES, IS_CAPITAL, IS_SYMBOL, IS_POINT)}
    last = OUTSIDE
    for at in range(0, len(data), BLOCK_BYTES):
        kinds = classes[data[at : at + BLOCK_BYTES]]
        before = np.empty(len(kinds), np.uint8)
        before[0] = last
        before[1:] = state[OUTSIDE][kinds[:-1]]
        last = state[OUTSIDE][kinds[-1]]
        first, stop = np.searchsorted(heads, [at, at + len(kinds)])
        starts = heads[first:stop] - at
        cut_off = starts[before[starts] == IN_WORD] + at  # a text before ended in a word
        before[starts] = OUTSIDE
        told = emits[before, kinds]
        for k, places in found.items():
            places.append(np.flatnonzero(told & k) + at)
        found[CLOSES].append(cut_off)
    if last == IN_WORD:
        found[CLOSES].append(np.array([len(data)]))
    joined = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in found.items()}
    joined[CLOSES].sort()
    return joined


def new_words(data: Any, starts: Any, ends: Any, owner: Any) -> Any:
    """Marks the first-seen word spans of each text, by an open hash table of spans.

    All spans are inserted at once, round by round: a span takes a free slot,
    ends at a slot whose span has its text's number and all its bytes, or goes
    on to the next slot. Equal hashes alone decide nothing.
    """
    import numpy as np
    import xxhash

    n = len(starts)
    size = ends - starts
    padded = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
    shift = (8 * (8 - np.minimum(size, 8))).astype(np.uint64)
    head = np.ascontiguousarray(eights[starts + 8]).view("<u8").ravel()
    head = head << shift >> shift  # bytes behind a short word go
    tail = np.ascontiguousarray(eights[ends]).view("<u8").ravel()
    tail = np.where(size > 8, tail, np.uint64(0))
    long = np.flatnonzero(size > 16)  # head and tail hold all bytes of the others
    raw = memoryview(data)
    whole = np.zeros(n, np.uint64)
    for i in long.tolist():
        whole[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]])
    odd = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    mixed = (head * odd[0]) ^ ((tail ^ whole) * odd[1])
    mixed ^= ((owner.astype(np.uint64) << np.uint64(32)) + size.astype(np.uint64)) * odd[2]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * odd[0]
    slots = 1 << max(4, (2 * n).bit_length())
    slot = (mixed >> np.uint64(40)).astype(np.int64) & (slots - 1)
    table = np.full(slots, -1, np.int64)
    is_new = np.zeros(n, bool)
    todo = np.arange(n)
    while len(todo):
        at = slot[todo]
        free = table[at] < 0
        table[at[free]] = todo[free]  # one of several takes the slot
        held = table[at]
        is_new[todo[held == todo]] = True
        same = (
            (owner[held] == owner[todo]) & (size[held] == size[todo])
            & (head[held] == head[todo]) & (tail[held] == tail[todo])
        )
        for k in np.flatnonzero(same & (size[todo] > 16) & (held != todo)).tolist():
            i, j = todo[k], held[k]
            same[k] = raw[starts[i] : ends[i]] == raw[starts[j] : ends[j]]
        todo = todo[~same]
        slot[todo] = (slot[todo] + 1) & (slots - 1)
    return is_new


MEASURES = ("words", "distinct_words", "capitals", "symbols", "points")


def measured(data: Any, offsets: Any) -> dict[str, Any]:
    """The measures of each text of a run of texts."""
    import numpy as np

    told = transduce(data, offsets)

    def per_text(places: Any) -> Any:
        return np.diff(np.searchsorted(places, offsets))

    starts = told[OPENS]
    words = per_text(starts)
    owner = np.repeat(np.arange(len(offsets) - 1), words)
    is_new = new_words(data, starts, told[CLOSES], owner)
    return {
        "words": words, "distinct_words": per_text(starts[is_new]),
        "capitals": per_text(told[IS_CAPITAL]), "symbols": per_text(told[IS_SYMBOL]),
        "points": per_text(told[IS_POINT]),
    }


def measures(text: Column) -> Column:
    """Struct of words, distinct_words, capitals (A-Z), symbols and points (code points) of a text.

    Words are runs of bytes other than blanks (0x20, 0x09 to 0x0D), in whole
    texts of any length. A null text counts as an empty one: zeros.
    """

    def run(texts: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow.compute as pc

        raw = pc.fill_null(texts.cast(pa.binary()), b"")
        parts: list[dict[str, Any]] = []
        for first, stop in _runs(raw):
            run_of = raw.slice(first, stop - first)
            bounds = np.frombuffer(run_of.buffers()[1], np.int32)[run_of.offset :][: len(run_of) + 1]
            data = np.frombuffer(run_of.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
            parts.append(measured(data, (bounds - bounds[0]).astype(np.int64)))
        columns = [
            pa.array(np.concatenate([p[m] for p in parts] or [np.zeros(0, np.int64)]), pa.int64())
            for m in MEASURES
        ]
        return pa.StructArray.from_arrays(columns, list(MEASURES))

    schema = ", ".join(f"{m}: long" for m in MEASURES)
    return F.arrow_udf(run, f"struct<{schema}>")(text)


def _runs(raw: pa.BinaryArray) -> Iterator[tuple[int, int]]:
    """Rows in runs of about SLICE_BYTES, one row at least."""
    import pyarrow.compute as pc

    at = held = 0
    for i, n in enumerate(pc.binary_length(raw).to_pylist()):
        if held and held + n > SLICE_BYTES:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(raw):
        yield at, len(raw)


REPEAT = "E"  # the filter against texts that a smaller id has


def standard_filters(m: Column) -> dict[str, Column]:
    """Failure conditions by letter, of the struct of measures; REPEAT is found by the table."""
    return {
        "A": m["words"] < 100,
        "B": 100 * m["distinct_words"] < 80 * m["words"],
        "C": 100 * m["capitals"] > 10 * m["points"],
        "D": m["symbols"] > 0,
    }


def failures(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """(part, fails, n, good, toxic): rows of each part by the letters of all filters that they fail.

    A text fails REPEAT if a row with a smaller id has the same text anywhere
    in the table. Rows with a null id neither fail it nor let others fail; rows
    that share the smallest id all pass. Null texts are empty ones, null parts
    are ''. A row is good or toxic if any label row of its id says 1.

    Texts leave the first stage as digests. Equal rows are counted before each
    shuffle, so that a text of very many copies is a few rows per task; which
    id is the smallest is decided among one row per (text, part, label).
    """
    parts = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"),
        measures(F.col(text_col)).alias("m"),
    )
    letters = [
        F.when(fails, F.lit(letter)).otherwise(F.lit(""))
        for letter, fails in standard_filters(F.col("m")).items()
    ]
    rows = (
        parts.select("doc_id", "part", "digest", F.concat(*letters).alias("fails"))
        .groupBy("digest", "doc_id", "part", "fails").agg(F.count(F.lit(1)).alias("n"))
    )
    marks = labels.groupBy(F.col("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    known = F.col("doc_id").isNotNull()
    grouped = (
        rows.join(marks, "doc_id", "left")
        .select("digest", "doc_id", "part", "fails", "n",
                F.coalesce("good", F.lit(False)).alias("good"),
                F.coalesce("toxic", F.lit(False)).alias("toxic"))
        .groupBy("digest", "part", "fails", "good", "toxic")
        .agg(F.sum("n").alias("n"),
             F.min(F.when(known, F.struct("doc_id", "n"))).alias("least"),
             F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("unnamed"))
    )
    first = F.expr("min(least.doc_id) OVER (PARTITION BY digest)")
    passes = F.col("unnamed") + F.when(
        F.col("least.doc_id") == F.col("first"), F.col("least.n")
    ).otherwise(0)
    split = (
        grouped.withColumn("first", first)
        .withColumn("passes", passes)
        .select("part", "good", "toxic", F.explode(F.array(
            F.struct("fails", F.col("passes").alias("n")),
            F.struct(F.concat("fails", F.lit(REPEAT)).alias("fails"),
                     (F.col("n") - F.col("passes")).alias("n")),
        )).alias("x"))
        .select("part", "good", "toxic", "x.*")
        .filter("n > 0")
    )
    return split.groupBy("part", "fails").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def audit(found: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row per part, order of the filters and step, from the table of ``failures``.

    ``kept`` rows pass the filters up to this step; ``removed`` fail this one
    first; ``redundant`` fail it but were removed before; ``unique_fails`` fail
    it alone; ``good_lost`` and ``toxic_lost`` are among the removed;
    ``shapley`` sums what this filter removes over all orders. A part without
    rows in a case has zero; no parts give no rows. The input has at most
    2 ** len(letters) rows per part, whatever the number of documents.
    """
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = F.sequence(F.lit(1), F.lit(len(letters)))
    cases = (
        found.select("*", F.explode(orders).alias("filter_order"))
        .select("*", F.explode(steps).alias("step"))
        .withColumn("letter", F.expr("substring(filter_order, step, 1)"))
        .withColumn("passed", F.expr(
            "char_length(translate(left(filter_order, step - 1), fails, '')) = step - 1"))
        .withColumn("hit", F.expr("instr(fails, letter) > 0"))
    )

    def total(what: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")

    hit, passed = F.col("hit"), F.col("passed")
    # Of the orders of its failures, each filter comes first in an equal share.
    share = F.expr(f"n * ({factorial(len(letters))} div char_length(fails))")
    return cases.groupBy("part", "filter_order", "step").agg(
        total("n", passed & ~hit).alias("kept"),
        total("n", passed & hit).alias("removed"),
        total("n", ~passed & hit).alias("redundant"),
        total("n", F.col("fails") == F.col("letter")).alias("unique_fails"),
        total("good", passed & hit).alias("good_lost"),
        total("toxic", passed & hit).alias("toxic_lost"),
        F.sum(F.when(hit, share).otherwise(0)).cast("long").alias("shapley"),
    )


def audit_sql() -> str:
    """The audit of ``documents`` and ``labels`` in DuckDB's SQL."""
    letters = "ABCDE"
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations(letters))
    blank = r"[^\x20\x09-\x0D]+"
    return rf"""
    WITH base AS (
      SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body FROM documents
    ), words AS (
      SELECT *, regexp_extract_all(body, '{blank}') AS found,
             min(doc_id) OVER (PARTITION BY body) AS first_id FROM base
    ), failing AS (
      SELECT doc_id, part,
        CASE WHEN len(found) < 100 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(found)) < 80 * len(found) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body)
           THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN first_id < doc_id THEN 'E' ELSE '' END AS fails
      FROM words
    ), marks AS (
      SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
             max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
    ), patterns AS (
      SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good,
             coalesce(sum(toxic), 0) AS toxic
      FROM failing LEFT JOIN marks USING (doc_id) GROUP BY part, fails
    ), orders AS (
      SELECT * FROM (VALUES {orders}) AS o(filter_order)
    ), steps AS (
      SELECT * FROM (VALUES (1), (2), (3), (4), (5)) AS s(step)
    ), cases AS (
      SELECT *, substring(filter_order, step, 1) AS letter,
        length(translate(substring(filter_order, 1, step - 1), fails, '')) = step - 1 AS passed,
        strpos(fails, substring(filter_order, step, 1)) > 0 AS hit
      FROM patterns CROSS JOIN orders CROSS JOIN steps
    )
    SELECT part, filter_order, CAST(step AS INTEGER) AS step,
      CAST(sum(CASE WHEN passed AND NOT hit THEN n ELSE 0 END) AS BIGINT) AS kept,
      CAST(sum(CASE WHEN passed AND hit THEN n ELSE 0 END) AS BIGINT) AS removed,
      CAST(sum(CASE WHEN NOT passed AND hit THEN n ELSE 0 END) AS BIGINT) AS redundant,
      CAST(sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
      CAST(sum(CASE WHEN passed AND hit THEN good ELSE 0 END) AS BIGINT) AS good_lost,
      CAST(sum(CASE WHEN passed AND hit THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
      CAST(sum(CASE WHEN hit THEN n * (120 // length(fails)) ELSE 0 END) AS BIGINT) AS shapley
    FROM cases GROUP BY part, filter_order, step
    """
