"""License scan: positional indexes of the rare words of each template, and phrase checks."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import Batches

# The phrases of the base scan and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Openings of published licenses, with a phrase that must be there.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge",
     "permission is hereby granted free of charge to any person obtaining a copy of this software "
     "and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "apache license version 2",
     "licensed under the apache license version 2 0 the license you may not use this file except "
     "in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "apache license version 2", "licensed under the apache license version 2 0"),
    ("gpl-3", "gnu general public license",
     "this program is free software you can redistribute it and or modify it under the terms of "
     "the gnu general public license as published by the free software foundation either version 3"),
    ("gpl-3", "gnu general public license version 3",
     "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license",
     "this library is free software you can redistribute it and or modify it under the terms of "
     "the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "mozilla public license v 2 0",
     "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms",
     "redistribution and use in source and binary forms with or without modification are "
     "permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software",
     "permission to use copy modify and or distribute this software for any purpose with or "
     "without fee is hereby granted"),
    ("cc-by-nc", "creative commons attribution noncommercial",
     "this work is licensed under a creative commons attribution noncommercial 4 0 international "
     "license"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike",
     "this work is licensed under a creative commons attribution sharealike 4 0 international "
     "license"),
    ("cc-by", "creative commons attribution 4 0",
     "this work is licensed under a creative commons attribution 4 0 international license"),
    ("proprietary", "all rights reserved", "copyright all rights reserved"),
)

COVERED = 0.6  # share of a template's words in place
AGREE = 3  # rare words that must agree on a relative position, where a template has so many to spare

_KEPT = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)


def words_of(blob: bytes | None) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters."""
    return blob.translate(_KEPT).split() if blob else []


def vocabulary(templates: Iterable[Sequence[str]]) -> set[bytes]:
    return {w for t in templates for w in t[2].encode().split()}


def document_frequency(docs: DataFrame, text_col: str, vocab: set[bytes]) -> dict[bytes, float]:
    """IDF of each license word over all documents; the result is as large as the vocabulary."""

    def count(batches: Batches) -> Batches:
        from collections import Counter

        from framewise.llm.common import blobs

        for batch in batches:
            seen: Counter[bytes] = Counter()
            for blob in blobs(batch["text"]):
                seen.update(vocab.intersection(words_of(blob)))
            seen[b""] += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                ["word", "n"],
            )

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word binary, n long")
    rows = {bytes(r.word): r.n for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = rows.pop(b"", 0)
    return {w: math.log((total + 1) / (rows.get(w, 0) + 0.5)) for w in vocab}


@dataclass(frozen=True)
class PositionalIndex:
    """Rare license words -> the templates that hold them, with their places there."""

    postings: dict[bytes, list[tuple[int, int]]]  # word -> (template, place)
    votes: list[int]  # words that must agree on a relative position, per template

    @staticmethod
    def of(
        bodies: Sequence[Sequence[bytes]], idf: dict[bytes, float], covered: float, agree: int = AGREE
    ) -> PositionalIndex:
        """The words of highest IDF of each template, with as many places as a match needs.

        A place where ``covered`` of a template's words stand has at most the
        others wrong. Of more indexed places than that, all but those agree on
        the relative position: ``agree`` of them, or as many as there can be. So
        no match is missed, however common its words are.
        """
        postings: dict[bytes, list[tuple[int, int]]] = {}
        votes = []
        for number, body in enumerate(bodies):
            places: dict[bytes, list[int]] = {}
            for at, word in enumerate(body):
                places.setdefault(word, []).append(at)
            wrong = math.floor((1 - covered) * len(body) + 1e-9)
            held = 0
            for word in sorted(places, key=lambda w: (-idf[w], w)):
                if held >= wrong + agree:
                    break
                postings.setdefault(word, []).extend((number, at) for at in places[word])
                held += len(places[word])
            votes.append(max(1, held - wrong))
        return PositionalIndex(postings, votes)

    def candidates(self, words: Sequence[bytes], idf: dict[bytes, float]) -> list[tuple[int, int]]:
        """(template, relative position) on which enough of the file's rare license words agree."""
        places: dict[bytes, list[int]] = {}
        for i, word in enumerate(words):
            if word in self.postings:
                places.setdefault(word, []).append(i)
        agreed: dict[tuple[int, int], int] = {}
        for word in sorted(places, key=lambda w: -idf[w]):
            for number, at in self.postings[word]:
                for i in places[word]:
                    spot = (number, i - at)
                    agreed[spot] = agreed.get(spot, 0) + 1
        return [spot for spot, n in agreed.items() if n >= self.votes[spot[0]]]


RESULT = (
    "struct<n_words: long, n_base: long, first_word: long, last_word: long, base_labels: string, "
    "labels: string, score: double>"
)


def scan_column(
    text: Column, idf: dict[bytes, float], phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[Sequence[str]] = TEMPLATES, covered: float = COVERED,
) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        from framewise.llm.common import blobs

        wanted = [(b" " + p.encode() + b" ", label) for p, label in phrases]
        bodies = [t[2].encode().split() for t in templates]
        musts = [b" " + t[1].encode() + b" " for t in templates]
        index = PositionalIndex.of(bodies, idf, covered)

        def one(blob: bytes | None) -> dict[str, Any]:
            words = words_of(blob)
            places, base = [], set()
            line = b" " + b" ".join(words) + b" "
            for phrase, label in wanted:
                at, seen, number = line.find(phrase), 0, 0
                while at >= 0:
                    number += line.count(b" ", seen, at)  # words before this place
                    places.append(number)
                    base.add(label)
                    at, seen = line.find(phrase, at + 1), at
            labels, best = set(base), 1.0 if base else 0.0
            for number, start in index.candidates(words, idf):
                body = bodies[number]
                lo, hi = max(start, 0), min(start + len(body), len(words))
                share = sum(words[i] == body[i - start] for i in range(lo, hi)) / len(body)
                if share < covered:
                    continue
                around = b" " + b" ".join(words[lo:hi]) + b" "
                if musts[number] in around:
                    labels.add(templates[number][0])
                    best = max(best, share)
            return {
                "n_words": len(words), "n_base": len(places),
                "first_word": min(places, default=None), "last_word": max(places, default=None),
                "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)),
                "score": best,
            }

        kind = pa.struct([
            ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
            ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()),
            ("score", pa.float64()),
        ])
        return pa.array([one(b) for b in blobs(texts)], kind)

    return F.arrow_udf(run, RESULT)(text)


def scan(
    docs: DataFrame, text_col: str = "text", templates: Sequence[Sequence[str]] = TEMPLATES,
    **params: Any,
) -> DataFrame:
    """``docs`` with a column ``license``: words, base places and labels, all labels, score.

    A file's license words of highest IDF (over all files) are looked up in an
    index word -> (template, position). Relative positions on which enough of
    them agree are candidates (``PositionalIndex``); one counts if COVERED of the
    template's words stand in place and its mandatory phrase is among them. So
    labels and score equal a scan over all templates and places. ``templates``
    are (label, mandatory phrase, words), in lower case; their words and IDF are
    held by the driver and every task.
    score is 1 for a base label, else the best covered share, else 0. Null and
    empty texts have no words, null positions and empty labels. Equal labels
    count once. An existing column ``license`` is replaced.
    """
    idf = document_frequency(docs, text_col, vocabulary(templates))
    return docs.withColumn("license", scan_column(F.col(text_col), idf, templates=templates, **params))
