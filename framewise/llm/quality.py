"""Ordinal quality classifier: one score, ordered thresholds, hashed text features."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import fresh_names

GRADES = 3
SAMPLE_ROWS = 8_000  # labelled documents that the model is fitted on, at most
MIN_DOCS = 8  # a feature counts if so many, or a hundredth, of the fitted documents have it
SPACE = 1 << 24  # slots that features are hashed to
PREFIX = 4
KNOWN_WORDS = 250_000  # whose features a task holds at once
SLICE = 256  # texts that are Python strings at once
KEEP_FROM = 0.25  # smallest probability of the top grade that is kept


@dataclass
class OrdinalModel:
    """P(grade >= k) = sigmoid(score - cuts[k - 1]); score sums the weights of a text's features."""

    cuts: list[float]
    weights: dict[int, float] = field(default_factory=dict)
    fitted_on: int = 0

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. top, one row per score."""
        return _sigmoid(scores[:, None] - np.asarray(self.cuts)[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -50, 50)))


def _slices(rows: pa.RecordBatch | pa.Array) -> Iterator[pa.RecordBatch | pa.Array]:
    return (rows.slice(at, SLICE) for at in range(0, len(rows), SLICE))


def _features(
    space: int, prefix: int, wanted: Iterable[int] | None = None
) -> Callable[[str], dict[int, float]]:
    """Hashed features of a text and their values; only the ``wanted`` ones, if named.

    Words and word starts count as present or not. Word shapes (runs of capital
    letters, small letters, digits; other characters as they are) count by the
    root of their share of the words. Each distinct word is looked at once.
    """
    import re
    from collections import Counter

    import xxhash

    digest = xxhash.xxh32_intdigest
    core = re.compile(r"[^\W_]+")
    runs = [(re.compile(p), r) for p, r in (
        (r"[A-ZÀ-ÖØ-Þ]+", "A"), (r"[a-zß-öø-ÿ]+", "a"), (r"[0-9]+", "0"), (r"(.)\1+", r"\1\1"))]

    class Known(dict):
        def __missing__(self, word: str) -> tuple[tuple[int, ...], int]:
            if len(self) > KNOWN_WORDS:
                self.clear()
            shape = word
            for pattern, to in runs:
                shape = pattern.sub(to, shape)
            slots = set()
            for part in core.findall(word.lower()):
                slots.add(digest("w:" + part) % space)
                if len(part) > prefix:
                    slots.add(digest("p:" + part[:prefix]) % space)
            shape = digest("s:" + shape) % space
            if own is not None:
                slots, shape = [own[s] for s in slots if s in own], own.get(shape, -1)
            found = tuple(slots), shape
            if len(word) <= 256:
                self[word] = found
            return found

    known = Known()
    own = None if wanted is None else {s: s for s in wanted}  # the words share these numbers

    def of(text: str) -> dict[int, float]:
        counts = Counter(text.split())
        total = sum(counts.values())
        values: dict[int, float] = {}
        shapes: Counter[int] = Counter()
        for word, n in counts.items():
            slots, shape = known[word]
            shapes[shape] += n
            for slot in slots:
                values[slot] = 1.0
        for shape, n in shapes.items():
            if shape >= 0:
                values[shape] = values.get(shape, 0.0) + (n / total) ** 0.5
        return values

    return of


def fit(
    docs: DataFrame, grades: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    grade_col: str = "grade", levels: int = GRADES, sample_rows: int = SAMPLE_ROWS,
    space: int = SPACE, min_docs: int = MIN_DOCS, steps: int = 250, penalty: float = 2e-4,
) -> OrdinalModel:
    """Fit on at most ``sample_rows`` graded documents, chosen by a hash of their id.

    The proportional-odds likelihood is maximised with a ridge penalty; the
    thresholds stay in order because their gaps are exponentials. Grades that
    are null or outside 0 .. levels - 1, null ids and null texts are left out;
    an id graded more than once counts with its lowest grade. Without graded
    documents, or with a single grade among them, the model has no weights and
    gives every text the top grade.
    """
    chosen = (
        grades.select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade"))
        .filter(F.col("id").isNotNull() & F.col("grade").between(0, levels - 1))
        .groupBy("id").agg(F.min("grade").alias("grade"))
        .orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    )  # at most sample_rows short rows: proven small enough to broadcast
    graded = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .filter(F.col("text").isNotNull())
        .join(F.broadcast(chosen), "id")
    )

    def extract(batches):  # noqa: ANN001, ANN202
        of = _features(space, PREFIX)
        for batch in (part for whole in batches for part in _slices(whole)):
            rows = [of(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["grade"],
                 pa.array([list(r) for r in rows], pa.list_(pa.int32())),
                 pa.array([list(r.values()) for r in rows], pa.list_(pa.float32()))],
                ["id", "grade", "slots", "values"],
            )

    id_type = graded.schema["id"].dataType.simpleString()
    found = graded.mapInArrow(
        extract, f"id {id_type}, grade int, slots array<int>, values array<float>"
    ).dropDuplicates(["id"]).toArrow().sort_by("id")
    y = found["grade"].to_numpy().astype(int)
    if len(y) == 0 or len(set(y.tolist())) < 2:
        return OrdinalModel([-50.0] * (levels - 1), {}, len(y))
    slots = found["slots"].combine_chunks()
    value = found["values"].combine_chunks().values.to_numpy()
    del found
    row = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(slots.offsets.to_numpy()))
    names, at, seen = np.unique(slots.values.to_numpy(), return_inverse=True, return_counts=True)
    del slots
    used = seen >= min(min_docs, max(1, len(y) // 100))
    place = np.cumsum(used) - 1
    mask = used[at]
    row, col, value = row[mask].astype(int), place[at[mask]], value[mask].astype(float)
    del at, mask
    weights, cuts = _ascend(row, col, value, y, int(used.sum()), levels, steps, penalty)
    return OrdinalModel(cuts.tolist(), dict(zip(names[used].tolist(), weights.tolist())), len(y))


def _ascend(row, col, value, y, width, levels, steps, penalty):  # noqa: ANN001, ANN202
    """Adam on weights and thresholds; everything is in the order of the sample."""
    n = len(y)
    share = np.array([np.mean(y >= k) for k in range(1, levels)]).clip(1e-3, 1 - 1e-3)
    cuts = -np.log(share / (1 - share))
    cuts = np.maximum.accumulate(cuts + 1e-3 * np.arange(levels - 1))
    params = np.concatenate([
        np.zeros(width), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))
    ])
    m = np.zeros_like(params)
    v = np.zeros_like(params)
    for step in range(1, steps + 1):
        w, first, gaps = params[:width], params[width], np.exp(params[width + 1 :])
        cuts = first + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(row, value * w[col], n)
        tail = _sigmoid(score[:, None] - cuts[None, :])
        edge = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
        slope = np.zeros((n, levels + 1))
        slope[:, 1:levels] = tail * (1 - tail)
        chance = np.maximum(edge[np.arange(n), y] - edge[np.arange(n), y + 1], 1e-12)
        by_score = -(slope[np.arange(n), y] - slope[np.arange(n), y + 1]) / chance / n
        by_cut = np.zeros(levels + 1)
        np.add.at(by_cut, y, slope[np.arange(n), y] / chance / n)
        np.add.at(by_cut, y + 1, -slope[np.arange(n), y + 1] / chance / n)
        by_cut = by_cut[1:levels]
        grad = np.concatenate([
            np.bincount(col, value * by_score[row], width) + penalty * w,
            [by_cut.sum()],
            np.array([by_cut[k + 1 :].sum() for k in range(levels - 2)]) * gaps,
        ])
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        params -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(params[width + 1 :])
    return params[:width], params[width] + np.concatenate([[0.0], np.cumsum(gaps)])


def score(model: OrdinalModel, text: Column, space: int = SPACE) -> Column:
    """struct(expected_grade, tail_prob): mean grade and P(top grade) of a text; null as empty."""

    def run(texts: pa.Array) -> pa.Array:
        of = _features(space, PREFIX, model.weights)
        weight = model.weights
        total = np.array([
            sum(v * weight[s] for s, v in of(t or "").items())
            for part in _slices(texts) for t in part.to_pylist()
        ], float)
        tails = model.tails(total)
        return pa.StructArray.from_arrays(
            [pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], ["expected_grade", "tail_prob"]
        )

    return F.arrow_udf(run, "struct<expected_grade: double, tail_prob: double>")(text)


def grades_of(labels: DataFrame) -> DataFrame:
    """Graded ratings from two yes/no labels: 0 toxic, 1 clean but poor, 2 clean and good."""
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    grade = F.when(toxic, 0).when(good, 2).when(F.col("quality").isNotNull(), 1)
    return labels.select("doc_id", grade.alias("grade"))


def graded(
    docs: DataFrame, labels: DataFrame, text_col: str = "text", keep_from: float = KEEP_FROM,
    **params: object,
) -> DataFrame:
    """``docs`` with expected_grade, tail_prob and kept (tail_prob >= keep_from).

    A null or empty text has no features and gets the score 0. Empty tables
    give no rows. Columns of the same names in ``docs`` are replaced.
    """
    model = fit(docs, grades_of(labels), text_col=text_col, **params)
    scored = fresh_names(docs, "score")["score"]
    found = docs.withColumn(scored, score(model, F.col(text_col)))
    return found.select(
        *[c for c in docs.columns if c not in ("expected_grade", "tail_prob", "kept")],
        f"{scored}.expected_grade", f"{scored}.tail_prob",
        (F.col(f"{scored}.tail_prob") >= keep_from).alias("kept"),
    )
