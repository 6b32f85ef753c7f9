"""Token counts that follow edits: a tree of pre-token sums per document."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAF = 32  # pre-tokens of a leaf when a tree is built
# Fixed value: how a byte-level vocabulary cuts text before it merges.
PATTERN = (
    r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)
LOOK_AHEAD = 3  # characters behind a pre-token that can decide where it ends
TREE = "struct<leaves: int, chars: array<int>, pretokens: array<int>, tokens: array<int>>"


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of a byte-level vocabulary and the pattern of its pre-tokens."""

    ranks: dict[bytes, int]
    pattern: str = PATTERN


def load_vocabulary(ranks_file: str, pattern: str = PATTERN) -> Vocabulary:
    """Read a file of base64 tokens and ranks on the driver; it is of bounded size."""
    import base64

    with open(ranks_file, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    return Vocabulary({base64.b64decode(t): int(r) for t, r in pairs}, pattern)


def _counter(vocabulary: Vocabulary) -> tuple[Any, Callable[[str], int]]:
    """The compiled pattern, and the number of tokens of a pre-token."""
    import regex
    import tiktoken

    encoding = tiktoken.Encoding(
        "counted", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={}
    )

    class Known(dict):
        def __missing__(self, part: str) -> int:
            n = len(encoding.encode_ordinary(part))
            if len(part) < 64:
                if len(self) > 400_000:
                    self.clear()
                self[part] = n
            return n

    return regex.compile(vocabulary.pattern), Known().__getitem__


class SumTree:
    """Sums of characters, pre-tokens and tokens over the leaves of one document.

    Node 1 is the root, node n has children 2n and 2n + 1, the leaves come
    last. A change of one leaf renews the sums on its way to the root only.
    """

    def __init__(self, chars: list[int], pretokens: list[int], tokens: list[int]) -> None:
        self.sums = [chars, pretokens, tokens]
        self.size = len(chars) // 2

    @classmethod
    def build(cls, leaves: list[tuple[int, int, int]]) -> SumTree:
        size = 1 << max(0, (len(leaves) - 1).bit_length())
        sums = []
        for k in range(3):
            tree = [0] * size + [leaf[k] for leaf in leaves] + [0] * (size - len(leaves))
            for node in range(size - 1, 0, -1):
                tree[node] = tree[2 * node] + tree[2 * node + 1]
            sums.append(tree)
        return cls(*sums)

    def set(self, leaf: int, values: tuple[int, int, int]) -> None:
        node = leaf + self.size
        for tree, value in zip(self.sums, values):
            tree[node] = value
        node //= 2
        while node:
            for tree in self.sums:
                tree[node] = tree[2 * node] + tree[2 * node + 1]
            node //= 2

    def find(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character position, and where the leaf starts."""
        node, start = 1, 0
        chars = self.sums[0]
        while node < self.size:
            node *= 2
            if start + chars[node] <= position and chars[node + 1]:
                start += chars[node]
                node += 1
        return node - self.size, start

    @property
    def totals(self) -> tuple[int, int, int]:
        return tuple(tree[1] for tree in self.sums)  # type: ignore[return-value]


def _leaves(parts: list[str], count: Callable[[str], int], leaf: int) -> list[tuple[int, int, int]]:
    sizes, tokens = list(map(len, parts)), list(map(count, parts))
    return [
        (sum(sizes[i : i + leaf]), len(sizes[i : i + leaf]), sum(tokens[i : i + leaf]))
        for i in range(0, len(parts), leaf)
    ] or [(0, 0, 0)]


def build_trees(text: Column, vocabulary: Any, leaf: int = LEAF) -> Column:
    """A tree of sums per text (see TREE); null has the tree of the empty text.

    ``vocabulary`` is a broadcast ``Vocabulary``. The root, at index 1 of each
    array, has the totals.
    """

    def run(texts: pa.Array) -> pa.Array:
        pattern, count = _counter(vocabulary.value)
        out = []
        for text_ in texts.to_pylist():
            tree = SumTree.build(_leaves(pattern.findall(text_ or ""), count, leaf))
            out.append(_stored(tree))
        return pa.array(out, _TYPE)

    return F.arrow_udf(run, TREE)(text)


_INTS = pa.list_(pa.int32())
_TYPE = pa.struct([("leaves", pa.int32()), ("chars", _INTS), ("pretokens", _INTS), ("tokens", _INTS)])
_CHANGE = pa.struct([
    ("text", pa.string()), ("tree", _TYPE), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64()),
    ("encoded_pretokens", pa.int64()),
])
CHANGE = (
    f"struct<text: string, tree: {TREE}, n_pretokens: long, n_tokens: long, encoded_pretokens: long>"
)


def _stored(tree: SumTree) -> dict[str, Any]:
    chars, pretokens, tokens = tree.sums
    return {"leaves": tree.size, "chars": chars, "pretokens": pretokens, "tokens": tokens}


def apply_edits(text: Column, tree: Column, edits: Column, vocabulary: Any) -> Column:
    """Edited text, its tree, its counts, and how many pre-tokens were encoded for it.

    ``edits`` is an array of struct (at, removed, inserted), applied one after
    the other: from character ``at`` on ``removed`` characters give way to
    ``inserted``. Places beyond the text mean its end; a null edit, or a null
    text, list or field, changes nothing or stands for nothing to remove or
    insert. Only the leaves that an edit touches are cut and encoded again,
    with as many leaves before as the look-ahead of the pattern can reach and
    as many behind as it takes until a cut falls on an old border.
    """

    def run(texts: pa.Array, trees: pa.Array, lists: pa.Array) -> pa.Array:
        pattern, count = _counter(vocabulary.value)
        out = []
        for body, stored, changes in zip(texts.to_pylist(), trees.to_pylist(), lists.to_pylist()):
            body, encoded = body or "", 0
            tree = SumTree(stored["chars"], stored["pretokens"], stored["tokens"])
            for change in changes or []:
                if change is not None:
                    body, cost = _edit(body, tree, change, pattern, count)
                    encoded += cost
            _, pretokens, tokens = tree.totals
            out.append({"text": body, "tree": _stored(tree), "n_pretokens": pretokens,
                        "n_tokens": tokens, "encoded_pretokens": encoded})
        return pa.array(out, _CHANGE)

    return F.arrow_udf(run, CHANGE)(text, tree, edits)


def _edit(
    body: str, tree: SumTree, change: dict[str, Any], pattern: Any, count: Callable[[str], int]
) -> tuple[str, int]:
    at = min(max(change["at"] or 0, 0), len(body))
    stop = min(at + max(change["removed"] or 0, 0), len(body))
    inserted = change["inserted"] or ""
    new = body[:at] + inserted + body[stop:]
    shift = len(new) - len(body)
    leaf, start = tree.find(max(0, at - LOOK_AHEAD))
    first, (last, begin) = leaf, tree.find(min(stop, max(0, len(body) - 1)))
    border = begin + tree.sums[0][last + tree.size]  # end of the last touched leaf, in ``body``
    parts: list[str] = []
    here = start
    matches = pattern.finditer(new, start)
    while True:
        # Cut on until a pre-token ends on the border of a leaf behind the edit.
        while here < border + shift:
            part = next(matches).group()
            parts.append(part)
            here += len(part)
        if here == border + shift or here >= len(new):
            break
        while border + shift < here and last + 1 < tree.size:
            last += 1
            border += tree.sums[0][last + tree.size]
    # All touched leaves become one; the others stay empty, so that no leaf behind moves.
    tree.set(first, (sum(map(len, parts)), len(parts), sum(map(count, parts))))
    for empty in range(first + 1, last + 1):
        tree.set(empty, (0, 0, 0))
    return new, len(parts)


def recount(
    docs: DataFrame, edits: Column, vocabulary: Vocabulary, text_col: str = "text",
    id_col: str = "doc_id", leaf: int = LEAF,
) -> DataFrame:
    """Counts before and after edits: doc_id, the counts, the edited text and both trees.

    Trees are one column of the document's row, so building, keeping and
    changing them takes no shuffle. Repeated rows are counted each; an empty
    table gives no rows.
    """
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    built = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), edits.alias("edits")
    ).withColumn("tree", build_trees(F.col("text"), known, leaf))
    changed = built.withColumn(
        "change", apply_edits(F.col("text"), F.col("tree"), F.col("edits"), known)
    )
    return changed.select(
        "doc_id", F.element_at("tree.pretokens", 2).cast("long").alias("n_pretokens"),
        F.element_at("tree.tokens", 2).cast("long").alias("n_tokens"),
        F.col("change.n_pretokens").alias("edited_pretokens"),
        F.col("change.n_tokens").alias("edited_tokens"), "change.encoded_pretokens",
        F.col("change.text").alias("edited_text"), "tree", F.col("change.tree").alias("edited_tree"),
    )
