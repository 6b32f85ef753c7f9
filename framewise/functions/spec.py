"""What makes a frame: the fold that opens, extends and closes it.

One specification serves the batch operators and the stateful stream, so both
give the same frames for the same rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

NAMED_AGGREGATES: dict[str, Callable[[int, int], int]] = {
    "sum": lambda v, agg: agg + v,
    "max": lambda v, agg: v if v > agg else agg,
    "min": lambda v, agg: v if v < agg else agg,
    "count": lambda v, agg: agg + 1,
}


@dataclass(frozen=True)
class Mergeable:
    """How a stretch of rows acts on whatever state comes before it.

    ``summarise(values)`` describes a stretch, ``compose(left, right)`` two
    neighbouring ones as one, and ``apply(summary, state)`` gives the state
    behind it (None: no open frame) and the number of frames that open in it.
    With these, stretches of one key are summarised side by side and composed
    like prefix sums. Summaries must be picklable.
    """

    summarise: Callable[[Sequence[int]], Any]
    compose: Callable[[Any, Any], Any]
    apply: Callable[[Any, Any], tuple[Any, int]]
    states: tuple[Any, ...] | None = None  # all there are, if the fold knows only these

    @staticmethod
    def finite(step: Callable[[Any, int], tuple[Any, bool, bool, bool]], states: Sequence[Any]) -> Mergeable:
        """For folds that only know the given states: a table of what becomes of each.

        All states walk through the rows together; those that meet go on as one.
        """
        known = [None, *dict.fromkeys(states)]

        def summarise(values: Sequence[int]) -> dict[Any, tuple[Any, int]]:
            # state now -> (frames it has opened, entry states that lead here with frames more)
            walking: dict[Any, tuple[int, list[tuple[Any, int]]]] = {s: (0, [(s, 0)]) for s in known}
            for v in values:
                after: dict[Any, tuple[int, list[tuple[Any, int]]]] = {}
                for state, (opened, members) in walking.items():
                    state, _, opens, _ = step(state, v)
                    if state not in known:
                        raise ValueError(f"the fold reached {state!r}, which is not among its states")
                    opened += opens
                    if state in after:
                        base, joined = after[state]
                        joined += [(s, more + opened - base) for s, more in members]
                    else:
                        after[state] = (opened, members)
                walking = after
            return {
                s: (state, opened + more)
                for state, (opened, members) in walking.items() for s, more in members
            }

        def compose(
            left: dict[Any, tuple[Any, int]], right: dict[Any, tuple[Any, int]]
        ) -> dict[Any, tuple[Any, int]]:
            return {s: (right[mid][0], n + right[mid][1]) for s, (mid, n) in left.items()}

        return Mergeable(summarise, compose, lambda table, state: table[state], tuple(known[1:]))


@dataclass(frozen=True)
class FrameSpec:
    """A frame kind with its parameters.

    ``opens(v)`` says whether a row may open a frame when none is open,
    ``start(v)`` gives the state of a frame opened by ``v``, ``keeps(v, state)``
    whether an open frame takes the row, ``fold(v, state)`` the state after it,
    and ``closes(v, state)`` whether the row ends the frame. Each row is tested
    in the order close, extend, open; a row that closes a frame may open the
    next one. ``v`` is the row's value truncated toward zero.
    """

    kind: str
    opens: Callable[[int], bool]
    start: Callable[[int], Any]
    keeps: Callable[[int, Any], bool]
    fold: Callable[[int, Any], Any]
    closes: Callable[[int, Any], bool]
    params: dict[str, Any] = field(default_factory=dict)
    mergeable: Mergeable | None = None

    def step(self, state: Any, v: int) -> tuple[Any, bool, bool, bool]:
        """One row: new state (None = no open frame), member, opened, closed."""
        closed = False
        if state is not None:
            if self.closes(v, state):
                state, closed = None, True
            elif self.keeps(v, state):
                return self.fold(v, state), True, False, False
            else:
                return state, False, False, False
        if self.opens(v):
            return self.start(v), True, True, closed
        return None, False, False, closed

    def _with_states(self, states: Sequence[Any]) -> FrameSpec:
        return replace(self, mergeable=Mergeable.finite(self.step, states))

    @staticmethod
    def threshold(limit: int) -> FrameSpec:
        """Runs of consecutive rows at or above ``limit``."""
        limit = _whole("limit", limit)
        return FrameSpec(
            kind="threshold",
            opens=lambda v: v >= limit,
            start=lambda v: True,
            keeps=lambda v, s: v >= limit,
            fold=lambda v, s: s,
            closes=lambda v, s: v < limit,
            params={"limit": limit},
        )._with_states([True])

    @staticmethod
    def delta(limit: int) -> FrameSpec:
        """Rows that differ from the frame's first row by less than ``limit``."""
        limit = _whole("limit", limit)
        return FrameSpec(
            kind="delta",
            opens=lambda v: True,
            start=lambda v: v,
            keeps=lambda v, s: abs(s - v) < limit,
            fold=lambda v, s: s,
            closes=lambda v, s: abs(s - v) >= limit,
            params={"limit": limit},
        )

    @staticmethod
    def aggregate(
        how: str | Callable[[int, int], int], limit: int, init: int = 0,
        mergeable: Mergeable | None = None,
    ) -> FrameSpec:
        """Rows whose running aggregate, begun at ``init``, stays below ``limit``.

        ``mergeable`` describes an own function to large keys (see ``Mergeable``).
        """
        limit, init = _whole("limit", limit), _whole("init", init)
        if callable(how):
            merge, name = how, "callable"
        elif how in NAMED_AGGREGATES:
            merge, name = NAMED_AGGREGATES[how], how
        else:
            raise ValueError(f"unknown frame aggregate {how!r}; use one of "
                             f"{sorted(NAMED_AGGREGATES)} or a function of (value, aggregate)")
        return FrameSpec(
            kind="aggregate",
            opens=lambda v: True,
            start=lambda v: merge(v, init),
            keeps=lambda v, s: merge(v, s) < limit,
            fold=merge,
            closes=lambda v, s: merge(v, s) >= limit,
            params={"how": name, "limit": limit, "init": init},
            mergeable=mergeable,
        )

    @staticmethod
    def boundary(bounds: Sequence[int]) -> FrameSpec:
        """Rows that stay in one of the value ranges cut by ``bounds``."""
        cuts = sorted({_whole("bound", b) for b in bounds})
        if not cuts:
            raise ValueError("a boundary frame needs at least one bound")
        return FrameSpec(
            kind="boundary",
            opens=lambda v: True,
            start=lambda v: bisect_right(cuts, v),
            keeps=lambda v, s: bisect_right(cuts, v) == s,
            fold=lambda v, s: s,
            closes=lambda v, s: bisect_right(cuts, v) != s,
            params={"bounds": cuts},
        )._with_states(range(len(cuts) + 1))

    @staticmethod
    def custom(
        opens: Callable[[int], bool],
        start: Callable[[int], Any],
        keeps: Callable[[int, Any], bool],
        fold: Callable[[int, Any], Any] | None = None,
        closes: Callable[[int, Any], bool] | None = None,
        states: Sequence[Any] | None = None,
        mergeable: Mergeable | None = None,
    ) -> FrameSpec:
        """A frame by the caller's own predicates.

        Without ``closes`` a frame ends at the first row it does not keep.
        ``start`` and ``fold`` must give a picklable state other than None.
        ``states`` lists all (hashable) states that there are, if they are few;
        ``mergeable`` describes any other fold. With one of them a large key is
        folded in parallel, in two passes.
        """
        spec = FrameSpec(
            kind="custom",
            opens=opens,
            start=start,
            keeps=keeps,
            fold=fold or (lambda v, s: s),
            closes=closes or (lambda v, s: not keeps(v, s)),
            params={"skips_rows": closes is not None},
            mergeable=mergeable,
        )
        return spec if states is None or mergeable is not None else spec._with_states(states)

    @staticmethod
    def named(kind: str, **params: Any) -> FrameSpec:
        """Choose a kind by name: threshold, delta, aggregate or boundary."""
        makers = {
            "threshold": FrameSpec.threshold,
            "delta": FrameSpec.delta,
            "aggregate": FrameSpec.aggregate,
            "boundary": FrameSpec.boundary,
            "custom": FrameSpec.custom,
        }
        if kind not in makers:
            raise ValueError(f"unknown frame kind {kind!r}; use one of {sorted(makers)}")
        return makers[kind](**params)


def parse_window_params(kind: str, text: str) -> dict[str, Any]:
    """Read ``"T"`` / ``"T;size;slide"`` or ``"fn;init;T"`` into parameters.

    ``time`` uses size and slide (second and third field, milliseconds); the
    frame kinds use the first field, or function, start value and limit when
    the text begins with a function name.
    """
    parts = [p.strip() for p in text.split(";") if p.strip()]
    if not parts:
        raise ValueError("empty window parameters")
    if kind == "time":
        if len(parts) < 3:
            raise ValueError("time windows need three fields, such as '0;5000;1000'")
        return {"size_ms": int(parts[1]), "slide_ms": int(parts[2])}
    if kind in ("threshold", "delta"):
        return {"limit": int(parts[0])}
    if kind == "aggregate":
        if parts[0].lstrip("-").isdigit():
            return {"how": "sum", "init": 0, "limit": int(parts[0])}
        if len(parts) != 3:
            raise ValueError("aggregate windows need 'function;init;limit'")
        return {"how": parts[0], "init": int(parts[1]), "limit": int(parts[2])}
    if kind == "boundary":
        return {"bounds": [int(p) for p in parts]}
    raise ValueError(f"unknown window kind {kind!r}")


def _whole(name: str, value: Any) -> int:
    if isinstance(value, bool) or int(value) != value:
        raise ValueError(f"{name} must be a whole number, not {value!r}")
    return int(value)
