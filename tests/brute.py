"""Frames by a plain loop over sorted rows, written apart from the library."""

import math


def closes_and_joins(kind, p):
    """(opens alone?, state at open, still in frame?, next state) for a frame kind."""
    if kind == "threshold":
        return lambda v: v >= p, lambda v: None, lambda v, s: v >= p, lambda v, s: None
    if kind == "delta":
        return lambda v: True, lambda v: v, lambda v, s: abs(s - v) < p, lambda v, s: s
    if kind == "boundary":
        part = lambda v: sum(v >= b for b in set(p))
        return lambda v: True, part, lambda v, s: part(v) == s, lambda v, s: s
    how, limit, init = p
    f = {"sum": lambda v, a: v + a, "max": max, "min": min, "count": lambda v, a: a + 1}.get(how, how)
    return lambda v: True, lambda v: f(v, init), lambda v, s: f(v, s) < limit, f


def frames(rows, kind, p):
    """rows: (key, ts, tie, value). Returns sorted (key, seq, start, tie, end, closed, n, sum)."""
    opens, start, stays, fold = closes_and_joins(kind, p)
    by_key = {}
    for r in rows:
        by_key.setdefault(r[0], []).append(r)
    out = []
    for key, group in by_key.items():
        group.sort(key=lambda r: (r[1], r[2]))
        current, state, seq = None, None, 0
        for _, ts, tie, value in group:
            v = math.trunc(value)
            if current is not None and not stays(v, state):
                out.append((key, seq, *current[:2], ts, True, *current[3:]))
                current = None
            if current is not None:
                state = fold(v, state)
                current = (*current[:2], ts + 1, current[3] + 1, round(current[4] + value, 4))
            elif opens(v):
                seq += 1
                state = start(v)
                current = (ts, tie, ts + 1, 1, round(value, 4))
        if current is not None:
            out.append((key, seq, *current[:2], current[2], False, *current[3:]))
    return sorted(out, key=order)


def order(row):
    return tuple((x is not None, x) for x in row)
