"""Neighbours of points among the points of other owners.

The points looked from are halved on their widest side until few are left; what
lies out of reach of a half is left out at once.  So memory follows the points,
not the pairs, however densely or unevenly they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Points looked from at once, and distances held at once.
LEAF, CELLS = 64, 1 << 20


def limit(radius: float) -> float:
    """The largest square whose root is at most ``radius``."""
    q = radius * radius
    while np.sqrt(q) > radius:
        q = np.nextafter(q, 0)
    while np.sqrt(np.nextafter(q, np.inf)) <= radius:
        q = np.nextafter(q, np.inf)
    return float(q)


def _first_of(*cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the columns (the last one first), and where a new value begins in it."""
    o = np.lexsort(cols)
    new = np.ones(len(o), bool)
    if len(o):
        new[1:] = np.any([c[o][1:] != c[o][:-1] for c in cols], axis=0)
    return o, new


def _near(x: np.ndarray, k: np.ndarray, lo: np.ndarray, hi: np.ndarray, radius: float) -> np.ndarray:
    """Those of the rows ``k`` at most ``radius`` (a little more, for rounding) outside a box."""
    pad = radius * (1 + 1e-6) + 1e-12 * max(np.abs(lo).max(), np.abs(hi).max())
    for a in range(3):
        v = x[a].take(k)
        k = k[(v >= lo[a] - pad) & (v <= hi[a] + pad)]
    return k


def _halves(x: np.ndarray, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    o = np.argpartition(x[int(np.argmax(hi - lo))].take(c), len(c) // 2)
    return c[o[: len(c) // 2]], c[o[len(c) // 2 :]]


def _box(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = x.take(c, axis=1)
    return p.min(axis=1), p.max(axis=1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed as x + y + z."""
    d = np.subtract.outer(a[0], b[0])
    d *= d
    for i in (1, 2):
        e = np.subtract.outer(a[i], b[i])
        e *= e
        d += e
    return d


def _owners_in_reach(a: np.ndarray, owner: np.ndarray, c: np.ndarray, most: float) -> np.ndarray:
    """For each of ``c`` the number of owners with a row of ``a`` in reach; ``owner`` is sorted."""
    start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    n = np.diff(np.r_[start, len(owner)])
    g = np.argsort(-n, kind="stable")
    start, n = start[g], n[g]
    # every owner's first row, then the second of those that have two, and so on: each part lies over the first owners
    parts = [start[: int(np.searchsorted(-n, -t))] + t for t in range(int(n[0]))]
    a = a.take(np.concatenate(parts), axis=1)
    hit = np.empty((a.shape[1], c.shape[1]), bool)
    step = max(1, (1 << 14) // c.shape[1])
    for i in range(0, len(hit), step):
        np.less_equal(_squares(a[:, i : i + step], c), most, out=hit[i : i + step])
    at = len(parts[0])
    for p in parts[1:]:
        hit[: len(p)] |= hit[at : at + len(p)]
        at += len(p)
    return hit[: len(parts[0])].view(np.uint8).sum(axis=0, dtype=np.int64)


def other_owners(x: np.ndarray, owner: np.ndarray, asked: np.ndarray, radius: float) -> np.ndarray:
    """For each asked row the number of other owners with a row at most
    ``radius`` away; ``x`` has a line for each axis.
    """
    rows = np.flatnonzero(asked)
    o, new = _first_of(*x[:, rows])
    place = np.empty(len(rows), int)
    place[o] = np.cumsum(new) - 1
    at = x[:, rows[o[new]]]
    o, new = _first_of(*x, owner)  # each owner once at a place, by owner
    cx, co = x[:, o[new]], owner[o[new]]
    got, most = np.zeros(at.shape[1], np.int64), limit(radius)
    todo = [(np.arange(len(got)), np.arange(len(co)))] if len(got) else []
    while todo:
        c, k = todo.pop()
        lo, hi = _box(at, c)
        k = _near(cx, k, lo, hi, radius)
        if len(c) > LEAF or (len(c) > 1 and len(c) * len(k) > 16 * CELLS):
            todo += [(h, k) for h in _halves(at, c, lo, hi)]
            continue
        a = cx.take(k, axis=1)
        out = np.maximum(np.maximum(lo[:, None] - a, a - hi[:, None]), 0)
        in_reach = (out * out).sum(axis=0) <= most * (1 + 1e-6)  # of the box; the corners are not
        got[c] = _owners_in_reach(a[:, in_reach], co[k[in_reach]], at[:, c], most)
    return got[place] - 1  # its own owner is always in reach


def nearest_others(x: np.ndarray, owner: np.ndarray, asked: np.ndarray, k: int, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, neighbour, distance and rank (from 1) of the ``k`` nearest rows of
    other owners, at most ``radius`` away; ``x`` has a line for each axis.  Ties
    fall to the earlier row; the rows are sorted by owner.
    """
    rows = np.flatnonzero(asked)
    # at one place k rows of an owner, and 2 k in all, serve everyone: k at most are the asker's own
    at = np.arange(len(owner))
    for cap, cols in ((k, (*x, owner)), (2 * k, x)):
        o, new = _first_of(*[c[at] for c in cols])  # stable, so the earlier rows come first
        first = np.flatnonzero(new)
        at = np.sort(at[o[np.arange(len(o)) - np.repeat(first, np.diff(np.r_[first, len(o)])) < cap]])
    todo = [(rows, at, radius)] if len(rows) else []
    while todo:
        c, q, r = todo.pop()
        lo, hi = _box(x, c)
        wide = float(np.sqrt(((hi - lo) ** 2).sum())) * (1 + 1e-6)
        if wide < r and len(c) - np.unique(owner[c], return_counts=True)[1].max() >= k:
            r = wide  # everyone here has k others that near
        few = len(c) <= LEAF // 2
        if few and len(c) > k:
            d = np.sqrt(_squares(x[:, c], x[:, c]))
            np.copyto(d, np.inf, where=owner[c][:, None] == owner[c])
            r = min(r, float(np.partition(d, k - 1, axis=1)[:, k - 1].max()) * (1 + 1e-6))
        q = _near(x, q, lo, hi, r)
        if not few or (len(c) > 1 and len(c) * len(q) > CELLS):
            todo += [(h, q, r) for h in _halves(x, c, lo, hi)]
        elif len(q):
            d = np.sqrt(_squares(x[:, c], x.take(q, axis=1)))
            np.copyto(d, np.inf, where=(owner[c][:, None] == owner[q]) | (d > radius))
            i = np.arange(len(c))
            for rank in range(1, k + 1):
                j = d.argmin(axis=1)
                best = d[i, j]
                there = best < np.inf
                if not there.any():
                    break
                yield c[there], q[j[there]], best[there], np.full(int(there.sum()), rank)
                d[i, j] = np.inf
