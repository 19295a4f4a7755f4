"""Nearest points and closest pairs within graphs, in numpy: a grid that is fine where points are dense, boxes of blocks of
points that bound distances."""

from __future__ import annotations

import numpy as np

#: Points to a block, and how much is compared at once.
BLOCK, AT_ONCE = 8, 2_000_000


def expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value): of each row all values from low to high, exclusive."""
    sizes = np.maximum(high - low, 0)
    rows = np.repeat(np.arange(len(low)), sizes)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[rows]


def _dense(cells: np.ndarray) -> np.ndarray:
    """Cell numbers made small: neighbours stay neighbours, others don't become any."""
    values, at = np.unique(cells, return_inverse=True)
    return np.concatenate([[0], np.cumsum(np.minimum(np.diff(values), 2))])[at]


def _first(groups: np.ndarray, k: int) -> np.ndarray:
    """Whether each of rows sorted by group is among the first k of its group."""
    at = np.arange(len(groups))
    starts = np.maximum.accumulate(np.where(np.concatenate([[True], groups[1:] != groups[:-1]]), at, 0)) if len(groups) else at
    return at - starts < k


class Grid:
    """Points by cell of a square grid, graph by graph."""

    def __init__(self, g: np.ndarray, x: np.ndarray, y: np.ndarray, side: float):
        side *= 1 + 1e-9  # so that rounding takes no two points that are side apart two cells apart
        cx, cy = (_dense(np.floor(v / side)) + 1 for v in (x, y))
        self.height = int(cy.max(initial=0)) + 2
        self.column = (np.unique(g, return_inverse=True)[1] * (int(cx.max(initial=0)) + 2) + cx) * self.height
        self.cell = self.column + cy

    def around(self, some: np.ndarray, among: np.ndarray):
        """(i, j), in parts: each of some with all of among in its own and the eight cells around, itself too."""
        sorted_ = among[np.argsort(self.cell[among], kind="stable")]
        keys = self.cell[sorted_]
        low, high = ([np.searchsorted(keys, self.cell[some] + d * self.height + e, side=s) for d in (-1, 0, 1)] for e, s in ((-1, "left"), (1, "right")))
        sizes = np.cumsum(sum(h - a for a, h in zip(low, high, strict=True)))
        at = 0
        while at < len(some):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + AT_ONCE, side="right")))
            parts = [expanded(a[at:end], h[at:end]) for a, h in zip(low, high, strict=True)]
            yield some[at:end][np.concatenate([p[0] for p in parts])], sorted_[np.concatenate([p[1] for p in parts])]
            at = end


def nearest(g: np.ndarray, x: np.ndarray, y: np.ndarray, k: int, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d2): of each point the k nearest others of its graph within radius, inclusive, ties to the earlier one.

    Points look around in a fine grid first; those that find k within a cell's side are done, the others look again in cells
    twice as wide, up to radius. So a crowd is searched in small cells, however many points one cell of the coarsest holds.
    Of points at one place only the first k + 1 can be anyone's nearest. Points that aren't numbers have no neighbours.
    """
    rows = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
    none = np.empty(0, np.int64)
    if k < 1 or radius < 0 or not len(rows):
        return none, none, np.empty(0)
    g, x, y = g[rows], x[rows], y[rows]
    order = np.lexsort([y, x, g])
    new = np.concatenate([[True], (np.diff(g[order]) != 0) | (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)])
    among = np.sort(order[_first(np.cumsum(new), k + 1)])
    widest = radius if radius > 0 else 1.0
    crowd = len(among) / len(np.unique(Grid(g, x, y, widest).cell[among]))
    levels = min(12, int(np.ceil(np.log2(max(1.0, 3 * crowd / k)) / 2)))
    out, todo = [], np.arange(len(rows))
    for level in range(levels, -1, -1):
        side = widest / 2**level
        reach = min(radius, side) ** 2
        found = np.zeros(len(rows), dtype=np.int64)
        for i, j in Grid(g, x, y, side).around(todo, among):
            d2 = (x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2
            near = np.flatnonzero((d2 <= reach) & (i != j))
            i, j, d2 = i[near], j[near], d2[near]
            best = np.lexsort([j, d2, i])
            best = best[_first(i[best], k)]
            np.add.at(found, i[best], 1)
            out.append((i[best], j[best], d2[best], np.full(len(best), level)))
        todo = todo[found[todo] < k]
        done = found if level == 0 else np.where(found >= k, found, 0)
        out[:] = [tuple(v[(part[3] != level) | (done[part[0]] > 0)] for v in part) for part in out]
        if not len(todo):
            break
    i, j, d2 = (np.concatenate([part[n] for part in out]) if out else none for n in range(3))
    return rows[i], rows[j], d2


def closest(x: np.ndarray, y: np.ndarray, starts: np.ndarray, ends: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(d2, i, j, distances): of each pair of contours one and two their closest points, ties to the earlier i, then j.

    A contour is the points from starts to ends, in blocks that lie along it. The gap between two boxes is less than any
    distance between their points: of each pair the two blocks of the smallest gap are measured first, then only blocks whose
    gap is no larger than what was found. distances: how many were measured. Of a pair without points d2 is infinite.
    """
    counts = -(-(ends - starts) // BLOCK)
    contour, nth = expanded(np.zeros(len(starts), np.int64), counts)
    low = starts[contour] + nth * BLOCK
    place = low[:, None] + np.arange(BLOCK)
    held = place < ends[contour][:, None]
    place = np.where(held, place, low[:, None])
    finite = np.isfinite(x) & np.isfinite(y)
    xs, ys = (np.where(finite, v, np.inf)[place] for v in (x, y))  # a point that isn't a number is far from all
    box = [f(v, axis=1) for v in (xs, ys) for f in (np.min, np.max)]
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    d2, i, j, measured = np.full(len(one), np.inf), np.full(len(one), -1), np.full(len(one), -1), 0

    def measure(p, a, b):
        nonlocal measured
        for at in range(0, len(p), AT_ONCE // BLOCK**2):
            q, u, v = (w[at : at + AT_ONCE // BLOCK**2] for w in (p, a, b))
            with np.errstate(invalid="ignore"):
                every = (xs[u][:, :, None] - xs[v][:, None, :]) ** 2 + (ys[u][:, :, None] - ys[v][:, None, :]) ** 2
            every = np.where(held[u][:, :, None] & held[v][:, None, :] & np.isfinite(every), every, np.inf).reshape(len(q), -1)
            measured += int((held[u].sum(axis=1) * held[v].sum(axis=1)).sum())
            best = every.argmin(axis=1)
            found = every[np.arange(len(q)), best], place[u, best // BLOCK], place[v, best % BLOCK]
            order = np.lexsort([found[2], found[1], found[0], q])
            order = order[_first(q[order], 1)]
            at_, (s, m, n) = q[order], (w[order] for w in found)
            less = (s < d2[at_]) | ((s == d2[at_]) & np.isfinite(s) & ((m < i[at_]) | ((m == i[at_]) & (n < j[at_]))))
            d2[at_[less]], i[at_[less]], j[at_[less]] = s[less], m[less], n[less]

    sizes = counts[one] * counts[two]
    total, at = np.cumsum(sizes), 0
    while at < len(one):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, side="right")))
        p, n = expanded(np.zeros(end - at, np.int64), sizes[at:end])
        p += at
        a, b = first[one[p]] + n // np.maximum(counts[two[p]], 1), first[two[p]] + n % np.maximum(counts[two[p]], 1)
        with np.errstate(invalid="ignore"):
            gaps = [np.maximum(np.maximum(box[c][b] - box[c + 1][a], box[c][a] - box[c + 1][b]), 0) for c in (0, 2)]
        gap = np.nan_to_num(gaps[0] ** 2 + gaps[1] ** 2, nan=0.0)
        order = np.lexsort([gap, p])
        order = order[_first(p[order], 1)]
        measure(p[order], a[order], b[order])
        more = gap <= d2[p]
        more[order] = False
        measure(p[more], a[more], b[more])
        at = end
    return d2, i, j, measured


def box_pairs(low_x: np.ndarray, low_y: np.ndarray, high_x: np.ndarray, high_y: np.ndarray, bridge: float, stack: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one, two, stacked): boxes at most bridge apart, or stacked: overlapping in x by half the narrower and at most stack
    apart in y. Boxes are met in order of their left sides, so only those that share a stretch of x are compared."""
    order = np.argsort(low_x, kind="stable")
    until = np.searchsorted(low_x[order], high_x[order] + max(bridge, 0.0) * (1 + 1e-9) + 1e-9, side="right")
    i, j = expanded(np.arange(len(order)) + 1, until)
    i, j = order[i], order[j]
    i, j = np.minimum(i, j), np.maximum(i, j)
    gap_x = np.maximum(np.maximum(low_x[j] - high_x[i], low_x[i] - high_x[j]), 0.0)
    gap_y = np.maximum(np.maximum(low_y[j] - high_y[i], low_y[i] - high_y[j]), 0.0)
    overlap = np.minimum(high_x[i], high_x[j]) - np.maximum(low_x[i], low_x[j])
    narrow = np.maximum(np.minimum(high_x[i] - low_x[i], high_x[j] - low_x[j]), least)
    stacked = (overlap >= 0.5 * narrow) & (gap_y <= stack) if stack > 0 else np.zeros(len(i), dtype=bool)
    wanted = stacked | (gap_x * gap_x + gap_y * gap_y <= bridge * bridge) if bridge > 0 else stacked
    return i[wanted], j[wanted], stacked[wanted]
