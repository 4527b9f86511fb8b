"""Coverings of shapes by quadtree cells, and exact comparisons of the edges in one cell; numpy over whole batches.

The grid is shifted by fixed shares of a cell that no whole numbers relate to each
other or to 1, so that its lines don't fall on coordinates that people write, nor its
corners on lines through such places.
"""

from __future__ import annotations

import numpy as np

SHIFT = np.array([0.38196601125010515, 0.41421356237309505])


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[k] .. starts[k] + sizes[k] - 1`` one after another."""
    if not len(sizes):
        return np.empty(0, np.int64)
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def products(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) of two ragged lists row by row; ``first`` and ``second`` are the rows' offsets."""
    n, m = np.diff(first), np.diff(second)
    i = np.repeat(np.arange(first[-1]), np.repeat(m, n))
    return i, ragged(np.repeat(second[:-1], n), np.repeat(m, n))


def box_of(level: np.ndarray, cx: np.ndarray, cy: np.ndarray, cell: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, bottom, side) of cells."""
    side = cell * np.exp2(level)
    return cx * side - SHIFT[0] * cell, cy * side - SHIFT[1] * cell, side


def meets_box(e: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each edge (x0, y0, x1, y1) meets its closed box of left, bottom, width and height."""
    near = (np.minimum(e[:, 0], e[:, 2]) <= x + w) & (np.maximum(e[:, 0], e[:, 2]) >= x) & (np.minimum(e[:, 1], e[:, 3]) <= y + h) & (np.maximum(e[:, 1], e[:, 3]) >= y)
    dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    side = [dx * (b - e[:, 1]) - dy * (a - e[:, 0]) for a in (x, x + w) for b in (y, y + h)]
    return near & (np.minimum.reduce(side) <= 0) & (np.maximum.reduce(side) >= 0)


def winding_rows(px: np.ndarray, py: np.ndarray, e: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """How often edges run around each point, from edges cut by the points' rows: those at its right that go up, less those that go down.

    weight: how often each edge counts.
    """
    rows, at = np.unique(py, return_inverse=True)
    at = at.ravel()
    a, b = np.searchsorted(rows, np.minimum(e[:, 1], e[:, 3])), np.searchsorted(rows, np.maximum(e[:, 1], e[:, 3]))
    k, r = np.repeat(np.arange(len(e)), b - a), ragged(a, b - a)
    x = e[k, 0] + (rows[r] - e[k, 1]) * (e[k, 2] - e[k, 0]) / (e[k, 3] - e[k, 1])
    worth = np.where(e[k, 3] > e[k, 1], 1, -1) * (1 if weight is None else weight[k])
    row, place, point = np.concatenate([r, at]), np.concatenate([x, px]), np.concatenate([np.zeros(len(x), bool), np.ones(len(px), bool)])
    order = np.lexsort((point, place, row))
    upto = np.empty(len(order), np.int64)
    upto[order] = np.cumsum(np.concatenate([worth, np.zeros(len(px), np.int64)])[order])
    total = np.cumsum(np.bincount(r, weights=worth, minlength=len(rows))).astype(np.int64)
    return total[at] - upto[len(x) :] if len(px) else np.empty(0, np.int64)


def inside_rows(px: np.ndarray, py: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Whether points lie inside by the crossing number; as :func:`polygons.inside`."""
    return winding_rows(px, py, e, np.where(e[:, 3] > e[:, 1], 1, -1)) % 2 == 1


def cover(edges: np.ndarray, is_area: bool, cell: float, levels: int = 40):
    """(level, cx, cy, inside, corner, first, edges) of the cells of one shape.

    A cell that no edge meets and that lies in the area is ``inside`` and as large as
    it can be; cells that edges meet are of level 0, side ``cell``, and have the edges
    ``edges[first[k]:first[k + 1]]``; corner tells whether their lower left corner is
    in the area.  Points are edges of no length.
    """
    low, high = edges.reshape(-1, 2).min(axis=0), edges.reshape(-1, 2).max(axis=0)
    level = 0
    span = lambda n: (np.floor((low + SHIFT * cell) / (cell * 2.0**n)), np.floor((high + SHIFT * cell) / (cell * 2.0**n)))
    while level < levels and (span(level)[1] - span(level)[0]).max() > 1:
        level += 1
    (x0, y0), (x1, y1) = span(level)
    cx, cy = (g.ravel().astype(np.int64) for g in np.meshgrid(np.arange(x0, x1 + 1), np.arange(y0, y1 + 1)))
    c, k = (g.ravel() for g in np.meshgrid(np.arange(len(cx)), np.arange(len(edges)), indexing="ij"))
    whole = []
    while True:
        x, y, side = box_of(np.full(len(cx), level), cx, cy, cell)
        hit = meets_box(edges[k], x[c], y[c], side[c], side[c])
        c, k = c[hit], k[hit]
        held = np.bincount(c, minlength=len(cx))
        free = np.flatnonzero(held == 0)
        if is_area and len(free):
            free = free[inside_rows(x[free] + side[free] / 2, y[free] + side[free] / 2, edges)]
            whole.append(np.stack([np.full(len(free), level), cx[free], cy[free]]))
        border = np.flatnonzero(held)
        if level == 0:
            break
        place = np.empty(len(cx), np.int64)
        place[border] = np.arange(len(border))
        cx, cy = (np.repeat(2 * v[border], 4) + np.tile(d, len(border)) for v, d in ((cx, [0, 1, 0, 1]), (cy, [0, 0, 1, 1])))
        c, k = np.repeat(4 * place[c], 4) + np.tile([0, 1, 2, 3], len(c)), np.repeat(k, 4)
        level -= 1
    order = np.argsort(c, kind="stable")
    corner = inside_rows(x[border], y[border], edges) if is_area else np.zeros(len(border), bool)
    inner = np.concatenate(whole, axis=1) if whole else np.empty((3, 0), np.int64)
    n = inner.shape[1]
    level_, cx_, cy_ = (np.concatenate([a, b]) for a, b in zip(inner, (np.zeros(len(border), np.int64), cx[border], cy[border]), strict=True))
    first = np.concatenate([np.zeros(n + 1, np.int64), np.cumsum(held[border])])
    return level_, cx_, cy_, np.arange(len(level_)) < n, np.concatenate([np.zeros(n, bool), corner]), first, edges[k[order]]


def crossings(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(meet, from, to) of edge pairs: whether the closed edges share a point, and the share of ``a`` where they do (one place, or a stretch)."""
    d, f, w = a[:, 2:] - a[:, :2], b[:, 2:] - b[:, :2], b[:, :2] - a[:, :2]
    cross, off = d[:, 0] * f[:, 1] - d[:, 1] * f[:, 0], w[:, 0] * d[:, 1] - w[:, 1] * d[:, 0]
    dd, ff = (d * d).sum(1), (f * f).sum(1)
    flat = np.abs(cross) <= 1e-14 * np.sqrt(dd * ff)
    some = np.where(flat, 1.0, cross)
    t, u = (w[:, 0] * f[:, 1] - w[:, 1] * f[:, 0]) / some, off / some
    proper = ~flat & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    # edges along one line, or of no length: ends of b along a; a point against an edge is the other way round
    reach = np.abs(off) <= 1e-12 * np.sqrt(dd) * (np.sqrt(dd) + np.sqrt(ff) + np.abs(w).max(axis=1, initial=0))
    along = np.where(dd == 0, 1.0, dd)
    s0, s1 = (w * d).sum(1) / along, ((w + f) * d).sum(1) / along
    on = flat & (dd > 0) & reach & (np.maximum(s0, s1) >= 0) & (np.minimum(s0, s1) <= 1)
    back = np.where(ff == 0, 1.0, ff)
    g = -(w * f).sum(1) / back
    apart = np.abs(-w - g[:, None] * f).max(axis=1, initial=0)
    point = (dd == 0) & (g >= 0) & (g <= 1) & (apart <= 1e-12 * (np.sqrt(ff) + np.abs(w).max(axis=1, initial=0)))
    point &= (ff > 0) | (w == 0).all(axis=1)
    lo = np.where(proper, t, np.clip(np.minimum(s0, s1), 0, 1))
    hi = np.where(proper, t, np.clip(np.maximum(s0, s1), 0, 1))
    return proper | on | point, np.where(point, 0.0, lo), np.where(point, 0.0, hi)


def clip_shares(e: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretch of each edge in its box, as shares of its length."""
    t0, t1 = np.zeros(len(e)), np.ones(len(e))
    for p, q, lo, size in ((e[:, 0], e[:, 2], x, w), (e[:, 1], e[:, 3], y, h)):
        d = q - p
        some = np.where(d == 0, 1.0, d)
        a, b = (lo - p) / some, (lo + size - p) / some
        t0 = np.where(d == 0, t0, np.maximum(t0, np.minimum(a, b)))
        t1 = np.where(d == 0, t1, np.minimum(t1, np.maximum(a, b)))
    return t0, np.maximum(t0, t1)


class CellEdges:
    """The edges of shapes in cells, a row for each shape and cell: offsets, edges, corners in the shape, and the cells' boxes."""

    def __init__(self, first: np.ndarray, edges: np.ndarray, area: np.ndarray, corner: np.ndarray, x: np.ndarray, y: np.ndarray, side: np.ndarray):
        self.first, self.edges, self.area, self.corner, self.x, self.y, self.side = first, edges, area, corner, x, y, side
        self.row = np.repeat(np.arange(len(first) - 1), np.diff(first))

    def holds(self, row: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        """Whether points of rows (in ascending order) are in the shape: the way from the cell's corner, up and then right, tells by its crossings.  Lines and points hold none."""
        at = np.searchsorted(row, np.arange(len(self.first)))
        i, j = products(at, self.first)
        e, r = self.edges[j], row[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = ((e[:, 0] > self.x[r]) != (e[:, 2] > self.x[r])) & _between(e[:, 1] + (self.x[r] - e[:, 0]) * (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0]), self.y[r], py[i])
            right = ((e[:, 1] > py[i]) != (e[:, 3] > py[i])) & _between(e[:, 0] + (py[i] - e[:, 1]) * (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1]), self.x[r], px[i])
        odd = np.bincount(i[up], minlength=len(row)) + np.bincount(i[right], minlength=len(row))
        return self.area[row] & (self.corner[row] ^ (odd % 2).astype(bool))

    def clipped(self) -> tuple[np.ndarray, np.ndarray]:
        r = self.row
        return clip_shares(self.edges, self.x[r], self.y[r], self.side[r], self.side[r])


def _between(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return (v > lo) & (v <= hi)


def _some(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(bool)


def rows_meet(a: CellEdges, b: CellEdges) -> np.ndarray:
    """Whether the two shapes of each row share a point in its cell."""
    n = len(a.corner)
    i, j = products(a.first, b.first)
    out = _some(a.row[i[crossings(a.edges[i], b.edges[j])[0]]], n)
    for p, q in ((a, b), (b, a)):
        t0, t1 = p.clipped()
        mid = p.edges[:, :2] + ((t0 + t1) / 2)[:, None] * (p.edges[:, 2:] - p.edges[:, :2])
        out |= _some(p.row[q.holds(p.row, mid[:, 0], mid[:, 1])], n)
    return out


def rows_within(a: CellEdges, b: CellEdges) -> tuple[np.ndarray, np.ndarray]:
    """(no point of a outside b, some point of a in b and not on its border), in the cell of each row.

    Edges of a are cut where they meet edges of b; the middle of each piece must be in
    b or on its border, and no piece of b's edges may run inside a.
    """
    n = len(a.corner)
    place, on, held = _pieces(a, b)
    fine = ~_some(place[~(on | held)], n)
    strict = _some(place[held & ~on], n)
    place, on, held = _pieces(b, a)
    cut = _some(place[held & ~on], n)
    return fine & ~cut, strict


def _pieces(p: CellEdges, q: CellEdges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, on q's border, in q) of the middle of each piece that q's edges cut p's edges into, within the cells."""
    i, j = products(p.first, q.first)
    met, lo, hi = crossings(p.edges[i], q.edges[j])
    t0, t1 = p.clipped()
    every = np.arange(len(p.edges))
    edge = np.concatenate([every, every, i[met], i[met]])
    t = np.concatenate([t0, t1, lo[met], hi[met]])
    t = np.clip(t, t0[edge], t1[edge])
    order = np.lexsort((t, edge))
    edge, t = edge[order], t[order]
    lone = (p.edges[:, :2] == p.edges[:, 2:]).all(axis=1)
    keep = (edge[:-1] == edge[1:]) & ((t[1:] - t[:-1] > 1e-12) | (lone[edge[:-1]] & np.append(True, edge[1:-1] != edge[:-2])))
    k, m = edge[:-1][keep], (t[:-1][keep] + t[1:][keep]) / 2
    mid = p.edges[k, :2] + m[:, None] * (p.edges[k, 2:] - p.edges[k, :2])
    row = p.row[k]
    at = np.searchsorted(row, np.arange(len(p.first)))
    i, j = products(at, q.first)
    e, v = q.edges[j], mid[i]
    d, w = e[:, 2:] - e[:, :2], v - e[:, :2]
    dd = (d * d).sum(1)
    s = np.clip((w * d).sum(1) / np.where(dd == 0, 1.0, dd), 0, 1)
    near = np.abs(w - s[:, None] * d).max(axis=1, initial=0) <= 1e-9 * q.side[row[i]]
    return row, _some(i[near], len(row)), q.holds(row, mid[:, 0], mid[:, 1])


def cut_at_cells(edges: np.ndarray, weight: np.ndarray, cell: float, grid: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cx, cy, edges, weight): edges cut where they cross cells' sides, each piece with its cell; all ends on a grid.

    An edge and its reverse give the same pieces: each runs from its lower end, and
    its weight is below zero if it was turned.
    """
    e = np.rint(edges / grid) * grid
    turned = (e[:, 0] > e[:, 2]) | ((e[:, 0] == e[:, 2]) & (e[:, 1] > e[:, 3]))
    e, weight = np.where(turned[:, None], e[:, [2, 3, 0, 1]], e), np.where(turned, -weight, weight)
    every, d = np.arange(len(e)), e[:, 2:] - e[:, :2]
    at, share, place = [every, every], [np.zeros(len(e)), np.ones(len(e))], [e[:, :2], e[:, 2:]]
    for k in (0, 1):
        lo, hi = np.minimum(e[:, k], e[:, k + 2]), np.maximum(e[:, k], e[:, k + 2])
        first, last = np.floor(lo / cell + SHIFT[k]).astype(np.int64), np.floor(hi / cell + SHIFT[k]).astype(np.int64)
        i = np.repeat(every, last - first)
        line = np.rint((ragged(first + 1, last - first) - SHIFT[k]) * cell / grid) * grid
        t = np.clip((line - e[i, k]) / d[i, k], 0, 1)
        point = e[i, :2] + t[:, None] * d[i]
        point[:, k] = line
        at.append(i)
        share.append(t)
        place.append(np.rint(point / grid) * grid)
    at, share, place = np.concatenate(at), np.concatenate(share), np.concatenate(place)
    order = np.lexsort((share, at))
    at, place = at[order], place[order]
    keep = (at[:-1] == at[1:]) & (place[:-1] != place[1:]).any(axis=1)
    pieces, at = np.hstack([place[:-1], place[1:]])[keep], at[:-1][keep]
    middle = (pieces[:, :2] + pieces[:, 2:]) / 2
    cx, cy = (np.floor(middle[:, k] / cell + SHIFT[k]).astype(np.int64) for k in (0, 1))
    return cx, cy, pieces, weight[at]
