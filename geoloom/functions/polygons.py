"""Boolean operations on areas by arranging their edges; used inside tasks, one small geometry at a time.

An area is a list of rings (arrays of n x 2, closed or not) read by the even-odd rule,
so shells and holes need no order.  Edges are cut where they cross, each piece is
asked which inputs lie on its two sides, and pieces between wanted and unwanted
become the rings of the result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from geoloom.functions.covering import SHIFT, CellEdges, meets_box, rows_meet, rows_within, winding_rows

Rings = list[np.ndarray]


def edges_of(rings: Rings) -> np.ndarray:
    """All edges, n x 4."""
    out = [np.concatenate([np.hstack([r[:-1], r[1:]]), np.hstack([r[-1:], r[:1]])]) for r in rings if len(r) > 1]
    return np.concatenate(out) if out else np.empty((0, 4))


def inside(points: np.ndarray, edges: np.ndarray, step: int = 1 << 21) -> np.ndarray:
    """Whether each point is inside by the crossing number."""
    out = np.zeros(len(points), bool)
    x0, y0, x1, y1 = edges.T
    rise = np.where(y1 == y0, 1, y1 - y0)
    for k in range(0, len(points) if len(edges) else 0, max(1, step // max(1, len(edges)))):
        part = slice(k, k + max(1, step // len(edges)))
        x, y = points[part, :1], points[part, 1:]
        hit = (y0 > y) != (y1 > y)
        out[part] = (hit & (x < x0 + (y - y0) * (x1 - x0) / rise)).sum(1) % 2 == 1
    return out


def meeting(lo: np.ndarray, hi: np.ndarray, step: int = 1 << 20):
    """Pairs (i, j) of boxes that meet, each once, in blocks: by a sweep over the sorted left sides."""
    order = np.argsort(lo[:, 0], kind="stable")
    left, right = lo[order], hi[order]
    upto = np.searchsorted(left[:, 0], right[:, 0], "right")  # boxes that begin before this one ends
    n = np.maximum(upto - np.arange(len(lo)) - 1, 0)
    total = np.concatenate([[0], np.cumsum(n)])
    k = 0
    while k < len(lo):
        m = max(int(np.searchsorted(total, total[k] + step, "right")) - 1, k + 1)
        i = np.repeat(np.arange(k, m), n[k:m])
        j = i + 1 + np.arange(len(i)) - np.repeat(total[k:m] - total[k], n[k:m])
        met = (left[i, 1] <= right[j, 1]) & (left[j, 1] <= right[i, 1])
        yield order[i[met]], order[j[met]]
        k = m


def noded(edges: np.ndarray, grid: float, fixed: np.ndarray | None = None, weight: np.ndarray | None = None):
    """Edges cut at all crossings and touches, ends on a grid, each piece once, whole pieces only.

    An end within two steps of the grid of another edge cuts that edge, whichever way
    the edges run, so edges that nearly lie on each other become the same pieces.
    fixed: places (n x 2) that stay where they are, on the grid.  With a weight for
    each edge, gives (pieces, weights): how often edges run along each piece from its
    first end, less how often the other way; pieces of weight 0 go.
    """
    p, d = edges[:, :2], edges[:, 2:] - edges[:, :2]
    length = np.hypot(*d.T) + 1e-300
    every, near = np.arange(len(edges)), 2 * grid
    at, cut, place = [every, every], [np.zeros(len(edges)), np.ones(len(edges))], [edges[:, :2], edges[:, 2:]]
    for i, j in meeting(np.minimum(edges[:, :2], edges[:, 2:]) - near, np.maximum(edges[:, :2], edges[:, 2:]) + near):
        w = p[j] - p[i]
        cross = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
        flat = np.abs(cross) <= 1e-12 * length[i] * length[j]
        some = np.where(flat, 1.0, cross)
        t, u = (w[:, 0] * d[j, 1] - w[:, 1] * d[j, 0]) / some, (w[:, 0] * d[i, 1] - w[:, 1] * d[i, 0]) / some
        hit = ~flat & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        point = p[i[hit]] + t[hit, None] * d[i[hit]]
        at += [i[hit], j[hit]]
        cut += [t[hit], u[hit]]
        place += [point, point]
        for a, b in ((i, j), (j, i)):
            for q in (edges[b, :2], edges[b, 2:]):
                v = q - p[a]
                along, off = (v * d[a]).sum(1) / length[a], np.abs(v[:, 0] * d[a, 1] - v[:, 1] * d[a, 0]) / length[a]
                on = (off <= near) & (along >= -near) & (along <= length[a] + near)
                at.append(a[on])
                cut.append((along / length[a])[on])
                place.append(q[on])
    at, cut = np.concatenate(at), np.clip(np.concatenate(cut), 0.0, 1.0)
    place = settled(np.rint(np.concatenate(place) / grid).astype(np.int64), fixed=None if fixed is None else np.rint(fixed / grid).astype(np.int64))
    order = np.lexsort((cut, at))
    at, place = at[order], place[order]
    a, b = place[:-1], place[1:]
    keep = (at[:-1] == at[1:]) & (a != b).any(1)
    a, b = a[keep], b[keep]
    swap = (a[:, 0] > b[:, 0]) | ((a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1]))
    pieces = np.where(swap[:, None], np.hstack([b, a]), np.hstack([a, b]))
    pieces, same = np.unique(pieces, axis=0, return_inverse=True)
    pieces = pieces.reshape(-1, 4).astype(float) * grid
    if weight is None:
        return pieces
    total = np.zeros(len(pieces), np.int64)
    np.add.at(total, same.ravel(), np.where(swap, -1, 1) * weight[at[:-1][keep]])
    return pieces[total != 0], total[total != 0]


def arranged(edges: np.ndarray, weight: np.ndarray, grid: float, fixed: np.ndarray | None = None, most: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, weights) of :func:`noded`, noded again until nothing changes, as pieces that are moved to the grid may cross others."""
    pieces, weight = noded(edges, grid, fixed, weight)
    for _ in range(most):
        if not len(pieces):
            break
        again, total = noded(pieces, grid, fixed, weight)
        if again.shape == pieces.shape and (again == pieces).all() and (total == weight).all():
            break
        pieces, weight = again, total
    return pieces, weight


def settled(place: np.ndarray, reach: int = 2, fixed: np.ndarray | None = None) -> np.ndarray:
    """Grid places with those within ``reach`` of each other made one: a point that two edges give may be rounded either way.  ``fixed`` places stay, and others move to them."""
    if fixed is not None and len(fixed):
        place = np.concatenate([fixed, place])
    points, first, at = np.unique(place, axis=0, return_index=True, return_inverse=True)
    held = first < (0 if fixed is None else len(fixed))
    rank = np.empty(len(points), np.int64)
    rank[np.argsort(~held, kind="stable")] = np.arange(len(points))  # fixed ones count as the least
    label = rank.copy()
    pairs = [np.stack(x) for x in meeting(points.astype(float), points.astype(float) + reach)]
    a, b = np.concatenate(pairs, axis=1) if pairs else np.empty((2, 0), np.int64)
    back = np.empty(len(points), np.int64)
    back[rank] = np.arange(len(points))
    while len(a) and (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[back[label]]
    label[held] = rank[held]
    out = points[back[label]][at.ravel()]
    return out[len(fixed) :] if fixed is not None else out


def combine(a: Rings, b: Rings, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray], in_a: bool = False) -> Rings:
    """The rings of ``wanted(inside a, inside b)``; shells run counter-clockwise, holes clockwise.

    in_a: nothing outside ``a`` is wanted, so only edges of ``b`` that reach its box
    are arranged, and those at its right tell what is inside.
    """
    ea, eb = edges_of(a), edges_of(b)
    near = eb
    if in_a and len(ea) and len(eb):
        low, high = np.minimum(ea[:, :2], ea[:, 2:]).min(axis=0), np.maximum(ea[:, :2], ea[:, 2:]).max(axis=0)
        room = 1e-6 * (1 + np.abs(ea).max() + np.ptp(ea.reshape(-1, 2), axis=0).max())
        lo, hi = np.minimum(eb[:, :2], eb[:, 2:]), np.maximum(eb[:, :2], eb[:, 2:])
        level = (lo[:, 1] <= high[1] + room) & (hi[:, 1] >= low[1] - room) & (hi[:, 0] >= low[0] - room)
        near, eb = eb[level & (lo[:, 0] <= high[0] + room)], eb[level]
    both = np.concatenate([ea, near])
    both = both[(both[:, :2] != both[:, 2:]).any(1)]
    if not len(both):
        return []
    size = float(np.abs(both).max() + np.ptp(both.reshape(-1, 2), axis=0).max()) or 1.0
    for coarser in range(4):
        rings = _arranged(ea, eb, both, 2.0 ** (np.ceil(np.log2(size * 1e-10)) + 4 * coarser), wanted)
        if rings is not None:
            return rings
    raise ValueError("the rings of an overlay don't close")


def _arranged(ea: np.ndarray, eb: np.ndarray, both: np.ndarray, grid: float, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Rings | None:
    """:func:`combine` on a grid; None if the pieces that part wanted from unwanted don't make rings there."""
    pieces = noded(both, grid)
    if not len(pieces):
        return []
    left, right = (wanted(inside(p, ea), inside(p, eb)) for p in sides(pieces, grid))
    return linked(_between(pieces, left, right))


def linked(directed: np.ndarray) -> Rings | None:
    """Rings of directed edges that have their inside on the left; at a crossing the sharpest left turn keeps rings apart that only touch.  None if one does not close."""
    rings, open_ = chained(directed)
    if open_:
        return None
    rings = [straightened(r) for r in rings]
    return [r for r in rings if len(r) > 2]


def chained(directed: np.ndarray, ends: set | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(rings, open chains) of directed edges, as in :func:`linked`; chains run from end to end, rings don't repeat their first vertex.

    ends: places where every chain stops.  Chains also stop where no edge goes on.
    """
    after: dict[tuple, list[tuple]] = {}
    arrive: dict[tuple, int] = {}
    for x0, y0, x1, y1 in directed.tolist():
        after.setdefault((x0, y0), []).append((x1, y1))
        arrive[x1, y1] = arrive.get((x1, y1), 0) + 1
    ends = ends or set()
    starts = [p for p, ways in after.items() for _ in range(len(ways) if p in ends else len(ways) - arrive.get(p, 0))]
    rings, chains = [], []

    def walk(start: tuple, first: tuple | None = None) -> tuple[list, bool]:
        line, came, at = [start], None, start
        while True:
            ways = after.get(at)
            if not ways or (came is not None and at in ends):
                return line, False
            k = 0
            if came is not None and len(ways) > 1:
                turn = [np.arctan2(came[0] * (w[1] - at[1]) - came[1] * (w[0] - at[0]), came[0] * (w[0] - at[0]) + came[1] * (w[1] - at[1])) for w in ways]
                k = int(np.argmax(turn))
            to = ways.pop(k)
            if not ways:
                del after[at]
            came, at = (to[0] - at[0], to[1] - at[1]), to
            if at == start and start not in ends:
                return line, True
            line.append(at)

    for start in starts:
        if start in after:
            line, closed = walk(start)
            (rings if closed else chains).append(np.array(line))
    while after:
        line, closed = walk(next(iter(after)))
        (rings if closed else chains).append(np.array(line))
    return rings, chains


def straightened(ring: np.ndarray, closed: bool = True) -> np.ndarray:
    """The ring without vertices on a straight run; a chain that is not closed keeps its ends."""
    before, after = ring - np.roll(ring, 1, 0), np.roll(ring, -1, 0) - ring
    bent = np.abs(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0]) > 1e-9 * np.hypot(*before.T) * np.hypot(*after.T)
    if not closed:
        bent[[0, -1]] = True
    return ring[bent]


def signed_area(ring: np.ndarray) -> float:
    """Shoelace area, above 0 if counter-clockwise."""
    x, y = ring.T
    return float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y) / 2)


def intersection(a: Rings, b: Rings) -> Rings:
    """What lies in both; two convex shapes are clipped directly."""
    if len(a) == len(b) == 1 and len(a[0]) > 2 and len(b[0]) > 2 and is_simple_convex(a[0]) and is_simple_convex(b[0]):
        return clipped(a[0], b[0])
    return a if within(a, b) else combine(a, b, np.logical_and, in_a=True)


def clipped(shape: np.ndarray, window: np.ndarray) -> Rings:
    """The part of a convex shape in a convex window: it is cut by one side of the window after another (Sutherland-Hodgman)."""
    out = [tuple(p) for p in (shape if signed_area(shape) > 0 else shape[::-1]).tolist()]
    sides = window if signed_area(window) > 0 else window[::-1]
    for (ax, ay), (bx, by) in zip(sides.tolist(), np.roll(sides, -1, 0).tolist(), strict=True):
        depth = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in out]
        kept = []
        for k, (p, d) in enumerate(zip(out, depth, strict=True)):
            q, e = out[k - 1], depth[k - 1]
            if (d >= 0) != (e >= 0):
                t = e / (e - d)
                kept.append((q[0] + t * (p[0] - q[0]), q[1] + t * (p[1] - q[1])))
            if d >= 0:
                kept.append(p)
        out = kept
        if not out:
            return []
    ring = np.array([p for k, p in enumerate(out) if p != out[k - 1]])
    return [ring] if len(ring) > 2 and signed_area(ring) > 1e-15 else []


def difference(a: Rings, b: Rings) -> Rings:
    """What lies in a alone."""
    return combine(a, b, lambda p, q: p & ~q, in_a=True)


def _cells(a: Rings, b: Rings) -> tuple[CellEdges, CellEdges] | None:
    """The edges of both in one cell around ``a``; None where the boxes lie apart."""
    ea, eb = edges_of(a), edges_of(b)
    if not len(ea) or not len(eb):
        return None
    low, high = ea.reshape(-1, 2).min(axis=0), ea.reshape(-1, 2).max(axis=0)
    side = float((high - low).max()) or 1.0
    x, y, size = np.array([low[0] - 0.21 * side]), np.array([low[1] - 0.23 * side]), np.array([1.41 * side])
    met = meets_box(eb, *(np.repeat(v, len(eb)) for v in (x, y, size, size)))
    one = lambda e, corner: CellEdges(np.array([0, len(e)]), e, np.ones(1, bool), corner, x, y, size)
    return one(ea, np.zeros(1, bool)), one(eb[met], inside(np.stack([x, y], 1), eb))


def touches(a: Rings, b: Rings) -> bool:
    """Whether two areas share a point, borders included."""
    cells = _cells(a, b)
    return bool(cells and rows_meet(*cells)[0])


def within(a: Rings, b: Rings) -> bool:
    """Whether no point of ``a`` lies outside ``b``."""
    cells = _cells(a, b)
    return bool(cells and rows_within(*cells)[0][0])


def union(a: Rings, b: Rings) -> Rings:
    """What lies in either."""
    return combine(a, b, np.logical_or)


def repaired(a: Rings) -> Rings:
    """Self-crossing rings rebuilt by the even-odd rule; a convex ring needs nothing."""
    if len(a) == 1 and len(a[0]) > 2 and is_simple_convex(a[0]):
        return a if signed_area(a[0]) > 0 else [a[0][::-1]]
    return combine(a, [], lambda p, q: p)


def union_all(shapes: list[Rings]) -> Rings:
    """The union of many areas, arranged in one sweep: what edges run around, shells counter-clockwise and holes clockwise."""
    shapes = [s for s in shapes if s]
    if len(shapes) < 2:
        return shapes[0] if shapes else []
    return run_around(edges_of([r for s in shapes for r in oriented(s)]))


def oriented(a: Rings) -> Rings:
    """Rings of an area with shells counter-clockwise and holes clockwise, told by how many other rings hold them."""
    if len(a) == 1:
        return a if signed_area(a[0]) >= 0 else [a[0][::-1]]
    out = []
    for k, r in enumerate(a):
        others = edges_of([q for j, q in enumerate(a) if j != k])
        depth = int(np.median(inside((r + np.roll(r, -1, 0)) / 2, others)))
        out.append(r if (signed_area(r) > 0) == (depth % 2 == 0) else r[::-1])
    return out


def run_around(edges: np.ndarray) -> Rings:
    """The rings around all places that directed edges run around more often counter-clockwise than clockwise."""
    edges = edges[(edges[:, :2] != edges[:, 2:]).any(1)]
    if not len(edges):
        return []
    size = float(np.abs(edges).max() + np.ptp(edges.reshape(-1, 2), axis=0).max()) or 1.0
    for coarser in range(4):
        grid = 2.0 ** (np.ceil(np.log2(size * 1e-10)) + 4 * coarser)
        pieces, weight = arranged(edges, np.ones(len(edges), np.int64), grid)
        if not len(pieces):
            return []
        _, right = sides(pieces, grid, 1 / 16)
        right = winding(right, pieces, weight)
        rings = linked(_between(pieces, right + weight > 0, right > 0))
        if rings is not None:
            return rings
    raise ValueError("the rings of a union don't close")


def outline_in_cell(edges: np.ndarray, weight: np.ndarray, base: int, cx: int, cy: int, cell: float, grid: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(rings, open chains) of the border, in one cell, of all that edges run around; edges end at the cell's sides.

    base: how often the cell's lower left corner is run around.
    """
    low = np.rint((np.array([cx, cy]) - SHIFT) * cell / grid) * grid
    high = np.rint((np.array([cx + 1, cy + 1]) - SHIFT) * cell / grid) * grid
    ends = edges.reshape(-1, 2)
    rim = np.unique(ends[((ends == low) | (ends == high)).any(axis=1)], axis=0)
    pieces, weight = arranged(edges, weight, grid, rim)
    if not len(pieces):
        return [], []
    # runs around a place: those around the corner, and what changes on the way up and then right
    right = base + _path_winding(sides(pieces, grid, 1 / 16)[1], pieces, weight, low)
    return chained(_between(pieces, right + weight > 0, right > 0), {tuple(p) for p in rim.tolist()})


def _path_winding(points: np.ndarray, e: np.ndarray, weight: np.ndarray, low: np.ndarray) -> np.ndarray:
    """How the winding number changes from the corner up to each point's height and then right to it."""
    px, py = points.T
    across = winding_rows(np.full(len(px), low[0]), py, e, weight) - winding_rows(px, py, e, weight)
    # going up, along the left side: edges are turned so that up becomes right
    upright = e[:, [1, 0, 3, 2]]
    at = np.full(len(px), low[0])
    rise = winding_rows(np.full(len(px), low[1]), at, upright, weight) - winding_rows(py, at, upright, weight)
    return rise - across


def winding(points: np.ndarray, e: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """How often edges run around points that lie on none of them, by rays along the axis that fewer edges stand across."""
    crossed = [int((np.searchsorted(at, np.maximum(e[:, k], e[:, k + 2])) - np.searchsorted(at, np.minimum(e[:, k], e[:, k + 2]))).sum()) for k in (0, 1) for at in (np.sort(points[:, k]),)]
    if crossed[0] < crossed[1]:
        return -winding_rows(points[:, 1], points[:, 0], e[:, [1, 0, 3, 2]], weight)
    return winding_rows(points[:, 0], points[:, 1], e, weight)


def sides(pieces: np.ndarray, grid: float, steps: float = 64) -> tuple[np.ndarray, np.ndarray]:
    """A point close to the middle of each piece on its left, and one on its right, ``steps`` of the grid away at most."""
    mid, way = (pieces[:, :2] + pieces[:, 2:]) / 2, pieces[:, 2:] - pieces[:, :2]
    length = np.hypot(*way.T)
    aside = np.stack([-way[:, 1], way[:, 0]], 1) / length[:, None] * np.minimum(grid * steps, length / 8)[:, None]
    return mid + aside, mid - aside


def _between(pieces: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pieces with what is wanted on one side alone, so directed that it is on the left."""
    return np.concatenate([pieces[left & ~right], pieces[right & ~left][:, [2, 3, 0, 1]]])


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull, counter-clockwise, by monotone chains."""
    pts = np.unique(np.round(points, 12), axis=0)

    def chain(seq) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return np.array(chain(pts.tolist())[:-1] + chain(pts[::-1].tolist())[:-1])


def circle(distance: float, segments: int) -> np.ndarray:
    """A circle's vertices, ``segments`` a quadrant."""
    t = np.arange(4 * segments) * np.pi / (2 * segments)
    return np.stack([np.cos(t), np.sin(t)], 1) * distance


def offset_curve(path: np.ndarray, round_: np.ndarray) -> np.ndarray:
    """Directed edges of the curve that a closed path draws at its right, its Minkowski sum with a convex polygon.

    Each edge is moved by the polygon's vertex that is outermost on its right.  Where
    the path turns left, or back, the polygon's vertices between two edges follow;
    where it turns right the curve goes through the path's vertex.  What the curve
    runs around counter-clockwise, over all paths of a shape, is the widened shape.
    """
    moving = (path != np.roll(path, 1, 0)).any(1)
    if not moving.any():
        return np.hstack([path[0] + round_, path[0] + np.roll(round_, -1, 0)])
    path = path[moving]
    way = np.roll(path, -1, 0) - path
    k = (np.stack([way[:, 1], -way[:, 0]], 1) @ round_.T).argmax(axis=1)
    after, to = np.roll(way, -1, 0), np.roll(k, -1)
    cross, dot = way[:, 0] * after[:, 1] - way[:, 1] * after[:, 0], (way * after).sum(1)
    left = (cross > 0) | ((cross == 0) & (dot < 0))
    steps = np.where(left, (to - k) % len(round_), 0)
    # for each edge: its two ends, then the polygon's vertices, or the path's vertex
    through = ~left & (to != k)
    n = 2 + steps + through
    edge = np.repeat(np.arange(len(path)), n)
    j = np.arange(len(edge)) - np.repeat(np.cumsum(n) - n, n)
    corner = np.where(j == 0, edge, (edge + 1) % len(path))
    turn = (k[edge] + np.maximum(j - 1, 0)) % len(round_)
    points = path[corner] + np.where((through[edge] & (j == 2))[:, None], 0.0, round_[turn])
    return np.hstack([points, np.roll(points, -1, 0)])


def buffer(kind: str, parts: list[Rings], distance: float, segments: int = 30) -> Rings:
    """All within ``distance``, a circle having ``segments`` sides a quadrant: what the offset curves of all parts run around, arranged in one sweep.  A negative distance takes the border's buffer off an area."""
    round_ = circle(abs(distance), segments)
    rings = [r for p in parts for r in p if len(r)]
    if "Point" in kind:
        return run_around(np.concatenate([offset_curve(p[None, :], round_) for r in rings for p in np.unique(r, axis=0)])) if rings else []
    if "Polygon" not in kind:
        if len(rings) == 1 and len(rings[0]) == 2 and (rings[0][0] != rings[0][1]).any():
            return _curve_alone(offset_curve(rings[0], round_))
        return run_around(np.concatenate([offset_curve(np.concatenate([r, r[-2:0:-1]]), round_) for r in rings])) if rings else []
    own = oriented(repaired(rings))
    if not own:
        return []
    outer = [offset_curve(r, round_) for r in own]
    if distance > 0 and len(own) == 1 and is_simple_convex(own[0]):
        return _curve_alone(outer[0])
    if distance > 0:
        return run_around(np.concatenate(outer))
    border = run_around(np.concatenate(outer + [offset_curve(r[::-1], round_) for r in own]))
    return difference(own, border)


def _curve_alone(edges: np.ndarray) -> Rings:
    """The ring of a curve that never turns right."""
    return [straightened(edges[(edges[:, :2] != edges[:, 2:]).any(1), :2])]


def is_convex(ring: np.ndarray) -> bool:
    """Whether a ring never turns right."""
    before, after = ring - np.roll(ring, 1, 0), np.roll(ring, -1, 0) - ring
    turn = before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0]
    return bool((turn >= 0).all() or (turn <= 0).all())


def is_simple_convex(ring: np.ndarray) -> bool:
    """Whether a ring is convex and turns once around, with some area."""
    before, after = ring - np.roll(ring, 1, 0), np.roll(ring, -1, 0) - ring
    turn = np.arctan2(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0], (before * after).sum(1))
    return bool(is_convex(ring) and abs(abs(turn.sum()) - 2 * np.pi) < 1e-6 and signed_area(ring) != 0)


def nested(rings: Rings) -> list[Rings]:
    """Parts of a MultiPolygon: each shell with the holes it is the smallest to hold."""
    shells = sorted((r for r in rings if signed_area(r) > 0), key=signed_area)
    parts = [[s] for s in shells]
    if len(parts) == 1:
        return [[*parts[0], *(r for r in rings if signed_area(r) < 0)]]
    for hole in (r for r in rings if signed_area(r) < 0):
        probe = ((hole[:1] + hole[1:2]) / 2).repeat(1, 0)
        home = next((k for k, s in enumerate(shells) if inside(probe, edges_of([s]))[0] and signed_area(s) > -signed_area(hole)), None)
        if home is not None:
            parts[home].append(hole)
    return parts


def from_struct(geom: dict, areas: bool = True) -> Rings:
    """Rings of a geometry struct, those of areas without the closing vertex."""
    rings = [np.array([(v["x"], v["y"]) for v in r]) for p in geom["parts"] for r in p if len(r)]
    return rings if not areas else [r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r for r in rings]
