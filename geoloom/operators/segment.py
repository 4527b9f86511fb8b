"""Regions of rasters: components, polygons, contours, edges with hysteresis, watershed, clusters, Hough votes."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.functions.arrow_geometry import ARROW, VERTEX, geometries
from geoloom.functions.params import in_range, one_of
from geoloom.operators.focal import DERIVATIVE, TILE, separable, tile_apply, tiles
from geoloom.operators.graph import checkpointed, connected_components, small_join
from geoloom.operators.raster import KEY, by_band, otsu, stretched
from geoloom.operators.rings import CHAIN, chain_rows, rings_of_chains

STEPS = {4: ((0, 1), (1, 0)), 8: ((0, 1), (1, 0), (1, 1), (1, -1))}


#: What a pixel's number has room for: rasters, bands, rows, columns.
ID_BITS = {"raster_id": 21, "band": 6, "row": 18, "col": 18}


def pixel_id(raster: Column, band: Column, row: Column, col: Column) -> Column:
    """A number for each pixel; rasters from 2^21, bands from 64, rows or columns from 262,144 on, and numbers below 0, are an error."""
    out, low = F.lit(0).cast("long"), 0
    for (name, bits), c in reversed(list(zip(ID_BITS.items(), (raster, band, row, col), strict=True))):
        c = c.cast("long")
        refused = F.raise_error(F.concat(F.lit(f"no pixel number for {name} "), c.cast("string")))
        out = out + F.shiftleft(F.when((c >= 0) & (c < 1 << bits), c).when(c.isNotNull(), refused.cast("long")), low)
        low += bits
    return out


def tile_labels(grid: np.ndarray, connectivity: int) -> np.ndarray:
    """For each cell the first cell of its region of equal values (NaN cells: -1), by min-label hooking and pointer jumping."""
    h, w = grid.shape
    at = np.arange(h * w).reshape(h, w)
    a, b = [], []
    for dy, dx in STEPS[connectivity]:
        ys, xs = slice(0, h - dy), slice(max(0, -dx), w - max(0, dx))
        yt, xt = slice(dy, h), slice(max(0, dx), w - max(0, -dx))
        same = grid[ys, xs] == grid[yt, xt]
        a.append(at[ys, xs][same])
        b.append(at[yt, xt][same])
    a, b, label = np.concatenate(a), np.concatenate(b), at.ravel().copy()
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return np.where(np.isnan(grid).ravel(), -1, label).reshape(h, w)


def components(pixels: DataFrame, connectivity: int = 4, tile: int = TILE) -> DataFrame:
    """``(raster_id, band, row, col, value, label)``: pixels of equal value that touch share a label, their smallest pixel id; null values have none.

    Labels are found in tiles first.  Only pixels on tile edges are then joined with
    their neighbours, and the links between tile labels settled as a graph, so the
    rounds work on tile borders, not on pixels.
    """
    one_of("connectivity", str(connectivity), ("4", "8"))

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(pdf["row"].min()), int(pdf["col"].min())
        y, x = pdf["row"].to_numpy() - y0, pdf["col"].to_numpy() - x0
        grid = np.full((y.max() + 1, x.max() + 1), np.nan)
        grid[y, x] = pdf["value"].to_numpy()
        ids = np.zeros(grid.shape, np.int64)
        ids[y, x] = pdf["id"].to_numpy()
        return pdf[["raster_id", "band", "row", "col", "value"]].assign(local=ids.ravel()[tile_labels(grid, connectivity)[y, x]])

    cells = pixels.where("value is not null and not isnan(value)").withColumn("id", pixel_id(*[F.col(c) for c in ID_BITS])).withColumns({"ty": F.floor(F.col("row") / tile), "tx": F.floor(F.col("col") / tile)})
    local = checkpointed(cells.groupBy(*KEY, "ty", "tx").applyInPandas(label, "raster_id long, band int, row int, col int, value double, local long"))
    rim = local.where(((F.col("row") % tile).isin(0, tile - 1)) | ((F.col("col") % tile).isin(0, tile - 1)))
    here = rim.select(*KEY, "row", "col", "value", F.col("local").alias("a"), F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in STEPS[connectivity]])).alias("s"))
    here = here.select(*KEY, (F.col("row") + F.col("s.dy")).alias("row"), (F.col("col") + F.col("s.dx")).alias("col"), "value", "a")
    links = here.join(rim.select(*KEY, "row", "col", "value", F.col("local").alias("b")), [*KEY, "row", "col", "value"]).where("a <> b").select("a", "b").distinct()
    found = connected_components(links).select(F.col("node").alias("local"), "component")
    return small_join(local, found, ["local"], "left").select(*KEY, "row", "col", "value", F.coalesce("component", "local").alias("label"))


def region_table(labelled: DataFrame, cell_area: float = 1.0) -> DataFrame:
    """``(raster_id, band, label, dn, pixels, area, perimeter)`` of each region; perimeter counts pixel sides where the label changes."""
    sides = [F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0))]
    near = labelled.select(*KEY, "row", "col", "label", F.explode(F.array(*sides)).alias("s")).select(*KEY, (F.col("row") + F.col("s.dy")).alias("row"), (F.col("col") + F.col("s.dx")).alias("col"), "label")
    other = labelled.select(*KEY, "row", "col", F.col("label").alias("_l"))
    inner = near.join(other, [*KEY, "row", "col"]).where("label = _l").groupBy(*KEY, "label").agg(F.count("*").alias("inner"))
    size = labelled.groupBy(*KEY, "label").agg(F.first("value").cast("int").alias("dn"), F.count("*").alias("pixels"))
    return size.join(inner, [*KEY, "label"], "left").select(*KEY, "label", "dn", "pixels", (F.col("pixels") * cell_area).alias("area"), (F.col("pixels") * 4 - F.coalesce("inner", F.lit(0))).alias("perimeter"))


def polygonize(pixels: DataFrame, gt: tuple[float, ...], connectivity: int = 4, tile: int = TILE, most: int = 1 << 20) -> DataFrame:
    """``(raster_id, band, label, DN, geom)``: a polygon for each region of equal whole values, zero included.

    Each tile links the pixel sides between its labels, all at once, and drops the
    vertices on straight runs.  Regions that lie in one tile are polygons there.  Those
    of others are rings and chains, which end where the outline goes on in another tile
    and are linked to rings (:func:`geoloom.operators.rings.rings_of_chains`), so a
    region over many tiles comes together as its outline only.  Regions that hang
    together at corners alone (``connectivity`` 8) have a part for each.
    """
    from geoloom.operators.overlay import _polygons

    kind = "Polygon" if connectivity == 4 else "MultiPolygon"
    ox, px, _, oy, _, py = gt
    v = checkpointed(components(pixels.withColumn("value", F.floor("value").cast("double")), connectivity))
    # pixels have no numbers below 0, so no tiles either
    span = lambda c: F.explode(F.array_distinct(F.array(*[F.greatest(F.floor((F.col(c) + d) / tile), F.lit(0)) for d in (-1, 0, 1)])))
    dealt = v.select(*KEY, "row", "col", "label", F.col("value").cast("int").alias("DN")).withColumn("ty", span("row")).withColumn("tx", span("col"))

    def walk(table: pa.Table) -> pa.Table:
        row, col, label, dn = (table.column(c).to_numpy() for c in ("row", "col", "label", "DN"))
        core = (row // tile == table.column("ty")[0].as_py()) & (col // tile == table.column("tx")[0].as_py())
        names, at = np.unique(label, return_inverse=True)
        at, r0, c0 = at.ravel(), int(row.min()), int(col.min())
        grid = np.full((int(row.max()) - r0 + 3, int(col.max()) - c0 + 3), -1)
        grid[row - r0 + 1, col - c0 + 1] = at
        own = np.zeros(grid.shape, bool)
        own[row - r0 + 1, col - c0 + 1] = core
        value = np.zeros(len(names), np.int64)
        value[at] = dn
        lies = np.ones(len(names), bool)
        lies[at[~core]] = False
        of, closed, first, xy = _outlines(grid, own, r0, c0)
        told, geom = _whole_polygons(of, first, xy, lies, kind, lambda p: np.stack([ox + p[:, 0] * px, oy - p[:, 1] * py], 1))
        parts = [(k, xy[i:j]) for k, i, j in zip(of, first, first[1:], strict=False) if not lies[k]]
        xs, ys, _ = chain_rows([], [p for _, p in parts])
        none, every = len(told), np.concatenate([told, [k for k, _ in parts]]).astype(np.int64)
        one = lambda c: table.column(c).take(pa.array(np.zeros(len(every), np.int64)))
        with_none = lambda c: pa.concat_arrays([pa.nulls(none, c.type), c])
        return pa.table({"raster_id": one("raster_id"), "band": one("band"), "label": pa.array(names[every]), "DN": pa.array(value[every].astype(np.int32)), "geom": pa.concat_arrays([geom, pa.nulls(len(parts), geom.type)]), "xs": with_none(xs), "ys": with_none(ys), "closed": with_none(pa.array(closed[~lies[of]]))})

    keys = [*KEY, "label", "DN"]
    found = checkpointed(dealt.groupBy(*KEY, "ty", "tx").applyInArrow(walk, f"raster_id long, band int, label long, DN int, geom {G.TYPE}, {CHAIN}"))
    whole, chains = found.where("geom is not null").select(*keys, "geom"), found.where("geom is null").drop("geom")
    if not chains.limit(1).count():
        return whole
    shapes = _polygons(rings_of_chains(chains, keys, most), keys, kind)
    return whole.unionByName(shapes.withColumn("geom", G.map_vertices(F.col("geom"), lambda x, y: (ox + x * px, oy - y * py))))


#: A pixel's sides against the clock from the lower one: their outer neighbour, the way they go and their begin from the pixel's upper left corner, in rows and columns.
SIDES = (((1, 0), (0, 1), (1, 0)), ((0, 1), (-1, 0), (1, 1)), ((-1, 0), (0, -1), (0, 1)), ((0, -1), (1, 0), (0, 0)))


def _outlines(grid: np.ndarray, own: np.ndarray, r0: int, c0: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(label, closed, first vertex, vertices) of the outlines around the ``own`` cells of a grid of labels with one more cell on every side; x is the column, y the row below zero, the region on the left.

    After a side comes the one that turns most to the left, which the three cells
    around its end tell.  Chains end where that side is of a cell that is not ``own``;
    they have a vertex at each end.  One more number ends the list of first vertices.
    """
    h, w = grid.shape
    flat, mine = grid.ravel(), own.ravel()
    at, turn, after = [], [], []
    for d, ((oy, ox), (my, mx), _) in enumerate(SIDES):
        out, ahead = oy * w + ox, my * w + mx
        p = np.flatnonzero(mine)
        p = p[flat[p + out] != flat[p]]
        left, right = flat[p + ahead] != flat[p], flat[p + ahead + out] == flat[p]
        cell = np.where(left, p, np.where(right, p + ahead + out, p + ahead))
        to = np.where(left, (d + 1) % 4, np.where(right, (d + 3) % 4, d))
        at.append(d * h * w + p)
        turn.append(to != d)
        after.append(np.where(mine[cell], to * h * w + cell, -1))
    at, turn, after = (np.concatenate(x) for x in (at, turn, after))
    n = len(at)
    number = np.full(4 * h * w + 1, -1)
    number[at] = np.arange(n)
    after = number[after]  # -1 is the last place, which no side has
    every = np.arange(n)
    low, jump = every, np.where(after < 0, every, after)
    for _ in range(n.bit_length()):
        low, jump = np.minimum(low, low[jump]), jump[jump]
    open_ = after[jump] < 0
    line = np.where(open_, jump, low)  # a chain goes by its last side, a ring by its least
    end = (after < 0) | ~open_ & (after == low)
    left, jump = np.where(end, 0, 1), np.where(end, every, after)
    while (jump[jump] != jump).any():
        left, jump = left + left[jump], jump[jump]
    bent = np.zeros(n, bool)
    bent[after[turn & (after >= 0)]] = True
    begins = np.ones(n, bool)
    begins[after[after >= 0]] = False
    order = np.lexsort((-left, line))
    order = order[(bent | begins | (open_ & end))[order]]
    begin = np.array([b for _, _, b in SIDES])[at // (h * w)] + np.stack([at % (h * w) // w + r0 - 1, at % w + c0 - 1], 1)
    # the last side of a chain has its begin, if it is a vertex, and its end
    twice = np.where((open_ & end)[order], np.where((bent | begins)[order], 2, 1), 1)
    side = np.repeat(order, twice)
    last = np.append(side[1:] != side[:-1], True) & (open_ & end)[side]
    way = np.array([m for _, m, _ in SIDES])[at[side] // (h * w)]
    place = begin[side] + np.where(last[:, None], way, 0)
    first = np.flatnonzero(np.append(True, line[side][1:] != line[side][:-1])) if n else np.empty(0, np.int64)
    of = side[first]
    return flat[at[of] % (h * w)], ~open_[of], np.append(first, len(side)), np.stack([place[:, 1], -place[:, 0]], 1).astype(float)


def _whole_polygons(of: np.ndarray, first: np.ndarray, xy: np.ndarray, lies: np.ndarray, kind: str, placed: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, pa.Array]:
    """(labels, geometries) of the labels that ``lies`` marks, from the outlines of :func:`_outlines` with their vertices ``placed``: shells before their holes."""
    from geoloom.operators.overlay import parts_of

    size = np.diff(first)
    after = np.arange(len(xy)) + 1
    after[first[1:] - 1] = first[:-1]
    cross = (xy[:, 0] * xy[after, 1] - xy[after, 0] * xy[:, 1]) if len(xy) else np.empty(0)
    area = np.add.reduceat(cross, first[:-1]) if len(of) else np.empty(0)
    shell = area > 0
    shells = np.bincount(of[shell], minlength=len(lies))
    simple = np.flatnonzero(lies[of] & (shells[of] == 1))
    simple = simple[np.lexsort((simple, ~shell[simple], of[simple]))]
    ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    # each ring's vertices and its first one again
    many = size[simple] + 1
    upto = np.cumsum(many)
    take = np.repeat(first[simple] - (upto - many), many) + np.arange(upto[-1] if len(upto) else 0)
    take[upto - 1] = first[simple]
    vertices = pa.StructArray.from_arrays([pa.array(c) for c in placed(xy[take]).T], fields=list(VERTEX))
    labels, rings = np.unique(of[simple], return_counts=True)
    level = pa.ListArray.from_arrays(ends(rings), pa.ListArray.from_arrays(ends(many), vertices))
    level = pa.ListArray.from_arrays(ends(np.ones(len(labels))), level)
    geom = pa.StructArray.from_arrays([pa.array([kind] * len(labels), pa.string()), level], fields=list(ARROW))
    others = np.flatnonzero(lies & (shells > 1))
    held = [[[placed(r) for r in p] for p in parts_of([xy[first[i] : first[i + 1]] for i in np.flatnonzero(of == k)])] for k in others]
    return np.concatenate([labels, others]), pa.concat_arrays([geom, geometries(kind, held)])


def contours(pixels: DataFrame, min_area: float = 100) -> DataFrame:
    """``(raster_id, band, label, pixels, area)`` of the outer contours above Otsu's threshold, holes filled.

    What is not background that reaches the raster's edge is filled; its 8-connected
    regions are the contours' insides.  The area within the pixel centres is a whole
    for each full 2 x 2 block and a half for each with three pixels.
    """
    in_range("min_area", min_area, 0)
    v = stretched(pixels)
    light = small_join(v, otsu(v), KEY).select(*KEY, "row", "col", F.when(F.col("value") > F.col("threshold"), 1.0).otherwise(0.0).alias("value"))
    size = light.groupBy(*KEY).agg(F.max("row").alias("h"), F.max("col").alias("w"))
    dark = small_join(components(light.where("value = 0"), 4), size, KEY)
    outer = dark.where("row = 0 or col = 0 or row = h or col = w").select("label").distinct()
    open_ = dark.join(outer, "label", "left_semi").select(*KEY, "row", "col")
    filled = components(light.join(open_, [*KEY, "row", "col"], "left_anti").withColumn("value", F.lit(1.0)), 8)
    corner = F.explode(F.array(*[F.struct((F.col("row") - dy).alias("y"), (F.col("col") - dx).alias("x")) for dy in (0, 1) for dx in (0, 1)])).alias("q")
    blocks = filled.select(*KEY, "label", corner).groupBy(*KEY, "label", "q").agg(F.count("*").alias("n"))
    inside = blocks.groupBy(*KEY, "label").agg(F.sum(F.when(F.col("n") == 4, 1.0).when(F.col("n") == 3, 0.5).otherwise(0.0)).alias("area"))
    return filled.groupBy(*KEY, "label").agg(F.count("*").alias("pixels")).join(inside, [*KEY, "label"]).where(F.col("area") >= min_area)


def canny(pixels: DataFrame, low: float = 50, high: float = 150) -> DataFrame:
    """``(raster_id, band, row, col)`` of edge pixels: Sobel magnitude |gx| + |gy| thinned along the gradient, strong ones and weak ones that touch them through others."""
    slope, smooth = np.array(DERIVATIVE[1]), np.array(DERIVATIVE[0])

    def thin(g: np.ndarray) -> np.ndarray:
        gx, gy = separable(g, smooth, slope), separable(g, slope, smooth)
        m = np.abs(gx) + np.abs(gy)
        core, x, y = m[1:-1, 1:-1], gx[1:-1, 1:-1], gy[1:-1, 1:-1]
        near = lambda dy, dx: m[1 + dy : m.shape[0] - 1 + dy, 1 + dx : m.shape[1] - 1 + dx]
        t = math.tan(math.pi / 8)
        flat, steep = np.abs(y) <= t * np.abs(x), np.abs(x) < t * np.abs(y)
        a = np.where(flat, near(0, -1), np.where(steep, near(-1, 0), np.where(x * y > 0, near(-1, -1), near(-1, 1))))
        b = np.where(flat, near(0, 1), np.where(steep, near(1, 0), np.where(x * y > 0, near(1, 1), near(1, -1))))
        keep = (core > a) & (core >= b) & (core > low)
        return np.where(keep, np.where(core > high, 2.0, 1.0), np.nan)

    marked = checkpointed(tile_apply(stretched(pixels), thin, 2))
    grouped = components(marked.withColumn("value", F.lit(1.0)), 8).select(*KEY, "row", "col", "label")
    strong = grouped.join(marked.where("value = 2"), [*KEY, "row", "col"], "left_semi").select("label").distinct()
    return grouped.join(strong, "label", "left_semi").select(*KEY, "row", "col")


def watershed(pixels: DataFrame, markers: DataFrame, tile: int = TILE) -> DataFrame:
    """``(raster_id, band, row, col, label)``: each pixel gets the marker it is reached from over the lowest pass.

    markers: ``(raster_id, band, row, col, label)`` with labels above 0.  Tiles are
    flooded from their own markers and their neighbours' borders, by pass height and
    then by distance since the pass was reached; ties go to the smaller label.  Rounds
    go on until no border changes, so the result is that of one flood of the whole.
    A tile is flooded again, and then anew, only if a pixel beside it changed in the
    round before: what came of a neighbour's earlier labels must not stay.  Bands that
    are settled are put aside.  A pixel without a value is lower than all others.
    """
    none = F.col("value").isNull() | F.isnan("value")
    state = pixels.select(*KEY, "row", "col", F.when(none, F.lit(float("-inf"))).otherwise(F.col("value")).alias("value")).join(markers.select(*KEY, "row", "col", F.col("label").cast("long").alias("mark")), [*KEY, "row", "col"], "left")
    state = state.withColumns({"cost": F.when(F.col("mark").isNotNull(), F.col("value")).otherwise(F.lit(float("inf"))), "steps": F.lit(0).cast("long"), "mark": F.coalesce("mark", F.lit(0))})
    state = checkpointed(state.withColumns({"label": F.col("mark"), "changed": F.col("mark") > 0}))
    schema = "raster_id long, band int, row int, col int, value double, mark long, label long, cost double, steps long, changed boolean"
    names = [x.split()[0] for x in schema.split(", ")]

    place, aside, first = [*KEY, "ty", "tx"], [], True

    def flood(table: pa.Table) -> pa.Table:
        t = {c: table.column(c).to_numpy() for c in table.column_names}
        core, before = t["core"], [t[c] for c in ("cost", "steps", "label")]
        given = [np.where(core, x, y) for x, y in zip((t["value"], 0, t["mark"]), before, strict=True)]
        after = [x.copy() for x in before]
        order = np.lexsort([t[c] for c in place])
        cuts = np.flatnonzero(np.any([np.diff(t[c][order]) != 0 for c in place], axis=0)) + 1
        for part in np.split(order, cuts):
            for x, new in zip(after, _flooded(*(t[c][part] for c in ("row", "col", "value")), *(x[part] for x in given)), strict=True):
                x[part] = new
        t |= dict(zip(("cost", "steps", "label"), after, strict=True), changed=np.any([x != y for x, y in zip(before, after, strict=True)], axis=0))
        return pa.table({c: t[c][core] for c in names})

    span = lambda c: F.explode(F.array_distinct(F.array(*[F.floor((F.col(c) + d) / tile) for d in (-1, 0, 1)])))
    own = lambda c: F.floor(F.col(c) / tile)
    pieces, bands = state.rdd.getNumPartitions(), state.select(*KEY).distinct().count()
    while True:
        dealt = state.withColumn("ty", span("row")).withColumn("tx", span("col")).withColumn("core", (own("row") == F.col("ty")) & (own("col") == F.col("tx")))
        woken = checkpointed(dealt.where("changed" if first else "changed and not core").select(*place).distinct())
        first, busy = False, woken.select(*KEY).distinct().count()
        if not busy:  # costs and steps only fall, and labels follow them, so this comes
            for part in aside:
                state = state.unionByName(part)
            return state.select(*KEY, "row", "col", "label")
        if 2 * busy <= bands:
            running = woken.select(*KEY).distinct()
            aside.append(small_join(state, running, KEY, "left_anti"))
            state, dealt, bands = small_join(state, running, KEY, "left_semi"), small_join(dealt, running, KEY, "left_semi"), busy
        # groups of tiles with about 2^18 pixels, as a task spends more on a group than on a small tile
        group = F.pmod(F.xxhash64(*place), F.lit(woken.count() * (tile + 2) ** 2 // (1 << 18) + 1)).alias("group")
        flooded = small_join(dealt.drop("changed"), woken, place).groupBy(group).applyInArrow(flood, schema)
        calm = small_join(state.withColumns({"ty": own("row"), "tx": own("col")}), woken, place, "left_anti").withColumn("changed", F.lit(False))
        state = checkpointed(flooded.unionByName(calm.select(*names)).coalesce(pieces))


def _flooded(row: np.ndarray, col: np.ndarray, value: np.ndarray, cost: np.ndarray, steps: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cost, steps, label) of pixels that are flooded from those with a label: heights and labels go by their ranks, so that a state is one whole number."""
    n, start = len(row), np.flatnonzero(label)
    r, c = row - row.min() + 1, col - col.min() + 1
    at = np.full((r.max() + 2, c.max() + 2), n)
    at[r, c] = np.arange(n)
    near = list(zip(*(at[r + dr, c + dc].tolist() for dr, dc in ((0, 1), (1, 0), (0, -1), (-1, 0))), strict=True))
    levels, names = np.unique(np.concatenate([value, cost[start]])), np.unique(label[start])
    many, far = len(names) or 1, int(steps.max()) + n + 1
    high = [*np.searchsorted(levels, value).tolist(), 0]
    unit = far * many
    unseen = (len(levels) + 1) * unit
    best = [unseen] * n + [-1]  # nothing is lower than what lies outside
    for k, h, s, lab in zip(start.tolist(), np.searchsorted(levels, cost[start]).tolist(), steps[start].tolist(), np.searchsorted(names, label[start]).tolist(), strict=True):
        best[k] = (h * far + int(s)) * many + lab
    heap = [best[k] * n + k for k in start.tolist()]
    heapq.heapify(heap)
    while heap:
        now, k = divmod(heapq.heappop(heap), n)
        if now != best[k]:
            continue
        h, lab = now // unit, now % many
        for j in near[k]:
            new = high[j] * unit + lab if high[j] > h else now + many
            if new < best[j]:
                best[j] = new
                heapq.heappush(heap, new * n + j)
    got = [(x // unit, x // many % far, x % many) if x < unseen else (-1, 0, 0) for x in best[:n]]
    h, s, lab = (np.array(x, np.int64) for x in zip(*got, strict=True))
    seen = h >= 0
    return np.where(seen, levels[h], np.inf), s, np.where(seen, names[lab] if len(names) else 0, 0)


def with_boundaries(labels: DataFrame, markers: DataFrame | None = None, frame: bool = True) -> DataFrame:
    """``(raster_id, band, row, col, label)`` with -1 where segments meet: on the pixel of the two whose label is larger, and, with ``frame``, on the raster's outermost pixels.

    labels: those of :func:`watershed`, 0 being none.  Pixels of ``markers`` keep theirs,
    but for the frame.  Labels move to their four neighbours, one shuffle.
    """
    own = labels.select(*KEY, "row", "col", "label")
    sides = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))])).alias("s")
    here = (F.col("s.dy") == 0) & (F.col("s.dx") == 0)
    sent = own.select("*", sides).select(*KEY, (F.col("row") + F.col("s.dy")).alias("row"), (F.col("col") + F.col("s.dx")).alias("col"), "label", here.alias("here"))
    met = sent.groupBy(*KEY, "row", "col").agg(F.max(F.when(F.col("here"), F.col("label"))).alias("label"), F.min(F.when(~F.col("here") & (F.col("label") > 0), F.col("label"))).alias("least")).where("label is not null")
    line = (F.col("label") > 0) & (F.col("least") < F.col("label"))
    if markers is not None:
        met = met.join(markers.where("label > 0").select(*KEY, "row", "col", F.lit(True).alias("_marked")), [*KEY, "row", "col"], "left")
        line &= F.col("_marked").isNull()
    if frame:
        met = small_join(met, own.groupBy(*KEY).agg(F.max("row").alias("_h"), F.max("col").alias("_w")), KEY)
        line |= (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == F.col("_h")) | (F.col("col") == F.col("_w"))
    return met.select(*KEY, "row", "col", F.when(line, F.lit(-1).cast("long")).otherwise(F.col("label")).alias("label"))


def segment_count(labels: DataFrame) -> DataFrame:
    """``(raster_id, band, segment_count)``: the largest label of each band, 0 without any."""
    return labels.groupBy(*KEY).agg(F.greatest(F.max("label"), F.lit(0)).cast("long").alias("segment_count"))


# Fixed: steps of a 5 x 5 chamfer distance and their lengths.
CHAMFER = {(0, 1): 1.0, (1, 1): 1.4, (1, 2): 2.1969}


def _chamfer(dist: np.ndarray) -> np.ndarray:
    """Distances on a tile with two more cells on every side, relaxed until nothing changes."""
    steps = {(sy * a, sx * b): w for (p, q), w in CHAMFER.items() for a, b in ((p, q), (q, p)) for sy in (-1, 1) for sx in (-1, 1)}
    h, w = dist.shape
    while True:
        before = dist.copy()
        for (dy, dx), length in steps.items():
            to = dist[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
            np.minimum(to, dist[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)] + length, out=to)
        if (dist == before).all():
            return dist


def distance_transform(mask: DataFrame, tile: int = TILE) -> DataFrame:
    """``(raster_id, band, row, col, value)``: each pixel's distance to the nearest pixel of value 0, along chamfer steps; infinite where the band has none.

    Tiles are relaxed with two rows and columns of their neighbours; rounds go on until
    nothing changes that another tile sees, so they are as many as the tiles that a
    distance spans.
    """
    size = mask.groupBy(*KEY).agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    start = F.when(F.col("value") == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))
    state = checkpointed(small_join(mask.select(*KEY, "row", "col", start.alias("value")), size, KEY))

    def relax(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(pdf["row"].min()), int(pdf["col"].min())
        y, x = pdf["row"].to_numpy() - y0, pdf["col"].to_numpy() - x0
        grid = np.full((y.max() + 1, x.max() + 1), np.inf)
        grid[y, x] = pdf["value"].to_numpy()
        new = _chamfer(grid)[y, x]
        seen = np.any([np.maximum((pdf[c] - 2) // tile, 0) != np.minimum((pdf[c] + 2) // tile, (pdf[n] - 1) // tile) for c, n in (("row", "h"), ("col", "w"))], axis=0)
        out = pdf.assign(value=new, changed=(new != pdf["value"].to_numpy()) & seen)
        own = (pdf["row"] // tile == pdf["ty"]) & (pdf["col"] // tile == pdf["tx"])
        return out[own][[*KEY, "row", "col", "value", "h", "w", "changed"]]

    while True:
        dealt = tiles(state, 2, tile)
        state = checkpointed(dealt.groupBy(*KEY, "ty", "tx").applyInPandas(relax, "raster_id long, band int, row int, col int, value double, h int, w int, changed boolean"))
        if not state.where("changed").limit(1).count():
            return state.select(*KEY, "row", "col", "value")


def auto_markers(pixels: DataFrame, share: float = 0.5, tile: int = TILE) -> DataFrame:
    """Markers for :func:`watershed`: regions of pixels above Otsu's threshold whose distance from the pixels below is over ``share`` of the band's greatest."""
    v = stretched(pixels)
    light = small_join(v, otsu(v), KEY).select(*KEY, "row", "col", F.when(F.col("value") > F.col("threshold"), 1.0).otherwise(0.0).alias("value"))
    far = distance_transform(light, tile).where("value > 0")
    most = far.groupBy(*KEY).agg(F.max("value").alias("most"))
    core = small_join(far, most, KEY).where((F.col("value") > F.col("most") * share) | (F.col("value") == float("inf"))).select(*KEY, "row", "col", F.lit(1.0).alias("value"))
    return components(core, 8, tile).select(*KEY, "row", "col", (F.col("label") + 1).alias("label"))


def kmeans(pixels: DataFrame, bands: list[int], k: int = 5, max_iter: int = 100, epsilon: float = 0.001, seed: int = 1, starts: int = 3) -> tuple[DataFrame, float]:
    """(``(raster_id, row, col, label)``, compactness): k-means over all bands of each pixel by Spark ML, the most compact of ``starts`` runs."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    in_range("k", k, 1)
    in_range("starts", starts, 1)
    table = checkpointed(VectorAssembler(inputCols=[f"b{b}" for b in bands], outputCol="features").transform(by_band(pixels, bands)).select("raster_id", "row", "col", "features"))
    models = [KMeans(k=k, maxIter=max_iter, tol=epsilon, seed=seed + i).fit(table) for i in range(starts)]
    model = min(models, key=lambda m: m.summary.trainingCost)
    return model.transform(table).select("raster_id", "row", "col", F.col("prediction").alias("label")), model.summary.trainingCost


def hough_votes(edges: DataFrame, thetas: int = 180) -> DataFrame:
    """``(raster_id, rho, theta, votes)``: each edge pixel votes for the lines through it, theta in steps of 180 / thetas degrees.

    Each batch counts its pixels' votes in numpy, so only counts are shuffled.
    """
    angle = np.radians(np.arange(thetas) * (180.0 / thetas))
    cos, sin = np.cos(angle), np.sin(angle)

    def vote(batches):
        for pdf in batches:
            for rid, part in pdf.groupby("raster_id"):
                rho = np.floor(np.round(part["col"].to_numpy()[:, None] * cos + part["row"].to_numpy()[:, None] * sin, 6) + 0.5).astype(np.int64)
                low = rho.min() if len(rho) else 0
                count = np.bincount(((rho - low) * thetas + np.arange(thetas)).ravel())
                at = np.flatnonzero(count)
                yield pd.DataFrame({"raster_id": rid, "rho": at // thetas + low, "theta": at % thetas, "votes": count[at]})

    return edges.select("raster_id", "row", "col").mapInPandas(vote, "raster_id long, rho int, theta int, votes long").groupBy("raster_id", "rho", "theta").agg(F.sum("votes").alias("votes"))


def hough_lines(edges: DataFrame, threshold: int = 50, min_length: float = 50, max_gap: float = 10, thetas: int = 180, most: int = 200_000) -> DataFrame:
    """``(raster_id, rho, theta, start, stop)``: along each line with votes enough, stretches of pixels no further apart than ``max_gap`` and at least ``min_length`` long."""
    lines = checkpointed(hough_votes(edges, thetas).where(F.col("votes") >= threshold).select("raster_id", "rho", "theta"))
    t = F.radians(F.col("theta") * (180.0 / thetas))
    few = lines.limit(most + 1).collect()
    if len(few) <= most:  # edge pixels are tested against the kept lines where they are
        known = {}
        for r in few:
            known.setdefault(r["raster_id"], []).append((r["rho"], r["theta"]))
        held = edges.sparkSession.sparkContext.broadcast({k: np.array(v) for k, v in known.items()})
        angle = np.radians(np.arange(thetas) * (180.0 / thetas))

        def near(batches):
            for pdf in batches:
                for rid, part in pdf.groupby("raster_id"):
                    own = held.value.get(rid)
                    if own is None:
                        continue
                    row, col = part["row"].to_numpy(), part["col"].to_numpy()
                    for k in range(0, len(own), 4096):
                        rho, theta = own[k : k + 4096].T
                        at = np.floor(np.round(col[:, None] * np.cos(angle[theta]) + row[:, None] * np.sin(angle[theta]), 6) + 0.5)
                        i, j = np.nonzero(at == rho)
                        yield pd.DataFrame({"raster_id": rid, "row": row[i], "col": col[i], "theta": theta[j], "rho": rho[j]})

        on = edges.select("raster_id", "row", "col").mapInPandas(near, "raster_id long, row int, col int, theta int, rho int")
    else:
        every = edges.select("raster_id", "row", "col", F.explode(F.sequence(F.lit(0), F.lit(thetas - 1))).alias("theta"))
        on = every.withColumn("rho", F.floor(F.round(F.col("col") * F.cos(t) + F.col("row") * F.sin(t), 6) + 0.5).cast("int")).join(lines, ["raster_id", "rho", "theta"])
    on = on.withColumn("at", F.col("row") * F.cos(t) - F.col("col") * F.sin(t))
    w = Window.partitionBy("raster_id", "rho", "theta").orderBy("at")
    new = F.coalesce((F.col("at") - F.lag("at").over(w) > max_gap).cast("int"), F.lit(1))
    runs = on.withColumn("run", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("raster_id", "rho", "theta", "run").agg(F.min("at").alias("start"), F.max("at").alias("stop")).where(F.col("stop") - F.col("start") >= min_length).drop("run")


def hough_circle_votes(edges: DataFrame, min_radius: int = 1, max_radius: int = 10) -> DataFrame:
    """``(raster_id, row, col, radius, votes)``: each edge pixel ``(row, col, gx, gy)`` votes for centres on both sides along its gradient."""
    in_range("max_radius", max_radius, min_radius)
    r = F.explode(F.array(*[F.lit(s * k) for k in range(min_radius, max_radius + 1) for s in (-1, 1)])).alias("r")
    every = edges.where("gx <> 0 or gy <> 0").select("raster_id", "row", "col", "gx", "gy", r)
    n = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    at = lambda c, g: F.floor(F.round(F.col(c) + F.col("r") * F.col(g) / n, 6) + 0.5).cast("int")
    return every.select("raster_id", at("row", "gy").alias("row"), at("col", "gx").alias("col"), F.abs("r").alias("radius")).groupBy("raster_id", "row", "col", "radius").agg(F.count("*").alias("votes"))


def hough_circles(edges: DataFrame, min_radius: int = 1, max_radius: int = 10, threshold: int = 30, min_distance: float = 20) -> DataFrame:
    """``(raster_id, row, col, radius, votes)``: centres with ``threshold`` votes over all radii, the best of those nearer than ``min_distance``, each with its most voted radius (the least of equals)."""
    from geoloom.operators.matching import suppressed

    best = F.max_by("radius", F.struct("votes", -F.col("radius"))).alias("radius")
    centres = hough_circle_votes(edges, min_radius, max_radius).groupBy("raster_id", "row", "col").agg(best, F.sum("votes").cast("double").alias("response")).where(F.col("response") >= threshold)
    kept = suppressed(centres, min_distance, "round").select("raster_id", "row", "col")
    return centres.join(kept, ["raster_id", "row", "col"]).select("raster_id", "row", "col", "radius", F.col("response").cast("long").alias("votes"))
