"""Cutting, stacking and mosaicking of pixel tables."""

from __future__ import annotations

from functools import reduce
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions.params import extent, in_range, one_of, same_length
from geoloom.operators.focal import TILE, tiles
from geoloom.operators.graph import small_join
from geoloom.operators.project import NUMPY_WEIGHTS, cubic
from geoloom.operators.raster import KEY, PLACE

WIDE = 1024  # of a block that a task takes whole
GT = tuple[float, float, float, float, float, float]


def clip_extent(pixels: DataFrame, box, gt: GT) -> DataFrame:
    """Pixels of the window of an extent, rows and columns counted from its corner; edges are rounded to whole pixels.

    A filter on row and column only, so it reaches the scan.
    """
    xmin, ymin, xmax, ymax = extent(box)
    ox, px, _, oy, _, py = gt
    c0, r0 = max(0, int((xmin - ox) / px + 0.5)), max(0, int((ymax - oy) / py + 0.5))
    c1, r1 = c0 + max(1, int((xmax - xmin) / px + 0.5)), r0 + max(1, int((ymin - ymax) / py + 0.5))
    inside = pixels.where((F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1))
    return inside.withColumns({"row": (F.col("row") - r0).cast("int"), "col": (F.col("col") - c0).cast("int")})


def clip_cutline(pixels: DataFrame, cells: DataFrame) -> DataFrame:
    """Pixels under a rasterised cutline ``(row, col)``, cropped to its box; where both are given the cutline wins over an extent."""
    mask = cells.select("row", "col").distinct()
    corner = mask.agg(F.min("row").alias("r0"), F.min("col").alias("c0"))
    return pixels.join(mask, ["row", "col"], "left_semi").crossJoin(F.broadcast(corner)).select("raster_id", "band", (F.col("row") - F.col("r0")).cast("int").alias("row"), (F.col("col") - F.col("c0")).cast("int").alias("col"), "value")


def mosaic(sources: list[tuple[DataFrame, GT]]) -> DataFrame:
    """``(band, row, col, value)`` on one grid of the sources' common pixel size; a later source overwrites an earlier one.

    Each source is shifted to the common origin and its number kept; ``max_by`` picks
    the last, as a pre-aggregated maximum.
    """
    in_range("sources", len(sources), 2)
    px, py = sources[0][1][1], sources[0][1][5]
    if any(abs(g[1] - px) > 1e-9 or abs(g[5] - py) > 1e-9 for _, g in sources):
        raise ValueError("sources must be resampled to one pixel size first")
    left, top = min(g[0] for _, g in sources), max(g[3] for _, g in sources)
    moved = [p.select("band", (F.col("row") + round((g[3] - top) / py)).cast("int").alias("row"), (F.col("col") + round((g[0] - left) / px)).cast("int").alias("col"), "value", F.lit(k).alias("k")) for k, (p, g) in enumerate(sources)]
    return reduce(DataFrame.unionByName, moved).where("value is not null").groupBy("band", "row", "col").agg(F.max_by("value", "k").alias("value"))


def split(pixels: DataFrame, tile_size: int = 1024, overlap: int = 0) -> DataFrame:
    """Pixels with the tiles they are in: tiles start at multiples of ``tile_size`` and reach ``overlap`` further right and down."""
    in_range("tile_size", tile_size, 1)
    in_range("overlap", overlap, 0)

    def span(c: str):
        low = F.greatest(F.ceil((F.col(c) - tile_size - overlap + 1) / tile_size), F.lit(0))
        return F.explode(F.sequence(low.cast("int"), F.floor(F.col(c) / tile_size).cast("int")))

    tiled = pixels.withColumn("ty", span("row")).withColumn("tx", span("col"))
    return tiled.withColumns({"row": F.col("row") - F.col("ty") * tile_size, "col": F.col("col") - F.col("tx") * tile_size, "tile": F.concat_ws("_", F.lit("tile"), "tx", "ty")})


def merge_bands(sources: list[DataFrame], bands: list[int]) -> DataFrame:
    """The named band of each source, stacked: its place in the list is its new band."""
    same_length(sources=sources, bands=bands)
    parts = [p.where(F.col("band") == b).withColumn("band", F.lit(k)) for k, (p, b) in enumerate(zip(sources, bands, strict=True), 1)]
    return reduce(DataFrame.unionByName, parts)


def overviews(pixels: DataFrame, levels: tuple[int, ...] = (2, 4, 8, 16), resample: str = "average") -> DataFrame:
    """``(raster_id, band, level, row, col, value)``: reduced copies by nearest (the block's first pixel), average, mode (least on ties), gaussian or cubic.

    The smooth kernels weigh pixels by their distance from the block's centre, in
    blocks: ``exp(-2 d^2)`` within one block, or Keys' cubic within two; weights are
    divided out.  Levels of up to ``WIDE`` come from tiles of whole blocks, which carry
    as many pixels of their neighbours as the kernel reaches: a pixel moves once for
    all levels whose blocks fit one tile.  Wider blocks are aggregated
    (:func:`_wide_overviews`).
    """
    one_of("resample", resample, ("nearest", "average", "mode", "gaussian", "cubic"))
    if not any(x > 1 for x in levels):
        raise ValueError("at least one level must be above 1")
    fine, wide = [x for x in levels if 1 < x <= WIDE], [x for x in levels if x > WIDE]
    whole = lcm(*fine) if fine else 1
    groups = [fine] if fine and whole <= WIDE else [[x] for x in fine]
    parts = [_tiled_overviews(pixels, g, resample) for g in groups]
    return reduce(DataFrame.unionByName, parts + ([_wide_overviews(pixels, wide, resample)] if wide else []))


def _tiled_overviews(pixels: DataFrame, levels: list[int], resample: str) -> DataFrame:
    """:func:`overviews` of levels whose blocks fit whole into tiles."""
    side = lcm(*levels) * max(1, TILE // lcm(*levels))
    smooth = resample in ("gaussian", "cubic")
    reach = {"gaussian": 1, "cubic": 2}.get(resample, 0)
    if smooth:
        sent = tiles(pixels, reach * max(levels), side)
    else:
        sent = pixels.select(*PLACE, "value").withColumns({"ty": F.floor(F.col("row") / side), "tx": F.floor(F.col("col") / side)})

    def reduced(table: pa.Table) -> pa.Table:
        row, col, value = (table.column(c).combine_chunks() for c in ("row", "col", "value"))
        known = value.is_valid().to_numpy(zero_copy_only=False)
        row, col, value = row.to_numpy(), col.to_numpy(), value.to_numpy(zero_copy_only=False).astype(float)
        y0, x0 = table.column("ty")[0].as_py() * side, table.column("tx")[0].as_py() * side
        out = []
        for level in levels:
            if smooth:
                h, w = (table.column(c)[0].as_py() for c in ("h", "w"))
                r, c, v = _smoothed(row[known], col[known], value[known], y0, x0, level, min(side, h - y0), min(side, w - x0), resample)
                out.append((level, r, c, v, np.ones(len(v), bool)))
            else:
                out.append((level, *_picked(row, col, value, known, level, resample)))
        n = sum(len(r) for _, r, *_ in out)
        first = pa.array(np.zeros(n, np.int64))
        joined = lambda k, t: np.concatenate([np.asarray(o[k]) for o in out]).astype(t)
        level = np.repeat([o[0] for o in out], [len(o[1]) for o in out]).astype(np.int32)
        return pa.table({**{k: table.column(k).combine_chunks().take(first) for k in KEY}, "level": level, "row": joined(1, np.int32), "col": joined(2, np.int32), "value": pa.array(joined(3, float), mask=~joined(4, bool))})

    types = dict(pixels.dtypes)
    return sent.groupBy(*KEY, "ty", "tx").applyInArrow(reduced, f"raster_id {types['raster_id']}, band {types['band']}, level int, row int, col int, value double")


def _picked(row: np.ndarray, col: np.ndarray, value: np.ndarray, known: np.ndarray, level: int, resample: str) -> tuple:
    """Rows, columns, values and whether they are known of the blocks of some pixels, by nearest, average or mode."""
    r, c = row // level, col // level
    if resample == "mode":  # equal values of a block lie together, nulls as one value
        kind = np.where(known, np.where(np.isnan(value), 2, 1), 0)
        order = np.lexsort((value, kind, c, r))
        r, c, value, kind = (t[order] for t in (r, c, value, kind))
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1]) | (kind[1:] != kind[:-1]) | ((kind[1:] == 1) & (value[1:] != value[:-1]))
        at = np.flatnonzero(new)
        r, c, value, kind, n = r[at], c[at], value[at], kind[at], np.diff(np.append(at, len(new)))
        order = np.lexsort((value, -kind, -n, c, r))
        known = kind > 0
    else:
        order = np.lexsort((col, row, c, r))
    r, c, value, known = (t[order] for t in (r, c, value, known))
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
    at = np.flatnonzero(new)
    if resample != "average":
        return r[at], c[at], value[at], known[at]
    n = np.add.reduceat(known.astype(np.int64), at)
    return r[at], c[at], np.add.reduceat(np.where(known, value, 0.0), at) / np.maximum(n, 1), n > 0


def _smoothed(row: np.ndarray, col: np.ndarray, value: np.ndarray, y0: int, x0: int, level: int, height: int, width: int, resample: str) -> tuple:
    """Rows, columns and values of the blocks of a tile of ``height`` x ``width`` pixels from (y0, x0), by a smooth kernel over all pixels given."""
    if not len(row):
        return row, col, value

    def weights(first: int, n: int, places: np.ndarray) -> np.ndarray:
        d = np.abs((places[None, :] + 0.5) / level - 0.5 - (first // level + np.arange(-(-n // level)))[:, None])
        return np.where(d < 1, np.exp(-2 * d * d), 0.0) if resample == "gaussian" else NUMPY_WEIGHTS["cubic"](d)

    top, left = int(row.min()), int(col.min())
    grid, known = np.zeros((2, int(row.max()) - top + 1, int(col.max()) - left + 1))
    finite = np.isfinite(value)
    grid[row - top, col - left] = np.where(finite, value, 0.0)
    known[row - top, col - left] = 1.0
    down, across = weights(y0, height, top + np.arange(grid.shape[0])), weights(x0, width, left + np.arange(grid.shape[1])).T
    total, whole = down @ grid @ across, down @ known @ across
    for y, x, v in zip(row[~finite] - top, col[~finite] - left, value[~finite], strict=True):
        w = np.outer(down[:, y], across[x])
        total = np.where(w != 0, total + np.where(w != 0, w, 1.0) * v, total)
    r, c = np.nonzero(np.abs(whole) > 1e-9)
    return r + y0 // level, c + x0 // level, total[r, c] / whole[r, c]


def _wide_overviews(pixels: DataFrame, levels: list[int], resample: str) -> DataFrame:
    """:func:`overviews` of blocks too wide for a task, by aggregates over pixels exploded by level and, for the smooth kernels, by the 4 or 16 blocks they weigh in."""
    level = F.explode(F.array(*[F.lit(x) for x in levels])).alias("level")
    key = [*KEY, "level", "r", "c"]
    if resample in ("gaussian", "cubic"):
        reach, weight = (1, lambda d: F.when(F.abs(d) < 1, F.exp(d * d * -2)).otherwise(0.0)) if resample == "gaussian" else (2, cubic)
        size = pixels.groupBy(*KEY).agg(F.max("row").alias("h"), F.max("col").alias("w"))
        v = small_join(pixels.select(*PLACE, "value"), size, KEY).select(*PLACE, "value", "h", "w", level).where("value is not null")
        centre = lambda c: (F.col(c) + 0.5) / F.col("level") - 0.5
        near = lambda c, most: F.explode(F.sequence(F.greatest(F.floor(centre(c)) - (reach - 1), F.lit(0)), F.least(F.floor(centre(c)) + reach, F.floor(F.col(most) / F.col("level"))))).alias(c[0])
        v = v.select("*", near("row", "h")).select("*", near("col", "w"))
        v = v.withColumn("weight", weight(centre("row") - F.col("r")) * weight(centre("col") - F.col("c"))).where("weight <> 0")
        out = v.groupBy(*key).agg(F.sum("weight").alias("_w"), F.sum(F.col("weight") * F.col("value")).alias("_v")).where(F.abs("_w") > 1e-9)
        return out.select(*KEY, "level", F.col("r").cast("int").alias("row"), F.col("c").cast("int").alias("col"), (F.col("_v") / F.col("_w")).alias("value"))
    v = pixels.select(*PLACE, "value", level)
    v = v.withColumns({"r": F.floor(F.col("row") / F.col("level")).cast("int"), "c": F.floor(F.col("col") / F.col("level")).cast("int")})
    if resample == "mode":
        out = v.groupBy(*key, "value").agg(F.count("*").alias("n")).groupBy(*key).agg(F.max_by("value", F.struct("n", -F.col("value"))).alias("value"))
    elif resample == "nearest":
        out = v.groupBy(*key).agg(F.min_by("value", F.struct("row", "col")).alias("value"))
    else:
        out = v.groupBy(*key).agg(F.avg("value").alias("value"))
    return out.withColumnsRenamed({"r": "row", "c": "col"})
