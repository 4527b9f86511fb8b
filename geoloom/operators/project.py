"""Coordinate transforms in closed form, and resampling of rasters through them."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.params import epsg, one_of
from geoloom.operators.graph import small_join
from geoloom.operators.raster import KEY

A, FLAT = 6378137.0, 1 / 298.257223563
N = FLAT / (2 - FLAT)
Pair = tuple[Column, Column]


def is_geographic(srid: int) -> bool | None:
    """Whether a CRS has degrees; None if it is unknown."""
    return True if srid == 4326 else False if srid == 3857 or 32601 <= srid <= 32660 or 32701 <= srid <= 32760 else None


def require_projected(srid: int) -> None:
    """Refuse a geographic CRS; an unknown one passes."""
    if is_geographic(srid):
        raise ValueError("distances need a projected CRS, not degrees")


def require_same(a: int | None, b: int | None) -> None:
    """Both CRS are equal; two missing ones are."""
    if a != b:
        raise ValueError(f"layers have different CRS: {a} and {b}")


def to_mercator(lon: Column, lat: Column) -> Pair:
    """Spherical Mercator metres of degrees."""
    return lon * (A * math.pi / 180), F.ln(F.tan(F.radians(lat) / 2 + math.pi / 4)) * A


def from_mercator(x: Column, y: Column) -> Pair:
    """Degrees of spherical Mercator metres."""
    return x * (180 / (A * math.pi)), F.degrees(F.atan(F.exp(y / A)) * 2 - math.pi / 2)


# Fixed: Krüger's series of the transverse Mercator projection to the third order.
RECTIFYING = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (N / 2 - 2 / 3 * N**2 + 5 / 16 * N**3, 13 / 48 * N**2 - 3 / 5 * N**3, 61 / 240 * N**3)
BETA = (N / 2 - 2 / 3 * N**2 + 37 / 96 * N**3, N**2 / 48 + N**3 / 15, 17 / 480 * N**3)
DELTA = (2 * N - 2 / 3 * N**2 - 2 * N**3, 7 / 3 * N**2 - 8 / 5 * N**3, 56 / 15 * N**3)
SCALE = 0.9996


def to_utm(lon: Column, lat: Column, zone: int, south: bool = False) -> Pair:
    """Easting and northing in metres of degrees."""
    c = 2 * math.sqrt(N) / (1 + N)
    t = F.sinh(F.atanh(F.sin(F.radians(lat))) - c * F.atanh(c * F.sin(F.radians(lat))))
    dl = F.radians(lon - (zone * 6 - 183))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    e, n = eta, xi
    for j, a in enumerate(ALPHA, 1):
        e = e + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        n = n + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + SCALE * RECTIFYING * e, SCALE * RECTIFYING * n + (1e7 if south else 0)


def from_utm(x: Column, y: Column, zone: int, south: bool = False) -> Pair:
    """Degrees of easting and northing in metres."""
    xi = (y - (1e7 if south else 0)) / (SCALE * RECTIFYING)
    eta = (x - 500000) / (SCALE * RECTIFYING)
    p, q = xi, eta
    for j, b in enumerate(BETA, 1):
        p = p - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        q = q - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(p) / F.cosh(q))
    lat = chi
    for j, d in enumerate(DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(q), F.cos(p))) + (zone * 6 - 183), F.degrees(lat)


def transform(x: Column, y: Column, src: str | int, dst: str | int) -> Pair:
    """Coordinates in another CRS, x before y: degrees (4326), Mercator (3857), UTM (326zz, 327zz); others are refused."""
    a, b = epsg(src), epsg(dst)
    for code in (a, b):
        if is_geographic(code) is None:
            raise ValueError(f"EPSG:{code} has no closed form here")
    if a == b:
        return x, y
    if a == 3857:
        x, y = from_mercator(x, y)
    elif a != 4326:
        x, y = from_utm(x, y, a % 100, a >= 32700)
    if b == 3857:
        return to_mercator(x, y)
    return (x, y) if b == 4326 else to_utm(x, y, b % 100, b >= 32700)


def transform_points(points: DataFrame, src: str | int, dst: str | int, x: str = "x", y: str = "y") -> DataFrame:
    """The table with its coordinates transformed."""
    tx, ty = transform(F.col(x), F.col(y), src, dst)
    return points.withColumns({x: tx, y: ty})


def reproject_features(features: DataFrame, src: str | int, dst: str | int) -> DataFrame:
    """Features with every vertex transformed and their boxes made anew."""
    from geoloom.functions.geometry import map_vertices, with_box

    return with_box(features.withColumn("geom", map_vertices(F.col("geom"), lambda x, y: transform(x, y, src, dst))))


def cubic(d: Column, a: float = -0.5) -> Column:
    """Weight of Keys' cubic at a distance."""
    d = F.abs(d)
    return F.when(d <= 1, ((a + 2) * d - (a + 3)) * d * d + 1).when(d < 2, ((a * d - 5 * a) * d + 8 * a) * d - 4 * a).otherwise(0.0)


def spline(d: Column) -> Column:
    """Weight of the cubic B-spline at a distance."""
    d = F.abs(d)
    return F.when(d < 1, 2 / 3 - d * d + d * d * d / 2).when(d < 2, (2 - d) * (2 - d) * (2 - d) / 6).otherwise(0.0)


def lanczos(d: Column, lobes: int = 3) -> Column:
    """Weight of the Lanczos window at a distance."""
    x = d * math.pi
    return F.when(F.abs(d) < 1e-9, 1.0).when(F.abs(d) < lobes, lobes * F.sin(x) * F.sin(x / lobes) / (x * x)).otherwise(0.0)


#: Neighbours on each side and the weight of a distance.
WEIGHTS: dict[str, tuple[int, Callable[[Column], Column]]] = {"bilinear": (1, lambda d: F.greatest(1 - F.abs(d), F.lit(0.0))), "cubic": (2, cubic), "cubicspline": (2, spline), "lanczos": (3, lanczos)}
def _numpy(pieces: list, d: np.ndarray) -> np.ndarray:
    d = np.abs(d)
    return np.select([d < limit for limit, _ in pieces], [f(d) for _, f in pieces], 0.0)


#: The same weights for whole arrays of distances.
NUMPY_WEIGHTS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "bilinear": lambda d: np.maximum(1 - np.abs(d), 0.0),
    "cubic": lambda d: _numpy([(1, lambda x: (1.5 * x - 2.5) * x * x + 1), (2, lambda x: ((-0.5 * x + 2.5) * x - 4) * x + 2)], d),
    "cubicspline": lambda d: _numpy([(1, lambda x: 2 / 3 - x * x + x * x * x / 2), (2, lambda x: (2 - x) ** 3 / 6)], d),
    "lanczos": lambda d: np.where(np.abs(d) < 3, np.sinc(d) * np.sinc(d / 3), 0.0),
}
RESAMPLERS = ("nearest", *WEIGHTS, "average", "mode")


def resample(pixels: DataFrame, targets: DataFrame, method: str = "nearest") -> DataFrame:
    """``(raster_id, band, row, col, value)`` of the target grid.

    targets: ``(raster_id, row, col, sr, sc)``: each target pixel with its centre as a
    fractional source row and column (source pixel k spans k to k + 1); for average
    and mode also ``sr1, sc1``, the far corner, with sr, sc the near one.  Weighted
    methods explode a target's source neighbours, join them and divide by the weights
    found, so edges and NoData lose no brightness.  Targets off the source are left out.
    The join is by sorting: targets are exploded, so their size estimate is far too small
    and Spark would broadcast them all.
    """
    one_of("method", method, RESAMPLERS)
    key = ["raster_id", "row", "col"]
    source = pixels.select("raster_id", "band", F.col("row").alias("_r"), F.col("col").alias("_c"), "value")
    if method == "nearest":
        at = targets.select(*key, F.floor("sr").cast("int").alias("_r"), F.floor("sc").cast("int").alias("_c"))
        return at.join(source.hint("merge"), ["raster_id", "_r", "_c"]).select(*KEY, "row", "col", "value")
    if method in ("average", "mode"):
        every = lambda a, b: F.explode(F.sequence(F.floor(a).cast("int"), F.greatest(F.floor(a), F.ceil(b) - 1).cast("int")))
        at = targets.withColumn("_r", every("sr", "sr1")).withColumn("_c", every("sc", "sc1"))
        cover = lambda a, b, k: F.least(F.col(b), F.col(k) + 1) - F.greatest(F.col(a), F.col(k))
        got = at.join(source.hint("merge"), ["raster_id", "_r", "_c"]).withColumn("_w", cover("sr", "sr1", "_r") * cover("sc", "sc1", "_c"))
        out = [*KEY, "row", "col"]
        if method == "average":
            return got.groupBy(*out).agg((F.sum(F.col("_w") * F.col("value")) / F.sum("_w")).alias("value"))
        return _heaviest(got)
    reach, weight = WEIGHTS[method]
    steps = F.sequence(F.lit(1 - reach), F.lit(reach))
    at = targets.select(*key, (F.col("sr") - 0.5).alias("_y"), (F.col("sc") - 0.5).alias("_x"))
    at = at.withColumn("_dr", F.explode(steps)).withColumn("_dc", F.explode(steps))
    at = at.withColumns({"_r": (F.floor("_y") + F.col("_dr")).cast("int"), "_c": (F.floor("_x") + F.col("_dc")).cast("int")})
    at = at.withColumn("_w", weight(F.col("_y") - F.col("_r")) * weight(F.col("_x") - F.col("_c"))).where("_w <> 0")
    got = at.join(source.hint("merge"), ["raster_id", "_r", "_c"]).groupBy(*KEY, "row", "col").agg(F.sum("_w").alias("_w"), F.sum(F.col("_w") * F.col("value")).alias("_v"))
    return got.where(F.abs("_w") > 1e-9).select(*KEY, "row", "col", (F.col("_v") / F.col("_w")).alias("value"))


def grid_targets(rasters: DataFrame, height: int, width: int, to_source: Callable[[Column, Column], Pair], corners: bool = False) -> DataFrame:
    """Target pixels of every raster with the source place of their centres; ``to_source`` maps (column, row) there.

    With ``corners`` both corners are mapped, for average and mode.
    """
    grid = rasters.select("raster_id").distinct().select("raster_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("col"))
    if corners:
        x0, y0 = to_source(F.col("col").cast("double"), F.col("row").cast("double"))
        x1, y1 = to_source(F.col("col") + 1.0, F.col("row") + 1.0)
        return grid.select("raster_id", "row", "col", y0.alias("sr"), x0.alias("sc"), y1.alias("sr1"), x1.alias("sc1"))
    x, y = to_source(F.col("col") + 0.5, F.col("row") + 0.5)
    return grid.select("raster_id", "row", "col", y.alias("sr"), x.alias("sc"))


def resize(pixels: DataFrame, height: int, width: int, factor: float, method: str = "bilinear", tile: int = 256) -> DataFrame:
    """A raster scaled to ``height`` x ``width``; ``factor`` is source pixels per target pixel.

    The places that weigh in a target are those of its row and of its column, so weighted
    methods and ``average`` work on tiles of the target: source pixels are dealt to the
    tiles they weigh in, one shuffle, and a tile sums its kernel's places one after
    another.  For ``nearest`` and ``mode`` each source pixel names the targets it is for,
    so no grid of targets is made and joined; ``nearest`` moves no row.
    """
    one_of("method", method, RESAMPLERS)
    if method in ("nearest", "mode"):
        return _sent_to_targets(pixels, height, width, factor, method)
    reach = 1 if method == "average" else WEIGHTS[method][0] + 1

    def span(c: str, most: int) -> Column:
        low = F.greatest(F.floor((F.col(c) - reach) / (tile * factor)), F.lit(0))
        high = F.least(F.floor((F.col(c) + 1 + reach) / (tile * factor)), F.lit((most - 1) // tile))
        return F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>")))

    def places(first: int, n: int, low: int, m: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each place of the kernel: which of m source places from ``low`` it is for each of n target places from ``first``, and its weight there (0 off the source)."""
        t = np.arange(first, first + n)
        if method == "average":
            begin, count = np.floor(t * factor), int(np.ceil(factor)) + 1
            weight = lambda k: np.maximum(np.minimum((t + 1) * factor, k + 1) - np.maximum(t * factor, k), 0)
        else:
            at = (t + 0.5) * factor - 0.5
            begin, count = np.floor(at) + 2 - reach, 2 * (reach - 1)
            weight = lambda k: NUMPY_WEIGHTS[method](at - k)
        out = []
        for k in (begin + step for step in range(count)):
            own = (k - low).astype(np.int64)
            on = (own >= 0) & (own < m)
            out.append((np.where(on, own, 0), np.where(on, weight(k), 0.0)))
        return out

    def scale(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(pdf["ty"].iat[0]) * tile, int(pdf["tx"].iat[0]) * tile
        n, m = min(tile, height - ty), min(tile, width - tx)
        y0, x0 = int(pdf["row"].min()), int(pdf["col"].min())
        grid = np.full((int(pdf["row"].max()) - y0 + 1, int(pdf["col"].max()) - x0 + 1), np.nan)
        grid[pdf["row"].to_numpy() - y0, pdf["col"].to_numpy() - x0] = pdf["value"].to_numpy()
        total, whole = np.zeros((n, m)), np.zeros((n, m))
        across = places(tx, m, x0, grid.shape[1])
        for r, down in places(ty, n, y0, grid.shape[0]):
            for c, side in across:
                value, w = grid[r[:, None], c[None, :]], down[:, None] * side[None, :]
                known = ~np.isnan(value)
                total += np.where(known, w * np.where(known, value, 0.0), 0.0)
                whole += np.where(known, w, 0.0)
        y, x = np.nonzero(np.abs(whole) > 1e-9)
        return pd.DataFrame({"raster_id": pdf["raster_id"].iat[0], "band": pdf["band"].iat[0], "row": y + ty, "col": x + tx, "value": total[y, x] / whole[y, x]})

    sent = pixels.select(*KEY, "row", "col", "value").withColumn("ty", span("row", height)).withColumn("tx", span("col", width))
    return sent.groupBy(*KEY, "ty", "tx").applyInPandas(scale, "raster_id long, band int, row int, col int, value double")


def _sent_to_targets(pixels: DataFrame, height: int, width: int, factor: float, method: str) -> DataFrame:
    """:func:`resample` onto a scaled grid, by ``nearest`` or ``mode``, from the side of the source."""
    if method == "nearest":
        first = last = lambda t: F.floor((t + 0.5) * factor)
    else:
        first = lambda t: F.floor(t.cast("double") * factor)
        last = lambda t: F.greatest(first(t), F.ceil((t + 1.0) * factor) - 1)
    half = 0.5 if method == "nearest" else 0.0

    def least(of: Callable[[Column], Column], k: Column, near: Column) -> Column:
        """The least target whose place ``of`` is k or more: ``near`` or, as doubles are rounded, the one beside it."""
        return near + F.when(of(near) < k, 1).when(of(near - 1) >= k, -1).otherwise(0)

    def targets(c: str, most: int) -> Column:
        k = F.col(c)
        low = F.greatest(least(last, k, F.ceil(k / factor - half) if half else F.floor(k / factor)), F.lit(0))
        high = F.least(least(first, k + 1, F.ceil((k + 1) / factor - half)) - 1, F.lit(most - 1))
        return F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>")))

    own = pixels.select(*KEY, F.col("row").alias("_r"), F.col("col").alias("_c"), "value")
    sent = own.withColumn("row", targets("_r", height)).withColumn("col", targets("_c", width)).withColumns({"row": F.col("row").cast("int"), "col": F.col("col").cast("int")})
    if method == "nearest":
        return sent.select(*KEY, "row", "col", "value")
    cover = lambda t, k: F.least((F.col(t) + 1.0) * factor, F.col(k) + 1) - F.greatest(F.col(t).cast("double") * factor, F.col(k))
    return _heaviest(sent.withColumn("_w", cover("row", "_r") * cover("col", "_c")))


def _heaviest(covered: DataFrame) -> DataFrame:
    """The value that covers most of each target by its weight ``_w``, the smallest of equal ones."""
    out = [*KEY, "row", "col"]
    return covered.groupBy(*out, "value").agg(F.sum("_w").alias("_w")).groupBy(*out).agg(F.max_by("value", F.struct(F.round("_w", 9), -F.col("value"))).alias("value"))


def back_to_source(m: tuple[float, ...], x, y) -> tuple:
    """The source place of a target place, of columns or of arrays."""
    z = m[6] * x + m[7] * y + m[8]
    return (m[0] * x + m[1] * y + m[2]) / z, (m[3] * x + m[4] * y + m[5]) / z


def warp(pixels: DataFrame, height: int, width: int, inverse: tuple[float, ...], method: str = "nearest") -> DataFrame:
    """A raster seen through the inverse of a 2 x 3 affine or 3 x 3 projective matrix (row by row): target place to source place.

    ``nearest`` and ``bilinear`` under an affine matrix that makes nothing over eight
    times smaller work on tiles of the target: source pixels are dealt to the tiles whose
    places they may be at, one shuffle.  All else goes by a join of the target's places.
    """
    m = inverse if len(inverse) == 9 else (*inverse, 0.0, 0.0, 1.0)
    if method in ("nearest", "bilinear") and m[6] == m[7] == 0 and max(abs(m[0]) + abs(m[1]), abs(m[3]) + abs(m[4])) <= 8 * abs(m[8]):
        return _warp_tiles(pixels, height, width, tuple(float(v) for v in m), method)
    return resample(pixels, grid_targets(pixels, height, width, lambda x, y: back_to_source(m, x, y)), method)


def _warp_tiles(pixels: DataFrame, height: int, width: int, m: tuple[float, ...], method: str, tile: int = 256) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(pdf["ty"].iat[0]) * tile, int(pdf["tx"].iat[0]) * tile
        y0, x0 = int(pdf["row"].min()), int(pdf["col"].min())
        grid = np.full((int(pdf["row"].max()) - y0 + 1, int(pdf["col"].max()) - x0 + 1), np.nan)
        grid[pdf["row"].to_numpy() - y0, pdf["col"].to_numpy() - x0] = pdf["value"].to_numpy()
        out = seen_in(grid, y0, x0, np.arange(ty, min(ty + tile, height)), np.arange(tx, min(tx + tile, width)), m, method)
        y, x = np.nonzero(~np.isnan(out))
        return pd.DataFrame({"raster_id": pdf["raster_id"].iat[0], "band": pdf["band"].iat[0], "row": y + ty, "col": x + tx, "value": out[y, x]})

    sent = dealt_to_tiles(pixels.select(*KEY, "row", "col", "value"), tile_boxes(pixels.sparkSession, height, width, m, tile=tile), tile)
    return sent.groupBy(*KEY, "ty", "tx").applyInPandas(run, "raster_id long, band int, row int, col int, value double")


def tile_boxes(spark: SparkSession, height: int, width: int, m: tuple[float, ...], more: int = 0, beyond: int = 0, tile: int = 256) -> DataFrame:
    """``(ty, tx, r0, r1, c0, c1)``: the source rows and columns that each tile of a target of ``height`` x ``width`` may be seen at, by the two nearest on each side, and ``more`` around.

    Tiles reach ``beyond`` pixels further right and down.  A projective matrix may take
    a tile over the horizon; its box is null then.
    """
    across, down = -(-width // tile), -(-height // tile)
    tiles = spark.range(across * down).select(F.floor(F.col("id") / across).cast("int").alias("ty"), (F.col("id") % across).cast("int").alias("tx"))
    ends = lambda c, n: (F.col(c) * tile + 0.5, F.least(F.col(c) * tile + (tile - 1 + beyond), F.lit(n - 1)) + 0.5)
    corners = [(x, y) for x in ends("tx", width) for y in ends("ty", height)]
    z = [m[6] * x + m[7] * y + m[8] for x, y in corners]
    sx, sy = ([F.try_divide(m[k] * x + m[k + 1] * y + m[k + 2], d) for (x, y), d in zip(corners, z, strict=True)] for k in (0, 3))
    whole = (F.least(*z) > 0) | (F.greatest(*z) < 0)
    box = {"r0": F.floor(F.least(*sy)) - 2 - more, "r1": F.floor(F.greatest(*sy)) + 2 + more, "c0": F.floor(F.least(*sx)) - 2 - more, "c1": F.floor(F.greatest(*sx)) + 2 + more}
    return tiles.select("ty", "tx", *[F.when(whole, c).alias(n) for n, c in box.items()])


def dealt_to_tiles(pixels: DataFrame, boxes: DataFrame, tile: int = 256) -> DataFrame:
    """``pixels`` with the ``ty, tx`` of every tile whose box of source rows and columns they are in."""
    every = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / tile), F.floor(F.col(b) / tile)))
    blocks = boxes.where("r0 <= r1 and c0 <= c1").withColumn("_by", every("r0", "r1")).withColumn("_bx", every("c0", "c1"))
    own = pixels.withColumns({"_by": F.floor(F.col("row") / tile), "_bx": F.floor(F.col("col") / tile)})
    return small_join(own, blocks, ["_by", "_bx"]).where("row between r0 and r1 and col between c0 and c1").select(*pixels.columns, "ty", "tx")


def seen_in(grid: np.ndarray, top: int, left: int, rows: np.ndarray, cols: np.ndarray, m: tuple[float, ...], method: str) -> np.ndarray:
    """The target pixels ``rows`` x ``cols`` as a grid of source pixels from (top, left) on shows them through ``m``; NaN where it has none."""
    with np.errstate(all="ignore"):
        sx, sy = back_to_source(m, cols[None, :] + 0.5, rows[:, None] + 0.5)

    def at(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        r, c = r - top, c - left
        on = (r >= 0) & (r < grid.shape[0]) & (c >= 0) & (c < grid.shape[1])
        if not on.any():
            return np.full(on.shape, np.nan)
        return np.where(on, grid[np.where(on, r, 0).astype(np.int64), np.where(on, c, 0).astype(np.int64)], np.nan)

    if method == "nearest":
        return at(np.floor(sy), np.floor(sx))
    total, whole = np.zeros(sx.shape), np.zeros(sx.shape)
    for r in (np.floor(sy - 0.5), np.floor(sy - 0.5) + 1):
        for c in (np.floor(sx - 0.5), np.floor(sx - 0.5) + 1):
            value, w = at(r, c), np.maximum(1 - np.abs(sy - 0.5 - r), 0) * np.maximum(1 - np.abs(sx - 0.5 - c), 0)
            known = ~np.isnan(value) & (w > 0)
            total += np.where(known, w * np.where(known, value, 0.0), 0.0)
            whole += np.where(known, w, 0.0)
    return np.where(whole > 1e-9, total / np.where(whole > 1e-9, whole, 1.0), np.nan)


def reproject_raster(pixels: DataFrame, src: str | int, dst: str | int, gt_src: tuple[float, ...], gt_dst: tuple[float, ...], height: int, width: int, method: str = "nearest") -> DataFrame:
    """A raster on a target grid of another CRS: target centres go back through the transform to source places."""

    def back(x: Column, y: Column) -> Pair:
        wx, wy = transform(gt_dst[0] + x * gt_dst[1] + y * gt_dst[2], gt_dst[3] + x * gt_dst[4] + y * gt_dst[5], dst, src)
        return (wx - gt_src[0]) / gt_src[1], (wy - gt_src[3]) / gt_src[5]

    return resample(pixels, grid_targets(pixels, height, width, back, method in ("average", "mode")), method)
