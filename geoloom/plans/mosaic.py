"""Queries of cutting, mosaicking, projection and resampling."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.operators import mosaic as M
from geoloom.operators import project as P
from geoloom.operators.vector import BOX, rectangles
from geoloom.operators.zonal import target_srs
from geoloom.plans.base import group, rounded
from geoloom.sources import fixtures as X
from geoloom.sources.fixtures import PIX, POINTS, PX, RECTS, ZONES

QUERIES, ORACLES, query = group()
GT = (0.0, 1.0, 0.0, 64.0, 0.0, -1.0)


@query(f'WITH {PIX} SELECT raster_id, band, "row" - 20 AS "row", col - 10 AS col, value FROM pix WHERE "row" >= 20 AND "row" < 45 AND col >= 10 AND col < 31')
def t1_clip_extent(spark, sf):
    return M.clip_extent(X.pixels(spark, sf), (10.2, 19.4, 31.0, 44.3), GT)


@query(f'WITH {PIX}, z AS (SELECT DISTINCT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col FROM range(64) t(r), range(64) u(c) WHERE c + 0.5 > 5.2 AND c + 0.5 < 40.1 AND 64 - (r + 0.5) > 12.6 AND 64 - (r + 0.5) < 30.3) SELECT raster_id, band, "row" - (SELECT min("row") FROM z) AS "row", col - (SELECT min(col) FROM z) AS col, value FROM pix SEMI JOIN z USING ("row", col)')
def t2_clip_cutline(spark, sf):
    from geoloom.operators.vector import rasterize, rectangles

    line = spark.createDataFrame([(1, 5.2, 12.6, 40.1, 30.3)], "fid long, xmin double, ymin double, xmax double, ymax double")
    return M.clip_cutline(X.pixels(spark, sf), rasterize(rectangles(line), GT))


@query(f"""WITH {PX}, s AS (SELECT 0 AS k, raster_id, "row", col, b1 AS value FROM px UNION ALL SELECT 1, raster_id, "row" + 10, col + 40, b3 FROM px)
SELECT raster_id AS band, "row", col, arg_max(value, k) AS value FROM s GROUP BY ALL""")
def t3_mosaic(spark, sf):
    s = X.scenes(spark, sf)
    one, two = (s.select(F.col("raster_id").alias("band"), "row", "col", F.col(b).alias("value")) for b in ("b1", "b3"))
    return M.mosaic([(one, GT), (two, (40.0, 1.0, 0.0, 54.0, 0.0, -1.0))])


@query(f"""WITH {PIX} SELECT raster_id, band, "row" - ty * 24 AS "row", col - tx * 24 AS col, value, CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, 'tile_' || tx || '_' || ty AS tile
FROM pix, range(3) a(ty), range(3) b(tx) WHERE "row" >= ty * 24 AND "row" < ty * 24 + 28 AND col >= tx * 24 AND col < tx * 24 + 28""")
def t4_split(spark, sf):
    return M.split(X.pixels(spark, sf), 24, 4)


@query(f'WITH {PIX} SELECT raster_id, 1 AS band, "row", col, value FROM pix WHERE band = 3 UNION ALL SELECT raster_id, 2, "row", col, value FROM pix WHERE band = 1')
def t5_merge_bands(spark, sf):
    p = X.pixels(spark, sf)
    return M.merge_bands([p, p], [3, 1])


LEVELS = 'SELECT raster_id, band, level, CAST("row" // level AS INTEGER) AS r, CAST(col // level AS INTEGER) AS c, "row", col, value FROM pix, (VALUES (2), (4), (8)) l(level)'


@query(f'WITH {PIX}, v AS ({LEVELS}) SELECT raster_id, band, level, r AS "row", c AS col, round(avg(value), 6) AS value FROM v GROUP BY ALL')
def w14_overviews_average(spark, sf):
    return rounded(M.overviews(X.pixels(spark, sf), (2, 4, 8), "average"), "value")


@query(f'WITH {PIX}, v AS ({LEVELS}) SELECT raster_id, band, level, r AS "row", c AS col, value FROM v WHERE "row" % level = 0 AND col % level = 0')
def w14_overviews_nearest(spark, sf):
    return M.overviews(X.pixels(spark, sf), (2, 4, 8), "nearest")


@query(f'WITH {PIX}, v AS (SELECT raster_id, band, level, r, c, value, count(*) AS n FROM ({LEVELS}) GROUP BY ALL) SELECT raster_id, band, level, r AS "row", c AS col, arg_max(value, (n, -value)) AS value FROM v GROUP BY raster_id, band, level, r, c')
def w14_overviews_mode(spark, sf):
    return M.overviews(X.pixels(spark, sf), (2, 4, 8), "mode")


R = 6378137.0
LONLAT = "(-180 + x * 5.6) AS lon, (-80 + y * 2.5) AS lat"


def _lonlat(spark, sf):
    return X.points(spark, sf).select("pid", (-180 + F.col("x") * 5.6).alias("x"), (-80 + F.col("y") * 2.5).alias("y"))


def _smooth(weight: str, low: int, high: int) -> str:
    """SQL of an overview by a kernel of the distance ? in blocks."""
    w = lambda d: weight.replace("?", d)
    return f"""WITH {PIX}, v AS (SELECT *, ("row" + 0.5) / level - 0.5 AS cy, (col + 0.5) / level - 0.5 AS cx FROM pix, (VALUES (2), (8)) l(level)),
e AS (SELECT raster_id, band, level, CAST(floor(cy) + a AS INTEGER) AS r, CAST(floor(cx) + b AS INTEGER) AS c, value, cy - (floor(cy) + a) AS dy, cx - (floor(cx) + b) AS dx FROM v, range({low}, {high}) i(a), range({low}, {high}) j(b)),
k AS (SELECT *, CAST({w("dy")} AS DOUBLE) * CAST({w("dx")} AS DOUBLE) AS w FROM e WHERE r >= 0 AND c >= 0 AND r <= 63 // level AND c <= 63 // level)
SELECT raster_id, band, level, r AS "row", c AS col, round(sum(w * value) / sum(w), 6) AS value FROM k WHERE w <> 0 GROUP BY ALL HAVING abs(sum(w)) > 1e-9"""


@query(_smooth("(CASE WHEN abs(?) < 1 THEN exp(-2 * ? * ?) ELSE 0 END)", 0, 2))
def w14_overviews_gaussian(spark, sf):
    return rounded(M.overviews(X.pixels(spark, sf), (2, 8), "gaussian"), "value")


@query(_smooth("(CASE WHEN abs(?) <= 1 THEN (1.5 * abs(?) - 2.5) * abs(?) * abs(?) + 1 WHEN abs(?) < 2 THEN ((-0.5 * abs(?) + 2.5) * abs(?) - 4) * abs(?) + 2 ELSE 0 END)", -1, 3))
def w14_overviews_cubic(spark, sf):
    return rounded(M.overviews(X.pixels(spark, sf), (2, 8), "cubic"), "value")


@query(f"WITH {POINTS} SELECT pid, round(lon * {R * math.pi / 180!r}, 3) AS x, round(ln(tan(radians(lat) / 2 + {math.pi / 4!r})) * {R!r}, 3) AS y FROM (SELECT pid, {LONLAT} FROM points)")
def r3_transform_mercator(spark, sf):
    return rounded(P.transform_points(_lonlat(spark, sf), "EPSG:4326", "EPSG:3857"), "x", "y", digits=3)


def _utm_sql() -> str:
    c = 2 * math.sqrt(P.N) / (1 + P.N)
    e = " + ".join(["eta", *(f"{a!r} * cos({2 * j} * xi) * (exp({2 * j} * eta) - exp({-2 * j} * eta)) / 2" for j, a in enumerate(P.ALPHA, 1))])
    n = " + ".join(["xi", *(f"{a!r} * sin({2 * j} * xi) * (exp({2 * j} * eta) + exp({-2 * j} * eta)) / 2" for j, a in enumerate(P.ALPHA, 1))])
    k = P.SCALE * P.RECTIFYING
    return f"""WITH {POINTS}, g AS (SELECT pid, 114 + x / 10.7 AS lon, y * 1.2 AS lat FROM points), a AS (SELECT pid, radians(lon - 117) AS dl, atanh(sin(radians(lat))) - {c!r} * atanh({c!r} * sin(radians(lat))) AS q FROM g),
t AS (SELECT pid, dl, (exp(q) - exp(-q)) / 2 AS t FROM a), u AS (SELECT pid, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM t)
SELECT pid, round(500000 + {k!r} * ({e}), 3) AS x, round({k!r} * ({n}), 3) AS y FROM u"""


@query(_utm_sql())
def r3_transform_utm(spark, sf):
    p = X.points(spark, sf).select("pid", (114 + F.col("x") / 10.7).alias("x"), (F.col("y") * 1.2).alias("y"))
    return rounded(P.transform_points(p, 4326, 32650), "x", "y", digits=3)


@query(f"WITH {POINTS} SELECT pid, round(114 + x / 10.7, 6) AS x, round(y * 1.2, 6) AS y FROM points")
def r3_transform_round_trip(spark, sf):
    p = X.points(spark, sf).select("pid", (114 + F.col("x") / 10.7).alias("x"), (F.col("y") * 1.2).alias("y"))
    return rounded(P.transform_points(P.transform_points(P.transform_points(p, 4326, 32650), 32650, 3857), 3857, 4326), "x", "y")


GRID = 'SELECT raster_id, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, {0} AS sr, {1} AS sc FROM (SELECT DISTINCT raster_id FROM pix), range({2}) t(r), range({2}) u(c)'
NEAREST = 'SELECT p.raster_id, p.band, g."row", g.col, p.value FROM g JOIN pix p ON p.raster_id = g.raster_id AND p."row" = floor(g.sr) AND p.col = floor(g.sc)'


def weighted(weight: str, low: int, high: int, digits: int = 6) -> str:
    """SQL of a separable weighted resampling with weights of a distance d."""
    w = lambda d: weight.replace("?", d)
    return f"""SELECT p.raster_id, p.band, g."row", g.col, round(sum(w * value) / sum(w), {digits}) AS value FROM (SELECT *, CAST(floor(sr - 0.5) + a AS INTEGER) AS y, CAST(floor(sc - 0.5) + b AS INTEGER) AS x,
{w("(sr - 0.5 - (floor(sr - 0.5) + a))")} * {w("(sc - 0.5 - (floor(sc - 0.5) + b))")} AS w FROM g, range({low}, {high}) i(a), range({low}, {high}) j(b)) g JOIN pix p ON p.raster_id = g.raster_id AND p."row" = y AND p.col = x WHERE w <> 0 GROUP BY ALL HAVING abs(sum(w)) > 1e-9"""


@query(f"WITH {PIX}, g AS ({GRID.format('(r + 0.5) * 0.64', '(c + 0.5) * 0.64', 100)}) {NEAREST}")
def r4_resize_nearest(spark, sf):
    return P.resize(X.pixels(spark, sf), 100, 100, 0.64, "nearest")


@query(f"WITH {PIX}, g AS ({GRID.format('(r + 0.5) * 0.8::DOUBLE', '(c + 0.5) * 0.8::DOUBLE', 80)}) {weighted('greatest(1 - abs(?), 0)', 0, 2)}")
def r4_resize_bilinear(spark, sf):
    return rounded(P.resize(X.pixels(spark, sf), 80, 80, 0.8, "bilinear"), "value")


CUBIC = "(CASE WHEN abs(?) <= 1 THEN (1.5 * abs(?) - 2.5) * abs(?) * abs(?) + 1 WHEN abs(?) < 2 THEN ((-0.5 * abs(?) + 2.5) * abs(?) - 4) * abs(?) + 2 ELSE 0 END)"
SPLINE = "(CASE WHEN abs(?) < 1 THEN 2.0 / 3 - ? * ? + abs(?) ^ 3 / 2 WHEN abs(?) < 2 THEN (2 - abs(?)) ^ 3 / 6 ELSE 0 END)"
LANCZOS = "(CASE WHEN abs(?) < 1e-9 THEN 1 WHEN abs(?) < 3 THEN 3 * sin(pi() * ?) * sin(pi() * ? / 3) / (pi() * ?) ^ 2 ELSE 0 END)"


@query(f"WITH {PIX}, g AS ({GRID.format('(r + 0.5) * 0.8::DOUBLE', '(c + 0.5) * 0.8::DOUBLE', 80)}) {weighted(CUBIC, -1, 3, 9)}")
def r2_resample_cubic(spark, sf):
    return rounded(P.resize(X.pixels(spark, sf), 80, 80, 0.8, "cubic"), "value", digits=9)


@query(f"WITH {PIX}, g AS ({GRID.format('(r + 0.5) * 0.8::DOUBLE', '(c + 0.5) * 0.8::DOUBLE', 80)}) {weighted(SPLINE, -1, 3, 9)}")
def r2_resample_cubicspline(spark, sf):
    return rounded(P.resize(X.pixels(spark, sf), 80, 80, 0.8, "cubicspline"), "value", digits=9)


@query(f"WITH {PIX}, g AS ({GRID.format('(r + 0.5) * 0.8::DOUBLE', '(c + 0.5) * 0.8::DOUBLE', 80)}) {weighted(LANCZOS, -2, 4)}")
def r2_resample_lanczos(spark, sf):
    return rounded(P.resize(X.pixels(spark, sf), 80, 80, 0.8, "lanczos"), "value")


AREA = """SELECT p.raster_id, p.band, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, p.value, (least((r + 1) * 2.5, p."row" + 1) - greatest(r * 2.5, p."row")) * (least((c + 1) * 2.5, p.col + 1) - greatest(c * 2.5, p.col)) AS w
FROM pix p, range(25) t(r), range(25) u(c) WHERE p."row" + 1 > r * 2.5 AND p."row" < (r + 1) * 2.5 AND p.col + 1 > c * 2.5 AND p.col < (c + 1) * 2.5"""


@query(f'WITH {PIX}, a AS ({AREA}) SELECT raster_id, band, "row", col, round(CAST(sum(w * value) / sum(w) AS DOUBLE), 6) AS value FROM a GROUP BY ALL')
def r2_resample_average(spark, sf):
    return rounded(P.resize(X.pixels(spark, sf), 25, 25, 2.5, "average"), "value")


@query(f'WITH {PIX}, a AS (SELECT raster_id, band, "row", col, value, sum(w) AS w FROM ({AREA}) GROUP BY ALL) SELECT raster_id, band, "row", col, arg_max(value, (w, -value)) AS value FROM a GROUP BY raster_id, band, "row", col')
def r2_resample_mode(spark, sf):
    return P.resize(X.pixels(spark, sf), 25, 25, 2.5, "mode")


@query(f"WITH {PIX}, g AS ({GRID.format('(0.1 * (c + 0.5) + 0.9 * (r + 0.5) + 1.25)', '(0.9 * (c + 0.5) - 0.1 * (r + 0.5) + 3.33)', 64)}) {NEAREST}")
def r5_warp_affine(spark, sf):
    return P.warp(X.pixels(spark, sf), 64, 64, (0.9, -0.1, 3.33, 0.1, 0.9, 1.25), "nearest")


# Rasters lie at 116 E, 40 N with pixels of 0.001 degrees; the target has Mercator pixels of 110 m.
GT_DEG = (116.0, 0.001, 0.0, 40.0, 0.0, -0.001)
GT_M = (12913060.0, 110.0, 0.0, 4865940.0, 0.0, -110.0)
BACK_Y = f"((degrees(atan(exp((4865940.0::DOUBLE - (r + 0.5) * 110) / {R!r})) * 2 - {math.pi / 2!r}) - 40.0) / -0.001::DOUBLE)"
BACK_X = f"(((12913060.0::DOUBLE + (c + 0.5) * 110) * {180 / (R * math.pi)!r} - 116.0) / 0.001::DOUBLE)"


@query(f"WITH {PIX}, g AS ({GRID.format(BACK_Y, BACK_X, 64)}) {NEAREST}")
def r2_reproject_nearest(spark, sf):
    return P.reproject_raster(X.pixels(spark, sf), 4326, 3857, GT_DEG, GT_M, 64, 64, "nearest")


@query(f"WITH {PIX}, g AS ({GRID.format(BACK_Y, BACK_X, 64)}) {weighted('greatest(1 - abs(?), 0)', 0, 2).replace('round(sum(w * value) / sum(w), 6)', 'round(sum(w * value) / sum(w), 4)')}")
def r2_reproject_bilinear(spark, sf):
    return rounded(P.reproject_raster(X.pixels(spark, sf), 4326, 3857, GT_DEG, GT_M, 64, 64, "bilinear"), "value", digits=4)


@query(f"WITH {PIX}, g AS ({GRID.format('(r + 7.0)', '(c - 4.0)', 60)}) SELECT g.raster_id, b.band, g.\"row\", g.col, coalesce(p.value, -1) AS value FROM g CROSS JOIN (VALUES (1), (2), (3), (4)) b(band) LEFT JOIN pix p ON p.raster_id = g.raster_id AND p.band = b.band AND p.\"row\" = floor(g.sr) AND p.col = floor(g.sc)")
def r7_window_to_grid(spark, sf):
    p = X.pixels(spark, sf)
    targets = P.grid_targets(p, 60, 60, lambda x, y: (x - 4.5, y + 6.5))
    got = P.resample(p, targets, "nearest")
    every = targets.select("raster_id", "row", "col", F.explode(F.array(*[F.lit(b) for b in (1, 2, 3, 4)])).alias("band"))
    return every.join(got, ["raster_id", "band", "row", "col"], "left").select("raster_id", "band", "row", "col", F.coalesce("value", F.lit(-1.0)).alias("value"))


MERCATOR = "round({0} * (6378137.0 * pi() / 180), 3) AS {1}"
NORTHING = "round(ln(tan(radians({0}) / 2 + pi() / 4)) * 6378137.0, 3) AS {1}"
DEGREES = "(SELECT oid, 100 + xmin / 4 AS xmin, ymin / 2 AS ymin, 100 + xmax / 4 AS xmax, ymax / 2 AS ymax FROM rects)"


@query(f"WITH {RECTS} SELECT oid, {MERCATOR.format('xmin', 'xmin')}, {NORTHING.format('ymin', 'ymin')}, {MERCATOR.format('xmax', 'xmax')}, {NORTHING.format('ymax', 'ymax')}, 5 AS vertices FROM {DEGREES}")
def r1_reproject_features(spark, sf):
    r = X.rects(spark, sf)
    degrees = rectangles(r.select("oid", *[(100 + F.col(c) / 4 if c[0] == "x" else F.col(c) / 2).alias(c) for c in BOX]))
    return rounded(P.reproject_features(degrees, 4326, 3857).select("oid", *BOX, F.size(G.vertices(F.col("geom"))).alias("vertices")), *BOX, digits=3)


@query(f"WITH {ZONES} SELECT fid, fname, {MERCATOR.format('(100 + xmin / 8)', 'xmin')}, {NORTHING.format('(ymin / 8)', 'ymin')}, {MERCATOR.format('(100 + xmax / 8)', 'xmax')}, {NORTHING.format('(ymax / 8)', 'ymax')} FROM zones")
def r6_zones_to_target(spark, sf):
    z = X.zones(spark, sf)
    degrees = rectangles(z.select("fid", "fname", *[(100 + F.col(c) / 8 if c[0] == "x" else F.col(c) / 8).alias(c) for c in BOX]))
    return rounded(P.reproject_features(degrees, 4326, target_srs([4326, 3857])).select("fid", "fname", *BOX), *BOX, digits=3)
