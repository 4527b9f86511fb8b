"""Queries of the feature operators and of zonal statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.operators import project as R
from geoloom.operators import vector as V
from geoloom.operators import zonal as Z
from geoloom.plans.base import group, rounded
from geoloom.sources import fixtures as X
from geoloom.sources.fixtures import LINES, POINTS, PX, RECTS, ZONES

QUERIES, ORACLES, query = group()
GT = (0.0, 1.0, 0.0, 64.0, 0.0, -1.0)
CELL = 2.5


def _rects(spark, sf):
    return V.rectangles(X.rects(spark, sf))


@query(f"WITH {RECTS} SELECT * FROM rects WHERE kind IN ('Brand#11', 'Brand#22') OR oid % 3 = 0")
def f1_filter_attribute(spark, sf):
    return V.filter_features(X.rects(spark, sf), where="kind IN ('Brand#11', 'Brand#22') OR oid % 3 = 0")


@query(f"WITH {RECTS} SELECT oid, xmin, ymin, xmax, ymax FROM rects WHERE xmin <= 30 AND xmax >= 10.5 AND ymin <= 42 AND ymax >= 20")
def f2_filter_extent(spark, sf):
    return V.filter_features(X.rects(spark, sf), box=(10.5, 20, 30, 42)).select("oid", *V.BOX)


MEET = "a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax"


@query(f"WITH {RECTS} SELECT oid, xmin <= 45 AND 20 <= xmax AND ymin <= 30 AND 12.5 <= ymax AS meets FROM rects")
def f3_bbox_overlap(spark, sf):
    named = X.rects(spark, sf).select("oid", *[F.col(c).alias(f"a_{c}") for c in V.BOX], *[F.lit(v).alias(f"b_{c}") for c, v in zip(V.BOX, (20.0, 12.5, 45.0, 30.0), strict=True)])
    return named.select("oid", V.boxes_meet("a", "b").alias("meets"))


@query(f"WITH {RECTS}, n AS (SELECT count(*) AS n FROM rects) SELECT (SELECT count(*) FROM rects a JOIN rects b ON a.oid < b.oid AND {MEET}) AS pairs, n * (n - 1) // 2 AS total, round((SELECT count(*) FROM rects a JOIN rects b ON a.oid < b.oid AND {MEET}) / (n * (n - 1) / 2), 9) AS ratio FROM n")
def f4_overlap_ratio(spark, sf):
    return rounded(V.overlap_ratio(X.rects(spark, sf), "oid", CELL), "ratio", digits=9)


@query(f"WITH {POINTS}, {RECTS} SELECT pid, oid FROM points JOIN rects ON x >= xmin AND x < xmax AND y >= ymin AND y < ymax")
def j11_points_in_areas(spark, sf):
    return V.points_in_areas(X.points(spark, sf), _rects(spark, sf), "pid", "oid", CELL)


@query(f"WITH {POINTS} SELECT pid, x >= 10 AND x < 50 AND y >= 5 AND y < 55 AND NOT (x >= 20 AND x < 30 AND y >= 20 AND y < 40) AS inside FROM points")
def f5_contains_point(spark, sf):
    ring = lambda a, b, c, d: f"array({', '.join(f'named_struct({chr(39)}x{chr(39)}, {x}D, {chr(39)}y{chr(39)}, {y}D)' for x, y in ((a, b), (c, b), (c, d), (a, d), (a, b)))})"
    shape = F.struct(F.lit("Polygon").alias("kind"), F.expr(f"array(array({ring(10, 5, 50, 55)}, {ring(20, 20, 30, 40)}))").alias("parts"))
    return X.points(spark, sf).select("pid", G.contains_point(shape, F.col("x"), F.col("y")).alias("inside"))


@query(f"WITH {LINES} SELECT max(CASE WHEN lid IS NOT NULL THEN 'LineString' END) AS kind FROM lines")
def f7_effective_kind(spark, sf):
    lines = X.lines(spark, sf).withColumn("geom", G.segment(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]))
    return V.effective_kind(lines, "lid")


@query(f"WITH {RECTS} SELECT count(*) AS n, 'Polygon' AS kind, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax, 'oid:bigint, kind:string' AS fields FROM rects")
def f10_info(spark, sf):
    return V.info(_rects(spark, sf))


@query(f"WITH {POINTS} SELECT min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM points")
def f11_extent(spark, sf):
    pts = G.with_box(X.points(spark, sf).withColumn("geom", G.point(F.col("x"), F.col("y"))))
    return V.bounds(pts)


@query(f"WITH {RECTS} SELECT oid, 'MultiPolygon' AS kind, round((xmax - xmin) * (ymax - ymin), 6) AS area, round(2 * (xmax - xmin + ymax - ymin), 6) AS length, false AS empty, 2 AS rank FROM rects")
def s8_promotion_and_scalars(spark, sf):
    g = F.col("geom")
    out = _rects(spark, sf).select("oid", G.promoted(g).alias("geom"))
    return rounded(out.select("oid", G.kind(g).alias("kind"), G.area(g).alias("area"), G.length(g).alias("length"), G.is_empty(g).alias("empty"), G.rank(g).alias("rank")), "area", "length")


@query(f"WITH {RECTS}, o AS (SELECT p_partkey AS bid, xmin + 0.25 AS xmin, ymin + 0.75 AS ymin, xmax + 0.25 AS xmax, ymax + 0.75 AS ymax FROM part JOIN rects ON oid = p_partkey) SELECT a.oid, b.bid FROM rects a JOIN o b ON {MEET}")
def j1_grid_join(spark, sf):
    a = X.rects(spark, sf)
    b = a.select(F.col("oid").alias("bid"), (F.col("xmin") + 0.25).alias("xmin"), (F.col("ymin") + 0.75).alias("ymin"), (F.col("xmax") + 0.25).alias("xmax"), (F.col("ymax") + 0.75).alias("ymax"))
    return V.grid_join(a, b, "oid", "bid", CELL)


CUT = f"""{LINES}, {ZONES}, d AS (SELECT lid, fid, x1 - x0 AS dx, y1 - y0 AS dy, x0, y0, xmin, xmax, ymin, ymax FROM lines JOIN zones ON least(x0, x1) <= xmax AND greatest(x0, x1) >= xmin AND least(y0, y1) <= ymax AND greatest(y0, y1) >= ymin),
e AS (SELECT lid, fid, CASE WHEN dx <> 0 THEN least((xmin - x0) / dx, (xmax - x0) / dx) WHEN x0 BETWEEN xmin AND xmax THEN 0 ELSE 2 END AS xa, CASE WHEN dx <> 0 THEN greatest((xmin - x0) / dx, (xmax - x0) / dx) WHEN x0 BETWEEN xmin AND xmax THEN 1 ELSE -1 END AS xb,
 CASE WHEN dy <> 0 THEN least((ymin - y0) / dy, (ymax - y0) / dy) WHEN y0 BETWEEN ymin AND ymax THEN 0 ELSE 2 END AS ya, CASE WHEN dy <> 0 THEN greatest((ymin - y0) / dy, (ymax - y0) / dy) WHEN y0 BETWEEN ymin AND ymax THEN 1 ELSE -1 END AS yb FROM d),
s AS (SELECT lid, fid, greatest(xa, ya, 0) AS t0, least(xb, yb, 1) AS t1 FROM e WHERE least(xb, yb, 1) > greatest(xa, ya, 0))"""
SPAN = "sqrt((x1 - x0) ^ 2 + (y1 - y0) ^ 2)"


def _stretches(spark, sf):
    return V.clip_lines_to_boxes(X.lines(spark, sf), X.zones(spark, sf), "lid", "fid", 4.0)


@query(f"WITH {CUT} SELECT lid, round({SPAN} * sum(t1 - t0), 6) AS length, count(*) AS parts FROM s JOIN lines USING (lid) GROUP BY lid, x0, y0, x1, y1")
def j3_clip_lines(spark, sf):
    cut = V.cut_lines(X.lines(spark, sf), V.inside_stretches(_stretches(spark, sf), "lid"), "lid")
    return rounded(cut.select("lid", G.length(F.col("geom")).alias("length"), F.size("geom.parts").cast("long").alias("parts")), "length")


@query(f"WITH {CUT} SELECT lid, round({SPAN} * (1 - coalesce(sum(t1 - t0), 0)), 5) AS length FROM lines LEFT JOIN s USING (lid) GROUP BY lid, x0, y0, x1, y1 HAVING {SPAN} > 0 AND 1 - coalesce(sum(t1 - t0), 0) > 1e-9")
def j5_difference_lines(spark, sf):
    lines = X.lines(spark, sf)
    cut = V.cut_lines(lines, V.outside_stretches(lines, V.inside_stretches(_stretches(spark, sf), "lid"), "lid").where("t1 - t0 > 1e-12"), "lid")
    return rounded(cut.select("lid", G.length(F.col("geom")).alias("length")).where("length > 0"), "length", digits=5)


@query(f"WITH {CUT}, c AS (SELECT lid, count(*) AS n, sum(t1 - t0) AS w, sum(CAST(t0 > 0 AND t1 < 1 AS INTEGER)) AS inner_n, min(t0) AS a, max(t1) AS b FROM s GROUP BY lid) SELECT lid, n + CAST(a > 0 AS INTEGER) + CAST(b < 1 AS INTEGER) + n - 1 AS parts FROM c")
def j7_union_lines(spark, sf):
    lines, inside = X.lines(spark, sf), V.inside_stretches(_stretches(spark, sf), "lid")
    met = lines.join(inside.select("lid").distinct(), "lid", "left_semi")
    return inside.unionByName(V.outside_stretches(met, inside, "lid")).groupBy("lid").agg(F.count("*").alias("parts"))


# Lines of three vertices against a diamond in each zone.
BENT = """bent AS (SELECT lid, CAST(0 AS BIGINT) AS k, x0, y0, x1, y1 FROM lines UNION ALL SELECT lid, 1, x1, y1, x1 + 1.5::DOUBLE, y1 - (lid % 7)::DOUBLE / 2 FROM lines)"""
SIDES = """sides AS (SELECT lid, k, fid, a.* FROM bent JOIN zones ON least(x0, x1) <= xmax AND greatest(x0, x1) >= xmin AND least(y0, y1) <= ymax AND greatest(y0, y1) >= ymin
 CROSS JOIN LATERAL (SELECT 1 - s * (x0 - xmin - 5.5) / 5.5::DOUBLE - r * (y0 - ymin - 4.5) / 4.5::DOUBLE AS room, s * (x1 - x0) / 5.5::DOUBLE + r * (y1 - y0) / 4.5::DOUBLE AS slope FROM (VALUES (1, 1), (1, -1), (-1, 1), (-1, -1)) v(s, r)) a),
inner_ AS (SELECT lid, k, fid, any_value(k) + greatest(0, max(CASE WHEN slope < 0 THEN room / slope END)) AS m0, any_value(k) + least(1, min(CASE WHEN slope > 0 THEN room / slope END)) AS m1, bool_or(slope = 0 AND room < 0) AS off FROM sides GROUP BY lid, k, fid),
s AS (SELECT lid, k, m0, m1 FROM inner_ WHERE NOT off AND m1 - m0 > 1e-12)"""
BENT_LENGTH = "sum(sqrt((x1 - x0) ^ 2 + (y1 - y0) ^ 2) * (m1 - m0))"
PARTS = "p AS (SELECT lid, count(*) AS parts FROM (SELECT *, lag(m1) OVER (PARTITION BY lid ORDER BY m0) AS before FROM s) WHERE before IS NULL OR m0 > before GROUP BY lid)"


def _bent(spark, sf):
    """(lines, diamonds)."""
    l = X.lines(spark, sf)
    third = G.vertex(F.col("x1") + 1.5, F.col("y1") - (F.col("lid") % 7).cast("double") / 2)
    geom = G.geometry("LineString", F.array(F.array(F.array(G.vertex(F.col("x0"), F.col("y0")), G.vertex(F.col("x1"), F.col("y1")), third))))
    x, y = F.col("xmin") + 5.5, F.col("ymin") + 4.5
    ring = F.array(G.vertex(x + 5.5, y), G.vertex(x, y + 4.5), G.vertex(x - 5.5, y), G.vertex(x, y - 4.5), G.vertex(x + 5.5, y))
    return l.select("lid", geom.alias("geom")), G.with_box(X.zones(spark, sf).withColumn("geom", G.geometry("Polygon", F.array(F.array(ring)))))


def _measured(df):
    return rounded(df.select("lid", G.length(F.col("geom")).alias("length"), F.size("geom.parts").cast("long").alias("parts")), "length", digits=5)


@query(f"WITH {LINES}, {ZONES}, {BENT}, {SIDES}, {PARTS} SELECT lid, round({BENT_LENGTH}, 5) AS length, any_value(parts) AS parts FROM s JOIN bent USING (lid, k) JOIN p USING (lid) GROUP BY lid")
def j3_clip_bent_lines(spark, sf):
    return _measured(V.clip_lines(*_bent(spark, sf), "lid", "fid", 4.0))


@query(f"WITH {LINES}, {ZONES}, {BENT}, {SIDES}, i AS (SELECT lid, {BENT_LENGTH} AS inside FROM s JOIN bent USING (lid, k) GROUP BY lid), w AS (SELECT lid, sum(sqrt((x1 - x0) ^ 2 + (y1 - y0) ^ 2)) AS whole FROM bent GROUP BY lid) SELECT lid, round(whole - coalesce(inside, 0), 5) AS length FROM w LEFT JOIN i USING (lid) WHERE whole - coalesce(inside, 0) > 1e-9")
def j5_difference_bent_lines(spark, sf):
    return rounded(V.difference_lines(*_bent(spark, sf), "lid", "fid", 4.0).select("lid", G.length(F.col("geom")).alias("length")).where("length > 1e-9"), "length", digits=5)


@query(f"WITH {LINES}, {ZONES}, {BENT}, {SIDES}, {PARTS}, e AS (SELECT lid, min(m0) AS a, max(m1) AS b FROM s GROUP BY lid) SELECT lid, CASE WHEN parts IS NULL THEN 'input' ELSE 'split' END AS source, CAST(CASE WHEN parts IS NULL THEN 1 ELSE 2 * parts - 1 + CAST(a > 0 AS INTEGER) + CAST(b < 2 AS INTEGER) END AS BIGINT) AS parts FROM lines LEFT JOIN p USING (lid) LEFT JOIN e USING (lid)")
def j7_union_bent_lines(spark, sf):
    return V.union_lines(*_bent(spark, sf), "lid", "fid", 4.0).groupBy("lid", "source").agg(F.count("*").alias("parts"))


CELLS = """zc AS (SELECT fid, fname, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col FROM zones, range(64) t(r), range(64) u(c) WHERE c + 0.5 >= xmin AND c + 0.5 < xmax AND 64 - (r + 0.5) >= ymin AND 64 - (r + 0.5) < ymax)"""


@query(f'WITH {ZONES}, {CELLS} SELECT "row", col, max(fid)::DOUBLE AS value FROM zc GROUP BY ALL')
def v1_rasterize(spark, sf):
    z = V.rectangles(X.zones(spark, sf)).withColumn("k", F.col("fid"))
    return V.burned(V.rasterize(z, GT, attribute="k"))


@query(f'WITH {RECTS} SELECT oid, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col FROM rects, range(-10, 74) t(r), range(0, 74) u(c) WHERE c + 0.5 >= xmin AND c + 0.5 < xmax AND 64 - (r + 0.5) >= ymin AND 64 - (r + 0.5) < ymax')
def v1_rasterize_many(spark, sf):
    return V.rasterize(_rects(spark, sf), GT, fid="oid").select("oid", "row", "col")


@query(f"WITH {POINTS} SELECT pid, round(x - 2.5, 6) AS xmin, round(y - 2.5, 6) AS ymin, round(x + 2.5, 6) AS xmax, round(y + 2.5, 6) AS ymax, round(60 * 6.25 * sin(2 * pi() / 120), 6) AS area FROM points")
def v3_buffer_points(spark, sf):
    b = V.point_buffers(X.points(spark, sf), 2.5, 3857)
    return rounded(b.select("pid", *V.BOX, G.area(F.col("geom")).alias("area")), *V.BOX, "area")


CLASSES = '{"1": "water", "2": "forest", "3": "urban"}'
RESOLVED = f"""{PX}, {ZONES}, {CELLS}, classes AS (SELECT * FROM (VALUES (1, 'water'), (2, 'forest'), (3, 'urban')) t(class_value, class_name)),
cand AS (SELECT raster_id, "row", col, CAST(hi AS INTEGER) AS class_value, 0 AS priority FROM px WHERE hi <> 0 UNION ALL SELECT raster_id, "row", col, CAST(lo AS INTEGER), 1 FROM px WHERE lo <> 0),
found AS (SELECT raster_id, fid, fname, "row", col, arg_min(class_value, priority) AS class_value FROM zc JOIN cand USING ("row", col) JOIN classes USING (class_value) GROUP BY ALL),
counted AS (SELECT raster_id, fid, class_value, count(*) AS n FROM found GROUP BY ALL),
recs AS (SELECT s.raster_id, CAST(z.fid AS VARCHAR) AS feature_id, z.fname AS feature_name, coalesce(c.class_value, 0) AS class_value, coalesce(class_name, '') AS class_name, coalesce(n, 0) AS pixel_count, coalesce(n, 0)::DOUBLE * 4 AS area,
 coalesce(n / sum(n) OVER (PARTITION BY s.raster_id, z.fid), 0) AS ratio FROM (SELECT DISTINCT raster_id FROM px) s CROSS JOIN zones z LEFT JOIN counted c ON c.raster_id = s.raster_id AND c.fid = z.fid LEFT JOIN classes k ON k.class_value = c.class_value)"""


def _found(spark, sf):
    s = X.scenes(spark, sf)
    layers = F.explode(F.array(F.struct(F.lit(0).alias("priority"), F.col("hi").alias("value")), F.struct(F.lit(1).alias("priority"), F.col("lo").alias("value")))).alias("p")
    pixels = s.select("raster_id", "row", "col", layers).select("raster_id", "row", "col", "p.priority", "p.value", F.lit(0.0).alias("nodata"))
    zones = X.raster_ids(spark, sf).crossJoin(X.zones(spark, sf))  # a record for each zone of each raster is the result
    cells = V.rasterize(V.rectangles(X.zones(spark, sf)), GT).select("fid", "row", "col")
    return zones, Z.resolved(cells, pixels, Z.parse_class_map(spark, CLASSES), ["raster_id", "fid"])


COLUMNS = ("raster_id", "feature_id", "feature_name", "class_value", "class_name", "pixel_count", "area", "ratio", "actual_srs", "area_unit")


@query(f"WITH {RESOLVED} SELECT raster_id, feature_id, feature_name, class_value, class_name, pixel_count, area, round(ratio, 9) AS ratio, 'EPSG:3857' AS actual_srs, 'm2' AS area_unit FROM recs UNION ALL SELECT raster_id, '__summary__', '__summary__', class_value, class_name, CAST(sum(pixel_count) AS BIGINT), sum(area), round(CASE WHEN sum(sum(area)) OVER (PARTITION BY raster_id) > 0 THEN sum(area) / sum(sum(area)) OVER (PARTITION BY raster_id) ELSE 0 END, 9), 'EPSG:3857', 'm2' FROM recs GROUP BY raster_id, class_value, class_name")
def a8_feature_stats(spark, sf):
    zones, found = _found(spark, sf)
    records = Z.feature_stats(zones, found, 4.0, "EPSG:3857", by=("raster_id", "fid"))
    return rounded(Z.with_summary(records, ("raster_id",)), "ratio", digits=9).select(*COLUMNS)


@query(f"WITH {RESOLVED} SELECT raster_id, class_value, class_name, CAST(sum(pixel_count) AS BIGINT) AS pixel_count FROM recs GROUP BY ALL")
def a9_summary(spark, sf):
    zones, found = _found(spark, sf)
    out = Z.with_summary(Z.feature_stats(zones, found, 4.0, "EPSG:3857", by=("raster_id", "fid")), ("raster_id",))
    return out.where("feature_id = '__summary__'").select("raster_id", "class_value", "class_name", "pixel_count")


@query("SELECT arg_min(raster_id, (pixel_width * pixel_height, source_order)) AS raster_id, min(pixel_width * pixel_height) AS area FROM (SELECT s_suppkey AS raster_id, (10 + s_suppkey * 7 % 13)::DOUBLE AS pixel_width, (10 + s_suppkey * 5 % 11)::DOUBLE AS pixel_height, s_suppkey AS source_order FROM supplier)")
def a10_target_grid(spark, sf):
    k = F.col("s_suppkey")
    catalog = X.table(spark, sf, "supplier").select(k.alias("raster_id"), (10 + k * 7 % 13).cast("double").alias("pixel_width"), (10 + k * 5 % 11).cast("double").alias("pixel_height"), k.alias("source_order"))
    return Z.target_grid(catalog).select("raster_id", (F.col("pixel_width") * F.col("pixel_height")).alias("area"))


@query(f'WITH {RESOLVED} SELECT raster_id, "row", col, arg_max(class_value, fid) AS value FROM found WHERE class_value <> 0 GROUP BY ALL')
def a13_class_raster(spark, sf):
    return Z.class_raster(_found(spark, sf)[1], by=("raster_id",))


DEGREE = 6378137.0 * 3.141592653589793 / 180  # metres of a degree at the equator
LOW_TOP = 64 / DEGREE  # so near the equator degrees north are the same to twelve digits

STACK = f"""{PX}, {ZONES}, {CELLS}, classes AS (SELECT * FROM (VALUES (1, 'water'), (2, 'forest'), (3, 'urban')) t(class_value, class_name)),
coarse AS (SELECT raster_id, "row" // 2 AS r, col // 2 AS c, lo FROM px WHERE "row" % 2 = 0 AND col % 2 = 0),
cand AS (SELECT fid, zc."row", zc.col, CAST(hi AS INTEGER) AS class_value, raster_id * 2 AS priority FROM zc JOIN px ON px."row" = zc."row" AND px.col = zc.col WHERE hi <> 0
 UNION ALL SELECT fid, zc."row", zc.col, CAST(lo AS INTEGER), raster_id * 2 + 1 FROM zc JOIN coarse ON r = zc."row" // 2 AND c = zc.col // 2 WHERE lo <> 0),
found AS (SELECT fid, "row", col, arg_min(class_value, priority) AS class_value FROM cand JOIN classes USING (class_value) GROUP BY ALL),
counted AS (SELECT fid, class_value, count(*) AS n FROM found GROUP BY ALL),
recs AS (SELECT CAST(z.fid AS VARCHAR) AS feature_id, z.fname AS feature_name, coalesce(c.class_value, 0) AS class_value, coalesce(class_name, '') AS class_name, coalesce(n, 0) AS pixel_count, coalesce(n, 0)::DOUBLE AS area, coalesce(n / sum(n) OVER (PARTITION BY z.fid), 0) AS ratio FROM zones z LEFT JOIN counted c USING (fid) LEFT JOIN classes k ON k.class_value = c.class_value)"""


@query(f"WITH {STACK} SELECT feature_id, feature_name, class_value, class_name, pixel_count, area, round(ratio, 9) AS ratio, 'EPSG:3857' AS actual_srs FROM recs UNION ALL SELECT '__summary__', '__summary__', class_value, class_name, CAST(sum(pixel_count) AS BIGINT), sum(area), round(sum(area) / sum(sum(area)) OVER (), 9), 'EPSG:3857' FROM recs GROUP BY class_value, class_name")
def a8_stats_over_rasters(spark, sf):
    """A fine raster in Mercator and a coarse one in degrees for each scene, zones in degrees."""
    s = X.scenes(spark, sf)
    fine = s.select((F.col("raster_id") * 2).alias("raster_id"), "row", "col", F.col("hi").alias("value"))
    half = s.where("row % 2 = 0 and col % 2 = 0").select((F.col("raster_id") * 2 + 1).alias("raster_id"), F.floor(F.col("row") / 2).cast("int").alias("row"), F.floor(F.col("col") / 2).cast("int").alias("col"), F.col("lo").alias("value"))
    grid = lambda side, px, top, srid: [F.lit(0.0).alias("ox"), F.lit(px).alias("px"), F.lit(top).alias("oy"), F.lit(-px).alias("py"), F.lit(side).alias("width"), F.lit(side).alias("height"), F.lit(srid).alias("srid"), F.lit(0.0).alias("nodata")]
    ids = X.raster_ids(spark, sf)
    catalog = ids.select((F.col("raster_id") * 2).alias("raster_id"), (F.col("raster_id") * 2).alias("priority"), *grid(64, 1.0, 64.0, 3857)).unionByName(ids.select((F.col("raster_id") * 2 + 1).alias("raster_id"), (F.col("raster_id") * 2 + 1).alias("priority"), *grid(32, 2 / DEGREE, LOW_TOP, 4326)))
    zones = R.reproject_features(V.rectangles(X.zones(spark, sf)), 3857, 4326)
    out = Z.stats_over_rasters(zones, 4326, catalog, fine.unionByName(half), Z.parse_class_map(spark, CLASSES))
    return rounded(rounded(out.drop("area_unit"), "ratio", digits=9), "area")
