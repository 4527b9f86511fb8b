"""Queries of the area overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.operators import overlay as O
from geoloom.operators import segment as S
from geoloom.operators import vector as V
from geoloom.plans.base import group, rounded
from geoloom.plans.vector import RESOLVED, _found
from geoloom.sources import fixtures as X
from geoloom.sources.fixtures import LINES, RECTS, ZONES

QUERIES, ORACLES, query = group()
SHARED = "greatest(0, least(r.xmax, z.xmax) - greatest(r.xmin, z.xmin)) * greatest(0, least(r.ymax, z.ymax) - greatest(r.ymin, z.ymin))"
MEET = "r.xmin <= z.xmax AND z.xmin <= r.xmax AND r.ymin <= z.ymax AND z.ymin <= r.ymax"


def _both(spark, sf):
    return V.rectangles(X.rects(spark, sf)), V.rectangles(X.zones(spark, sf))


def _area(df, *keys):
    return rounded(df.select(*keys, G.area(F.col("geom")).alias("area")), "area", digits=4)


def probes(n: int) -> str:
    """SQL of the numbers of n x n probe points."""
    return f"range({n}) pi(i), range({n}) pj(j)"


def _with_probes(df, n: int, x, y):
    """``inside``: a text of 0 and 1 for n x n points, row by row; x and y give the place of a column and a row."""
    k = F.sequence(F.lit(0), F.lit(n * n - 1))
    told = F.transform(k, lambda v: F.when(G.contains_point(F.col("geom"), x(v % n), y(F.floor(v / n))), "1").otherwise("0"))
    return df.withColumn("inside", F.concat_ws("", told))


# Probes lie off the grid of the corners, so that none is on an edge.
IN_X, IN_Y = "(r.xmin + (i + 0.4321) / 5 * (r.xmax - r.xmin))", "(r.ymin + (j + 0.4321) / 5 * (r.ymax - r.ymin))"
WIDE_X, WIDE_Y = "(r.xmin - 6 + (i + 0.4321) * 2.51)", "(r.ymin - 6 + (j + 0.4321) * 2.51)"


def _off(table: str, x: str, y: str) -> str:
    return f"EXISTS (SELECT 1 FROM {table} WHERE {x} >= z.xmin AND {x} < z.xmax AND {y} >= z.ymin AND {y} < z.ymax)"


def _grown(c: str, share):
    return lambda k: F.col(f"r_{c}min") + (k + 0.4321) / 5 * (F.col(f"r_{c}max") - F.col(f"r_{c}min")) if share else F.col(f"r_{c}min") - 6 + (k + 0.4321) * 2.51


def _beside_rect(df, rects, share: bool):
    named = rects.select("oid", *[F.col(c).alias(f"r_{c}") for c in V.BOX])
    return _with_probes(df.join(named.hint("merge"), "oid"), 5 if share else 7, _grown("x", share), _grown("y", share))


@query(f"WITH {RECTS}, {ZONES} SELECT oid, kind, round(sum({SHARED}), 4) AS area, count(*) AS parts, 5 * count(*) AS vertices, round(min(greatest(r.xmin, z.xmin)), 6) AS xmin, round(min(greatest(r.ymin, z.ymin)), 6) AS ymin, round(max(least(r.xmax, z.xmax)), 6) AS xmax, round(max(least(r.ymax, z.ymax)), 6) AS ymax FROM rects r JOIN zones z ON {MEET} WHERE {SHARED} > 1e-9 GROUP BY oid, kind")
def j2_clip(spark, sf):
    out = O.clip(*_both(spark, sf), "oid", "fid", 4.0)
    out = out.select("oid", "kind", G.area(F.col("geom")).alias("area"), F.size("geom.parts").cast("long").alias("parts"), F.size(G.vertices(F.col("geom"))).cast("long").alias("vertices"), *V.BOX)
    return rounded(rounded(out, "area", digits=4), *V.BOX)


@query(f"""WITH {RECTS}, {ZONES}, a AS (SELECT oid, kind, round((r.xmax - r.xmin) * (r.ymax - r.ymin) - coalesce(sum({SHARED}) FILTER (z.fid IS NOT NULL), 0), 4) AS area FROM rects r LEFT JOIN zones z ON {MEET} GROUP BY oid, kind, r.xmin, r.ymin, r.xmax, r.ymax HAVING (r.xmax - r.xmin) * (r.ymax - r.ymin) - coalesce(sum({SHARED}) FILTER (z.fid IS NOT NULL), 0) > 1e-9),
p AS (SELECT oid, string_agg(CASE WHEN hit THEN '0' ELSE '1' END, '' ORDER BY j, i) AS inside FROM (SELECT oid, i, j, {_off('zones z', IN_X, IN_Y)} AS hit FROM rects r, {probes(5)}) GROUP BY oid) SELECT * FROM a JOIN p USING (oid)""")
def j4_difference(spark, sf):
    rects, zones = _both(spark, sf)
    out = _beside_rect(O.difference(rects, zones, "oid", "fid", 4.0), rects, True)
    return rounded(out.select("oid", "kind", G.area(F.col("geom")).alias("area"), "inside"), "area", digits=4)


@query(f"""WITH {RECTS}, {ZONES}, a AS (SELECT oid, CASE WHEN count(z.fid) > 0 THEN 'union' ELSE 'input' END AS source, round((r.xmax - r.xmin) * (r.ymax - r.ymin) + coalesce(sum((z.xmax - z.xmin) * (z.ymax - z.ymin) - {SHARED}), 0), 4) AS area FROM rects r LEFT JOIN zones z ON {MEET} GROUP BY oid, r.xmin, r.ymin, r.xmax, r.ymax),
p AS (SELECT oid, string_agg(CASE WHEN hit OR (x >= xmin AND x < xmax AND y >= ymin AND y < ymax) THEN '1' ELSE '0' END, '' ORDER BY j, i) AS inside FROM (SELECT r.*, i, j, {WIDE_X} AS x, {WIDE_Y} AS y, {_off(f'zones z WHERE {MEET} AND true', WIDE_X, WIDE_Y).replace('AND true WHERE', 'AND')} AS hit FROM rects r, {probes(7)}) GROUP BY oid) SELECT * FROM a JOIN p USING (oid)""")
def j6_union(spark, sf):
    rects, zones = _both(spark, sf)
    out = _beside_rect(O.union(rects, zones, "oid", "fid", 4.0), rects, False)
    return rounded(out.select("oid", "source", G.area(F.col("geom")).alias("area"), "inside"), "area", digits=4)


@query(f"""WITH {RECTS}, x AS (SELECT kind, v AS a, lead(v) OVER (PARTITION BY kind ORDER BY v) AS b FROM (SELECT DISTINCT kind, unnest([xmin, xmax]) AS v FROM rects)),
s AS (SELECT x.kind, a, b, ymin, ymax FROM x JOIN rects r ON r.kind = x.kind AND r.xmin <= a AND r.xmax >= b WHERE b IS NOT NULL),
m AS (SELECT *, max(ymax) OVER (PARTITION BY kind, a ORDER BY ymin, ymax ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
d AS (SELECT kind, round(sum((b - a) * greatest(0, ymax - greatest(ymin, coalesce(before, ymin)))), 4) AS area FROM m GROUP BY kind),
p AS (SELECT kind, string_agg(CASE WHEN hit THEN '1' ELSE '0' END, '' ORDER BY j, i) AS inside FROM (SELECT k.kind, i, j, EXISTS (SELECT 1 FROM rects z WHERE z.kind = k.kind AND i * 4 + 0.4321 >= z.xmin AND i * 4 + 0.4321 < z.xmax AND j * 4 + 0.4321 >= z.ymin AND j * 4 + 0.4321 < z.ymax) AS hit FROM (SELECT DISTINCT kind FROM rects) k, {probes(16)}) GROUP BY kind),
y AS (SELECT kind, v AS a, lead(v) OVER (PARTITION BY kind ORDER BY v) AS b FROM (SELECT DISTINCT kind, unnest([ymin, ymax]) AS v FROM rects)),
slabs AS (SELECT kind, a, b - a AS w, ymin AS lo, ymax AS hi, 'x' AS way FROM s UNION ALL SELECT y.kind, a, b - a, xmin, xmax, 'y' FROM y JOIN rects r ON r.kind = y.kind AND r.ymin <= a AND r.ymax >= b WHERE b IS NOT NULL),
apart AS (SELECT *, max(hi) OVER (PARTITION BY kind, way, a ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM slabs),
e AS (SELECT kind, round(2 * sum(w) FILTER (before IS NULL OR lo > before), 4) AS length FROM apart GROUP BY kind)
SELECT * FROM d JOIN p USING (kind) JOIN e USING (kind)""")
def a1_dissolve(spark, sf):
    out = _with_probes(O.dissolve(V.rectangles(X.rects(spark, sf)), "kind"), 16, lambda k: k * 4 + 0.4321, lambda k: k * 4 + 0.4321)
    return rounded(out.select("kind", G.area(F.col("geom")).alias("area"), G.length(F.col("geom")).alias("length"), "inside"), "area", "length", digits=4)


@query(f"WITH {RECTS} SELECT oid, round((xmax - xmin) * (ymax - ymin) + 2 * (xmax - xmin + ymax - ymin) * 0.5 + 60 * 0.25 * sin(2 * pi() / 120), 4) AS area FROM rects")
def v3_buffer_areas(spark, sf):
    return _area(O.buffer(V.rectangles(X.rects(spark, sf)), 0.5, 3857), "oid")


@query(f"WITH {LINES} SELECT count(*) AS feature_count, count(*) AS buffered_count, '0.25' AS distance, 'projected' AS srs_type FROM lines")
def v3_buffer_lines(spark, sf):
    lines = X.lines(spark, sf).withColumn("geom", G.segment(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]))
    return O.buffer_report(lines, O.buffer(lines, 0.25, 3857), 0.25)


@query(f"""WITH {LINES}, w AS (SELECT lid, x0, y0, x1, y1, sqrt((x1 - x0) ^ 2 + (y1 - y0) ^ 2) AS n FROM lines),
m AS (SELECT lid, max(0.25 * abs(cos(k * pi() / 60) * (y1 - y0) - sin(k * pi() / 60) * (x1 - x0))) AS wide FROM w, range(120) r(k) GROUP BY lid)
SELECT lid, round(60 * 0.0625 * sin(2 * pi() / 120) + 2 * wide, 5) AS area, round(least(x0, x1) - 0.25, 6) AS xmin, round(least(y0, y1) - 0.25, 6) AS ymin, round(greatest(x0, x1) + 0.25, 6) AS xmax, round(greatest(y0, y1) + 0.25, 6) AS ymax FROM w JOIN m USING (lid)""")
def v3_buffer_line_shapes(spark, sf):
    lines = X.lines(spark, sf).withColumn("geom", G.segment(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]))
    out = O.buffer(lines.select("lid", "geom"), 0.25, 3857).select("lid", G.area(F.col("geom")).alias("area"), *V.BOX)
    return rounded(rounded(out, "area", digits=5), *V.BOX)


@query(f"WITH {RECTS} SELECT oid, round((xmax - xmin) * (ymax - ymin) / 2, 4) AS area, '1001' AS inside FROM rects")
def f6_make_valid(spark, sf):
    c = [F.col(n) for n in V.BOX]
    ring = F.array(G.vertex(c[0], c[1]), G.vertex(c[2], c[3]), G.vertex(c[2], c[1]), G.vertex(c[0], c[3]), G.vertex(c[0], c[1]))
    out = O.normalized(X.rects(spark, sf).select("oid", G.geometry("Polygon", F.array(F.array(ring))).alias("geom")))
    width, height = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    # left, top, bottom and right of the crossing: two of the four triangles are the area
    probe = [G.contains_point(F.col("geom"), F.col("xmin") + width * a, F.col("ymin") + height * b) for a, b in ((0.2, 0.51), (0.51, 0.8), (0.51, 0.2), (0.8, 0.51))]
    told = out.withColumn("inside", F.concat_ws("", *[F.when(p, "1").otherwise("0") for p in probe]))
    return rounded(told.select("oid", G.area(F.col("geom")).alias("area"), "inside"), "area", digits=4)


@query(f"WITH {RESOLVED} SELECT raster_id, fid, CAST(class_value AS INTEGER) AS class_value, count(*) AS pixel_count FROM found WHERE class_value <> 0 GROUP BY ALL")
def a12_class_polygons(spark, sf):
    found = _found(spark, sf)[1].where("class_value <> 0")
    pixels = found.select("raster_id", F.col("fid").cast("int").alias("band"), "row", "col", F.col("class_value").cast("double").alias("value"))
    polygons = S.polygonize(pixels, (0.0, 1.0, 0.0, 64.0, 0.0, -1.0))
    return polygons.groupBy("raster_id", F.col("band").cast("long").alias("fid"), F.col("DN").alias("class_value")).agg(F.round(F.sum(G.area(F.col("geom")))).cast("long").alias("pixel_count"))
