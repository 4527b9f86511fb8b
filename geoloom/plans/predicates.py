"""Queries of the exact spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.operators import predicates as R
from geoloom.operators import vector as V
from geoloom.plans.base import group
from geoloom.sources import fixtures as X
from geoloom.sources.fixtures import LINES, POINTS, RECTS, ZONES

QUERIES, ORACLES, query = group()
CELL = 1.0
HOLE = "xmin + 4 AS hx0, ymin + 3 AS hy0, xmin + 7.5 AS hx1, ymin + 6.5 AS hy1"


def _diamonds(spark, sf):
    """A diamond in each zone, its half widths such that no corner of a rectangle can lie on its sides."""
    x, y = F.col("xmin") + 5.5, F.col("ymin") + 4.5
    ring = F.array(*[G.vertex(x + a, y + b) for a, b in ((5.503, 0.0), (0.0, 4.497), (-5.503, 0.0), (0.0, -4.497), (5.503, 0.0))])
    return G.with_box(X.zones(spark, sf).withColumn("geom", G.geometry("Polygon", F.array(F.array(ring)))))


def _holed(spark, sf):
    """The zones with a hole each."""
    shape = lambda x0, y0, x1, y1: F.array(G.vertex(x0, y0), G.vertex(x1, y0), G.vertex(x1, y1), G.vertex(x0, y1), G.vertex(x0, y0))
    x, y = F.col("xmin"), F.col("ymin")
    return X.zones(spark, sf).withColumn("geom", G.geometry("Polygon", F.array(F.array(shape(x, y, F.col("xmax"), F.col("ymax")), shape(x + 4, y + 3, x + 7.5, y + 6.5)))))


def _rects(spark, sf):
    return V.rectangles(X.rects(spark, sf))


def _lines(spark, sf):
    return G.with_box(X.lines(spark, sf).withColumn("geom", G.segment(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])))


AWAY = "greatest({0}min - c{0}, c{0} - {0}max, 0)"
FAR = "greatest(abs({0}min - c{0}), abs({0}max - c{0}))"
MIDDLES = "m AS (SELECT fid, xmin + 5.5 AS cx, ymin + 4.5 AS cy FROM zones)"


@query(f"WITH {RECTS}, {ZONES}, {MIDDLES} SELECT oid, fid FROM rects JOIN m ON {AWAY.format('x')} / 5.503 + {AWAY.format('y')} / 4.497 <= 1")
def f5_areas_intersect(spark, sf):
    return R.spatial_join(_rects(spark, sf), _diamonds(spark, sf), "oid", "fid", "intersects", CELL)


@query(f"WITH {RECTS}, {ZONES}, {MIDDLES} SELECT fid, oid FROM rects JOIN m ON {FAR.format('x')} / 5.503 + {FAR.format('y')} / 4.497 <= 1")
def f5_areas_contain(spark, sf):
    return R.spatial_join(_diamonds(spark, sf), _rects(spark, sf), "fid", "oid", "contains", CELL)


@query(f"WITH {RECTS}, {ZONES}, h AS (SELECT *, {HOLE} FROM zones) SELECT r.oid, fid FROM rects r JOIN h ON r.xmin <= h.xmax AND r.xmax >= h.xmin AND r.ymin <= h.ymax AND r.ymax >= h.ymin AND NOT (r.xmin > hx0 AND r.xmax < hx1 AND r.ymin > hy0 AND r.ymax < hy1)")
def f5_areas_with_holes_intersect(spark, sf):
    return R.spatial_join(_rects(spark, sf), _holed(spark, sf), "oid", "fid", "intersects", CELL)


@query(f"WITH {RECTS}, {ZONES}, h AS (SELECT *, {HOLE} FROM zones) SELECT r.oid, fid FROM rects r JOIN h ON r.xmin >= h.xmin AND r.xmax <= h.xmax AND r.ymin >= h.ymin AND r.ymax <= h.ymax AND NOT (r.xmin < hx1 AND r.xmax > hx0 AND r.ymin < hy1 AND r.ymax > hy0)")
def f5_areas_within_holed(spark, sf):
    return R.spatial_join(_rects(spark, sf), _holed(spark, sf), "oid", "fid", "within", CELL)


@query(f"""WITH {LINES}, {ZONES}, {MIDDLES}, s AS (SELECT lid, fid, 1 - a * (x0 - cx) / 5.503 - b * (y0 - cy) / 4.497 AS room, a * (x1 - x0) / 5.503 + b * (y1 - y0) / 4.497 AS slope FROM lines, m, (VALUES (1, 1), (1, -1), (-1, 1), (-1, -1)) v(a, b))
SELECT lid, fid FROM s GROUP BY lid, fid HAVING NOT bool_or(slope = 0 AND room < 0) AND greatest(0, coalesce(max(CASE WHEN slope < 0 THEN room / slope END), 0)) <= least(1, coalesce(min(CASE WHEN slope > 0 THEN room / slope END), 1))""")
def f5_lines_intersect(spark, sf):
    return R.spatial_join(_lines(spark, sf), _diamonds(spark, sf), "lid", "fid", "intersects", CELL)


@query(f"WITH {POINTS}, {ZONES}, h AS (SELECT *, {HOLE} FROM zones) SELECT pid, fid FROM points JOIN h ON x > xmin AND x < xmax AND y > ymin AND y < ymax AND NOT (x >= hx0 AND x <= hx1 AND y >= hy0 AND y <= hy1)")
def f5_points_within_holed(spark, sf):
    points = X.points(spark, sf).withColumn("geom", G.point(F.col("x"), F.col("y")))
    return R.spatial_join(points, _holed(spark, sf), "pid", "fid", "within", CELL)


@query(f"""WITH {LINES}, b AS (SELECT lid, x0, y0, x1, y1, x1 - x0 AS dx, y1 - y0 AS dy FROM lines WHERE least(x0, x1) <= 30 AND greatest(x0, x1) >= 10.5 AND least(y0, y1) <= 42 AND greatest(y0, y1) >= 20),
t AS (SELECT *, CASE WHEN dx <> 0 THEN least((10.5 - x0) / dx, (30 - x0) / dx) ELSE 0 END AS xa, CASE WHEN dx <> 0 THEN greatest((10.5 - x0) / dx, (30 - x0) / dx) ELSE 1 END AS xb, CASE WHEN dy <> 0 THEN least((20 - y0) / dy, (42 - y0) / dy) ELSE 0 END AS ya, CASE WHEN dy <> 0 THEN greatest((20 - y0) / dy, (42 - y0) / dy) ELSE 1 END AS yb FROM b)
SELECT lid FROM t WHERE greatest(xa, ya, 0) <= least(xb, yb, 1)""")
def f2_filter_extent_exact(spark, sf):
    return R.meets_extent(_lines(spark, sf), (10.5, 20, 30, 42)).select("lid")
