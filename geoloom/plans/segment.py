"""Queries of regions, contours, clusters and Hough votes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.operators import segment as S
from geoloom.operators.focal import DERIVATIVE
from geoloom.operators.graph import checkpointed
from geoloom.plans.base import group, rounded
from geoloom.plans.focal import ONE, neighbours, outer
from geoloom.plans.raster import OTSU
from geoloom.sources import fixtures as X
from geoloom.sources.fixtures import PX

QUERIES, ORACLES, query = group()
GT = (0.0, 1.0, 0.0, 64.0, 0.0, -1.0)
ID = "(raster_id * 4398046511104 + 68719476736 + \"row\" * 262144 + col)"


def _classes(spark, sf):
    return X.scenes(spark, sf).select("raster_id", F.lit(1).alias("band"), "row", "col", F.col("hi").alias("value"))


REACH = f"""cls AS MATERIALIZED (SELECT raster_id, "row", col, hi AS value, {ID} AS id FROM px),
near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM cls a CROSS JOIN (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) s(dy, dx) JOIN cls b ON b.raster_id = a.raster_id AND b."row" = a."row" + dy AND b.col = a.col + dx AND b.value = a.value),
reach(id, other) AS (SELECT id, id FROM cls UNION SELECT r.id, n.b FROM reach r JOIN near n ON n.a = r.other),
lab AS MATERIALIZED (SELECT id, min(other) AS label FROM reach GROUP BY id)"""


@query(f'WITH RECURSIVE {PX}, {REACH} SELECT raster_id, 1 AS band, "row", col, value, label FROM cls JOIN lab USING (id)')
def c1_components(spark, sf):
    return S.components(_classes(spark, sf), 4, tile=16)


CORNERS = """turns AS (SELECT label, sum(CASE WHEN n IN (1, 3) THEN 1 WHEN held IN (6, 9) THEN 2 ELSE 0 END) AS vertices FROM (SELECT label, count(*) AS n, sum(1 << (2 * a + b)) AS held FROM (SELECT label, "row" + a AS y, col + b AS x, a, b FROM cls JOIN lab USING (id), range(2) i(a), range(2) j(b)) GROUP BY label, y, x) GROUP BY label)"""


@query(f"""WITH RECURSIVE {PX}, {REACH}, {CORNERS} SELECT raster_id, 1 AS band, label, CAST(any_value(value) AS INTEGER) AS "DN", count(*)::DOUBLE AS area, CAST(any_value(vertices) AS BIGINT) AS vertices, min(col)::DOUBLE AS xmin, (63 - max("row"))::DOUBLE AS ymin, (max(col) + 1)::DOUBLE AS xmax, (64 - min("row"))::DOUBLE AS ymax FROM cls JOIN lab USING (id) JOIN turns USING (label) GROUP BY raster_id, label""")
def v2_polygonize(spark, sf):
    out = G.with_box(S.polygonize(_classes(spark, sf), GT))
    own = F.aggregate(F.flatten("geom.parts"), F.lit(0).cast("long"), lambda n, r: n + F.size(r) - 1)
    return out.select("raster_id", "band", "label", "DN", G.area(F.col("geom")).alias("area"), own.alias("vertices"), "xmin", "ymin", "xmax", "ymax")


LIGHT = f"""{OTSU}, lt AS MATERIALIZED (SELECT raster_id, "row", col, CAST(value > threshold AS INTEGER) AS light, raster_id * 4096 + "row" * 64 + col AS id FROM st JOIN o USING (raster_id, band) WHERE band = 1),
dark AS MATERIALIZED (SELECT * FROM lt WHERE light = 0),
outer_ AS (SELECT id, raster_id, "row", col FROM dark WHERE "row" IN (0, 63) OR col IN (0, 63) UNION SELECT d.id, d.raster_id, d."row", d.col FROM outer_ p CROSS JOIN (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) s(dy, dx) JOIN dark d ON d.raster_id = p.raster_id AND d."row" = p."row" + dy AND d.col = p.col + dx),
fil AS MATERIALIZED (SELECT raster_id, "row", col, id FROM lt ANTI JOIN outer_ USING (id)),
beside AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM fil a JOIN fil b ON b.raster_id = a.raster_id AND abs(b."row" - a."row") <= 1 AND abs(b.col - a.col) <= 1 AND a.id <> b.id),
cc(id, label) USING KEY (id) AS (SELECT id, id FROM fil UNION SELECT n.b, min(c.label) FROM cc c JOIN beside n ON n.a = c.id JOIN recurring.cc r ON r.id = n.b WHERE c.label < r.label GROUP BY n.b),
held AS MATERIALIZED (SELECT raster_id, label, "row", col FROM fil JOIN cc USING (id)),
quad AS (SELECT raster_id, label, y, x, count(*) AS n FROM (SELECT raster_id, label, "row" - a AS y, col - b AS x FROM held, range(2) i(a), range(2) j(b)) GROUP BY ALL),
inside AS (SELECT label, sum(CASE n WHEN 4 THEN 1.0 WHEN 3 THEN 0.5 ELSE 0 END)::DOUBLE AS area FROM quad GROUP BY label)"""


@query(f"""WITH RECURSIVE {LIGHT} SELECT raster_id, 1 AS band, {ID.replace('"row"', '(label // 64 % 64)').replace('col', '(label % 64)')} AS label, pixels, area FROM (SELECT raster_id, label, count(*) AS pixels FROM held GROUP BY ALL) JOIN inside USING (label) WHERE area >= 2""")
def c2_contours(spark, sf):
    return S.contours(X.pixels(spark, sf, (1,)), 2)


SIDE = "max(q.value) FILTER (dy = {0} AND dx = {1})"
AROUND = "struct_pack(" + ", ".join(f"n{i}{j} := {SIDE.format(i - 1, j - 1)}" for i in range(3) for j in range(3)) + ")"
CANNY = f"""{ONE}, gx AS MATERIALIZED ({neighbours("st", outer(DERIVATIVE[0], DERIVATIVE[1]))}), gy AS MATERIALIZED ({neighbours("st", outer(DERIVATIVE[1], DERIVATIVE[0]))}),
mag AS MATERIALIZED (SELECT gx.raster_id, gx.band, gx."row", gx.col, gx.value AS x, gy.value AS y, abs(gx.value) + abs(gy.value) AS value FROM gx JOIN gy USING (raster_id, band, "row", col)),
near9 AS MATERIALIZED ({neighbours("mag", [(i, j, 1.0) for i in (-1, 0, 1) for j in (-1, 0, 1)], "reflect101", AROUND)}),
pick AS (SELECT m.raster_id, m."row", m.col, m.value, CASE WHEN abs(y) <= {math.tan(math.pi / 8)!r} * abs(x) THEN [n.value.n10, n.value.n12] WHEN abs(x) < {math.tan(math.pi / 8)!r} * abs(y) THEN [n.value.n01, n.value.n21] WHEN x * y > 0 THEN [n.value.n00, n.value.n22] ELSE [n.value.n02, n.value.n20] END AS ab
 FROM mag m JOIN near9 n USING (raster_id, "row", col)),
kept AS MATERIALIZED (SELECT raster_id, "row", col, value > 150 AS strong FROM pick WHERE value > ab[1] AND value >= ab[2] AND value > 50),
on_(raster_id, "row", col) AS (SELECT raster_id, "row", col FROM kept WHERE strong UNION SELECT k.raster_id, k."row", k.col FROM on_ p JOIN kept k ON k.raster_id = p.raster_id AND abs(k."row" - p."row") <= 1 AND abs(k.col - p.col) <= 1)"""


@query(f'WITH RECURSIVE {CANNY} SELECT raster_id, 1 AS band, "row", col FROM on_')
def w11_edge_canny(spark, sf):
    return S.canny(X.pixels(spark, sf, (1,)))


@query()
def c3_watershed(spark, sf):
    p = checkpointed(X.pixels(spark, sf, (1,)))  # read by each of the steps
    return S.watershed(p, S.auto_markers(p), tile=32)


NAMED = f"""{PX}, l AS (SELECT raster_id, "row", col, CAST(b3 AS BIGINT) % 4 AS label FROM px), m AS (SELECT raster_id, "row", col FROM px WHERE b1 % 7 = 0),
b AS (SELECT a.*, (SELECT min(n.label) FROM l n WHERE n.raster_id = a.raster_id AND abs(n."row" - a."row") + abs(n.col - a.col) = 1 AND n.label > 0) AS least, m."row" IS NOT NULL AS marked FROM l a LEFT JOIN m USING (raster_id, "row", col)),
cut AS (SELECT raster_id, 1 AS band, "row", col, CASE WHEN "row" IN (0, 63) OR col IN (0, 63) OR (label > 0 AND least < label AND NOT marked) THEN -1 ELSE label END AS label FROM b)"""


def _cut(spark, sf):
    s = X.scenes(spark, sf)
    labels = s.select("raster_id", F.lit(1).alias("band"), "row", "col", (F.col("b3").cast("long") % 4).alias("label"))
    return S.with_boundaries(labels, s.where("b1 % 7 = 0").select("raster_id", F.lit(1).alias("band"), "row", "col", F.lit(1).alias("label")))


@query(f"WITH {NAMED} SELECT * FROM cut")
def c3_boundaries(spark, sf):
    return _cut(spark, sf)


@query(f"WITH {NAMED} SELECT raster_id, 1 AS band, CAST(max(label) AS BIGINT) AS segment_count FROM cut GROUP BY raster_id")
def c3_segment_count(spark, sf):
    return S.segment_count(_cut(spark, sf))


@query()
def c4_kmeans(spark, sf):
    labels, cost = S.kmeans(X.pixels(spark, sf), [1, 2, 3, 4], k=5)
    return labels.withColumn("compactness", F.lit(cost))


@query(f"WITH {PX} SELECT raster_id, count(*) AS pixels, count(*) AS settled FROM px GROUP BY raster_id")
def c4_kmeans_settled(spark, sf):
    """How many pixels of each raster are, but for the last step's movement, nearest to the mean of their own label."""
    bands = ["b1", "b2", "b3", "b4"]
    labels, _ = S.kmeans(X.pixels(spark, sf), [1, 2, 3, 4], k=5)
    v = labels.join(X.scenes(spark, sf).select("raster_id", "row", "col", *bands), ["raster_id", "row", "col"])
    means = v.groupBy("label").agg(*[F.avg(b).alias(b) for b in bands]).collect()  # a row for each label
    apart = {m["label"]: F.sqrt(sum(((F.col(b) - m[b]) ** 2 for b in bands), F.lit(0.0))) for m in means}
    own = F.coalesce(*[F.when(F.col("label") == k, d) for k, d in apart.items()])
    return v.groupBy("raster_id").agg(F.count("*").alias("pixels"), F.count_if(own - F.least(*apart.values()) < 0.05).alias("settled"))


EDGE = 'SELECT raster_id, "row", col FROM st JOIN o USING (raster_id, band) WHERE band = 1 AND value > threshold'


def _edges(spark, sf):
    from geoloom.operators.raster import KEY, otsu, stretched

    v = stretched(X.pixels(spark, sf, (1,)))
    return v.join(otsu(v), KEY).where("value > threshold").select("raster_id", "row", "col")


RHO = "CAST(floor(round(col * cos(radians(t)) + \"row\" * sin(radians(t)), 6) + 0.5) AS INTEGER)"


@query(f"WITH {OTSU}, e AS ({EDGE}) SELECT raster_id, {RHO} AS rho, CAST(t AS INTEGER) AS theta, count(*) AS votes FROM e, range(180) a(t) GROUP BY ALL")
def c5_hough_votes(spark, sf):
    return S.hough_votes(_edges(spark, sf))


@query(f"""WITH {OTSU}, e AS ({EDGE}), p AS (SELECT raster_id, {RHO} AS rho, CAST(t AS INTEGER) AS theta, "row" * cos(radians(t)) - col * sin(radians(t)) AS pos FROM e, range(180) a(t)),
l AS (SELECT raster_id, rho, theta FROM p GROUP BY ALL HAVING count(*) >= 45), g AS (SELECT *, CASE WHEN pos - lag(pos) OVER w > 3 OR lag(pos) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM p JOIN l USING (raster_id, rho, theta) WINDOW w AS (PARTITION BY raster_id, rho, theta ORDER BY pos)),
r AS (SELECT *, sum(new) OVER (PARTITION BY raster_id, rho, theta ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT raster_id, rho, theta, round(min(pos), 6) AS start, round(max(pos), 6) AS stop FROM r GROUP BY raster_id, rho, theta, run HAVING max(pos) - min(pos) >= 40""")
def c5_hough_lines(spark, sf):
    return rounded(S.hough_lines(_edges(spark, sf), 45, 40, 3), "start", "stop")


@query(f"""WITH {PX}, e AS (SELECT raster_id, "row", col, b1 - 128 AS gx, b3 - 64 AS gy FROM px WHERE b2 >= 5 AND (b1 <> 128 OR b3 <> 64))
SELECT raster_id, CAST(floor(round("row" + r * s * gy / sqrt(gx * gx + gy * gy), 6) + 0.5) AS INTEGER) AS "row", CAST(floor(round(col + r * s * gx / sqrt(gx * gx + gy * gy), 6) + 0.5) AS INTEGER) AS col, CAST(r AS INTEGER) AS radius, count(*) AS votes FROM e, range(3, 7) a(r), (VALUES (-1), (1)) b(s) GROUP BY ALL""")
def c6_hough_circle_votes(spark, sf):
    e = X.scenes(spark, sf).where("b2 >= 5").select("raster_id", "row", "col", (F.col("b1") - 128).alias("gx"), (F.col("b3") - 64).alias("gy"))
    return S.hough_circle_votes(e, 3, 6)


@query(f"""WITH {PX}, e AS (SELECT raster_id, "row", col, b1 - 128 AS gx, b3 - 64 AS gy FROM px WHERE b2 >= 5 AND (b1 <> 128 OR b3 <> 64)),
v AS (SELECT raster_id, CAST(floor(round("row" + r * s * gy / sqrt(gx * gx + gy * gy), 6) + 0.5) AS INTEGER) AS y, CAST(floor(round(col + r * s * gx / sqrt(gx * gx + gy * gy), 6) + 0.5) AS INTEGER) AS x, CAST(r AS INTEGER) AS radius, count(*) AS n FROM e, range(3, 7) a(r), (VALUES (-1), (1)) b(s) GROUP BY ALL),
c AS (SELECT raster_id, y, x, arg_max(radius, (n, -radius)) AS radius, CAST(sum(n) AS BIGINT) AS votes FROM v GROUP BY raster_id, y, x HAVING sum(n) >= 3),
l AS (SELECT raster_id, list([struct_pack(y := y, x := x, r := radius, v := votes)] ORDER BY votes DESC, y, x) AS every FROM c GROUP BY raster_id),
g AS (SELECT raster_id, unnest(list_reduce(every, lambda a, b: CASE WHEN len(list_filter(a, lambda k: (k.y - b[1].y) ^ 2 + (k.x - b[1].x) ^ 2 < 64)) = 0 THEN a || b ELSE a END)) AS k FROM l)
SELECT raster_id, k.y AS "row", k.x AS col, k.r AS radius, k.v AS votes FROM g""")
def c6_hough_circles(spark, sf):
    e = X.scenes(spark, sf).where("b2 >= 5").select("raster_id", "row", "col", (F.col("b1") - 128).alias("gx"), (F.col("b3") - 64).alias("gy"))
    return S.hough_circles(e, 3, 6, threshold=3, min_distance=8)
