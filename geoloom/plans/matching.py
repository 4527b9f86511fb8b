"""Queries of image matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import matching as K
from geoloom.operators.graph import checkpointed
from geoloom.operators.focal import DERIVATIVE
from geoloom.plans.base import group, rounded
from geoloom.plans.focal import ONE, neighbours, outer
from geoloom.sources import fixtures as X
from geoloom.sources.fixtures import PX

QUERIES, ORACLES, query = group()


def _vectors(spark, sf):
    """(queries, all rows): a query is left out of its own neighbours only by ``skip_own``."""
    v = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return v.where("id % 100 = 0"), v


NEAREST = """d AS (SELECT a.vec_id AS query_id, b.vec_id AS train_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ^ 2)) AS d2 FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d2, train_id) AS INTEGER) AS rank FROM d)"""


@query(f"WITH {NEAREST} SELECT query_id, train_id, round(sqrt(d2), 5) AS distance, rank FROM n WHERE rank <= 2")
def k2_two_nearest(spark, sf):
    return rounded(K.two_nearest(*_vectors(spark, sf), skip_own=True), "distance", digits=5)


@query(f"WITH {NEAREST}, p AS (SELECT query_id, min(d2) FILTER (rank = 1) AS a, min(d2) FILTER (rank = 2) AS b, min(train_id) FILTER (rank = 1) AS t FROM n WHERE rank <= 2 GROUP BY ALL) SELECT query_id AS idx1, t AS idx2, round(sqrt(a), 5) AS distance FROM p WHERE sqrt(a) < 0.95 * sqrt(b)")
def k2_match(spark, sf):
    return rounded(K.ratio_matches(K.two_nearest(*_vectors(spark, sf), skip_own=True), 0.95), "distance", digits=5)


@query(f"WITH {NEAREST}, p AS (SELECT query_id, min(d2) FILTER (rank = 1) AS a, min(d2) FILTER (rank = 2) AS b, min(train_id) FILTER (rank = 1) AS t FROM n WHERE rank <= 2 GROUP BY ALL) SELECT query_id AS idx1, t AS idx2, round(sqrt(a), 5) AS distance FROM p WHERE sqrt(a) < 0.95 * sqrt(b)")
def k2_match_lsh(spark, sf):
    """By an inverted file, whose answers are exact."""
    return rounded(K.ratio_matches(K.pruned_nearest(*_vectors(spark, sf), skip_own=True), 0.95), "distance", digits=5)


@query(f"WITH {NEAREST} SELECT query_id, train_id, round(sqrt(d2), 5) AS distance, rank FROM n WHERE rank <= 2")
def k2_pruned_nearest(spark, sf):
    return rounded(K.pruned_nearest(*_vectors(spark, sf), skip_own=True), "distance", digits=5)


def _band(spark, sf):
    return X.pixels(spark, sf, (1,))


# Corner response on the whole raster: beyond its edge gradients are mirrored, and those across the edge change sign.
PRODUCTS = f"""{ONE}, gx AS MATERIALIZED ({neighbours("st", outer(DERIVATIVE[0], DERIVATIVE[1]))}), gy AS MATERIALIZED ({neighbours("st", outer(DERIVATIVE[1], DERIVATIVE[0]))}),
g AS MATERIALIZED (SELECT gx.raster_id, gx."row", gx.col, gx.value / 2040 AS x, gy.value / 2040 AS y FROM gx JOIN gy USING (raster_id, band, "row", col)),
sums AS MATERIALIZED (SELECT p.raster_id, p."row", p.col, sum(q.x * q.x) AS xx, sum(q.x * q.y * CASE WHEN p."row" + dy < 0 THEN -1 ELSE 1 END * CASE WHEN p.col + dx < 0 THEN -1 ELSE 1 END) AS xy, sum(q.y * q.y) AS yy
 FROM g p CROSS JOIN (VALUES (-1, -1), (-1, 0), (0, -1), (0, 0)) k(dy, dx) JOIN g q ON q.raster_id = p.raster_id AND q."row" = abs(p."row" + dy) AND q.col = abs(p.col + dx) GROUP BY ALL)"""


def _corners(response: str, apart: str) -> str:
    """SQL of corners: peaks of the response, then a greedy pass in its order."""
    return f"""WITH {PRODUCTS}, resp AS MATERIALIZED (SELECT raster_id, "row", col, round({response}, 10) AS v FROM sums),
peak AS (SELECT a.raster_id, a."row", a.col, any_value(a.v) AS v FROM resp a JOIN resp b ON b.raster_id = a.raster_id AND abs(b."row" - a."row") <= 1 AND abs(b.col - a.col) <= 1 GROUP BY a.raster_id, a."row", a.col HAVING any_value(a.v) >= max(b.v)),
cand AS (SELECT * FROM peak JOIN (SELECT raster_id, max(v) * 0.01 AS least_ FROM resp GROUP BY raster_id) USING (raster_id) WHERE v > least_ AND "row" BETWEEN 1 AND 62 AND col BETWEEN 1 AND 62),
{greedy('cand', 'v', apart)} SELECT raster_id, k.y AS "row", k.x AS col, round(k.v, 10) AS response FROM kept"""


def greedy(source: str, value: str, apart: str) -> str:
    """SQL of the points that a pass in order of ``value`` keeps: none for which ``apart`` fails with a kept one."""
    return f"""l AS (SELECT raster_id, list([struct_pack(y := "row", x := col, v := {value})] ORDER BY {value} DESC, "row", col) AS every FROM {source} GROUP BY raster_id),
kept AS (SELECT raster_id, unnest(list_reduce(every, lambda a, b: CASE WHEN len(list_filter(a, lambda k: {apart})) = 0 THEN a || b ELSE a END)) AS k FROM l)"""


@query(_corners("xx * yy - xy * xy - 0.04 * (xx + yy) ^ 2", "abs(k.y - b[1].y) < 5 AND abs(k.x - b[1].x) < 5"))
def k3_corners_harris(spark, sf):
    return rounded(K.corners(_band(spark, sf), "harris", 5000, 0.01, 5), "response", digits=10)


@query(_corners("(xx + yy) / 2 - sqrt(((xx - yy) / 2) ^ 2 + xy ^ 2)", "(k.y - b[1].y) ^ 2 + (k.x - b[1].x) ^ 2 < 25"))
def k3_corners_shi_tomasi(spark, sf):
    return rounded(K.corners(_band(spark, sf), "shi_tomasi", 5000, 0.01, 5), "response", digits=10)


@query(f'WITH {PX}, cand AS (SELECT * FROM px WHERE b1 > 180), {greedy("cand", "b1", "abs(k.y - b[1].y) < 4 AND abs(k.x - b[1].x) < 4")} SELECT raster_id, k.y AS "row", k.x AS col, k.v AS response FROM kept')
def k4_suppressed(spark, sf):
    """Candidates are the pixels of band 1 above 180."""
    return K.suppressed(X.scenes(spark, sf).where("b1 > 180").select("raster_id", "row", "col", F.col("b1").alias("response")), 4)


@query()
def k1_keypoints(spark, sf):
    return K.keypoints(_band(spark, sf))


def _strip(spark, sf):
    """All rasters side by side as one, kept as every step reads it, and its width."""
    s = checkpointed(_band(spark, sf))
    n = s.agg(F.max("raster_id")).first()[0] + 1
    return s.select(F.lit(0).cast("long").alias("raster_id"), "band", "row", (F.col("raster_id") * 64 + F.col("col")).cast("int").alias("col"), "value"), 64 * n


def _moved(one, dy: int, dx: int):
    return one.withColumns({"row": (F.col("row") + dy).cast("int"), "col": (F.col("col") + dx).cast("int")})


@query(f'WITH {PX} SELECT CAST(0 AS BIGINT) AS raster_id, 1 AS band, "row", CAST(raster_id * 64 + col AS INTEGER) AS col, b1 AS value, 2.0::DOUBLE AS dx, 3.0::DOUBLE AS dy FROM px')
def k5_register(spark, sf):
    one, width = _strip(spark, sf)
    out, m = K.register(one, _moved(one, 3, 2), 64, width, "translation", "nearest")
    return out.withColumns({"dx": F.lit(round(float(m[0, 2]), 3)), "dy": F.lit(round(float(m[1, 2]), 3))})


@query()
def k6_ecc_register(spark, sf):
    from geoloom.operators.focal import filtered

    one, width = _strip(spark, sf)
    one = filtered(one, "gaussian", 9, 3.0)
    out, m = K.ecc_register(one, _moved(one, 1, 1), 64, width, "translation")
    return out.withColumns({"dx": F.lit(round(float(m[0, 2]), 2)), "dy": F.lit(round(float(m[1, 2]), 2))})


@query(f'WITH {PX} SELECT 1 AS band, "row", CAST(raster_id * 64 + col AS INTEGER) AS col, b1 AS value FROM px')
def k7_stitch(spark, sf):
    one, _ = _strip(spark, sf)
    return K.stitch([one, _moved(one, 3, 2)])


@query(f'WITH {PX} SELECT 1 AS band, "row", CAST(raster_id * 64 + col AS INTEGER) AS col, b1 AS value FROM px')
def k7_stitch_any_order(spark, sf):
    """Three images of the strip whose places are counted from different corners, matched pair by pair."""
    one, _ = _strip(spark, sf)
    return K.stitch([_moved(one, 6, 5), _moved(one, 3, 2), one], stitch_confidence=0.3)
