"""Queries of the per-pixel operators and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import raster as R
from geoloom.plans.base import group, rounded
from geoloom.sources import fixtures as X
from geoloom.sources.fixtures import PIX, PX

QUERIES, ORACLES, query = group()


ENDS = PIX + """,
ends AS MATERIALIZED (SELECT raster_id, band, min(value) AS lo, max(value) AS hi FROM pix GROUP BY ALL),
st AS MATERIALIZED (SELECT raster_id, band, "row", col, CASE WHEN hi - lo < 1e-10 THEN 0.0 ELSE round_even((value - lo) * 255 / (hi - lo), 0) END AS value FROM pix JOIN ends USING (raster_id, band))"""
OTSU = ENDS + """,
h AS (SELECT raster_id, band, CAST(value AS INTEGER) AS t, count(*) AS n FROM st GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w AS w0, sum(n * t) OVER w AS s0, sum(n) OVER (PARTITION BY raster_id, band) AS wn, sum(n * t) OVER (PARTITION BY raster_id, band) AS sn FROM h WINDOW w AS (PARTITION BY raster_id, band ORDER BY t)),
v AS (SELECT *, round(coalesce(w0 * (wn - w0) * (s0 / w0 - (sn - s0) / nullif(wn - w0, 0)) ^ 2, 0), 3) AS var FROM c),
o AS (SELECT raster_id, band, arg_max(t, (var, -t)) AS threshold FROM (SELECT raster_id, band, t, var FROM v) GROUP BY ALL)"""


@query(f"WITH {PIX} SELECT raster_id, band, count(nullif(value, 0)) AS n, min(nullif(value, 0)) AS min, max(nullif(value, 0)) AS max, round(avg(nullif(value, 0)), 6) AS mean, round(stddev_pop(nullif(value, 0)), 6) AS stddev FROM pix GROUP BY ALL")
def a2_stats(spark, sf):
    return rounded(R.band_stats(X.pixels(spark, sf), nodata=0), "mean", "stddev")


@query(f"WITH {PIX}, e AS (SELECT raster_id, band, min(value) AS lo, max(value) AS hi FROM pix GROUP BY ALL), g AS (SELECT raster_id, band, least(CAST(floor((value - lo) / ((hi - lo) / 16)) AS INTEGER), 15) AS bin, count(*) AS n FROM pix JOIN e USING (raster_id, band) WHERE hi > lo GROUP BY ALL) SELECT e.raster_id, e.band, CAST(b AS INTEGER) AS bin, round(lo + (b + 0.5) * ((hi - lo) / 16), 6) AS center, coalesce(n, 0) AS count FROM e CROSS JOIN range(16) t(b) LEFT JOIN g ON g.raster_id = e.raster_id AND g.band = e.band AND g.bin = b WHERE hi > lo")
def a3_histogram(spark, sf):
    return rounded(R.histogram(X.pixels(spark, sf), bins=16), "center")


@query("WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), g AS (SELECT least(CAST(floor((value - lo) / ((hi - lo) / 32)) AS INTEGER), 31) AS bin, count(*) AS n FROM events, e WHERE value IS NOT NULL GROUP BY ALL) SELECT CAST(0 AS BIGINT) AS raster_id, 1 AS band, CAST(b AS INTEGER) AS bin, round(lo + (b + 0.5) * ((hi - lo) / 32), 6) AS center, coalesce(n, 0) AS count FROM e CROSS JOIN range(32) t(b) LEFT JOIN g ON g.bin = b")
def a3_events_histogram(spark, sf):
    v = X.table(spark, sf, "events").select(F.lit(0).cast("long").alias("raster_id"), F.lit(1).alias("band"), "value")
    return rounded(R.histogram(v, bins=32), "center")


@query(f"WITH {PIX}, e AS (SELECT raster_id, band, min(value) AS a, CASE WHEN max(value) > min(value) THEN max(value) ELSE min(value) + 1 END AS z FROM pix GROUP BY ALL), g AS (SELECT raster_id, band, least(CAST(floor((value - a) / ((z - a) / 10)) AS INTEGER), 9) AS bin, count(*) AS n FROM pix JOIN e USING (raster_id, band) GROUP BY ALL) SELECT e.raster_id, e.band, CAST(b AS INTEGER) AS bin, round(a + b * ((z - a) / 10), 6) AS lo, round(a + (b + 1) * ((z - a) / 10), 6) AS hi, coalesce(n, 0) AS count FROM e CROSS JOIN range(10) t(b) LEFT JOIN g ON g.raster_id = e.raster_id AND g.band = e.band AND g.bin = b")
def a4_histogram_edges(spark, sf):
    return rounded(R.histogram_edges(X.pixels(spark, sf), bins=10), "lo", "hi")


@query(f"""WITH {PIX} SELECT raster_id, band, max(col) + 1 AS width, max("row") + 1 AS height, 0.0::DOUBLE AS xmin, 64.0::DOUBLE - (max("row") + 1) AS ymin, (max(col) + 1)::DOUBLE AS xmax, 64.0::DOUBLE AS ymax, CASE WHEN band = 2 THEN 'UInt16' ELSE 'double' END AS dtype, CASE band WHEN 1 THEN 'Red' ELSE 'Undefined' END AS color, 2 AS overviews, 0.0::DOUBLE AS nodata, 1.0::DOUBLE AS value_scale, 0.0::DOUBLE AS value_offset, 3857 AS srid, count(nullif(value, 0)) AS n, min(nullif(value, 0)) AS min, max(nullif(value, 0)) AS max, round(avg(nullif(value, 0)), 6) AS mean, round(stddev_pop(nullif(value, 0)), 6) AS stddev FROM pix GROUP BY ALL""")
def a5_raster_info(spark, sf):
    p = X.pixels(spark, sf)
    smaller = p.where("row % 2 = 0 and col % 2 = 0").select("raster_id", "band", F.explode(F.array(F.lit(2), F.lit(4))).alias("level"))
    return rounded(R.raster_info(p, nodata=0, srid=3857, band_types={2: "UInt16"}, colors={1: "Red"}, overviews=smaller), "mean", "stddev")


@query(f'WITH {PX} SELECT raster_id, "row", col, round(CASE WHEN abs(b2 - 3) < 1e-15 THEN 0 ELSE (b1 + 2 * b4) / (b2 - 3) END - b3 * 0.5, 6) AS value FROM px')
def p1_band_math(spark, sf):
    return rounded(R.band_math(X.pixels(spark, sf), "(B1 + 2*B4) / (B2 - 3) - B3*0.5"), "value")


@query(f'WITH {PX} SELECT raster_id, "row", col, round((b4 - b3) / (b4 + b3 + 1e-10), 6) AS value FROM px')
def p2_ndvi(spark, sf):
    return rounded(R.ndvi(X.pixels(spark, sf)), "value")


@query(f'WITH {ENDS} SELECT raster_id, band, "row", col, value FROM st')
def p3_stretch(spark, sf):
    return R.stretched(X.pixels(spark, sf))


def _threshold(method: str, sql: str, name: str):
    def run(spark, sf):
        return R.threshold(X.pixels(spark, sf), method, threshold_value=100, max_value=200)

    QUERIES[name], ORACLES[name] = run, f'WITH {OTSU if method == "otsu" else ENDS} SELECT raster_id, band, "row", col, {sql} AS value FROM st' + (" JOIN o USING (raster_id, band)" if method == "otsu" else "")


_threshold("binary", "CASE WHEN value > 100 THEN 200.0::DOUBLE ELSE 0 END", "p4_threshold_binary")
_threshold("binary_inv", "CASE WHEN value > 100 THEN 0.0::DOUBLE ELSE 200 END", "p5_threshold_binary_inv")
_threshold("truncate", "least(value, 100.0::DOUBLE)", "p6_threshold_truncate")
_threshold("tozero", "CASE WHEN value > 100 THEN value ELSE 0.0::DOUBLE END", "p7_threshold_tozero")
_threshold("otsu", "CASE WHEN value > threshold THEN 200.0::DOUBLE ELSE 0 END", "p8_threshold_otsu")

UNIT = "CASE WHEN hi - lo < 1e-10 THEN 0.0 ELSE (value - lo) / (hi - lo) END"


@query(f'WITH {ENDS} SELECT raster_id, band, "row", col, round({UNIT}, 6) AS value FROM pix JOIN ends USING (raster_id, band)')
def p11_enhance_normalize(spark, sf):
    return rounded(R.enhance(X.pixels(spark, sf), "normalize"), "value")


@query(f'WITH {PIX}, l AS (SELECT raster_id, band, "row", col, ln(1 + greatest(value, 0)) AS value FROM pix), e AS (SELECT raster_id, band, min(value) AS lo, max(value) AS hi FROM l GROUP BY ALL) SELECT raster_id, band, "row", col, round({UNIT}, 6) AS value FROM l JOIN e USING (raster_id, band)')
def p12_enhance_log(spark, sf):
    return rounded(R.enhance(X.pixels(spark, sf), "log"), "value")


@query(f'WITH {ENDS} SELECT raster_id, band, "row", col, round(pow({UNIT}, 1 / 2.2::DOUBLE), 6) AS value FROM pix JOIN ends USING (raster_id, band)')
def p13_enhance_gamma(spark, sf):
    return rounded(R.enhance(X.pixels(spark, sf), "gamma", gamma=2.2), "value")


@query(f'WITH {ENDS}, h AS (SELECT raster_id, band, value, count(*) AS n FROM st GROUP BY ALL), l AS (SELECT *, sum(n) OVER (PARTITION BY raster_id, band ORDER BY value) AS cdf, sum(n) OVER (PARTITION BY raster_id, band) AS total, first_value(n) OVER (PARTITION BY raster_id, band ORDER BY value) AS base FROM h) SELECT raster_id, band, "row", col, round(CASE WHEN total = base THEN value ELSE round_even((cdf - base)::DOUBLE * 255 / (total - base)::DOUBLE, 0) END / 255, 6) AS value FROM st JOIN l USING (raster_id, band, value)')
def p14_enhance_equalize(spark, sf):
    return rounded(R.enhance(X.pixels(spark, sf), "equalize"), "value")


def _channel(c: int) -> str:
    a = R.COLORMAPS["hot"]
    at, k = f"(value * {len(a) - 1} / 255)", f"least(CAST(floor(value * {len(a) - 1} / 255) AS INTEGER), {len(a) - 2})"
    table = "[" + ",".join(f"{float(x[c])}::DOUBLE" for x in a) + "]"
    return f"CAST(round_even({table}[{k} + 1] + ({table}[{k} + 2] - {table}[{k} + 1]) * ({at} - {k}), 0) AS INTEGER)"


@query(f'WITH {ENDS} SELECT raster_id, band, "row", col, {_channel(0)} AS r, {_channel(1)} AS g, {_channel(2)} AS b FROM st SEMI JOIN (SELECT * FROM ends WHERE hi - lo >= 1e-10) USING (raster_id, band)')
def p16_colormap(spark, sf):
    return R.colormap(X.pixels(spark, sf), "hot")


def _pair(spark, sf):
    s = X.scenes(spark, sf)
    return s.select("raster_id", "row", "col", F.col("b1").alias("value")), s.select("raster_id", "row", "col", F.col("b3").alias("value"))


@query(f'WITH {PX} SELECT raster_id, "row", col, abs(b1 - b3) AS value FROM px')
def p17_change_differencing(spark, sf):
    return R.change(*_pair(spark, sf), "differencing")


@query(f'WITH {PX} SELECT raster_id, "row", col, round(abs(ln((b3 + 1e-10) / (b1 + 1e-10))), 6) AS value FROM px')
def p18_change_ratio(spark, sf):
    return rounded(R.change(*_pair(spark, sf), "ratio"), "value")


@query(f'WITH {PX} SELECT raster_id, "row", col, round(sqrt((b1 - (b1 + b3) / 2) ^ 2 + (b3 - (b1 + b3) / 2) ^ 2), 6) AS value FROM px')
def p19_change_pcd(spark, sf):
    return rounded(R.change(*_pair(spark, sf), "pcd"), "value")


@query(f'WITH {PX}, d AS (SELECT raster_id, abs(b1 - b3) AS v FROM px), t AS (SELECT raster_id, avg(v) + stddev_pop(v) AS threshold FROM d GROUP BY ALL) SELECT raster_id, round(threshold, 6) AS threshold, CAST(sum(CAST(v > threshold AS INTEGER)) AS BIGINT) AS changed, count(*) AS total, round(sum(CAST(v > threshold AS INTEGER)) / count(*), 6) AS ratio FROM d JOIN t USING (raster_id) GROUP BY raster_id, threshold')
def a6_a7_change_summary(spark, sf):
    return rounded(R.change_summary(R.change(*_pair(spark, sf))), "threshold", "ratio")


def _sharpen(spark, sf, method: str):
    pan = X.scenes(spark, sf).select("raster_id", "row", "col", F.col("b4").alias("value"))
    return rounded(R.pansharpen(X.pixels(spark, sf, (1, 2, 3)), pan, [1, 2, 3], method), "value")


def _bands(*values: str) -> str:
    return " UNION ALL ".join(f'SELECT raster_id, {k} AS band, "row", col, round({v}, 6) AS value FROM s' for k, v in enumerate(values, 1))


@query(f"WITH {PX}, s AS (SELECT *, (b1 + b2 + b3) / 3 + 1e-10 AS m FROM px) {_bands('b1 / m * b4', 'b2 / m * b4', 'b3 / m * b4')}")
def p20_pansharpen_brovey(spark, sf):
    return _sharpen(spark, sf, "brovey")


@query(f"WITH {PX}, s AS (SELECT * FROM px) {_bands('(b1 + b4) / 2', '(b2 + b4) / 2', '(b3 + b4) / 2')}")
def p21_pansharpen_mean(spark, sf):
    return _sharpen(spark, sf, "simple_mean")


@query(f"WITH {PX}, e AS (SELECT raster_id, min(b4) AS lo, max(b4) AS hi FROM px GROUP BY ALL), s AS (SELECT px.*, greatest(b1, b2, b3) AS v, CASE WHEN e.hi - e.lo < 1e-10 THEN 0 ELSE round_even((b4 - e.lo) * 255 / (e.hi - e.lo), 0) END AS pan FROM px JOIN e USING (raster_id)) " + _bands(*(f"CASE WHEN v > 0 THEN b{k} * (pan / v) ELSE pan END" for k in (1, 2, 3))))
def p22_pansharpen_ihs(spark, sf):
    return _sharpen(spark, sf, "ihs")


KERNEL = "CASE WHEN abs({0}) < 1 THEN 1.25 * abs({0}) ^ 3 - 2.25 * {0} ^ 2 + 1 WHEN abs({0}) < 2 THEN -0.75 * abs({0}) ^ 3 + 3.75 * {0} ^ 2 - 6 * abs({0}) + 3 ELSE 0 END"
SCALED = f"""ms AS MATERIALIZED (SELECT raster_id, "row" // 2 AS r, col // 2 AS c, b1, b2, b3 FROM px WHERE "row" % 2 = 0 AND col % 2 = 0),
way AS (SELECT t, least(31, greatest(0, floor((t + 0.5) / 2 - 0.5)::INTEGER + d)) AS k, sum({KERNEL.format('((t + 0.5) / 2 - 0.5 - floor((t + 0.5) / 2 - 0.5) - d)')}) AS w FROM range(64) i(t), range(-1, 3) j(d) GROUP BY t, k),
up AS (SELECT ms.raster_id, y.t AS "row", x.t AS col, sum(y.w * x.w * b1) AS b1, sum(y.w * x.w * b2) AS b2, sum(y.w * x.w * b3) AS b3 FROM ms JOIN way y ON y.k = r JOIN way x ON x.k = c GROUP BY ALL),
u AS (SELECT up.raster_id, CAST(up."row" AS INTEGER) AS "row", CAST(up.col AS INTEGER) AS col, up.b1, up.b2, up.b3, px.b4 FROM up JOIN px ON px.raster_id = up.raster_id AND px."row" = up."row" AND px.col = up.col)"""


def _sharpen_scaled(spark, sf, method: str):
    """Bands of half the size of the panchromatic pixels."""
    pan = X.scenes(spark, sf).select("raster_id", "row", "col", F.col("b4").alias("value"))
    half = X.pixels(spark, sf, (1, 2, 3)).where("row % 2 = 0 and col % 2 = 0").withColumns({c: F.floor(F.col(c) / 2).cast("int") for c in ("row", "col")})
    return rounded(R.pansharpen(half, pan, [1, 2, 3], method), "value", digits=5)


@query(f"WITH {PX}, {SCALED}, s AS (SELECT * FROM u) {_bands('(b1 + b4) / 2', '(b2 + b4) / 2', '(b3 + b4) / 2').replace(', 6)', ', 5)')}")
def p21_pansharpen_mean_two_grids(spark, sf):
    return _sharpen_scaled(spark, sf, "simple_mean")


@query(f"WITH {PX}, {SCALED}, e AS (SELECT raster_id, min(b4) AS lo, max(b4) AS hi FROM px GROUP BY ALL), s AS (SELECT u.*, greatest(b1, b2, b3) AS v, CASE WHEN e.hi - e.lo < 1e-10 THEN 0 ELSE round_even((b4 - e.lo) * 255 / (e.hi - e.lo), 0) END AS pan FROM u JOIN e USING (raster_id)) " + _bands(*(f"CASE WHEN v > 1e-9 THEN b{k} * (pan / v) ELSE pan END" for k in (1, 2, 3))).replace(', 6)', ', 5)'))
def p22_pansharpen_ihs_two_grids(spark, sf):
    return _sharpen_scaled(spark, sf, "ihs")


def _catalog(spark, sf):
    return X.pixels(spark, sf).groupBy("raster_id", "band").agg(F.count("*").alias("pixels")).select("raster_id", "band", "pixels", F.lit(4326).alias("srid"), F.lit(None).cast("double").alias("nodata"))


@query(f"WITH {PIX} SELECT raster_id, band, count(*) AS pixels, 4326 AS srid, CASE WHEN band = 2 THEN -9999.0::DOUBLE END AS nodata FROM pix GROUP BY ALL")
def p23_set_nodata(spark, sf):
    return R.set_nodata(_catalog(spark, sf), -9999, band=2)


@query(f"WITH {PIX} SELECT raster_id, band, count(*) AS pixels, 3857 AS srid, CAST(NULL AS DOUBLE) AS nodata FROM pix GROUP BY ALL")
def p24_assign_srs(spark, sf):
    return R.assign_srs(_catalog(spark, sf), 3857)


CLAHE = f"""{ENDS}, v AS (SELECT raster_id, "row", col, CAST(value AS INTEGER) AS lv FROM st WHERE band = 1),
h AS (SELECT raster_id, "row" // 8 AS ty, col // 8 AS tx, lv, count(*) AS n FROM v GROUP BY ALL),
x AS (SELECT raster_id, ty, tx, CAST(sum(n - least(n, 1)) AS BIGINT) AS excess FROM h GROUP BY ALL),
b AS (SELECT x.*, CAST(l AS INTEGER) AS lv, CASE WHEN n IS NULL THEN 0 ELSE least(n, 1) END + excess // 256 + CASE WHEN excess % 256 > 0 AND l % greatest(1, 256 // greatest(excess % 256, 1)) = 0 AND l // greatest(1, 256 // greatest(excess % 256, 1)) < excess % 256 THEN 1 ELSE 0 END AS n
 FROM x CROSS JOIN range(256) r(l) LEFT JOIN h ON h.raster_id = x.raster_id AND h.ty = x.ty AND h.tx = x.tx AND h.lv = l),
lut AS MATERIALIZED (SELECT raster_id, ty, tx, lv, least(255.0::DOUBLE, round_even(CAST(sum(n) OVER (PARTITION BY raster_id, ty, tx ORDER BY lv) AS DOUBLE) * 255 / 64, 0)) AS o FROM b),
q AS (SELECT raster_id, "row", col, lv, CAST(greatest(0, least(7, floor("row" / 8.0 - 0.5) + i)) AS BIGINT) AS ty, CAST(greatest(0, least(7, floor(col / 8.0 - 0.5) + j)) AS BIGINT) AS tx,
 CASE i WHEN 1 THEN "row" / 8.0::DOUBLE - 0.5 - floor("row" / 8.0 - 0.5) ELSE 1 - "row" / 8.0::DOUBLE + 0.5 + floor("row" / 8.0 - 0.5) END * CASE j WHEN 1 THEN col / 8.0::DOUBLE - 0.5 - floor(col / 8.0 - 0.5) ELSE 1 - col / 8.0::DOUBLE + 0.5 + floor(col / 8.0 - 0.5) END AS w
 FROM v, range(2) a(i), range(2) c(j))"""


@query(f'WITH {CLAHE} SELECT raster_id, 1 AS band, "row", col, round(round_even(round(CAST(sum(w * o) / sum(w) AS DOUBLE), 6), 0) / 255, 6) AS value FROM q JOIN lut USING (raster_id, ty, tx, lv) GROUP BY raster_id, "row", col')
def p15_enhance_clahe(spark, sf):
    return rounded(R.clahe(X.pixels(spark, sf, (1,))), "value")
