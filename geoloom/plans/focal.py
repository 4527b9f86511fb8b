"""Queries of the neighbourhood operators."""

from __future__ import annotations

import numpy as np

from geoloom.operators import focal as A
from geoloom.plans.base import group, rounded
from geoloom.plans.raster import ENDS
from geoloom.sources import fixtures as X


QUERIES, ORACLES, query = group()
ONE = ENDS.replace('FROM pix JOIN ends', 'FROM (SELECT * FROM pix WHERE band = 1) JOIN ends')


def place(at: str, border: str) -> str:
    """A coordinate brought back into 0..63."""
    return f"CASE WHEN {at} < 0 THEN -({at}) WHEN {at} > 63 THEN 126 - ({at}) ELSE {at} END" if border == "reflect101" else f"least(greatest({at}, 0), 63)"


def neighbours(source: str, offsets: list[tuple], border: str = "reflect101", agg: str = "sum(w * q.value)") -> str:
    """SQL for an aggregate over weighted neighbours; border 'none' leaves out places beyond the raster."""
    values = ", ".join(f"({dy}, {dx}, {w!r}::DOUBLE)" for dy, dx, w in offsets)
    y, x = (('(p."row" + dy)', '(p.col + dx)') if border == "none" else (place('(p."row" + dy)', border), place("(p.col + dx)", border)))
    sent = f'SELECT raster_id * 4096 + p."row" * 64 + p.col AS id, raster_id * 4096 + {y} * 64 + {x} AS near, p.value, dy, dx, w FROM {source} p CROSS JOIN (VALUES {values}) k(dy, dx, w)'
    if border == "none":
        sent += f' WHERE {y} BETWEEN 0 AND 63 AND {x} BETWEEN 0 AND 63'
    sums = f'SELECT p.id, any_value(p.value) AS own, {agg} AS value FROM ({sent}) p JOIN (SELECT raster_id * 4096 + "row" * 64 + col AS id, value FROM {source}) q ON q.id = p.near GROUP BY p.id'
    return f'SELECT id // 4096 AS raster_id, 1 AS band, CAST(id // 64 % 64 AS INTEGER) AS "row", CAST(id % 64 AS INTEGER) AS col, own, value FROM ({sums})'


def outer(down, across) -> list[tuple]:
    """Offsets and weights of a separable kernel."""
    n, m = len(down) // 2, len(across) // 2
    return [(i - n, j - m, float(a * b)) for i, a in enumerate(down) for j, b in enumerate(across) if a * b]


def select(inner: str, value: str = "round(value, 6)") -> str:
    return f'SELECT raster_id, band, "row", col, {value} AS value FROM ({inner})'


def band(spark, sf):
    return X.pixels(spark, sf, (1,))


BASE = ENDS.split(",\nends AS")[0] + ", p1 AS (SELECT * FROM pix WHERE band = 1)"
G = A.gaussian_weights(5, 1.5)
SQUARE = outer([1.0] * 5, [1.0] * 5)


@query(f"WITH {BASE} " + select(neighbours("p1", outer(G, G))))
def w1_filter_gaussian(spark, sf):
    return rounded(A.filtered(band(spark, sf), "gaussian", 5, 1.5), "value")


@query(f"WITH {ONE} " + select(neighbours("st", SQUARE, "replicate", "median(q.value)"), "round(value / 255, 6)"))
def w2_filter_median(spark, sf):
    return rounded(A.filtered(band(spark, sf), "median", 5), "value")


DISC = [(y, x, 1.0) for y in range(-2, 3) for x in range(-2, 3) if y * y + x * x <= 4]
BILATERAL = "sum(exp(-(dy * dy + dx * dx) / 11250.0 - (q.value - p.value) ^ 2 / 11250.0) * q.value) / sum(exp(-(dy * dy + dx * dx) / 11250.0 - (q.value - p.value) ^ 2 / 11250.0))"


@query(f"WITH {ONE} " + select(neighbours("st", DISC, "reflect101", BILATERAL), "round(round_even(value, 0) / 255, 6)"))
def w3_filter_bilateral(spark, sf):
    return rounded(A.filtered(band(spark, sf), "bilateral", 5), "value")


def _morph(name: str, method: str, first: str, second: str | None) -> None:
    inner = neighbours("st", SQUARE, "none", f"{first}(q.value)")
    sql = f"WITH {ONE}, m1 AS ({inner}) "
    sql += select(neighbours("m1", SQUARE, "none", f"{second}(q.value)") if second else "SELECT * FROM m1", "round(value / 255, 6)")
    QUERIES[name], ORACLES[name] = (lambda spark, sf: rounded(A.filtered(band(spark, sf), method, 5), "value")), sql


_morph("w4_morph_erode", "morph_erode", "min", None)
_morph("w5_morph_dilate", "morph_dilate", "max", None)
_morph("w6_morph_open", "morph_open", "min", "max")
_morph("w7_morph_close", "morph_close", "max", "min")
CUT = "round(least(abs(value), 255.0) / 255, 6)"


@query(f"WITH {ONE} " + select(neighbours("st", outer(A.DERIVATIVE[1], A.DERIVATIVE[1])), CUT))
def w8_edge_sobel(spark, sf):
    return rounded(A.edges(band(spark, sf), "sobel"), "value")


@query(f"WITH {ONE} " + select(neighbours("st", [(-1, -1, 2.0), (-1, 1, 2.0), (1, -1, 2.0), (1, 1, 2.0), (0, 0, -8.0)]), CUT))
def w9_edge_laplacian(spark, sf):
    return rounded(A.edges(band(spark, sf), "laplacian"), "value")


@query(f"WITH {ONE} " + select(neighbours("st", outer(A.SCHARR[0], A.SCHARR[1])), CUT))
def w10_edge_scharr(spark, sf):
    return rounded(A.edges(band(spark, sf), "scharr"), "value")


def _adaptive(name: str, method: str, w) -> None:
    sql = f"WITH {ONE} " + select(neighbours("st", outer(w, w), "replicate"), "CASE WHEN own > round_even(round(value, 9), 0) - 2 THEN 255.0::DOUBLE ELSE 0 END")
    QUERIES[name], ORACLES[name] = (lambda spark, sf: A.adaptive_threshold(band(spark, sf), method)), sql


_adaptive("p9_threshold_adaptive_mean", "mean", np.full(11, 1 / 11))
_adaptive("p10_threshold_adaptive_gaussian", "gaussian", A.gaussian_weights(11, 0))


def _response(value: str) -> str:
    return f"""WITH {ONE}, gx AS ({neighbours("st", outer(A.DERIVATIVE[0], A.DERIVATIVE[1]))}), gy AS ({neighbours("st", outer(A.DERIVATIVE[1], A.DERIVATIVE[0]))}),
g AS (SELECT gx.raster_id, gx.band, gx."row", gx.col, gx.value / 2040 AS gx, gy.value / 2040 AS gy FROM gx JOIN gy USING (raster_id, band, "row", col)),
s AS (SELECT p.raster_id, p.band, p."row", p.col, sum(q.gx * q.gx) AS xx, sum(q.gx * q.gy) AS xy, sum(q.gy * q.gy) AS yy FROM g p CROSS JOIN (VALUES (-1, -1), (-1, 0), (0, -1), (0, 0)) k(dy, dx)
 JOIN g q ON q.raster_id = p.raster_id AND q."row" = p."row" + dy AND q.col = p.col + dx WHERE p."row" > 0 AND p.col > 0 GROUP BY ALL)
SELECT raster_id, band, "row", col, round({value}, 6) AS value FROM s"""


@query(_response("xx * yy - xy * xy - 0.04 * (xx + yy) ^ 2"))
def w13_corner_harris(spark, sf):
    return rounded(A.corner_response(band(spark, sf), "harris").where("row > 0 and col > 0"), "value")


@query(_response("(xx + yy) / 2 - sqrt(((xx - yy) / 2) ^ 2 + xy ^ 2)"))
def w13_corner_shi_tomasi(spark, sf):
    return rounded(A.corner_response(band(spark, sf), "shi_tomasi").where("row > 0 and col > 0"), "value")


TEMPLATE = np.array([[0, 40, 0], [80, 200, 120], [0, 160, 0]])
T8 = np.rint(TEMPLATE * 255 / 200)
FITS = 'SELECT * FROM ({}) WHERE "row" <= 61 AND col <= 61'
CELLS = [(i, j, float(T8[i, j])) for i in range(3) for j in range(3)]


def _template(name: str, method: str, value: str) -> None:
    inner = FITS.format(neighbours("st", CELLS, "none", value))
    QUERIES[name], ORACLES[name] = (lambda spark, sf: rounded(A.template_scores(band(spark, sf), TEMPLATE, method), "value", digits=4)), f"WITH {ONE} " + select(inner, "round(value, 4)")


SS, TT = "sum(q.value ^ 2)", f"{float((T8**2).sum())!r}"
CS, CT = "greatest(sum(q.value ^ 2) - sum(q.value) ^ 2 / 9, 0)", f"{float(((T8 - T8.mean()) ** 2).sum())!r}"
_template("w12_template_sqdiff", "sqdiff", f"{SS} - 2 * sum(w * q.value) + {TT}")
_template("w12_template_sqdiff_normed", "sqdiff_normed", f"CASE WHEN sqrt({SS} * {TT}) > 1e-9 THEN ({SS} - 2 * sum(w * q.value) + {TT}) / sqrt({SS} * {TT}) ELSE 1 END")
_template("w12_template_ccorr", "ccorr", "sum(w * q.value)")
_template("w12_template_ccorr_normed", "ccorr_normed", f"CASE WHEN sqrt({SS} * {TT}) > 1e-9 THEN sum(w * q.value) / sqrt({SS} * {TT}) ELSE 0 END")
_template("w12_template_ccoeff", "ccoeff", f"sum(w * q.value) - sum(q.value) * {float(T8.sum())!r} / 9")
_template("w12_template_ccoeff_normed", "ccoeff_normed", f"CASE WHEN sqrt({CS} * {CT}) > 1e-9 THEN (sum(w * q.value) - sum(q.value) * {float(T8.sum())!r} / 9) / sqrt({CS} * {CT}) ELSE 0 END")


@query(f"WITH {ONE}, m AS ({FITS.format(neighbours('st', CELLS, 'none', SS + ' - 2 * sum(w * q.value) + ' + TT))}) SELECT raster_id, \"row\", col, value FROM (SELECT *, row_number() OVER (PARTITION BY raster_id ORDER BY value, \"row\", col) AS n FROM m) WHERE n = 1")
def w12_template_best(spark, sf):
    return A.best_match(A.template_scores(band(spark, sf), TEMPLATE, "sqdiff"), "sqdiff")


