"""Feature and pixel tables derived from the star-schema tables, for the registered queries.

Rasters are 64 x 64: one for every 25 suppliers, so their number grows with the
data.  Everything is integer arithmetic, so other engines get the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(raster_id)`` of all rasters."""
    return table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_suppkey") / 25).cast("long").alias("raster_id")).distinct()


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(raster_id, row, col, hi, lo, b1, b2, b3, b4)``, a row for every pixel; hi = 0 is NoData."""
    li = table(spark, sf_dir, "lineitem")
    n, q = F.sum("l_linenumber"), F.sum(F.floor("l_quantity"))
    cells = li.groupBy(F.floor(F.col("l_suppkey") / 25).cast("long").alias("raster_id"), (F.col("l_orderkey") % SIDE).cast("int").alias("row"), (F.col("l_partkey") % SIDE).cast("int").alias("col"))
    got = cells.agg((n % 4).alias("hi"), (1 + q % 3).alias("lo"), (q % 256).alias("b1"), F.count("*").alias("b2"), (n % 256).alias("b3"), ((7 * n + 13 * F.count("*")) % 256).alias("b4"))
    side = F.sequence(F.lit(0), F.lit(SIDE - 1))
    grid = raster_ids(spark, sf_dir).select("raster_id", F.explode(side).alias("row")).select("*", F.explode(side).alias("col"))
    # rows that explode() makes are in no size estimate, so a broadcast would be chosen by a size that is not theirs
    return grid.hint("merge").join(got, ["raster_id", "row", "col"], "left").select("raster_id", "row", "col", *[F.coalesce(c, F.lit(1 if c == "lo" else 0)).cast("double").alias(c) for c in ("hi", "lo", "b1", "b2", "b3", "b4")])


def pixels(spark: SparkSession, sf_dir: str, bands: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """``(raster_id, band, row, col, value)`` of the bands of :func:`scenes`."""
    return scenes(spark, sf_dir).select("raster_id", "row", "col", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"b{b}").alias("value")) for b in bands])).alias("p")).select("raster_id", "p.band", "row", "col", "p.value")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(fid, fname, xmin, ymin, xmax, ymax)``: rectangles of nations on a 5 x 5 grid."""
    k = F.col("n_nationkey")
    x, y = (k % 5 * 13).cast("double"), (F.floor(k / 5) * 13).cast("double")
    return table(spark, sf_dir, "nation").select(k.cast("long").alias("fid"), F.col("n_name").alias("fname"), x.alias("xmin"), y.alias("ymin"), (x + 11.25).alias("xmax"), (y + 11.25).alias("ymax"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pid, x, y)`` of customers."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("pid"), (k * 7919 % 6400 / 100).alias("x"), (k * 104729 % 6400 / 100).alias("y"))


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(oid, kind, xmin, ymin, xmax, ymax)`` of parts."""
    k = F.col("p_partkey")
    x, y = k * 131 % 6000 / 100, k * 977 % 6000 / 100
    return table(spark, sf_dir, "part").select(k.alias("oid"), F.col("p_brand").alias("kind"), x.alias("xmin"), y.alias("ymin"), (x + 1 + k % 7 / 2).alias("xmax"), (y + 1 + k % 5 / 2).alias("ymax"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(lid, x0, y0, x1, y1)`` of orders."""
    k = F.col("o_orderkey")
    x, y = k * 31 % 6400 / 100, k * 57 % 6400 / 100
    return table(spark, sf_dir, "orders").select(k.alias("lid"), x.alias("x0"), y.alias("y0"), (x + (k * 17 % 500 - 250) / 100).alias("x1"), (y + (k * 23 % 500 - 250) / 100).alias("y1"))


#: The same tables as DuckDB common table expressions.
PX = """cells AS MATERIALIZED (SELECT l_suppkey // 25 AS raster_id, l_orderkey % 64 AS r, l_partkey % 64 AS c, sum(l_linenumber) AS n, sum(CAST(floor(l_quantity) AS BIGINT)) AS q, count(*) AS k FROM lineitem GROUP BY ALL),
px AS MATERIALIZED (SELECT g.raster_id, CAST(g.r AS INTEGER) AS "row", CAST(g.c AS INTEGER) AS col, CAST(coalesce(n % 4, 0) AS DOUBLE) AS hi, CAST(coalesce(1 + q % 3, 1) AS DOUBLE) AS lo,
 CAST(coalesce(q % 256, 0) AS DOUBLE) AS b1, CAST(coalesce(k, 0) AS DOUBLE) AS b2, CAST(coalesce(n % 256, 0) AS DOUBLE) AS b3, CAST(coalesce((7 * n + 13 * k) % 256, 0) AS DOUBLE) AS b4
 FROM (SELECT raster_id, r, c FROM (SELECT DISTINCT raster_id FROM cells), range(64) t(r), range(64) u(c)) g LEFT JOIN cells USING (raster_id, r, c))"""
PIX = PX + """,
pix AS (SELECT raster_id, 1 AS band, "row", col, b1 AS value FROM px UNION ALL SELECT raster_id, 2, "row", col, b2 FROM px UNION ALL SELECT raster_id, 3, "row", col, b3 FROM px UNION ALL SELECT raster_id, 4, "row", col, b4 FROM px)"""
ZONES = """zones AS (SELECT CAST(n_nationkey AS BIGINT) AS fid, n_name AS fname, CAST(n_nationkey % 5 * 13 AS DOUBLE) AS xmin, CAST(n_nationkey // 5 * 13 AS DOUBLE) AS ymin, n_nationkey % 5 * 13 + 11.25::DOUBLE AS xmax, n_nationkey // 5 * 13 + 11.25::DOUBLE AS ymax FROM nation)"""
POINTS = """points AS (SELECT c_custkey AS pid, (c_custkey * 7919 % 6400)::DOUBLE / 100 AS x, (c_custkey * 104729 % 6400)::DOUBLE / 100 AS y FROM customer)"""
RECTS = """rects AS (SELECT oid, kind, xmin, ymin, xmin + 1 + (oid % 7)::DOUBLE / 2 AS xmax, ymin + 1 + (oid % 5)::DOUBLE / 2 AS ymax FROM (SELECT p_partkey AS oid, p_brand AS kind, (p_partkey * 131 % 6000)::DOUBLE / 100 AS xmin, (p_partkey * 977 % 6000)::DOUBLE / 100 AS ymin FROM part))"""
LINES = """lines AS (SELECT lid, x0, y0, x0 + (lid * 17 % 500 - 250)::DOUBLE / 100 AS x1, y0 + (lid * 23 % 500 - 250)::DOUBLE / 100 AS y1 FROM (SELECT o_orderkey AS lid, (o_orderkey * 31 % 6400)::DOUBLE / 100 AS x0, (o_orderkey * 57 % 6400)::DOUBLE / 100 AS y0 FROM orders))"""
