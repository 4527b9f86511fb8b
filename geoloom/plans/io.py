"""Queries that write a table in a format and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.operators import raster as R
from geoloom.operators import vector as V
from geoloom.plans.base import group, rounded
from geoloom.plans.vector import ORACLES as VECTOR_SQL
from geoloom.plans.vector import CELLS, GT, a8_feature_stats
from geoloom.sources import fixtures as X
from geoloom.sources import io
from geoloom.sources.fixtures import PIX, RECTS, ZONES

QUERIES, ORACLES, query = group()
SCHEMA = "oid long, kind string"
BACK = f"WITH {RECTS} SELECT oid, kind, round(xmin, 6) AS xmin, round(ymax, 6) AS ymax, round((xmax - xmin) * (ymax - ymin), 6) AS area FROM rects"


def _back(spark, sf, fmt: str):
    """Features written as Parquet, converted to the format and read back."""
    stored, path = io.scratch(spark, "features"), io.scratch(spark, "features")
    io.write_features(V.rectangles(X.rects(spark, sf)), stored)
    if fmt == "parquet":
        path = stored
    else:
        io.convert(spark, stored, "parquet", path, fmt, SCHEMA)
    got = io.read_features(spark, path, fmt, SCHEMA)
    return rounded(got.select("oid", "kind", "xmin", "ymax", G.area(F.col("geom")).alias("area")), "xmin", "ymax", "area")


@query(BACK)
def s1_scan_parquet(spark, sf):
    return _back(spark, sf, "parquet")


@query(BACK)
def s7_convert_geojson(spark, sf):
    return _back(spark, sf, "GeoJSON")


@query(BACK)
def s7_convert_csv(spark, sf):
    return _back(spark, sf, "CSV")


@query(BACK)
def s7_convert_kml(spark, sf):
    return _back(spark, sf, "KML")


@query(f'WITH {PIX} SELECT raster_id, band, "row", col, value FROM pix')
def s5_pixel_sink(spark, sf):
    path = io.scratch(spark, "pixels")
    io.write_pixels(X.pixels(spark, sf), path)
    return spark.read.parquet(path).select(F.col("raster_id").cast("long").alias("raster_id"), "band", "row", "col", "value")


@query(VECTOR_SQL["a8_feature_stats"])
def s9_zonal_csv(spark, sf):
    path, records = io.scratch(spark, "zonal"), a8_feature_stats(spark, sf)
    io.write_records(records, path, "csv")
    return spark.read.option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "\u0000").schema(records.schema).csv(path)


@query(f"WITH {PIX} SELECT raster_id, band, count(*) AS n, min(value) AS min, max(value) AS max FROM pix GROUP BY ALL")
def s11_json_sink(spark, sf):
    path, records = io.scratch(spark, "stats"), R.band_stats(X.pixels(spark, sf)).select("raster_id", "band", "n", "min", "max")
    io.write_records(records, path, "json")
    return spark.read.schema(records.schema).json(path)


@query(f'WITH {PIX}, {ZONES}, {CELLS}, t AS (SELECT DISTINCT "row" // 8 AS ty, col // 8 AS tx FROM zc WHERE ("row" + col) % 64 < 9) SELECT raster_id, band, count(*) AS n, sum(value) AS total FROM pix JOIN t ON ty = "row" // 8 AND tx = col // 8 GROUP BY ALL')
def s5_tile_store(spark, sf):
    """Bands stored by tiles; only those are read that hold a zone's cell near one of two diagonals."""
    path = io.scratch(spark, "tiles")
    io.write_tiles(X.pixels(spark, sf), path, 8)
    cells = V.rasterize(V.rectangles(X.zones(spark, sf)), GT).where("(row + col) % 64 < 9")
    return io.read_tiles(spark, path, cells.select("row", "col"), 8).groupBy("raster_id", "band").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
