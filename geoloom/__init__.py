"""geoloom: raster and vector geoprocessing as Spark DataFrame operators."""
