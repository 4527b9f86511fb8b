"""Spark-native geoprocessing: part of the package, see the README."""
