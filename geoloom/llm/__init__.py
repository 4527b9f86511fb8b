"""Operators for preparing language-model training data with Spark.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; per-row Python runs inside ``mapInArrow`` / ``applyInArrow`` tasks.
"""
