"""All registered queries and their SQL, gathered from the modules of this folder."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ("raster", "focal", "mosaic", "vector", "predicates", "segment", "matching", "overlay", "io")


def queries() -> dict[str, Callable]:
    """Query name to ``(spark, sf_dir) -> DataFrame``."""
    out: dict[str, Callable] = {}
    for name in MODULES:
        out.update(import_module(f"geoloom.plans.{name}").QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL that gives the same rows."""
    out: dict[str, str] = {}
    for name in MODULES:
        out.update(import_module(f"geoloom.plans.{name}").ORACLES)
    return out
