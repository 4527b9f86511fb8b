"""How the modules of this folder register queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group() -> tuple[dict, dict, callable]:
    """(queries, their SQL, decorator): the decorator registers a function under its name, with the SQL if it has any."""
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """The columns rounded, so that engines that sum in other orders agree."""
    return df.withColumns({n: F.round(n, digits) for n in names})
