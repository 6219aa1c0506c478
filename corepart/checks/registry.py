"""The table of registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corepart.functions import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and the SQL that must give the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def values(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """One row (keys, pos, val) per vector element, rounded."""
    return df.select(*keys, F.posexplode(vec).alias("pos", "val")).select(
        *keys, "pos", rounded("val").alias("val")
    )


def sql_values(source: str, keys: str, vec: str) -> str:
    return (
        f"SELECT {keys}, (generate_subscripts({vec}, 1) - 1)::INTEGER AS pos,"
        f" round(unnest({vec})::DOUBLE, 6) + 0.0 AS val FROM {source}"
    )
