"""Registered queries over the supplied tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corepart.checks import fixtures, graph_queries, label_queries, route_queries, train_queries
from corepart.checks.registry import ORACLES, QUERIES
from corepart.operators.route import route_edges
from corepart.operators.skew import find_hubs
from corepart.plans.partition import seed_core

GROUPS = (graph_queries, label_queries, route_queries, train_queries)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """(part, n_edges): seed a core by degree, route every edge, count the edges of each part."""
    e = fixtures.g_trade(spark, sf)
    hubs = find_hubs(e)
    state, _, _ = seed_core(e, fixtures.PARTS, fixtures.CORE_RATE, "degree", fixtures.SEED, hubs)
    routed = route_edges(e, state.withColumnRenamed("label", "part"), fixtures.PARTS, hubs)
    return routed.groupBy("part").agg(F.count(F.lit(1)).alias("n_edges"))


__all__ = ["GROUPS", "ORACLES", "QUERIES", "flagship"]
