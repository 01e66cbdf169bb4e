"""All queries of the symbol-graph engine with the SQL each is compared against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.plans import change_queries, facet_queries, graph_queries, layout_queries, verb_queries

_PARTS = (facet_queries, graph_queries, change_queries, layout_queries, verb_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in _PARTS for name, f in part.Q.made.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.Q.sql.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_queries.Q.made["identity_graph"](spark, sf_dir)
