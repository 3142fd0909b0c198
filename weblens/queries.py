"""The engine's own queries over the driver's tables, and the SQL that each is checked by."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weblens.plans import analytics_queries, feature_queries, flow_queries, scalar_queries, score_queries

MODULES = (scalar_queries, feature_queries, flow_queries, score_queries, analytics_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for m in MODULES for name, run in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
