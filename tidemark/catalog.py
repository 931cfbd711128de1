"""All registered queries of the library proper, with the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import flow_queries, fundamental_queries, ingest_queries, portfolio_queries, screen_queries, series_queries, text_queries

MODULES = (series_queries, portfolio_queries, flow_queries, screen_queries, fundamental_queries, text_queries, ingest_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
