"""Name -> (builder, oracle SQL) registry of the library's queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import registry
from .plans import detail_queries, document_queries, domain_queries, event_queries, governance_queries, graph_queries, source_queries, stream_queries, symbol_queries  # noqa: F401  (they register)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
