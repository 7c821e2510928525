"""Named queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` states the same result over the same tables."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load() -> None:
    """Import every query module; importing registers its queries."""
    from litlake.plans import (  # noqa: F401
        bibliography_queries,
        corpus_queries,
        document_queries,
        graph_queries,
        identifier_queries,
        metadata_queries,
        record_queries,
        search_queries,
        telemetry_queries,
    )
