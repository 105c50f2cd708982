"""Every operator as a query over the shared test tables, most with an independent SQL statement beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


def load() -> None:
    from ragspark.registry import catalog_queries, flow_queries, retrieval_queries, text_queries  # noqa: F401
