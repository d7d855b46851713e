"""Registry of named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``oracle`` is the DuckDB statement with the same result."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def load_all() -> None:
    """Import every module that registers queries."""
    from originlens.plans import (  # noqa: F401
        q_ensembles,
        q_language,
        q_leakage,
        q_metrics,
        q_models,
        q_neighbors,
        q_rows,
        q_sampling,
        q_sources,
        q_streaming,
        q_text,
    )
