"""Registration of queries with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.sources.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table documents, dealt out over the cores for work that is heavy for its size."""
    return spread(table(spark, sf_dir, "documents"))


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir) under its name, with equivalent SQL of DuckDB's where there is any."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


__all__ = ["documents", "query", "table", "QUERIES", "ORACLE", "DataFrame", "SparkSession"]
