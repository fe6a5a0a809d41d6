"""The operators bound to the bundled tables: one query each, and the same in DuckDB's SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under `op_<id>_<slug>`."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def column_query(name: str, table: str, key: str, expression, sql: str, where: str = "true") -> None:
    """A query of one expression over a table: key and value."""
    ORACLES[name] = f"SELECT {key}, {sql} AS value FROM {table} WHERE {where}"
    QUERIES[name] = lambda spark, sf_dir: table_of(spark, sf_dir, table).where(where).select(*key.split(", "), expression().alias("value"))


def table_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from . import aggregates, incremental, ingest, joins, more, retrieval, review, states, text, workspace  # noqa: F401

    return QUERIES, ORACLES
