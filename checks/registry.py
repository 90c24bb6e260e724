"""The query register and a few helpers for writing queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(table)`; `table(name)` reads one of the given tables."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(expression: str, digits: int = 2) -> str:
    """DuckDB text that rounds a double as Spark does: on its shortest decimal form, halves away from zero."""
    return f"CAST(round(CAST(CAST({expression} AS VARCHAR) AS DECIMAL(38,17)), {digits}) AS DOUBLE)"
