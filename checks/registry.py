"""Names, queries and SQL of all checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from moltable.sources.readers import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; leave ``sql`` out where SQL cannot say the same at a bearable cost."""

    def register(query: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt out to all cores: for work that is heavy per text."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")
