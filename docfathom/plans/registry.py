"""Named queries with the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: SQL of the results of queries that write files; tests hold these queries against it.
WRITERS: dict[str, str] = {}


def query(name: str, sql: str | None = None, writes: bool = False) -> Callable[[Query], Query]:
    """Register a query; sql is for DuckDB over the same tables, None where SQL can't state the result. writes: it writes a store or files that it leaves in the
    shared folder, and its SQL is for tests alone."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name] = f
        if sql:
            (WRITERS if writes else ORACLES)[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
