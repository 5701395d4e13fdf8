"""All queries by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import project_queries, run_queries, table_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**text_queries.QUERIES, **table_queries.QUERIES, **run_queries.QUERIES, **project_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**text_queries.ORACLE_SQL, **table_queries.ORACLE_SQL, **run_queries.ORACLE_SQL, **project_queries.ORACLE_SQL}
