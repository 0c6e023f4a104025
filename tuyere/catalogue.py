"""All queries of the process-data operators, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tuyere.plans import catalog_queries, column_queries, model_queries, series_queries, storage_queries, table_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = series_queries.QUERIES | table_queries.QUERIES | model_queries.QUERIES | column_queries.QUERIES | catalog_queries.QUERIES | storage_queries.QUERIES
ORACLE_SQL: dict[str, str] = series_queries.ORACLE_SQL | table_queries.ORACLE_SQL | model_queries.ORACLE_SQL | column_queries.ORACLE_SQL | catalog_queries.ORACLE_SQL | storage_queries.ORACLE_SQL | {"multi_source_offset": catalog_queries.OFFSET_SQL, "kg_propagation": storage_queries.PROPAGATION_SQL}
