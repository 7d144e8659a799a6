"""All registered queries of the library: each operator over the test tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import function_queries, list_queries, relation_queries, shape_queries, state_queries

_MODULES = (list_queries, relation_queries, function_queries, state_queries, shape_queries)
QUERIES = {name: query for m in _MODULES for name, query in m.REGISTRY.queries.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.REGISTRY.sql.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_queries.admin_page(spark, sf_dir)
