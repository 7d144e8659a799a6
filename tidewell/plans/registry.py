"""Registration of queries with the SQL that they are held against, and the test tables as resources."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

#: The time that stands for now, so that results stay the same.
NOW = datetime(2024, 2, 1)


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def named(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql:
                self.sql[query.__name__] = sql
            return query

        return named


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as submissions."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("owner"),
        F.col("o_orderpriority").alias("name"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("total"),
        F.col("o_orderdate").alias("time_added"),
    )


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as input objects."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("filename"), F.col("p_type").alias("kind"), F.col("p_size").alias("size")
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as upload events: users are objects, event types steps of an upload."""
    kind = (
        F.when(F.col("event_type") == "purchase", "post-finish")
        .when(F.col("event_type") == "signup", "pre-create")
        .when(F.col("event_type") == "view", "post-receive")
        .otherwise("post-create")
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("object_id"),
        kind.alias("kind"),
        F.col("ts"),
        F.col("event_id").alias("seq"),
        F.get_json_object("props", "$.k").cast("long").alias("offset"),
        F.lit(100).cast("long").alias("size"),
        F.lit(False).alias("is_partial"),
    )
