"""Tables as Parquet, and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, root: str, name: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{root}/{name}.parquet")


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_table(df: DataFrame, path: str, cluster_by: list[str] | None = None, partitions: int | None = None) -> None:
    """Writes a new state; ``cluster_by`` sorts it by range, so that filters on it skip row groups."""
    if cluster_by:
        df = df.repartitionByRange(partitions, *cluster_by) if partitions else df.repartitionByRange(*cluster_by)
        df = df.sortWithinPartitions(*cluster_by)
    df.write.mode("overwrite").parquet(path)


def probe(spark: SparkSession) -> DataFrame:
    """One row, to see that the engine answers."""
    return spark.sql("SELECT 1 AS ok")
