"""Snapshots of outside systems: pods of a cluster, users of an identity directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import POD

_POD_JSON = T.StructType(
    [
        T.StructField("metadata", T.StructType([T.StructField("name", T.StringType())])),
        T.StructField("status", T.StructType([T.StructField("phase", T.StringType()), T.StructField("startTime", T.StringType())])),
    ]
)


def read_pods(spark: SparkSession, path: str) -> DataFrame:
    """(name, phase, start_time) from JSON lines as the cluster's API gives them."""
    pods = spark.read.schema(_POD_JSON).json(path)
    return pods.select(F.col("metadata.name").alias("name"), F.col("status.phase").alias("phase"), F.col("status.startTime").alias("start_time"))


def pods_from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, POD)


def job_states(pods: DataFrame) -> DataFrame:
    """(job_id, status, time_started)."""
    return pods.select(F.col("name").alias("job_id"), F.col("phase").alias("status"), F.col("start_time").alias("time_started"))


def directory_users(users: DataFrame, members: DataFrame, default_method: str = "default") -> DataFrame:
    """Users with their login method and roles; is_admin and is_user stay null for users without a role."""
    from ..functions.text import login_method
    from ..operators.dataflow import merge_roles

    roles = merge_roles(members)
    named = users.withColumn("login_method", login_method(F.col("attributes"), default_method))
    return named.join(roles, "id", "left")


def list_users(users: DataFrame, members: DataFrame, spec_filters: dict) -> DataFrame:
    """The users dialect: ``users_only`` lists those with a role, ``id`` picks some, ``username`` holds a text."""
    if spec_filters.get("users_only"):
        return users.join(members.select("id").distinct(), "id", "left_semi")
    if "id" in spec_filters:
        ids = spec_filters["id"]
        return users.where(F.col("id").isin(ids if isinstance(ids, list) else [ids]))
    if spec_filters.get("username"):
        return users.where(F.lower("username").contains(str(spec_filters["username"]).lower()))
    return users


def users_page(users: DataFrame, members: DataFrame, spec) -> DataFrame:
    """A page of ``list_users`` by user name, then id; a range includes its end and is taken once."""
    from ..operators.paging import By
    from ..plans.spec import page_of

    found = list_users(users, members, spec.filters)
    if spec.page is None:
        return found
    start, end = spec.page
    return page_of(found, [By("username"), By("id")], start, max(0, end - start + 1))


def users_range(users: DataFrame, members: DataFrame, spec) -> DataFrame:
    """content_range: ``users start-end/total``; the end as asked for, the total without a range."""
    total = list_users(users, members, spec.filters).agg(F.count(F.lit(1)).cast("string").alias("total"))
    start, end = spec.page if spec.page else (0, None)
    last = F.col("total") if end is None else F.lit(str(end))
    return total.select(F.concat(F.lit(f"users {start}-"), last, F.lit("/"), "total").alias("content_range"))
