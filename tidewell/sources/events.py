"""Upload webhooks as a stream or a table of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bearer_token, object_id_of
from ..schemas import UPLOAD_EVENT

KINDS = ("pre-create", "post-create", "post-receive", "pre-finish", "post-finish")


def read_upload_events(spark: SparkSession, path: str) -> DataFrame:
    return flat_events(spark.read.schema(UPLOAD_EVENT).json(path))


def stream_upload_events(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return flat_events(spark.readStream.schema(UPLOAD_EVENT).option("maxFilesPerTrigger", files_per_trigger).json(path))


def flat_events(events: DataFrame) -> DataFrame:
    """(object_id, kind, ts, seq, offset, size, is_partial, filename, filetype, token); unknown kinds are left out.

    The object's id stands in the upload's, and in its metadata before that exists.
    """
    upload = "Event.Upload"
    header = F.get(F.try_element_at(F.col("Event.HTTPRequest.Header"), F.lit("Authorization")), F.lit(0))
    meta = lambda k: F.try_element_at(F.col(f"{upload}.MetaData"), F.lit(k))
    return events.where(F.col("Type").isin(*KINDS)).select(
        F.coalesce(object_id_of(F.col(f"{upload}.ID")), meta("object_id")).alias("object_id"),
        F.col("Type").alias("kind"),
        F.col("received").alias("ts"),
        F.col("sequence").alias("seq"),
        F.col(f"{upload}.Offset").alias("offset"),
        F.col(f"{upload}.Size").alias("size"),
        F.coalesce(F.col(f"{upload}.IsPartial"), F.lit(False)).alias("is_partial"),
        meta("filename").alias("filename"),
        meta("filetype").alias("filetype"),
        bearer_token(header).alias("token"),
    )
