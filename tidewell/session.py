"""What a session needs beyond Spark's own set-up."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="tidewell-")
        context.addPyFile(shutil.make_archive(f"{folder}/tidewell", "zip", package.parent, package.name))
        _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share, below ``spark.checkpoint.dir``; only in one process, where
    that is unset, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidewell-shared-")
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}-{uuid.uuid4()}"
