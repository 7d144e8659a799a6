"""An object store under a root path: listings, JSON documents, binaries, logs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


_LISTED = "key string, size long, last_modified timestamp, is_folder boolean, level int"


def walk(spark: SparkSession, root: str, prefix: str = "", tasks: int | None = None) -> DataFrame:
    """(key, size, last_modified, is_folder, level): objects and folders whose key has the prefix, level by level.

    The walk begins in the prefix's own folder, and of that takes only what has the prefix. The folders of a level
    are listed in tasks, whose rows are written and give the next level's folders; the driver holds counts only. A
    folder is listed in one task. Names are as they are, hidden ones too. A folder that isn't there has nothing.
    For stores that Arrow reads (local, HDFS, S3, GCS).
    """
    root, at = root.rstrip("/"), shared_folder(spark)
    folder, _, name = prefix.rpartition("/")
    tasks = tasks or 4 * spark.sparkContext.defaultParallelism

    def listing(level: int, name: str):
        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow import fs

            store, base = fs.FileSystem.from_uri(root)
            for batch in batches:
                for own in batch.column("key").to_pylist():
                    path = f"{base}/{own}" if own else base
                    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
                    for i in range(0, len(found), 10_000):
                        rows = [x for x in found[i : i + 10_000] if x.base_name.startswith(name)]
                        is_folder = [x.type == fs.FileType.Directory for x in rows]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([f"{own}/{x.base_name}" if own else x.base_name for x in rows], pa.string()),
                                pa.array([None if d else x.size for x, d in zip(rows, is_folder, strict=True)], pa.int64()),
                                pa.array([x.mtime for x in rows], pa.timestamp("us", "UTC")),
                                pa.array(is_folder, pa.bool_()),
                                pa.array([level] * len(rows), pa.int32()),
                            ],
                            names=["key", "size", "last_modified", "is_folder", "level"],
                        )

        return listed

    folders, level, n = spark.createDataFrame([(folder,)], "key string"), 0, 1
    while n:
        folders.repartition(min(n, tasks)).mapInArrow(listing(level, name), _LISTED).write.parquet(f"{at}/level={level}")
        written = spark.read.schema(_LISTED).parquet(f"{at}/level={level}")
        folders, level, name = written.where("is_folder").select("key"), level + 1, ""
        n = folders.count()
    return spark.read.schema(_LISTED).parquet(*(f"{at}/level={i}" for i in range(level)))


def list_objects(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """(key, size, last_modified) of all objects below the root whose key has the prefix; contents aren't read."""
    return walk(spark, root, prefix).where("not is_folder").select("key", "size", "last_modified")


def read_json_maps(spark: SparkSession, path: str, value: str = "double") -> DataFrame:
    """(path, document): each JSON file as a map of strings to values; null if it isn't one."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", f"map<string,{value}>").alias("document"))


def read_binaries(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content, length)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content", "length")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(path, log), a row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("log"))


def file_outputs(listing: DataFrame, base_url: str, submission: str) -> DataFrame:
    """(filename, size_bytes, last_modified, url) of a submission's outputs."""
    name = F.substring_index("key", "/", -1)
    return listing.select(
        name.alias("filename"),
        F.col("size").alias("size_bytes"),
        "last_modified",
        F.concat_ws("/", F.lit(base_url), F.lit(submission), name).alias("url"),
    )
