"""Tables that change a few rows at a time: copy-on-write by file, committed with a ledger of stream batches.

A table's folder holds ``data`` (Parquet files, never changed), ``manifests`` (for each version the table of its
files) and ``commits`` (for each version one small file that names its manifest and the ledger). A change finds the
files that hold its keys, writes their new rows beside them, and commits a manifest in which they are swapped. The
commit file is created only if none of that version exists: two writers can't both win, and what was written
before a failed commit is never read. The ledger says which batch of each stream is in, so that a batch that is run
again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import mutate


class Conflict(RuntimeError):
    """Another writer committed the version first; read again and repeat the change."""


@dataclass(frozen=True)
class Version:
    number: int
    manifest: str
    ledger: dict[str, int]


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, df: DataFrame, root: str, cluster_by: list[str] | None = None, files: int | None = None) -> VersionedTable:
        """A new table of these rows; ``cluster_by`` puts near keys in one file, so that few files hold a change's keys."""
        table = cls(df.sparkSession, root)
        if table.version(missing=True) is not None:
            raise FileExistsError(root)
        if cluster_by:
            df = df.repartitionByRange(files, *cluster_by) if files else df.repartitionByRange(*cluster_by)
            df = df.sortWithinPartitions(*cluster_by)
        elif files:
            df = df.repartition(files)
        table._commit(Version(-1, "", {}), table._write(df), df.schema)
        return table

    def version(self, number: int | None = None, missing: bool = False) -> Version | None:
        """The newest version, or one by its number."""
        if number is None:
            folder = self._path(f"{self.root}/commits")
            names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
            found = sorted(n for n in names if n.endswith(".json"))
            if not found:
                if missing:
                    return None
                raise FileNotFoundError(self.root)
            number = int(found[-1].removesuffix(".json"))
        said = json.loads(self._text(f"{self.root}/commits/{number:020d}.json"))
        return Version(said["version"], said["manifest"], said["ledger"])

    def files(self, version: Version | None = None) -> list[str]:
        version = version or self.version()
        return [r.path for r in self.spark.read.schema("path string").parquet(f"{self.root}/{version.manifest}").collect()]

    def read(self, version: Version | None = None) -> DataFrame:
        return self._rows(self.files(version or self.version()))

    @property
    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self._text(f"{self.root}/schema.json")))

    def append(self, rows: DataFrame, **batch) -> Version:
        return self._swap(self.version(), [], rows, **batch)

    def update_keys(self, keys: DataFrame, key: str, change: Callable[[DataFrame], DataFrame], new: DataFrame | None = None, **batch) -> Version:
        """Passes the rows of the files that hold any of ``keys`` through ``change``, which must leave those of
        other keys as they are; ``new`` rows are added. Other files stay as they are, by name and content."""
        version = self.version()
        touched = self.touched(keys, key, version)
        rows = change(self._rows(touched)) if touched else None
        rows = new if rows is None else rows if new is None else rows.unionByName(new)
        return version if rows is None and not batch else self._swap(version, touched, rows, **batch)

    def touched(self, keys: DataFrame, key: str, version: Version | None = None) -> list[str]:
        """Files that hold one of the keys; only the key's column is read."""
        held = self.read(version).select(F.col(key).alias("__key"), F.col("_metadata.file_path").alias("path"))
        wanted = keys.select(F.col(key).alias("__key")).where("__key is not null").distinct()
        return [r.path for r in held.join(wanted, "__key", "left_semi").select("path").distinct().collect()]

    def patch(self, patches: DataFrame, key: str, **batch) -> Version:
        """See ``mutate.patch``."""
        return self.update_keys(patches, key, lambda df: mutate.patch(df, patches, key), **batch)

    def delete_keys(self, keys: DataFrame, key: str, **batch) -> Version:
        return self.update_keys(keys, key, lambda df: mutate.delete_keys(df, keys, key), **batch)

    def upsert(self, rows: DataFrame, key: str, **batch) -> Version:
        """See ``mutate.upsert``; each key comes once."""
        rows = rows.select(*self.schema.names)
        return self.update_keys(rows, key, lambda df: mutate.delete_keys(df, rows, key), new=rows, **batch)

    def update_where(self, condition: Column, values: dict[str, Column], **batch) -> Version:
        """See ``mutate.update_where``; files without a row that the condition holds for stay as they are."""
        version = self.version()
        hit = self.read(version).where(condition).select(F.col("_metadata.file_path").alias("path")).distinct().collect()
        touched = [r.path for r in hit]
        if not touched:
            return version if not batch else self._swap(version, [], None, **batch)
        return self._swap(version, touched, mutate.update_where(self._rows(touched), condition, values), **batch)

    def has(self, stream: str, batch: int) -> bool:
        """Whether a stream's batch is in the table; batches of a stream come in order."""
        return self.version().ledger.get(stream, -1) >= batch

    def forget(self, keep: int = 2) -> int:
        """Deletes files that none of the last ``keep`` versions lists; returns their number. A change that is being
        written meanwhile would lose its files, so call it when none is."""
        newest = self.version().number
        kept = {f for n in range(max(0, newest - keep + 1), newest + 1) for f in self.files(self.version(n))}
        names, n = {f.rpartition("/data/")[2] for f in kept}, 0
        for folder in self._fs.listStatus(self._path(f"{self.root}/data")):
            for file in self._fs.listStatus(folder.getPath()):
                name = f"{folder.getPath().getName()}/{file.getPath().getName()}"
                if name.endswith(".parquet") and name not in names:
                    n += bool(self._fs.delete(file.getPath(), False))
        return n

    def _rows(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*files)

    def _write(self, rows: DataFrame) -> list[str]:
        folder = f"{self.root}/data/{uuid.uuid4()}"
        rows.write.parquet(folder)
        return [str(s.getPath()) for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().endswith(".parquet")]

    def _swap(self, version: Version, out: list[str], rows: DataFrame | None, stream: str | None = None, batch: int | None = None) -> Version:
        """Commits a version without the files ``out`` and with new ones of ``rows``."""
        new = [] if rows is None else self._write(rows.select(*self.schema.names))
        gone = {f.rpartition("/data/")[2] for f in out}
        files = [f for f in self.files(version) if f.rpartition("/data/")[2] not in gone] + new
        ledger = version.ledger if stream is None else version.ledger | {stream: batch}
        return self._commit(Version(version.number, version.manifest, ledger), files)

    def _commit(self, before: Version, files: list[str], schema: StructType | None = None) -> Version:
        if schema is not None:
            self._create(f"{self.root}/schema.json", schema.json())
        version = Version(before.number + 1, f"manifests/{uuid.uuid4()}", before.ledger)
        self.spark.createDataFrame([(f,) for f in files], "path string").coalesce(1).write.parquet(f"{self.root}/{version.manifest}")
        said = {"version": version.number, "manifest": version.manifest, "ledger": version.ledger}
        self._create(f"{self.root}/commits/{version.number:020d}.json", json.dumps(said))
        return version

    def _create(self, path: str, text: str) -> None:
        """Creates a file whole under its name, only if there is none of that name."""
        try:
            out = self._fs.create(self._path(path), False)
        except Exception as error:
            if "already exists" in str(error):
                raise Conflict(path) from None
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
