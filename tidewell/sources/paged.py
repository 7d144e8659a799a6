"""Snapshots of an outside system, kept as pages, as a data source for batches and streams.

A folder holds a folder for each snapshot, named by a number that grows; in it are ``page-<n>.json`` files of JSON
lines and, written last, ``done.json``: ``{"pages": n, "taken": "<ISO time>"}``. A snapshot without ``done.json`` is
still being written, and isn't read. One that lacks a page it should have is incomplete: its rows say so, and it has
a row of its own that says so, even if no page is left. So nothing takes what is missing for what is gone.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import StructType

SCHEMA = "snapshot long, taken timestamp, succeeded boolean, name string, phase string, start_time string"


@dataclass
class Page(InputPartition):
    """A page to read; ``path`` is None for the row that says that a snapshot is incomplete."""

    snapshot: int
    taken: str
    succeeded: bool
    path: str | None


class Folder:
    """Lists snapshots and their pages; reads none."""

    def __init__(self, path: str):
        self.path = path

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def snapshots(self) -> list[int]:
        from pyarrow import fs

        store, base = self._store()
        names = [x.base_name for x in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if x.type == fs.FileType.Directory]
        return sorted(int(n) for n in names if n.isdecimal() and store.get_file_info(f"{base}/{n}/done.json").type == fs.FileType.File)

    def pages(self, snapshot: int) -> list[Page]:
        from pyarrow import fs

        store, base = self._store()
        names = {str(int(x)): x for x in (i.base_name for i in store.get_file_info(fs.FileSelector(base))) if x.isdecimal()}
        folder = f"{base}/{names[str(snapshot)]}"
        with store.open_input_file(f"{folder}/done.json") as f:
            done = json.loads(f.read())
        there = {x.base_name for x in store.get_file_info(fs.FileSelector(folder)) if x.type == fs.FileType.File}
        wanted = [f"page-{i}.json" for i in range(done["pages"])]
        whole = all(p in there for p in wanted)
        found = [Page(snapshot, done["taken"], whole, f"{folder}/{p}") for p in wanted if p in there]
        return found if whole else [*found, Page(snapshot, done["taken"], False, None)]

    def rows(self, page: Page) -> Iterator[tuple]:
        taken = datetime.fromisoformat(page.taken)
        taken = taken.replace(tzinfo=timezone.utc) if taken.tzinfo is None else taken
        if page.path is None:
            yield page.snapshot, taken, False, None, None, None
            return
        store, _ = self._store()
        with store.open_input_file(page.path) as f:
            lines = f.read().decode().splitlines()
        for line in filter(str.strip, lines):
            pod = json.loads(line)
            status = pod.get("status") or {}
            yield page.snapshot, taken, page.succeeded, (pod.get("metadata") or {}).get("name"), status.get("phase"), status.get("startTime")


class PagedReader(DataSourceReader):
    def __init__(self, path: str):
        self.folder, self.kept = Folder(path), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Conditions on the snapshot's number choose the folders to list; Spark keeps the others."""
        tests = {
            EqualTo: lambda v: lambda n: n == v,
            In: lambda v: lambda n: n in v,
            GreaterThan: lambda v: lambda n: n > v,
            GreaterThanOrEqual: lambda v: lambda n: n >= v,
            LessThan: lambda v: lambda n: n < v,
            LessThanOrEqual: lambda v: lambda n: n <= v,
        }
        for f in filters:
            if type(f) in tests and f.attribute == ("snapshot",):
                self.kept.append(tests[type(f)](f.value))
            else:
                yield f

    def partitions(self) -> list[Page]:
        return [p for n in self.folder.snapshots() if all(k(n) for k in self.kept) for p in self.folder.pages(n)] or [Page(-1, "", False, None)]

    def read(self, page: Page) -> Iterator[tuple]:
        return iter(()) if page.snapshot < 0 else self.folder.rows(page)


class PagedStreamReader(DataSourceStreamReader):
    """Offsets are snapshots' numbers: a batch is the whole of the snapshots after one, up to another."""

    def __init__(self, path: str):
        self.folder = Folder(path)

    def initialOffset(self) -> dict:
        return {"snapshot": -1}

    def latestOffset(self) -> dict:
        return {"snapshot": max(self.folder.snapshots(), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [p for n in self.folder.snapshots() if start["snapshot"] < n <= end["snapshot"] for p in self.folder.pages(n)]

    def read(self, page: Page) -> Iterator[tuple]:
        return self.folder.rows(page)

    def commit(self, end: dict) -> None:
        """Snapshots stay: what is read is told by the stream's checkpoint."""


class PagedSnapshots(DataSource):
    """``spark.dataSource.register(PagedSnapshots)``, then the format ``paged_snapshots`` with option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "paged_snapshots"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PagedStreamReader(self.options["path"])
