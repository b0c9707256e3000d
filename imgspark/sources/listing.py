"""The files of a folder as rows, listed by tasks: `spark.read.format("listed_files").load(folder)`, or `readStream`.

Rows: path (as Spark's own file sources write it) and length. Spark's sources keep a record of every file on the driver; here the
driver knows folders alone. Options: root (the qualified name of the folder, which begins every path), deep (the files of its
sub-folders too, one level). Hidden and empty files are left out, as Spark does. Folders are opened by Arrow's file systems.

The stream's offset is the time of the last change that any folder tells, and a batch lists the folders that changed since the one
before. So a file may come again with its folder, and who reads the stream drops what came before.
"""

from __future__ import annotations

import contextlib
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .byte_files import opened

SCHEMA = "path string, length long"
#: Sub-folders that a task lists, and files in a batch of rows.
FOLDERS, ROWS = 16, 10_000
#: Nanoseconds in which a folder may change again without a new time.
MARGIN = 2_000_000_000


@dataclass
class Folders(InputPartition):
    #: below the root; "" is the root itself
    names: list[str]


def entries(fs, folder: str) -> Iterator[tuple[str, bool, int | None]]:
    """(name, whether it is a folder, bytes of a file) of what is in a folder and not hidden; a local one is never held whole."""
    if fs.type_name == "local":
        with os.scandir(folder) as found:
            for x in found:
                with contextlib.suppress(FileNotFoundError):  # it went meanwhile
                    if not x.name.startswith(("_", ".")):
                        yield x.name, x.is_dir(), None if x.is_dir() else x.stat().st_size
    else:
        from pyarrow import fs as F

        for x in fs.get_file_info(F.FileSelector(folder)):
            if not x.base_name.startswith(("_", ".")):
                yield x.base_name, x.type == F.FileType.Directory, x.size


class ListedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listed_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ListedReader:
        return ListedReader(self.options["path"], self.options["root"], self.options["deep"] == "true")

    def streamReader(self, schema: StructType) -> ListedStream:  # noqa: N802
        return ListedStream(self.options["path"], self.options["root"], self.options["deep"] == "true")


class ListedReader(DataSourceReader):
    def __init__(self, folder: str, root: str, deep: bool) -> None:
        self.folder, self.root, self.deep = folder, root.rstrip("/"), deep

    def folders(self) -> list[str]:
        fs, base = opened(self.folder)
        return ["", *(sorted(name for name, folder, _ in entries(fs, base) if folder) if self.deep else ())]

    def partitions(self) -> list[Folders]:
        return dealt(self.folders())

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        fs, base = opened(self.folder)
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["path", "length"])
        rows: list[tuple[str, int]] = []
        for below in partition.names:
            inner = f"/{below}" if below else ""
            for name, folder, size in entries(fs, base + inner):
                if not folder and size:
                    rows.append((f"{self.root}{inner}/{name}", size))
                if len(rows) == ROWS:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)


class ListedStream(ListedReader, DataSourceStreamReader):
    def changes(self) -> dict[str, int]:
        """When each folder was changed, in ns; now for those that don't tell, or changed so lately that they may do so again unseen."""
        fs, base = opened(self.folder)
        now, found = time.time_ns(), {}
        for below in self.folders():
            at = fs.get_file_info(f"{base}/{below}".rstrip("/")).mtime_ns
            found[below] = now if at is None or at > now - MARGIN else at
        return found

    def initialOffset(self) -> dict:  # noqa: N802
        return {"changed": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"changed": max(self.changes().values())}

    def partitions(self, start: dict, end: dict) -> list[Folders]:
        return dealt([below for below, at in self.changes().items() if at >= start["changed"] - MARGIN]) if start != end else []


def dealt(names: list[str]) -> list[Folders]:
    return [Folders(names[i : i + FOLDERS]) for i in range(0, len(names), FOLDERS)]


def listed(spark: SparkSession, folder: str, deep: bool, stream: bool = False) -> DataFrame | None:
    """path and length of the files; None if this is no folder that Arrow opens (a pattern, a file, a store of Spark's alone)."""
    from pyarrow import fs as F

    try:
        fs, base = opened(folder)
        if fs.get_file_info(base).type != F.FileType.Directory:
            return None
    except (ValueError, OSError, NotImplementedError):
        return None
    spark.dataSource.register(ListedFiles)
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    source = (spark.readStream if stream else spark.read).format(ListedFiles.name())
    return source.option("root", root).option("deep", str(deep).lower()).load(folder)
