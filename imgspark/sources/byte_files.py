"""A Spark data source that writes rows of bytes as files of their own: `df.write.format("byte_files").save(folder)`.

Rows are (path string, content binary): content is appended to the file `path` below the folder. Rows of one path have to stand
in one partition, one after the other. Every task attempt writes below a staging folder of its own; its commit message names
that folder, and the driver moves what the messages name into place when all tasks are done, whole folders where they are new. So an attempt that failed or ran
twice leaves nothing, a failed job leaves nothing, and readers never see half a file. Folders are opened by Arrow's
file systems (local or mounted paths, hdfs://, s3://, gs://). `overwrite` first removes what the folder held.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "path string, content binary"
#: Files that the driver moves at a time.
MOVES = 16
#: File systems that move a folder with all that it holds.
RENAMES = ("local", "hdfs")


def opened(folder: str):
    """(file system, path on it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", folder.rstrip("/")))


def checked(path: str | None) -> str:
    parts = (path or "").split("/")
    if any(p in ("", ".", "..") or p.startswith("_staging-") for p in parts):
        raise ValueError(f"not a file below the folder: {path!r}")
    return "/".join(parts)


@dataclass
class Written(WriterCommitMessage):
    attempt: str | None
    files: int
    size: int


class ByteFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "byte_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> ByteFilesWriter:
        if [(f.name, f.dataType.simpleString()) for f in schema] != [("path", "string"), ("content", "binary")]:
            raise ValueError(f"byte_files takes rows of {SCHEMA}")
        return ByteFilesWriter(self.options["path"], overwrite)


class ByteFilesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool) -> None:
        self.folder, self.overwrite, self.staging = folder, overwrite, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = opened(self.folder)
        attempt = f"{base}/{self.staging}/{uuid.uuid4().hex}"
        path, out, files, size = None, None, 0, 0
        try:
            for batch in iterator:
                for p, content in zip(batch.column(0), batch.column(1), strict=True):
                    if out is None or p.as_py() != path:
                        if out is not None:
                            out.close()
                        path = p.as_py()
                        at = f"{attempt}/{checked(path)}"
                        fs.create_dir(at.rpartition("/")[0], recursive=True)
                        out = fs.open_output_stream(at)
                        files += 1
                    if content.is_valid:
                        out.write(content.as_buffer())
                        size += content.as_buffer().size
        finally:
            if out is not None:
                out.close()
        return Written(attempt if files else None, files, size)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs as F

        fs, base = opened(self.folder)
        if self.overwrite:
            for x in fs.get_file_info(F.FileSelector(base, allow_not_found=True)):
                if x.base_name != self.staging:
                    (fs.delete_dir if x.type == F.FileType.Directory else fs.delete_file)(x.path)
        with ThreadPoolExecutor(MOVES) as pool:
            for m in messages:
                if m is not None and m.attempt:
                    self.move(fs, pool, m.attempt, base)
        self.abort(messages)

    def move(self, fs, pool: ThreadPoolExecutor, source: str, target: str) -> None:
        """What a folder holds; a folder that is new below the target goes in one move, where the file system has such a thing."""
        from pyarrow import fs as F

        fs.create_dir(target, recursive=True)
        files = []
        for x in fs.get_file_info(F.FileSelector(source)):
            to = f"{target}/{x.base_name}"
            if x.type == F.FileType.Directory and (fs.type_name not in RENAMES or fs.get_file_info(to).type != F.FileType.NotFound):
                self.move(fs, pool, x.path, to)
            else:
                files.append((x.path, to))
        list(pool.map(lambda f: fs.move(*f), files))

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing is in its place yet: the staging folder goes, with what any attempt has left there."""
        from pyarrow import fs as F

        fs, base = opened(self.folder)
        if fs.get_file_info(f"{base}/{self.staging}").type == F.FileType.Directory:
            fs.delete_dir(f"{base}/{self.staging}")


def save(rows: DataFrame, folder: str, mode: str = "append") -> None:
    """Write rows (path, content), each path whole in one partition and in order."""
    register(rows.sparkSession)
    rows.select("path", "content").write.format(ByteFiles.name()).mode(mode).save(folder)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ByteFiles)
