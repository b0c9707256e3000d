"""Files as rows of byte ranges, so that no file has to be a row: `spark.read.format("byte_ranges").load(folder)`.

Rows: path, k (number of the range), start, own (bytes that the range owns), length (of the file) and content: the own bytes and
`LOOK_AHEAD` more, so that a marker at a range's end can be read. Options: range_bytes (8 MiB), task_bytes (ranges that a task reads).
Folders are opened by Arrow's file systems, as in byte_files; empty files have no range. A file that shrinks while it is
read fails the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .byte_files import opened

LOOK_AHEAD = 9
RANGE_BYTES = 8 << 20
SCHEMA = "path string, k long, start long, own long, length long, content binary"


@dataclass
class Ranges(InputPartition):
    #: path, first range, ranges, length of the file
    pieces: list[tuple[str, int, int, int]]


class ByteRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ByteRangesReader:
        return ByteRangesReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), int(self.options.get("task_bytes", 8 * RANGE_BYTES)))


class ByteRangesReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int, task_bytes: int) -> None:
        if not 0 < range_bytes < 1 << 30:
            raise ValueError("range_bytes has to lie between 1 and 2**30")
        self.folder, self.range_bytes, self.ranges = folder, range_bytes, max(1, task_bytes // range_bytes)

    def partitions(self) -> list[Ranges]:
        """Tasks of equal numbers of ranges: many small files in one, a large file in many."""
        from pyarrow import fs as F

        fs, base = opened(self.folder)
        out, room = [Ranges([])], self.ranges
        for x in sorted(fs.get_file_info(F.FileSelector(base, recursive=True)), key=lambda x: x.path):
            if x.type != F.FileType.File or x.base_name.startswith(("_", ".")):
                continue
            first, n = 0, -(-x.size // self.range_bytes)
            while first < n:
                took = min(room, n - first)
                out[-1].pieces.append((x.path, first, took, x.size))
                first, room = first + took, room - took
                if not room:
                    out.append(Ranges([]))
                    room = self.ranges
        return [p for p in out if p.pieces] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[tuple]:
        fs, _ = opened(self.folder)
        for path, first, n, length in partition.pieces:
            with fs.open_input_file(path) as f:
                for k in range(first, first + n):
                    start = k * self.range_bytes
                    own = min(self.range_bytes, length - start)
                    content = f.read_at(min(own + LOOK_AHEAD, length - start), start)
                    if len(content) < own:
                        raise OSError(f"{path} is shorter than it was")
                    yield path, k, start, own, length, content


def read_ranges(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(ByteRanges)
    return spark.read.format(ByteRanges.name()).option("range_bytes", range_bytes).load(folder)


def ranges_of(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The same rows of files (path, content) that are rows already; null and empty content has none."""
    length = F.octet_length("content").cast("long")
    rows = files.select("path", "content", length.alias("length")).filter("length > 0")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / range_bytes))).alias("k")).withColumn("start", F.col("k") * range_bytes)
    own = F.least(F.lit(range_bytes).cast("long"), F.col("length") - F.col("start"))
    return rows.select("path", "k", "start", own.alias("own"), "length", F.substring("content", (F.col("start") + 1).cast("int"), F.lit(range_bytes + LOOK_AHEAD)).alias("content"))
