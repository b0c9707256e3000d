"""Pictures embedded in files that are read as byte ranges.

A JPEG is found by a walk from marker to marker, which may leave one range for the next at any place. So each range says, once
and from its own bytes, what a walk does that comes in at any of the places where one may come in (a marker within a segment's
length of the range's start): it ends at an end marker, breaks, leaves for a place behind the range, or looks for the end marker
behind the scan header. These answers are functions that compose: walks that begin in a range follow them by joins on
(path, place), a round for each range edge that a header crosses. Only numbers are joined, no bytes move, and a range is read once.

The end marker behind a scan header is the first one of the range where the search begins, or of the next range that has any: a
running minimum over the ranges. Of pictures in each other the outer one counts: a search goes on behind the end of
what it found, as if the file were read from its start.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import SIZED
from ..sources.shared import shared_dir

#: A segment is two bytes of marker and up to this many more: so far behind a range's start a walk may come in.
SEGMENT = 65535
ANSWERS = "path string, kind string, place long, state string, to long, width long, height long, eois array<long>"
WALK, SCAN, DONE = "walk", "scan", "done"


def step(data: bytes, start: int, own: int, length: int, at: int) -> tuple[str, int, tuple[int, int] | None] | None:
    """(state, place, size if one was passed) of a walk from marker `at`, until it leaves the own bytes; None where it breaks."""
    size = None
    while at < start + own:
        i = at - start
        if at + 3 >= length:
            return (DONE, at + 2, size) if data[i : i + 2] == b"\xff\xd9" else None
        kind = data[i + 1]
        if data[i] != 0xFF:
            return None
        if kind == 0xFF:
            at += 1
        elif kind == 0xD9:
            return DONE, at + 2, size
        elif 0xD0 <= kind <= 0xD7 or kind == 0x01:
            at += 2
        else:
            n = int.from_bytes(data[i + 2 : i + 4])
            if n < 2 or at + 2 + n > length:
                return None
            if kind in SIZED and n >= 7:
                size = int.from_bytes(data[i + 7 : i + 9]), int.from_bytes(data[i + 5 : i + 7])
            at += 2 + n
            if kind == 0xDA:
                return SCAN, at, size
    return WALK, at, size


def places(data: bytes, what: bytes, own: int) -> Iterator[int]:
    i = data.find(what)
    while 0 <= i < own:
        yield i
        i = data.find(what, i + 1)


def answers(ranges: DataFrame) -> DataFrame:
    """Rows of ANSWERS: `start` for walks that begin in a range, `enter` for each place where one may come in, and one `ends` with the
    range's end markers (those that may lie before a place of entry, and the next one)."""
    schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("place", pa.int64()), ("state", pa.string()), ("to", pa.int64()), ("width", pa.int64()), ("height", pa.int64()), ("eois", pa.list_(pa.int64()))])

    def of(path: str, k: int, start: int, own: int, length: int, data: bytes) -> Iterator[tuple]:
        eois = [start + i for i in places(data, b"\xff\xd9", own)]

        def walk(at: int) -> tuple | None:
            if not (found := step(data, start, own, length, at)):
                return None
            state, to, size = found
            if state == SCAN and to < start + own:
                i = bisect_left(eois, to)
                state, to = (DONE, eois[i] + 2) if i < len(eois) else (SCAN, start + own)
            return state, to, *(size or (None, None)), None

        for i in places(data, b"\xff\xd8\xff", own):
            if found := walk(start + i + 2):
                yield path, "start", start + i, *found
        if k:
            for i in places(data[: SEGMENT + 3], b"\xff", min(own, SEGMENT + 2)):
                if found := walk(start + i):
                    yield path, "enter", start + i, *found
        yield path, "ends", k, None, eois[0] if eois else None, None, None, eois[: bisect_left(eois, start + SEGMENT + 2) + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows = list(of(*(c[i].as_py() for c in b.columns)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return ranges.select("path", "k", "start", "own", "length", "content").mapInArrow(run, ANSWERS)


def scan_ends(found: DataFrame, ranges_end: DataFrame, range_bytes: int) -> DataFrame:
    """Scans (path, start, to, width, height) with `end` behind the first end marker at `to` or later; those without one are gone."""
    later = Window.partitionBy("path").orderBy("k").rowsBetween(1, Window.unboundedFollowing)
    ends = ranges_end.select("path", F.col("place").alias("k"), "eois", F.col("to").alias("first")).withColumn("next", F.min("first").over(later))
    met = found.withColumn("k", F.floor(F.col("to") / range_bytes)).join(ends, ["path", "k"])
    end = F.coalesce(F.get(F.filter("eois", lambda e: e >= F.col("to")), F.lit(0)), F.col("next"))
    return met.withColumn("end", end + 2).filter("end is not null").select("path", "start", "end", "width", "height")


def embedded_pictures(ranges: DataFrame, range_bytes: int) -> DataFrame:
    """path, start, end, width and height of every picture in files that are given as ranges (sources/byte_ranges)."""
    shared_dir(ranges.sparkSession)
    said = answers(ranges).checkpoint()
    enter = said.filter("kind = 'enter'").select("path", F.col("place").alias("to"), F.col("state").alias("_state"), F.col("to").alias("_to"), F.col("width").alias("_w"), F.col("height").alias("_h"))
    walks = said.filter("kind = 'start'").select("path", F.col("place").alias("start"), "state", "to", "width", "height")
    ended, going = walks.filter(f"state != '{WALK}'"), walks.filter(f"state = '{WALK}'").checkpoint()
    while not going.isEmpty():
        on = going.drop("state").join(enter, ["path", "to"]).select("path", "start", F.col("_state").alias("state"), F.col("_to").alias("to"), F.coalesce("_w", "width").alias("width"), F.coalesce("_h", "height").alias("height")).checkpoint()
        ended, going = ended.unionByName(on.filter(f"state != '{WALK}'")), on.filter(f"state = '{WALK}'")
    ended = ended.filter("width is not null")
    scans = scan_ends(ended.filter(f"state = '{SCAN}'"), said.filter("kind = 'ends'"), range_bytes)
    return outer(ended.filter(f"state = '{DONE}'").select("path", "start", F.col("to").alias("end"), "width", "height").unionByName(scans))


def outer(pictures: DataFrame) -> DataFrame:
    """Of pictures in one file those that a reader meets who goes on behind the end of each: a stream of numbers, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, free = None, 0
        for b in batches:
            keep = []
            for i, (p, s, e) in enumerate(zip(*(b.column(c).to_pylist() for c in ("path", "start", "end")), strict=True)):
                if p != path:
                    path, free = p, 0
                if s >= free:
                    keep.append(i)
                    free = e
            yield b.take(pa.array(keep, pa.int64()))

    return pictures.repartition("path").sortWithinPartitions("path", "start").mapInArrow(run, pictures.schema)
