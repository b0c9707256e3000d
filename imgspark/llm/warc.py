"""WARC archives: writing records, resolving revisits by payload digest, reading them back.

Archives are written by Spark's text writer with two line ends after every row, which is just what ends a WARC record, so
they land on any file system that Spark knows and a lost task is written anew; a file is one gzip member. They are read as rows
between double line ends, in order and a file to a task as gzip can't be split, and put together by Content-Length, so memory
holds one record and never a file. Length and digest of a payload are worked out again and have to match its headers.

Resolution: the headers alone, without payloads, are shuffled by payload digest. Partial minima find the original of each
digest, the smallest identifier; all other records with that digest become revisits that refer to it. A revisit keeps
digest and length of the full payload in its headers. Records that come in as revisits are resolved likewise. A record that is
written again gets an id of its own, made of the file and the place that it came from, so rows that repeat have different ids.

Defined cases: a null payload counts as empty; payloads shorter than min_bytes are always responses; a null URL is left
out; line ends in a URL are percent-encoded; of repeated rows (equal page_id and payload) the first by file position is
the response and the others revisit it; a null page_id is written as an empty header, read as null, and comes last; an
empty table gives archives without records; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, remove, scratch, whole

END = "\r\n"
#: WARC-Date of records whose table has no capture time.
NO_DATE = "1970-01-01T00:00:00Z"
RECORDS_IN_FILE = 1000
FIELDS = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long"
HEADER = re.compile(rb"^([A-Za-z-]+): *(.*)$")


def uuid_of(text: Column) -> Column:
    return F.regexp_replace(F.md5(text), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def record_text(date: str = NO_DATE) -> Column:
    """The record, less the two line ends after it, as an expression over record_id, page_id, url, record_type,
    payload_digest, payload_bytes, refers_to, refers_to_record and payload."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    urn = lambda c: F.concat(F.lit("<urn:uuid:"), F.col(c), F.lit(">"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    revisit = F.col("record_type") == "revisit"
    head = F.concat(F.lit("HTTP/1.1 200 OK" + END), line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit(END))
    body = F.concat(head, F.when(revisit, F.lit("")).otherwise(whole(F.col("payload"))))
    return F.concat(
        F.lit("WARC/1.1" + END),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn("record_id")),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("X-Page-Id", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", urn("refers_to_record")),
                F.coalesce(line("X-Refers-To-Page-Id", F.col("refers_to").cast("string")), F.lit("")),
            ),
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit(END),
        body,
    )


def write_archives(records: DataFrame, path: str, date: str = NO_DATE, records_in_file: int = RECORDS_IN_FILE) -> None:
    writer = records.select(record_text(date).alias("value")).write.option("lineSep", END * 2).option("maxRecordsPerFile", records_in_file)
    writer.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers by lower-case name, and block of each record of a file that comes in pieces."""
    held, start, need, headers = bytearray(), 0, None, {}
    for piece in pieces:
        held += piece
        while True:
            if need is None and (end := held.find(b"\r\n\r\n")) >= 0:
                first, *lines = bytes(held[:end]).split(b"\r\n")
                if not first.startswith(b"WARC/"):
                    raise ValueError(f"no record at {start}")
                headers = {m[1].decode().lower(): m[2].decode() for x in lines if (m := HEADER.match(x))}
                body = end + 4
                need = body + int(headers["content-length"])
            if need is None or len(held) < need + 4:
                break
            yield start, headers, bytes(held[body:need])
            del held[: need + 4]
            start, need = start + need + 4, None
    if held.strip():
        raise ValueError(f"a record at {start} has no end")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each record: file, offset, record_id, page_id, url, record_type, payload_digest, payload_bytes, refers_to and payload."""
    kinds = {"file": pa.string(), "offset": pa.int64(), "record_id": pa.string(), "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
    schema = pa.schema(kinds | ({"payload": pa.string()} if payloads else {}))

    def row(file: str, offset: int, h: dict[str, str], block: bytes) -> dict:
        number = lambda x: int(x) if x else None
        payload, digest, n = block.partition(b"\r\n\r\n")[2], h["warc-payload-digest"].removeprefix("sha256:"), int(h["x-payload-length"])
        if h["warc-type"] != "revisit" and (len(payload), hashlib.sha256(payload).hexdigest()) != (n, digest):
            raise ValueError(f"{file} at {offset}: the payload is not the one of its headers")
        out = {"file": file, "offset": offset, "record_id": h["warc-record-id"][10:-1], "page_id": number(h.get("x-page-id")), "url": h.get("warc-target-uri"), "record_type": h["warc-type"], "payload_digest": digest, "payload_bytes": n, "refers_to": number(h.get("x-refers-to-page-id"))}
        return out | ({"payload": payload.decode()} if payloads else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((name.as_py(), part.as_buffer().to_pybytes() + b"\r\n\r\n") for b in batches for name, part in zip(b.column(0), b.column(1), strict=True))
        rows, held = [], 0
        for name, own in groupby(pieces, key=lambda x: x[0]):
            for offset, headers, block in parse(x for _, x in own):
                rows.append(row(name, offset, headers, block))
                held += len(block) * payloads + 300
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    # the text reader undoes the compression, whatever the file system
    parts = spark.read.option("lineSep", END * 2).text(path).select(F.input_file_name().alias("file"), "value")
    return parts.mapInArrow(run, f"file string, offset long, record_id string, {FIELDS}" + ", payload string" * payloads)


def resolve(headers: DataFrame, min_bytes: int = 100) -> DataFrame:
    """file and offset of each record with its new record_id and its record_type, refers_to and refers_to_record after resolution."""
    order = F.struct(F.col("page_id").isNull(), "page_id", "file", "offset")
    first = headers.filter(F.col("payload_bytes") >= min_bytes).groupBy(F.col("payload_digest").alias("_digest")).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    fresh = lambda file, offset: uuid_of(F.concat_ws(" ", file, offset.cast("string")))
    joined = headers.join(first, (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") >= min_bytes), "left")
    again = F.col("_first").isNotNull() & ((F.col("file") != F.col("_first.file")) | (F.col("offset") != F.col("_first.offset")))
    return joined.select(
        "file", "offset", fresh(F.col("file"), F.col("offset")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("_first.page_id")).alias("refers_to"), F.when(again, fresh(F.col("_first.file"), F.col("_first.offset"))).alias("refers_to_record"),
    )


def deduplicate_archives(spark: SparkSession, source: str, target: str, min_bytes: int = 100) -> None:
    """Write the archives in source to target with repeated payloads as revisits.

    A payload is at hand only where its record is no revisit, so in source the first record of a digest must have it."""
    decided = resolve(cut(read_archives(spark, source, payloads=False)), min_bytes)
    records = read_archives(spark, source).drop("record_id", "record_type", "refers_to").join(decided, ["file", "offset"])
    write_archives(records, target)


def page_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write one response record for each page."""
    payload = whole(F.col(html).cast("string"))
    records = pages.select(
        F.expr("uuid()").alias("record_id"), F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.lit("response").alias("record_type"), F.sha2(payload.cast("binary"), 256).alias("payload_digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_to_record"), payload.alias("payload"),
    )
    write_archives(records, path)


def warc_revisits(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Pages written as archives, these written again without repeated payloads, and what is read back from the latter."""
    spark = pages.sparkSession
    raw, lean = scratch(spark, "warc-raw"), scratch(spark, "warc-lean")
    page_archives(pages, raw)
    deduplicate_archives(spark, raw, lean, min_bytes)
    remove(spark, raw)
    back = cut(read_archives(spark, lean, payloads=False).select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    remove(spark, lean)
    return back
