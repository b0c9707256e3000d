"""One ZIP archive for each job, made by many tasks.

Members are deflated where their rows are and stored once, as ready local entries. Names, sizes and checksums alone then get
their offsets, by running sums that no group has to fit a task for; a directory entry is a row like a member. The writer streams an
archive's rows in order of their place, a member at a time. ZIP64 fields stand where an offset, a size or a count needs them.

Of equal names in a job the last stays. Defined cases: null content is an empty member; rows without a name or a job are left out, an
archive can't name them; a job without rows has no archive; a name is stored as UTF-8 as it is.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.manifest import keep_last_bytes
from ..operators.rasters import over_rows
from ..operators.scan import prefix_sums
from .byte_files import save
from .shared import fresh, remove

LIMIT = 0xFFFFFFFF
MANY = 0xFFFF
UTF8 = 0x800
MEMBERS = "job_id long, name string, seq long, method int, crc long, packed long, size long, entry_bytes long, entry binary"


def dos_date(date: str) -> int:
    """YYYY-MM-DD as a day of the format."""
    y, m, d = map(int, date.split("-"))
    return (y - 1980) << 9 | m << 5 | d


def members(results: DataFrame, date: str, deflate: bool = True) -> DataFrame:
    """A ready local entry for each of results (image_id, job_id, name, seq, content), the last of equal names."""
    day = dos_date(date)

    def make(r: dict) -> list[dict]:
        name, content = r["name"].encode(), r["content"] or b""
        method, data = 0, content
        if deflate and content:
            squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
            data = squeeze.compress(content) + squeeze.flush()
            method = 8
        crc = zlib.crc32(content)
        head = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 20, UTF8, method, 0, day, crc, len(data), len(content), len(name), 0)
        entry = head + name + data
        return [{"job_id": r["job_id"], "name": r["name"], "seq": r["seq"], "method": method, "crc": crc, "packed": len(data), "size": len(content), "entry_bytes": len(entry), "entry": entry}]

    kept = keep_last_bytes(results.filter("job_id is not null and octet_length(name) between 1 and 65535"), "job_id", "name", "seq")
    return over_rows(kept.select(F.col("job_id").cast("long"), "name", F.col("seq").cast("long"), "content"), MEMBERS, make, slice_rows=4)


def directory(sized: DataFrame, limit: int = LIMIT) -> DataFrame:
    """sized (all of MEMBERS but the entry) with `at`, the place of its local entry, and `directory_at`, that of its directory entry
    behind the first one's."""
    far = prefix_sums(sized, "job_id", ["seq", "name"], {"at": "entry_bytes"})
    far = far.withColumn("directory_bytes", 46 + F.octet_length("name") + F.when(F.col("at") >= limit, 12).otherwise(0))
    return prefix_sums(far, "job_id", ["seq", "name"], {"directory_at": "directory_bytes"})


def directory_rows(placed: DataFrame, date: str, limit: int = LIMIT) -> DataFrame:
    """job_id, at and content of the directory entries and of what ends each archive."""
    day = dos_date(date)
    jobs = placed.groupBy("job_id").agg(F.sum("entry_bytes").alias("start"), F.sum("directory_bytes").alias("length"), F.count(F.lit(1)).alias("n"))

    def entry(r: dict) -> list[dict]:
        name, far = r["name"].encode(), r["at"] >= limit
        extra = struct.pack("<HHQ", 1, 8, r["at"]) if far else b""
        head = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45 if far else 20, UTF8, r["method"], 0, day, r["crc"], r["packed"], r["size"], len(name), len(extra), 0, 0, 0, 0, LIMIT if far else r["at"])
        return [{"job_id": r["job_id"], "at": r["start"] + r["directory_at"], "content": head + name + extra}]

    def end(r: dict) -> list[dict]:
        start, length, n = r["start"], r["length"], r["n"]
        out = b""
        if start >= limit or length >= limit or n >= min(MANY, limit):
            out += struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, length, start)
            out += struct.pack("<4sIQI", b"PK\x06\x07", 0, start + length, 1)
            n, length, start = MANY, LIMIT, LIMIT
        return [{"job_id": r["job_id"], "at": r["start"] + r["length"], "content": out + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, n, n, length, start, 0)}]

    schema = "job_id long, at long, content binary"
    entries = over_rows(placed.join(jobs.select("job_id", "start"), "job_id"), schema, entry)
    return entries.unionByName(over_rows(jobs, schema, end))


def laid_out(results: DataFrame, date: str, deflate: bool = True, limit: int = LIMIT) -> tuple[DataFrame, str]:
    """(job_id, at, content) of every piece of the archives, and the scratch folder where deflated members lie until they are written."""
    spark = results.sparkSession
    scratch = fresh(spark, "zip-members")
    members(results, date, deflate).write.parquet(scratch)
    stored = spark.read.parquet(scratch)
    placed = directory(stored.drop("entry"), limit)
    local = stored.select("job_id", "name", F.col("entry").alias("content")).join(placed.select("job_id", "name", "at"), ["job_id", "name"]).select("job_id", "at", "content")
    return local.unionByName(directory_rows(placed, date, limit)), scratch


def write_archives(results: DataFrame, folder: str, prefix: str, date: str, deflate: bool = True, limit: int = LIMIT) -> None:
    """folder/<job_id>/<prefix>-export-<date>.zip for each job of results (image_id, job_id, name, seq, content)."""
    rows, scratch = laid_out(results, date, deflate, limit)
    path = F.concat(F.col("job_id").cast("string"), F.lit(f"/{prefix}-export-{date}.zip"))
    save(rows.repartition("job_id").sortWithinPartitions("job_id", "at").select(path.alias("path"), "content"), folder)
    remove(results.sparkSession, scratch)


def read_entries(rows: DataFrame) -> DataFrame:
    """What the pieces of laid_out() say when they are read back: job_id, kind (local, directory), name, at, crc, size and sha256.

    at is where a member's local entry lies: by its place, or by the directory. A member whose bytes don't have the checksum
    that its entry names fails the job."""

    def read(r: dict) -> list[dict]:
        b = r["content"]
        if b[:4] == b"PK\x03\x04":
            method, crc, packed, size, n, extra = (struct.unpack_from(f"<{f}", b, at)[0] for f, at in (("H", 8), ("I", 14), ("I", 18), ("I", 22), ("H", 26), ("H", 28)))
            data = b[30 + n + extra :]
            data = zlib.decompress(data, -15) if method == 8 else data
            if zlib.crc32(data) != crc or len(data) != size or len(b) != 30 + n + extra + packed:
                raise ValueError(f"{b[30 : 30 + n]!r} is damaged")
            return [{"job_id": r["job_id"], "kind": "local", "name": b[30 : 30 + n].decode(), "at": r["at"], "crc": crc, "size": size, "data": data}]
        if b[:4] == b"PK\x01\x02":
            crc, size, n, extra, at = (struct.unpack_from(f"<{f}", b, k)[0] for f, k in (("I", 16), ("I", 24), ("H", 28), ("H", 30), ("I", 42)))
            at = struct.unpack_from("<Q", b, 50 + n)[0] if extra else at
            return [{"job_id": r["job_id"], "kind": "directory", "name": b[46 : 46 + n].decode(), "at": at, "crc": crc, "size": size, "data": None}]
        return []

    return over_rows(rows, "job_id long, kind string, name string, at long, crc long, size long, data binary", read, slice_rows=4).withColumn("sha256", F.sha2("data", 256)).drop("data")
