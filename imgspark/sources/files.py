"""Files: intake in batch and stream, decoding, embedded pictures, single files as a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import manifest as M
from ..operators.manifest import keep_last_bytes
from ..operators.pictures import embedded_pictures
from ..operators.rasters import over_rows
from .byte_files import save
from .byte_ranges import RANGE_BYTES, ranges_of
from .listing import listed

#: MIME types by extension, for files that come without one.
BY_EXTENSION = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif", "avif": "image/avif", "bmp": "image/bmp"}


def _listed(files: DataFrame, batch_id: str) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    mime = F.lit("")
    for extension, m in BY_EXTENSION.items():
        mime = F.when(F.lower(name).endswith(f".{extension}"), m).otherwise(mime)
    rows = files.select(F.sha2(F.concat("path", F.lit(batch_id)), 256).alias("image_id"), "path", name.alias("name"), mime.alias("mime"), F.col("length").alias("size_bytes"))
    return rows.filter(M.is_image(F.col("name"), F.col("mime")))


def read_images(spark: SparkSession, path: str, batch_id: str, deep: bool = False) -> DataFrame:
    """The accepted files of a folder, without their bytes. A file that comes in two batches is two items.

    Tasks list the folder, so no file passes the driver. A folder is listed in one task; deep: those right below it are part of the
    intake, so many files should lie in many of them. Patterns, and stores that only Spark opens, are listed by Spark on the driver.
    Files of no bytes are never items, as with Spark's file sources."""
    found = listed(spark, path, deep)
    if found is None:
        found = spark.read.format("binaryFile").load(path if not deep else [path, f"{path}/*"]).drop("content")
    return _listed(found, batch_id)


def stream_images(spark: SparkSession, path: str, batch_id: str, deep: bool = False) -> DataFrame:
    """The same as a stream. Which files came before is state by their paths, kept by executors."""
    found = listed(spark, path, deep, stream=True)
    if found is not None:
        return _listed(found.dropDuplicates(["path"]), batch_id)
    schema = "path string, modificationTime timestamp, length long, content binary"
    return _listed(spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", str(deep).lower()).load(path), batch_id)


def decode_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rasters in RGB order by path, files that can't be decoded)."""
    images = spark.read.format("image").load(path).select("image.*")
    good = images.filter("height > 0").select(F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("channels"), F.lit(8).alias("bits"), "data")

    def swap(r: dict) -> list[dict]:
        import numpy as np

        a = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"])
        return [r | {"data": (a[..., [2, 1, 0, *range(3, a.shape[2])]] if a.shape[2] >= 3 else a).tobytes()}]

    rasters = over_rows(good, "path string, height int, width int, channels int, bits int, data binary", swap)
    # the failures are the listed files less the decoded ones, whatever the image source does with a file it can't read
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    listed = spark.read.format("binaryFile").load(path).select("path").withColumn("key", plain("path"))
    bad = listed.join(good.select(plain("path").alias("key")), "key", "left_anti")
    return rasters, bad.select("path", F.lit("not a picture").alias("error"))


def jpeg_candidates(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every picture embedded in files (path, content): path, start, end, width, height. Files that are too large for a row come by
    read_ranges() straight to embedded_pictures()."""
    return embedded_pictures(ranges_of(files, range_bytes), range_bytes)


def best_embedded_jpeg(candidates: DataFrame) -> DataFrame:
    """The largest by bytes, then by pixels, then the first."""
    order = Window.partitionBy("path").orderBy((F.col("end") - F.col("start")).desc(), (F.col("width") * F.col("height")).desc(), "start")
    return candidates.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")


def write_files(results: DataFrame, directory: str, mode: str = "append") -> DataFrame:
    """Every result (image_id, job_id, name, seq, content) as a file of its own under directory/job_id, the last of equal names.

    All files appear when the job is done, or none (byte_files). Separators in a name become underscores. Returns image_id and error
    of the results that have no job or a name that no file can have; these are not written."""
    name = F.regexp_replace("name", r"[/\\]", "_")
    bad = F.col("job_id").isNull() | F.col("name").isNull() | name.isin("", ".", "..")
    kept = keep_last_bytes(results.filter(~bad).withColumn("name", name), "job_id", "name", "seq")
    save(kept.select(F.concat_ws("/", F.col("job_id").cast("string"), "name").alias("path"), "content"), directory, mode)
    return results.filter(bad).select("image_id", F.lit("no file name").alias("error"))
