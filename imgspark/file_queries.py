"""Queries that write files and read them back, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.manifest import keep_last
from .sources import archives, byte_files
from .sources import derived as D
from .sources.shared import fresh, remove, shared_dir


def settled(frame: DataFrame, *scratch: str) -> DataFrame:
    """The rows as a reliable checkpoint, and the scratch folders that they came from removed."""
    shared_dir(frame.sparkSession)
    out = frame.checkpoint()
    for path in scratch:
        remove(frame.sparkSession, path)
    return out


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result for each document: its text as content, sixteen documents to a name, eight jobs."""
    d = F.col("doc_id")
    return D.read(spark, sf_dir, "documents").select(
        d.alias("image_id"), (d % 8).alias("job_id"), F.concat(F.lit("text-"), F.floor(d / 16).cast("string"), F.lit(".txt")).alias("name"), d.alias("seq"), F.coalesce("text", F.lit("")).cast("binary").alias("content")
    )


def archive_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the directories of one archive a job say, held against the entries that lie where they point. Members are stored
    as they are, so that SQL can say where each begins."""
    rows, scratch = archives.laid_out(texts(spark, sf_dir), "2026-01-02", deflate=False)
    entries = settled(archives.read_entries(rows), scratch)
    local = entries.filter("kind = 'local'").select("job_id", "at", F.col("name").alias("local_name"), F.col("crc").alias("local_crc"), "sha256")
    named = entries.filter("kind = 'directory'").drop("sha256").join(local, ["job_id", "at"]).filter("name = local_name and crc = local_crc")
    return named.select("job_id", "name", "at", "size", "sha256")


def written_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every result as a file of its own, the last of equal names, written by the data source and read back."""
    at = fresh(spark, "written-files")
    last = keep_last(texts(spark, sf_dir).withColumn("content", F.concat(F.col("name").cast("binary"), F.col("content"))), "job_id", "name", "seq")
    byte_files.save(last.select(F.concat(F.col("job_id").cast("string"), F.lit("/"), "name").alias("path"), "content"), at)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(at)
    name = F.split(F.col("path"), "/")
    return settled(found.select(F.element_at(name, -2).cast("long").alias("job_id"), F.element_at(name, -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")), at)


LAST = """WITH t AS (SELECT doc_id % 8 AS job_id, 'text-' || (doc_id // 16) || '.txt' AS name, doc_id AS seq, coalesce(text, '') AS text FROM documents),
 k AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY job_id, name ORDER BY seq DESC) = 1)"""

TABLE = {
    "archive_layout": (archive_layout, LAST + """ SELECT job_id, name, CAST(coalesce(sum(30 + strlen(name) + strlen(text)) OVER (PARTITION BY job_id ORDER BY seq, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at,
 CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256 FROM k"""),
    "written_files": (written_files, LAST + " SELECT job_id, name, CAST(strlen(name || text) AS BIGINT) AS size, sha256(name || text) AS sha256 FROM k"),
}
