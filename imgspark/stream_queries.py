"""Queries that run as streams over the given tables, to their end, with the SQL of the same result."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .file_queries import settled
from .sources import byte_files
from .sources import derived as D
from .sources import files as FS
from .sources.shared import fresh
from .streaming.jobs import PROVIDER, stream_jobs

STATE = "spark.sql.streaming.stateStore.providerClass"
FOREVER = "36500 days"
#: Files of a folder of the intake.
FILES = 4096


@contextmanager
def provider(spark: SparkSession) -> Iterator[None]:
    """Streams that start in here keep their state in RocksDB."""
    before = spark.conf.get(STATE, None)
    spark.conf.set(STATE, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(STATE) if before is None else spark.conf.set(STATE, before)


def streamed_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live progress of every job, its events delivered in four shuffled parts: the last row that the stream has told."""
    at = fresh(spark, "streamed-progress")
    events = D.progress_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(4, F.xxhash64("event_id")).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    jobs = stream_jobs(D.manifest(spark, sf_dir), stream, shards=4, idle=FOREVER, late=FOREVER)
    tell = lambda batch, n: batch.withColumn("n", F.lit(n)).write.mode("overwrite").parquet(f"{at}/out/batch-{n}")
    with provider(spark):
        jobs.writeStream.foreachBatch(tell).outputMode("append").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    told = spark.read.parquet(f"{at}/out/*")
    return settled(told.groupBy("job_id").agg(F.max_by(F.struct("*"), "n").alias("r")).select("r.*").drop("n"), at)


def taken_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder with a file for each row of the manifest, listed at once and as a stream that ends with what is there: names, types
    and sizes of the accepted files. The files lie in sub-folders of FILES at most, each of one task, so the driver knows of those alone."""
    at = fresh(spark, "intake")
    folder = F.floor(F.monotonically_increasing_id() / FILES).cast("string")
    named = D.manifest(spark, sf_dir).select(F.concat_ws("-", F.col("image_id").cast("string"), "name").alias("name"), folder.alias("folder"))
    byte_files.save(named.select(F.concat_ws("/", "folder", "name").alias("path"), F.col("name").cast("binary").alias("content")), f"{at}/drop")
    out = lambda files, way: files.select(F.lit(way).alias("way"), "name", "mime", "size_bytes")
    write = out(FS.stream_images(spark, f"{at}/drop", "day", deep=True), "stream").writeStream.format("parquet").option("path", f"{at}/streamed").option("checkpointLocation", f"{at}/state")
    with provider(spark):
        write.trigger(availableNow=True).start().awaitTermination()
    return settled(out(FS.read_images(spark, f"{at}/drop", "day", deep=True), "batch").unionByName(spark.read.parquet(f"{at}/streamed")), at)


def table(manifest: str, events: str, raw: str) -> dict[str, tuple]:
    kinds = " ".join(f"WHEN lower(name) LIKE '%.{e}' THEN '{m}'" for e, m in FS.BY_EXTENSION.items())
    return {
        "taken_in": (taken_in, f"WITH {manifest}, f AS (SELECT image_id || '-' || name AS name FROM manifest), t AS (SELECT name, CASE {kinds} ELSE '' END AS mime, strlen(name) AS size_bytes FROM f)"
                     f" SELECT way, name, mime, CAST(size_bytes AS BIGINT) AS size_bytes FROM t, (VALUES ('batch'), ('stream')) w(way) WHERE mime LIKE 'image/%' OR {raw}"),  # fmt: skip
        "streamed_progress": (streamed_progress, f"WITH {manifest}, {events}," + """ p AS (SELECT e.* FROM progress e SEMI JOIN manifest m USING (job_id, image_id)),
 l AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY job_id, image_id ORDER BY ts DESC, event_id DESC) = 1),
 t AS (SELECT job_id, (epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000)::DOUBLE AS s FROM p GROUP BY job_id),
 i AS (SELECT m.job_id, coalesce(kind IN ('done', 'failed'), FALSE) AS ended, coalesce(progress_pct, 0) AS pct FROM manifest m LEFT JOIN l USING (job_id, image_id)),
 j AS (SELECT job_id, count(*) AS total, count(*) FILTER (ended) AS finished, sum(CASE WHEN ended THEN 100 ELSE pct END)::DOUBLE / (count(*) * 100) AS mean FROM i GROUP BY job_id)
 SELECT job_id, total, finished, CAST(least(99, floor(mean * 100 + 0.5)) AS BIGINT) AS percent, CASE WHEN mean > 0.03 THEN CAST(greatest(0, floor(s / mean - s + 0.5)) AS BIGINT) END AS seconds_left, least(finished + 1, total) AS current FROM j JOIN t USING (job_id)"""),
    }
