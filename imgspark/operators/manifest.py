"""Queue and result tables: planning, upserts, collisions and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import manifest as M


def accepted(files: DataFrame) -> DataFrame:
    return files.filter(M.is_image(F.col("name"), F.col("mime")))


def plan(manifest: DataFrame, options: DataFrame) -> DataFrame:
    """manifest with route, out_w, out_h, out_mime, out_name and quality. options: one row a job, so it is broadcast by size."""
    m = manifest.join(options, "job_id")
    c = F.col
    forced = F.when(c("operation") == "resize", "original").when(c("operation") == "remove-background", "png").otherwise(c("format"))
    m = m.withColumns({"raw": M.is_raw(c("name"), c("mime")), "format": forced})
    m = m.withColumn("out_mime", M.output_mime(c("format"), c("mime"), c("raw")))
    m = m.withColumn("route", M.route(c("operation"), c("format"), c("mime"), c("raw"), c("out_mime")))
    w, h = M.plan_size(c("operation"), c("percentage"), c("opt_width"), c("opt_height"), c("keep_aspect"), c("width"), c("height"))
    whole = c("route").isin("pass-through", "remove-background")
    return m.select(
        *manifest.columns, "route", "out_mime",
        F.when(whole, F.lit(None)).otherwise(w).alias("out_w"), F.when(whole, F.lit(None)).otherwise(h).alias("out_h"),
        M.output_name(c("name"), c("out_mime"), c("route")).alias("out_name"),
        M.encode_quality(c("operation"), c("quality_percent"), c("out_mime")).alias("quality"),
    )


def drop_items(queue: DataFrame, gone: DataFrame) -> DataFrame:
    return queue.join(gone.select("image_id"), "image_id", "left_anti")


def append_items(queue: DataFrame, batch: DataFrame) -> DataFrame:
    """Both batches; files that come twice stay twice."""
    return queue.unionByName(batch)


def upsert_refinements(results: DataFrame, edits: DataFrame) -> DataFrame:
    """Size (and content, if there) of refined results replaced, the rest of the row kept."""
    changed = [c for c in edits.columns if c != "image_id"]
    e = edits.select("image_id", *[F.col(c).alias(f"new_{c}") for c in changed])
    return results.join(e, "image_id", "left").select(*[F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) if c in changed else F.col(c) for c in results.columns])


def with_restore_source(results: DataFrame, sources: DataFrame) -> DataFrame:
    """Each result with the size of its source, or its own where the source is missing, and the scale between them."""
    s = sources.select("image_id", F.col("width").alias("source_w"), F.col("height").alias("source_h"))
    r = results.join(s, "image_id", "left")
    return r.withColumns({"source_w": F.coalesce("source_w", "width"), "source_h": F.coalesce("source_h", "height")})


def keep_last(results: DataFrame, bundle: str, name: str, seq: str) -> DataFrame:
    """Of equal names in a bundle the last stays; max_by merges before the shuffle, so a hot name moves a row a task."""
    return results.groupBy(bundle, name).agg(F.max_by(F.struct("*"), F.col(seq)).alias("row")).select("row.*")


def keep_last_bytes(results: DataFrame, bundle: str, name: str, seq: str) -> DataFrame:
    """keep_last() for results with `content`: names and ids are merged, the bytes of the rows that stay join them afterwards."""
    ids = [c for c in dict.fromkeys(["image_id", bundle, name, seq]) if c in results.columns]
    last = keep_last(results.select(*ids), bundle, name, seq).select(*[F.col(c).alias(f"_{c}") for c in ids])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ids]
    return results.join(last, same, "left_semi")


def queue_summary(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum("size_bytes").alias("total_bytes"))


def savings_summary(results: DataFrame) -> DataFrame:
    """Growth never counts against what others save."""
    done = F.col("status") == "done"
    saved = F.sum(F.when(done, F.greatest(F.lit(0), F.col("original_size") - F.col("output_size"))).otherwise(0))
    return results.groupBy("job_id").agg(F.count_if(done).alias("n_results"), saved.alias("saved_bytes"))


def run_summary(results: DataFrame) -> DataFrame:
    """Counts, and the first failure by order of completion."""
    failed = F.col("status") == "error"
    message = F.concat_ws(": ", F.col("name"), F.col("error"))
    return results.groupBy("job_id").agg(
        F.count_if(~failed).alias("completed"), F.count_if(failed).alias("failed"), F.min_by(F.when(failed, message), F.when(failed, F.col("finish_seq"))).alias("first_failure")
    )
