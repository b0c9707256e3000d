"""Progress of running jobs, from their events, as batch queries. Latest is by (ts, event_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.manifest import half_up


def latest(events: DataFrame) -> DataFrame:
    order = F.struct("ts", "event_id")
    return events.groupBy("job_id", "image_id").agg(F.max_by("kind", order).alias("kind"), F.max_by("progress_pct", order).alias("progress_pct"))


def batch_progress(queue: DataFrame, events: DataFrame, elapsed: int) -> DataFrame:
    """Per job: finished, percent, seconds left after `elapsed` seconds, and the item at work. Items without an event count 0."""
    ended = F.col("kind").isin("done", "failed")
    p = F.when(ended, 100).otherwise(F.coalesce("progress_pct", F.lit(0)))
    items = queue.select("job_id", "image_id").join(latest(events), ["job_id", "image_id"], "left")
    jobs = items.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(ended).alias("finished"), F.sum(p).alias("points"))
    return job_rows(jobs, elapsed)


def job_rows(jobs: DataFrame, elapsed: int | Column) -> DataFrame:
    """The rows of batch_progress() from job_id, total, finished and points (100 a finished item)."""
    mean = F.col("points") / (F.col("total") * 100)
    return jobs.select(
        "job_id", "total", "finished", F.least(F.lit(99), half_up(mean * 100)).cast("long").alias("percent"),
        F.when(mean > 0.03, F.greatest(F.lit(0), half_up(elapsed / mean - elapsed))).cast("long").alias("seconds_left"),
        F.least(F.col("finished") + 1, F.col("total")).alias("current"),
    )


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")).cast("long")


def _runs(events: DataFrame, now: str | None) -> DataFrame:
    """events with `at` and `following`, the times of an event and of the item's next one in microseconds, and `run`.

    A timer runs from an item's event to its next one, and to `now` (the latest event of all if it is None) from the last; after
    done or failed none runs, and what follows is another run of the item."""
    line = Window.partitionBy("job_id", "image_id").orderBy("ts", "event_id")
    end = events.agg(F.max(_micros(F.col("ts")))).first()[0] if now is None else events.sparkSession.sql(f"select unix_micros(timestamp '{now}')").first()[0]
    e = events.withColumns({"at": _micros(F.col("ts")), "ended": F.col("kind").isin("done", "failed")})
    before = F.count_if("ended").over(line.rowsBetween(Window.unboundedPreceding, -1))
    following = F.coalesce(F.lead("at").over(line), F.greatest(F.lit(end), F.col("at")))
    return e.withColumns({"following": following, "run": F.coalesce(before, F.lit(0))})


def stalled_items(events: DataFrame, gap_seconds: int = 180, now: str | None = None) -> DataFrame:
    """Items that were silent at work for longer than the gap, before a later event or until now, with the longest silence."""
    silent = _runs(events, now).filter(~F.col("ended")).withColumn("silence", F.col("following") - F.col("at"))
    return silent.filter(F.col("silence") > gap_seconds * 1_000_000).groupBy("job_id", "image_id").agg(F.max("silence").alias("longest_us"), F.count(F.lit(1)).alias("stalls"))


def overdue_items(events: DataFrame, limit_seconds: int = 90, now: str | None = None) -> DataFrame:
    """Runs of items that took longer than the limit from their first event to their end, or until now if they have none."""
    until = F.max(F.when(F.col("ended"), F.col("at")).otherwise(F.col("following")))
    spans = _runs(events, now).groupBy("job_id", "image_id", "run").agg((until - F.min("at")).alias("span_us"))
    return spans.filter(F.col("span_us") > limit_seconds * 1_000_000)
