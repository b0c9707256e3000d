"""Live progress of jobs as a stream whose batches cost what their events cost, however many items the jobs have.

The items of a job are dealt to shards. A shard keeps its items' latest events in a map and tells, once a batch, by how much its sums
have changed; a job adds up what its shards tell. Nothing is read again or rewritten between batches, and a job with most of
the events is as many groups as it has shards. A shard that has been silent for `idle` of event time lets go of its items, and
a job whose shards have all done so of its sums: ended jobs leave the state.

The queue comes in as the state that the stream begins with, so items without an event count and events of unknown items don't.
An event that is older than an item's latest changes nothing: after any order of delivery the sums are those of the batch query, as
long as no event is later than `late`, and none comes to a shard that has been idle.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

from ..operators.progress import job_rows

CHANGES = "job_id long, shard int, points long, finished long, first_us long, last_us long, gone boolean, ts timestamp"
SUMS = "job_id long, points long, finished long, first_us long, last_us long, ts timestamp"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Shard(StatefulProcessor):
    """Items of one shard of a job: their latest event by (ts, event_id)."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "image_id long", "at_us long, event_id long, points long, ended boolean")
        self.timer = handle.getValueState("timer", "due_ms long, last_us long")

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        self.items.updateValue((initialState.image_id,), (None, None, 0, False))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        points = finished = 0
        first = last = None
        for r in rows:
            known = self.items.getValue((r.image_id,)) if self.items.containsKey((r.image_id,)) else None
            if known is None:
                continue
            first = r.at_us if first is None else min(first, r.at_us)
            last = r.at_us if last is None else max(last, r.at_us)
            if known[0] is not None and (known[0], known[1]) > (r.at_us, r.event_id):
                continue
            points += r.points - known[2]
            finished += r.ended - known[3]
            self.items.updateValue((r.image_id,), (r.at_us, r.event_id, r.points, r.ended))
        if last is None:
            return
        due, before = self.timer.get() if self.timer.exists() else (None, last)
        if due is not None:
            self.handle.deleteTimer(due)
        last_of_all = max(last, before)
        due = max(last_of_all // 1000 + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(due)
        self.timer.update((due, last_of_all))
        yield Row(job_id=key[0], shard=key[1], points=points, finished=finished, first_us=first, last_us=last, gone=False, ts=_time(last, timerValues))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = self.timer.get()[1]
        self.items.clear()
        self.timer.clear()
        yield Row(job_id=key[0], shard=key[1], points=0, finished=0, first_us=None, last_us=None, gone=True, ts=_time(at, timerValues))

    def close(self) -> None:
        pass


class Job(StatefulProcessor):
    """Sums over the shards of a job, told again whenever they change."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "points long, finished long, first_us long, last_us long")
        self.shards = handle.getMapState("shards", "shard int", "there boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        points, finished, first, last = self.sums.get() if self.sums.exists() else (0, 0, None, None)
        changed = False
        for r in rows:
            if r.gone:
                if self.shards.containsKey((r.shard,)):
                    self.shards.removeKey((r.shard,))
                continue
            changed = True
            self.shards.updateValue((r.shard,), (True,))
            points, finished = points + r.points, finished + r.finished
            first = r.first_us if first is None else min(first, r.first_us)
            last = r.last_us if last is None else max(last, r.last_us)
        if not changed and next(iter(self.shards.keys()), None) is None:
            self.sums.clear()
            self.shards.clear()
        elif changed:
            self.sums.update((points, finished, first, last))
            yield Row(job_id=key[0], points=points, finished=finished, first_us=first, last_us=last, ts=_time(last, timerValues))

    def close(self) -> None:
        pass


def _time(us: int, timers: TimerValues) -> datetime:
    """For what is told on: never behind the watermark."""
    return datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=max(us, 1000 * (timers.getCurrentWatermarkInMs() + 1)))


def stream_jobs(queue: DataFrame, events: DataFrame, shards: int = 64, idle: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """A stream of batch_progress() rows, one for each job that a batch of events has changed; the last row of a job holds.

    Seconds left are reckoned from the job's own first and last event. The session has to keep state in RocksDB (PROVIDER).
    Write it in append mode."""
    spark = queue.sparkSession
    shard = F.pmod(F.xxhash64("image_id"), F.lit(shards)).cast("int").alias("shard")
    items = queue.select("job_id", shard, "image_id").distinct().groupBy("job_id", "shard")
    totals = queue.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"))
    idle_ms = int(spark.sql(f"select unix_millis(timestamp '1970-01-01' + interval {idle}) as n").first().n)
    ended = F.col("kind").isin("done", "failed")
    ts = F.col("ts").cast("timestamp")
    e = events.select("job_id", "image_id", "event_id", ts.alias("ts"), F.unix_micros(ts).alias("at_us"), F.when(ended, 100).otherwise(F.coalesce("progress_pct", F.lit(0))).cast("long").alias("points"), ended.alias("ended"))
    e = e.withWatermark("ts", late).select("*", shard)
    changes = e.groupBy("job_id", "shard").transformWithState(Shard(idle_ms), CHANGES, "Append", "EventTime", initialState=items, eventTimeColumnName="ts")
    sums = changes.groupBy("job_id").transformWithState(Job(), SUMS, "Append", "EventTime", eventTimeColumnName="ts")
    elapsed = F.floor(F.col("last_us") / 1_000_000) - F.floor(F.col("first_us") / 1_000_000)
    return job_rows(sums.join(totals, "job_id").withColumn("elapsed", elapsed), F.col("elapsed"))
