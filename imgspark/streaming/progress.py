"""Progress as streams. An event that is older than an item's latest changes nothing, so late delivery gives the batch result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.progress import latest

TIMERS = "job_id long, image_id long, reason string, since timestamp, due timestamp"


def stream_latest(events: DataFrame) -> DataFrame:
    """The latest kind and progress of each item; the state is a row an item. Write it in update mode, or complete to a table."""
    return latest(events)


def stream_stalled(events: DataFrame, gap: str = "180 seconds", late: str = "10 minutes") -> DataFrame:
    """One row for each session of an item; a further row of an item means that it was silent for longer than the gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("job_id", "image_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("events"), F.max("progress_pct").alias("progress_pct"))


def stream_timers(events: DataFrame, gap_seconds: int = 180, limit_seconds: int | None = None, late: str = "10 minutes") -> DataFrame:
    """Items as their timers run out: reason `silent` (no event for the gap) or `time limit` (no end within the limit).

    Each event arms the item's timer again; done and failed end it. An item that never speaks again is reported once other
    items' events have moved the watermark past its timer. since: the event that armed it, or the run's first one; due: when it
    ran out. A reported item begins anew with its next event. State: two times an item."""
    gap, limit = pd.Timedelta(seconds=gap_seconds), pd.Timedelta(seconds=limit_seconds) if limit_seconds else None

    def expired(first: pd.Timestamp, last: pd.Timestamp) -> tuple[str, pd.Timestamp, pd.Timestamp]:
        silent = ("silent", last, last + gap)
        return silent if limit is None or last + gap <= first + limit else ("time limit", first, first + limit)

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        first, last = map(pd.Timestamp, state.get) if state.exists else (None, None)
        found = []
        if state.hasTimedOut:
            found.append(expired(first, last))
            first = None
        else:
            for r in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():
                if first is not None and r.ts > (due := expired(first, last))[2]:
                    found.append(due)
                    first = None
                if r.kind in ("done", "failed"):
                    first = None
                else:
                    first, last = (r.ts, r.ts) if first is None else (first, max(last, r.ts))
        if first is None:
            if state.exists:
                state.remove()
        else:
            state.update((first.to_pydatetime(), last.to_pydatetime()))
            # as whole milliseconds behind the last moment that is still in time
            state.setTimeoutTimestamp(max(int(expired(first, last)[2].timestamp() * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(*key, *x) for x in found], columns=["job_id", "image_id", "reason", "since", "due"])

    timed = events.select("job_id", "image_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "kind").withWatermark("ts", late)
    return timed.groupBy("job_id", "image_id").applyInPandasWithState(watch, TIMERS, "first timestamp, last timestamp", "append", "EventTimeTimeout")
