"""Live progress of jobs with state against the batch query over all events."""

import random

import pytest
from pyspark.sql import functions as F

from imgspark.operators import progress
from imgspark.sources import derived
from imgspark.streaming.jobs import PROVIDER, stream_jobs


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def followed(spark, tmp_path, queue, batches, schema, name, **options):
    """The rows that the stream gives for batches of events, in order."""
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = []
    write = stream_jobs(queue, stream, shards=3, **options).writeStream.foreachBatch(lambda b, n: out.append([r.asDict() for r in b.collect()]))
    q = write.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(400)
    if q.exception():
        raise q.exception()
    return out


def by_batch(spark, queue, events):
    want = {}
    for (job,) in events.select("job_id").distinct().collect():
        own = events.filter(F.col("job_id") == job)
        known = own.join(queue, ["job_id", "image_id"], "left_semi")
        span = known.agg((F.max(F.unix_timestamp(F.col("ts").cast("timestamp"))) - F.min(F.unix_timestamp(F.col("ts").cast("timestamp"))))).first()[0]
        if span is not None:
            want[job] = progress.batch_progress(queue.filter(F.col("job_id") == job), own, span).first().asDict()
    return want


def test_any_order_of_events_gives_the_batch_rows(rocks, sf_dir, tmp_path):
    events = derived.progress_events(rocks, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    queue = derived.manifest(rocks, sf_dir).select("image_id", "job_id").filter("image_id % 9 <> 4")
    rows = events.collect()
    random.Random(5).shuffle(rows)
    batches = [rows[i::3] for i in range(3)]
    out = followed(rocks, tmp_path, queue, batches, events.schema, "jobs", late="1000 days", idle="3000 days")
    last = {r["job_id"]: r for b in out for r in b}
    assert last == by_batch(rocks, queue, events) and len(last) > 3
    assert max(len({r["job_id"] for r in b}) - len(b) for b in out) == 0


def test_idle_jobs_leave_and_changed_ones_alone_are_told(rocks, tmp_path):
    schema = "job_id long, image_id long, event_id long, ts timestamp, progress_pct long, kind string"
    at = lambda h: __import__("datetime").datetime(2024, 1, 1 + h // 24, h % 24)
    queue = rocks.createDataFrame([(j, i) for j in (1, 2) for i in range(4)], "job_id long, image_id long")
    batches = [
        [(1, 0, 1, at(1), 40, "progress"), (1, 1, 2, at(1), 10, "progress"), (2, 0, 3, at(1), 50, "progress"), (1, 99, 4, at(1), 90, "progress")],
        [(1, 0, 5, at(2), None, "done"), (1, 1, 6, at(0), 99, "progress")],
        [(2, 1, 7, at(40), 20, "progress")],
        [(2, 2, 8, at(60), 20, "progress")],
        [(1, 2, 9, at(61), 100, "progress"), (2, 3, 10, at(61), 30, "progress")],
    ]
    out = followed(rocks, tmp_path, queue, batches, schema, "idle", late="0 seconds", idle="10 hours")
    told = [(r["job_id"], r["total"], r["finished"], r["percent"]) for b in out for r in b]
    assert told[:3] == [(1, 4, 0, 13), (2, 4, 0, 13), (1, 4, 1, 28)] or told[:3] == [(2, 4, 0, 13), (1, 4, 0, 13), (1, 4, 1, 28)]
    assert all(j == 2 for j, *_ in told[3:])  # job 1 had been idle for more than ten hours: it is forgotten, and so are its items
