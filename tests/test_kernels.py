"""Kernels against slow loops, files through Spark's own readers, streams against their batch twins."""

import struct
import tracemalloc
import zlib
from datetime import timedelta
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from imgspark.functions import kernels as K
from imgspark.operators import edits, progress, rasters
from imgspark.operators import manifest as O
from imgspark.plans.convert import convert_all, predict_masks, process_images
from imgspark.sources import derived, files
from imgspark.streaming.progress import stream_latest, stream_stalled, stream_timers

RNG = np.random.default_rng(4)
MASKS = [RNG.random((h, w)) < p for h, w in ((1, 1), (1, 9), (9, 1), (7, 13), (40, 31)) for p in (0.2, 0.5, 0.8)] + [np.zeros((5, 5), bool), np.ones((6, 4), bool), np.indices((8, 8)).sum(0) % 2 == 0]


def loop_components(on):
    labels, n = np.zeros(on.shape, int), 0
    for y, x in np.argwhere(on):
        if labels[y, x]:
            continue
        n += 1
        stack = [(y, x)]
        while stack:
            a, b = stack.pop()
            if 0 <= a < on.shape[0] and 0 <= b < on.shape[1] and on[a, b] and not labels[a, b]:
                labels[a, b] = n
                stack += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return labels, n


@pytest.mark.parametrize("on", MASKS, ids=lambda m: str(m.shape))
def test_components(on):
    labels, n = K.components(on)
    want, m = loop_components(on)
    assert n == m and (labels == want).all()
    for label, area, x0, y0, x1, y1, first in K.component_stats(labels, n):
        ys, xs = np.nonzero(want == label)
        assert (area, x0, y0, x1, y1, first) == (len(ys), xs.min(), ys.min(), xs.max(), ys.max(), ys[0] * on.shape[1] + xs[0])


@pytest.mark.parametrize("on", MASKS, ids=lambda m: str(m.shape))
def test_pinholes_islands_and_holes(on):
    want = on.copy()
    for _ in range(2):
        old = want.copy()
        for y in range(1, on.shape[0] - 1):
            for x in range(1, on.shape[1] - 1):
                if old[y - 1 : y + 2, x - 1 : x + 2].sum() - old[y, x] >= 5:
                    want[y, x] = True
    assert (K.close_pinholes(on) == want).all()
    painted = RNG.random(on.shape) < 0.05
    labels, n = loop_components(on)
    hit = {labels[y, x] for y, x in np.argwhere(painted & on)}
    assert (K.keep_prompted(on, painted) == (np.isin(labels, list(hit)) & on if hit else on)).all()
    filled = K.fill_holes(on, np.ones(on.shape, bool), 4)
    assert (filled >= on).all()
    holes, m = loop_components(~on)
    for i in range(1, m + 1):
        ys, xs = np.nonzero(holes == i)
        border = (ys == 0).any() or (xs == 0).any() or (ys == on.shape[0] - 1).any() or (xs == on.shape[1] - 1).any()
        assert filled[ys[0], xs[0]] == (not border and len(ys) <= 24)


def test_sharpening_loop():
    a = RNG.integers(0, 65536, (6, 7, 3)).astype(np.uint16)
    got = K.sharpen16(a)
    for y in range(6):
        for x in range(7):
            for k in range(3):
                c = float(a[y, x, k])
                ring = sum(float(a[min(max(y + i, 0), 5), min(max(x + j, 0), 6), k]) for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0)))
                d = c - (4 * c + ring) / 8
                assert got[y, x, k] == (c if abs(d) < 256 else min(65535, max(0, np.floor(c + 0.42 * d + 0.5))))
    assert K.sharpen16(a[:2]) is not None and (K.sharpen16(a[:2]) == a[:2]).all()


def test_edge_filter_keeps_solid_pixels_and_flat_alpha():
    rgb, alpha = RNG.integers(0, 256, (9, 8, 3)).astype(np.uint8), RNG.integers(0, 256, (9, 8)).astype(np.uint8)
    out = K.edge_filter(rgb, alpha)
    solid = (alpha <= 2) | (alpha >= 253)
    assert (out[solid] == alpha[solid]).all() and out.dtype == np.uint8
    assert (K.edge_filter(rgb, np.full((9, 8), 77, np.uint8)) == 77).all()


def test_growth_and_suppression():
    on = np.zeros((7, 7), bool)
    on[3, 3] = True
    assert K.grow_by_colour(on, np.full((7, 7, 3), 90, np.uint8)).sum() == 25
    split = np.full((7, 7, 3), 90, np.uint8)
    split[:, 4:] = 250
    assert not K.grow_by_colour(on, split)[:, 4:].any()
    rects = [(0.5, 0, 0, 10, 10), (0.9, 1, 1, 11, 11), (0.4, 30, 0, 40, 10), (0.4, 60, 0, 70, 10)]
    assert K.suppress_overlaps(rects, 2) == [1, 2] and K.suppress_overlaps(rects, 9) == [1, 2, 3]


def test_resample_invariants():
    for dtype in (np.uint8, np.uint16):
        a = RNG.integers(0, 200, (12, 10, 3)).astype(dtype)
        assert (K.resample(a, 12, 10) == a).all() and K.resample(a, 1, 1).shape == (1, 1, 3)
        assert abs(K.resample(a, 6, 5).mean() - a.mean()) < 0.6
        flat = np.full((5, 5, 3), 77, dtype)
        assert (K.resample(flat, 9, 2) == 77).all()
    half = np.zeros((2, 2, 4), np.uint8)
    half[0, 0] = (200, 100, 0, 255)
    assert K.resample(half, 1, 1)[0, 0].tolist() == [200, 100, 0, 64]


def exact_enlarged(rgba, height, width, y, x):
    """One pixel of an enlarged RGBA raster in fractions: colours weighted by alpha, transparent ones zero."""
    near = []
    for m, n, i in ((rgba.shape[0], height, y), (rgba.shape[1], width, x)):
        pos = min(max(Fraction((2 * i + 1) * m, 2 * n) - Fraction(1, 2), Fraction(0)), Fraction(m - 1))
        near.append([(int(pos), 1 - pos % 1), (min(int(pos) + 1, m - 1), pos % 1)])
    four = [(p * q, rgba[v, u].tolist()) for v, p in near[0] for u, q in near[1]]
    alpha = sum(w * c[3] for w, c in four)
    return [sum(w * c[k] * c[3] for w, c in four) / alpha if alpha else Fraction(0) for k in range(3)] + [alpha]


def test_enlarged_rgba_is_the_rounded_mean():
    for h, w, height, width in ((1, 1, 3, 4), (2, 3, 7, 11), (5, 4, 5, 23), (6, 7, 31, 8), (4, 6, 25, 6), (9, 8, 40, 29)):
        a = RNG.integers(0, 256, (h, w, 4)).astype(np.uint8)
        a[..., 3] = np.where(RNG.random((h, w)) < 0.4, 255, np.where(RNG.random((h, w)) < 0.4, 0, a[..., 3]))
        got = K.resample(a, height, width)
        assert got.shape == (height, width, 4) and got.dtype == np.uint8
        for y, x in np.ndindex(height, width):
            exact = exact_enlarged(a, height, width, y, x)
            assert all(abs(g - e) <= Fraction(1, 2) + Fraction(1, 10**9) for g, e in zip(got[y, x].tolist(), exact, strict=True))
        over = K.resample(a, height, width, black=True)
        assert (over[..., :3] == K.flatten_alpha(got)).all() and (over[..., 3] == 255).all()
    small = K.resample(a, 3, 2, black=True)
    assert (small == K.over_black(K.resample(a, 3, 2))).all()


def test_enlarging_holds_strips_beside_the_result():
    a = RNG.integers(0, 256, (24, 24, 4)).astype(np.uint8)
    for black in (False, True):
        tracemalloc.start()
        result = K.resample(a, 1500, 2000, black=black)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert result.shape == (1500, 2000, 4) and peak < 1500 * 2000 * 4 + 16e6


def read_png16(content):
    at, data = 8, b""
    while at < len(content):
        n, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + n]
        assert struct.unpack(">I", content[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        if kind == b"IHDR":
            w, h, bits, colour = struct.unpack(">IIBB", body[:10])
        if kind == b"IDAT":
            data += body
        at += 12 + n
    raw, size, rows = zlib.decompress(data), 6, []
    assert (bits, colour) == (16, 2)
    above = bytearray(w * 6)
    for y in range(h):
        line = bytearray(raw[y * (w * 6 + 1) + 1 : (y + 1) * (w * 6 + 1)])
        assert raw[y * (w * 6 + 1)] == 4
        for i in range(len(line)):
            a, b, c = line[i - size] if i >= size else 0, above[i], above[i - size] if i >= size else 0
            p = a + b - c
            line[i] = (line[i] + min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]) & 255
        rows.append(np.frombuffer(bytes(line), ">u2").reshape(w, 3))
        above = line
    return np.stack(rows)


def test_png_round_trips(spark, tmp_path):
    deep = RNG.integers(0, 65536, (9, 7, 3)).astype(np.uint16)
    assert (read_png16(K.png(deep)) == deep).all()
    with pytest.raises(ValueError):
        K.png(deep[..., :1])
    pictures = {"rgb": RNG.integers(0, 256, (5, 6, 3)).astype(np.uint8), "rgba": RNG.integers(0, 256, (4, 3, 4)).astype(np.uint8), "grey": RNG.integers(0, 256, (3, 3, 1)).astype(np.uint8)}
    for name, a in pictures.items():
        (tmp_path / f"{name}.png").write_bytes(K.png(a))
    (tmp_path / "fake.png").write_text("no picture")
    (tmp_path / "empty.png").write_bytes(b"")
    (tmp_path / "notes.txt").write_text("x")
    good, bad = files.decode_images(spark, str(tmp_path))
    for r in good.collect():
        a = pictures[r.path.rpartition("/")[2].removesuffix(".png")]
        got = rasters.unpack(r.asDict())
        assert (got[..., : a.shape[2]] == a).all()
    assert good.count() == 3 and bad.count() == 2  # Spark lists no empty files
    listed = files.read_images(spark, str(tmp_path), "b1")
    assert sorted(r.name for r in listed.collect()) == ["fake.png", "grey.png", "rgb.png", "rgba.png"]
    assert listed.select("image_id").intersect(files.read_images(spark, str(tmp_path), "b2").select("image_id")).count() == 0
    q = files.stream_images(spark, str(tmp_path), "b1").writeStream.format("memory").queryName("intake").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("intake").collect())) == sorted(map(tuple, listed.collect()))


def test_intake_is_listed_by_tasks_and_goes_on_where_it_stopped(spark, tmp_path):
    """Twenty sub-folders in more than one task, hidden and empty files, a file that is there already in a folder that changes."""
    drop, out = tmp_path / "drop", tmp_path / "out"
    put = lambda name: ((drop / name).parent.mkdir(parents=True, exist_ok=True), (drop / name).write_text("x" * len(name)))
    names = [f"{i}/{i}-{k}.png" for i in range(20) for k in range(3)] + ["own.JPG"]
    for name in [*names, "3/_hidden.png", "_staging/no.png", ".no.png", "3/notes.txt", "3/deeper/no.png"]:
        put(name)
    (drop / "4/empty.png").write_bytes(b"")
    plain = files.read_images(spark, str(drop), "b").collect()
    assert [r.name for r in plain] == ["own.JPG"] and plain[0].path == f"file:{drop}/own.JPG"
    listed = files.read_images(spark, str(drop), "b", deep=True)
    assert "FileScan" not in listed._jdf.queryExecution().executedPlan().toString()
    assert {(r.path, r.size_bytes) for r in listed.collect()} == {(f"file:{drop}/{n}", len(n)) for n in names}

    def streamed():
        q = files.stream_images(spark, str(drop), "b", deep=True).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state"))
        q.trigger(availableNow=True).start().awaitTermination(120)
        return sorted(map(tuple, spark.read.parquet(str(out)).collect()))

    assert streamed() == sorted(map(tuple, listed.collect()))
    for name in ("5/late.png", "21/new.png"):
        put(name)
    listed = files.read_images(spark, str(drop), "b", deep=True)
    assert streamed() == sorted(map(tuple, listed.collect())) and listed.count() == len(names) + 2
    assert [r.name for r in files.read_images(spark, f"{drop}/2*", "b").collect()].count("2-1.png") == 1


def jpeg(w, h, tail=b"\x11\x22"):
    seg = lambda kind, body: b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xC0, b"\x08" + struct.pack(">HH", h, w) + b"\x03") + seg(0xDA, b"\x01") + tail + b"\xff\xd9"


def test_embedded_jpegs(spark):
    small, large = jpeg(4, 3), jpeg(640, 480, b"\x01" * 50)
    same = jpeg(8, 8, b"\x01" * 50)
    blobs = {"two": b"II*\0junk" + small + b"pad" + large, "tie": same + large, "cut": large[:-20], "none": b"nothing", "short": b"\xff\xd8\xff\xe0\x00\x01", "twins": small + small}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in blobs.items()] + [("null", None)], "path string, content binary")
    best = {r.path: (r.start, r.width, r.height, blobs[r.path][r.start : r.end]) for r in files.best_embedded_jpeg(files.jpeg_candidates(df)).collect()}
    assert best == {"two": (11 + len(small), 640, 480, large), "tie": (len(same), 640, 480, large), "twins": (0, 4, 3, small)}


def test_effective_edits_by_plain_fold(spark, sf_dir):
    log = derived.strokes(spark, sf_dir).withColumn("image_id", F.col("image_id") % 7)
    logs = {}
    for r in log.orderBy("seq").collect():
        logs.setdefault(r.image_id, []).append(r)
    want = set()
    for i, entries in logs.items():
        stack, left = [], 0
        for r in entries:
            if r.tool == "undo":
                if left:
                    stack.pop()
                    left -= 1
            elif r.tool == "reset":
                stack, left = [], 0
            else:
                stack.append(r.seq)
                left = min(12, left + 1)
        want |= {(i, s) for s in stack}
    assert {(r.image_id, r.seq) for r in edits.effective_edits(log).collect()} == want


@pytest.mark.parametrize("limit", [12, 3, 0])
def test_one_log_split_over_many_tasks(spark, limit):
    """Undos that reach through several ranges, in a log of one image that lies in thirteen of them."""
    for k, v in (("spark.sql.shuffle.partitions", "13"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(k, v)
    try:
        for seed, undos in ((1, 0.45), (2, 0.55), (3, 0.2)):
            r = np.random.default_rng(seed)
            tools, run = [], 0
            for _ in range(400):
                run = run - 1 if run else int(r.integers(1, 30)) if r.random() < 0.1 else 0
                tools.append("undo" if run or r.random() < undos else "erase" if r.random() < 0.9 else None)
            log = [(1, k, t) for k, t in enumerate(tools)] + [(2, 5, "undo"), (2, 6, "erase"), (3, 1, "erase"), (3, 2, "reset"), (None, 1, "erase")]
            stack, left = [], 0
            for k, t in enumerate(tools):
                if t != "undo":
                    stack.append(k)
                    left = min(limit, left + 1)
                elif left:
                    stack.pop()
                    left -= 1
            got = edits.effective_edits(spark.createDataFrame(log, "image_id long, seq long, tool string"), limit)
            assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, k, tools[k]) for k in stack] + [(2, 6, "erase")], key=str)
            assert got.columns == ["image_id", "seq", "tool"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_edit_logs_are_not_gathered_in_a_row(spark):
    tool = F.expr("case when id = 500 then 'reset' when id % 30000 >= 29980 then 'undo' else 'erase' end")
    log = spark.range(60000).select(F.lit(1).cast("long").alias("image_id"), F.col("id").alias("seq"), tool.alias("tool")).repartition(5)
    got = edits.effective_edits(log.unionByName(log.filter("seq < 500").withColumn("image_id", F.lit(2).cast("long"))))
    assert "collect_list" not in got._jdf.queryExecution().toString()
    want = [(1, i) for i in (*range(501, 29968), *range(30000, 59968))] + [(2, i) for i in range(500)]
    assert sorted((r.image_id, r.seq) for r in got.collect()) == want


def test_streams_equal_batch(spark, sf_dir, tmp_path):
    events = derived.progress_events(spark, sf_dir)
    events.orderBy(F.rand(3)).repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_latest(stream).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("latest").collect())) == sorted(map(tuple, progress.latest(events).collect()))
    q = stream_stalled(stream, late="400 days").writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    sessions = spark.table("sessions").groupBy("job_id", "image_id").count().filter("count > 1").select("job_id", "image_id", (F.col("count") - 1).alias("stalls"))
    # a gap of exactly 180 s ends a session and isn't yet a stall; none is in the data
    gaps = {}
    by = {}
    for r in events.orderBy("ts", "event_id").collect():
        if (r.ts - by.get((r.job_id, r.image_id), r.ts)).total_seconds() > 180:
            gaps[r.job_id, r.image_id] = gaps.get((r.job_id, r.image_id), 0) + 1
        by[r.job_id, r.image_id] = r.ts
    assert sorted(map(tuple, sessions.collect())) == sorted((*k, n) for k, n in gaps.items())


def timers(rows, gap, limit, now):
    """What stream_timers() has to report, and the silences and runs of the batch twins, by a loop."""
    reports, silences, runs = [], [], []
    by = {}
    for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
        by.setdefault((r.job_id, r.image_id), []).append(r)
    for key, own in by.items():
        first = last = start = None
        for i, r in enumerate(own):
            for t, final in ((r.ts, False), *([(now, True)] if i == len(own) - 1 else [])):
                if final or first is not None:
                    due = min([(last + gap, "silent", last), *([(first + limit, "time limit", first)] if limit else [])], key=lambda x: x[0]) if first else None
                    if due and due[0] < t:
                        reports.append((*key, due[1], due[2], due[0]))
                        first = None
                if not final:
                    first, last = (None, None) if r.kind in ("done", "failed") else (first or r.ts, r.ts)
            start = start or r.ts
            following = own[i + 1].ts if i + 1 < len(own) else now
            ended = r.kind in ("done", "failed")
            if not ended and following - r.ts > gap:
                silences.append((*key, following - r.ts))
            if ended or i + 1 == len(own):
                runs.append((*key, (r.ts if ended else following) - start))
                start = None
    return reports, silences, runs


def test_stalls_and_limits_by_a_loop(spark, sf_dir):
    events = derived.progress_events(spark, sf_dir)
    rows = events.collect()
    _, silences, runs = timers(rows, timedelta(seconds=180), None, max(r.ts for r in rows))
    want = {}
    for job, image, s in silences:
        want.setdefault((job, image), []).append(s // timedelta(microseconds=1))
    assert sorted(map(tuple, progress.stalled_items(events).collect())) == sorted((*k, max(v), len(v)) for k, v in want.items())
    want = sorted((job, image, s // timedelta(microseconds=1)) for job, image, s in runs if s > timedelta(seconds=90))
    assert sorted(map(tuple, progress.overdue_items(events).select("job_id", "image_id", "span_us").collect())) == want
    # an item that is done is never stalled; one that only began is, once it is late enough
    one = spark.createDataFrame([(1, 1, 1, "2024-01-01 00:00:00", 5, "progress"), (1, 2, 2, "2024-01-01 00:00:00", 5, "done")], "job_id long, image_id long, event_id long, ts string, progress_pct long, kind string")
    assert [tuple(r) for r in progress.stalled_items(one, now="2024-01-01 00:10:00").collect()] == [(1, 1, 600_000_000, 1)]
    assert [tuple(r) for r in progress.overdue_items(one, now="2024-01-01 00:01:31").collect()] == [(1, 1, 0, 91_000_000)]
    assert not progress.stalled_items(one, now="2024-01-01 00:03:00").collect() and not progress.overdue_items(one).collect()


@pytest.mark.parametrize("limit", [None, 1800])
def test_timers_as_a_stream(spark, sf_dir, tmp_path, limit):
    events = derived.progress_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    ordered = events.orderBy("ts", "event_id").collect()
    for i in range(0, len(ordered), 400):
        spark.createDataFrame(ordered[i : i + 400], events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_timers(stream, 3600, limit, late="0 seconds").writeStream.format("memory").queryName(f"timers{limit}").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    reports, _, _ = timers(ordered, timedelta(seconds=3600), limit and timedelta(seconds=limit), max(r.ts for r in ordered))
    got = sorted(map(tuple, spark.table(f"timers{limit}").collect()))
    assert got == sorted(reports) and {r[2] for r in got} == {"time limit" if limit else "silent"}


def test_conversion_job(spark, sf_dir):
    d = derived.masks(spark, sf_dir)
    planned = O.plan(O.accepted(derived.manifest(spark, sf_dir)), derived.options(spark)).withColumns({"out_w": F.lit(5).cast("long"), "out_h": F.lit(4).cast("long")})

    def encode(a, mime, quality):
        if mime == "image/webp":
            raise RuntimeError("no encoder")
        return (K.png(a), "image/png") if mime == "image/avif" else (bytes(a.shape[:2]), mime)

    rows = process_images(planned, d, encode).collect()
    expected = planned.filter("route in ('re-encode', 'raw-8')").join(d, "image_id").count()
    assert len(rows) == expected and {r.status for r in rows} == {"done", "error"}
    for r in rows:
        assert (r.status == "error") == r.name.endswith(".webp") and not r.name.endswith(".avif")
        assert r.status == "error" or r.name.endswith(".png") or bytes(r.content) == b"\x04\x05"


def test_conversion_of_a_whole_batch_loses_no_row(spark):
    routes = ["re-encode", "raw-8", "raw-16", "pass-through", "remove-background", "raw-16", "pass-through", "re-encode", None, "pass-through"]
    plan = [(i, r, 2, 2, "image/png", f"{i}.png", None) for i, r in enumerate(routes)]
    planned = spark.createDataFrame(plan, "image_id long, route string, out_w long, out_h long, out_mime string, out_name string, quality double")
    deep = RNG.integers(0, 65536, (3, 4, 3)).astype(np.uint16)
    frames = [rasters.pack(i, deep if i == 2 else np.full((2, 2, 3), 9, np.uint8)) for i in (0, 1, 2, 3)]
    files = spark.createDataFrame([(3, bytearray(b"as it is")), (0, bytearray(b"x")), (9, None)], "image_id long, content binary")
    rows = convert_all(planned, spark.createDataFrame(frames, rasters.RASTER), files, lambda a, mime, quality: (b"new", mime)).collect()
    got = {r.image_id: (r.status, r.content and bytes(r.content)) for r in rows}
    assert len(rows) == len(plan) and all(r.name == f"{r.image_id}.png" and r.output_size == (r.content and len(r.content)) for r in rows)
    assert got == {0: ("done", b"new"), 1: ("done", b"new"), 2: ("done", K.png(K.sharpen16(deep))), 3: ("done", b"as it is")} | {i: ("error", None) for i in range(4, 10)}
    assert {r.image_id: r.error for r in rows}[4] == "not part of this job: remove-background"


def test_predicted_masks(spark, sf_dir):
    d = derived.frames16(spark, sf_dir)
    out = predict_masks(d, lambda: lambda a: a.mean(axis=-1) / 257).limit(3).collect()
    assert all((r.channels, r.bits, r.height) == (1, 8, 24) for r in out)


def test_invalid_frames_become_errors(spark):
    rows = [(1, 2, 2, 1, 8, bytearray(4)), (2, 2, 2, 1, 8, bytearray(3)), (3, 2, 2, 1, 8, None), (4, 2, 2, 1, 16, bytearray(8))]
    good, bad = rasters.validate_frames(spark.createDataFrame(rows, rasters.RASTER))
    assert sorted(r.image_id for r in good.collect()) == [1, 4] and sorted(r.image_id for r in bad.collect()) == [2, 3]
    out = {r.image_id: r.error for r in rasters.encode_png(good).collect()}
    assert out[1] is None and "three channels" in out[4]
