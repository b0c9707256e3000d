"""Jobs over rows against their kernels row by row, tiles against whole frames, and files on disk."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from imgspark.functions import crops as C
from imgspark.functions import finish as N
from imgspark.functions import kernels as K
from imgspark.functions import matte as M
from imgspark.functions import selection as S
from imgspark.operators import mattes, rasters, scan, selections, tiles
from imgspark.plans import background as B
from imgspark.sources import files

RNG = np.random.default_rng(3)
POINTS = "image_id long, seq long, x double, y double, radius double, label int"


def frame(spark, arrays):
    return spark.createDataFrame([rasters.pack(i, a) for i, a in enumerate(arrays)], rasters.RASTER)


def arrays_of(df):
    return {r.image_id: rasters.unpack(r.asDict()) for r in df.collect()}


def portrait(i, h=90, w=120):
    y, x = np.mgrid[:h, :w]
    body = (np.abs(x - w / 2) < 30) & (y > 40) | ((y - 28) ** 2 + (x - w / 2 + i) ** 2 < 150)
    light = np.where(body, 215, 25)[..., None] + RNG.integers(-20, 20, (h, w, 3))
    return np.dstack([np.clip(light, 0, 255), np.full((h, w), 255)]).astype(np.uint8)


def test_background_removal_equals_its_stages_by_hand(spark, tmp_path):
    pictures = [portrait(i) for i in range(4)] + [np.zeros((20, 20, 4), np.uint8)]
    predict = lambda a: np.clip((a[..., :3].astype(float).mean(-1) - 60) * 1.7, 0, 255)
    for output in ("image", "mask"):
        got = arrays_of(B.remove_background(frame(spark, pictures), lambda: predict, str(tmp_path / output), output=output))
        assert len(got) == len(pictures)
        planned = 0
        for i, a in enumerate(pictures):
            whole = np.clip(np.rint(predict(a)), 0, 255).astype(np.uint8)
            layers = [M.Layer(whole, 0, 0, a.shape[1], a.shape[0])]
            for c in C.all_crops(whole, a.shape[1], a.shape[0]):
                mask = np.clip(np.rint(predict(a[c.top : c.bottom, c.left : c.right])), 0, 255).astype(np.uint8)
                layers.append(M.Layer(M.expand_pockets(mask) if c.detail == "hair" else mask, c.left, c.top, c.right, c.bottom, c.band, c.detail))
                planned += 1
            want = N.finish(a, layers, output == "image")
            assert (got[i] == (want if output == "image" else want[..., 3:])).all()
        assert planned


def test_a_failing_model_costs_its_crops_only(spark, tmp_path):
    pictures = [portrait(i) for i in range(3)] + [np.full((30, 30, 4), 7, np.uint8)]
    light = lambda a: np.clip((a[..., :3].astype(float).mean(-1) - 60) * 1.7, 0, 255)

    def fails(a):
        if a.shape[0] == 30:
            raise ValueError("odd size")
        return light(a)

    at = str(tmp_path / "a")
    alone = arrays_of(B.remove_background(frame(spark, pictures), lambda: fails, at))
    assert sorted(alone) == [0, 1, 2]
    assert [tuple(r) for r in B.mask_errors(spark, at).collect()] == [(3, 0, "odd size")]
    helped = arrays_of(B.remove_background(frame(spark, pictures), lambda: fails, str(tmp_path / "b"), fallback=lambda: light))
    assert sorted(helped) == [0, 1, 2, 3] and all((helped[i] == alone[i]).all() for i in alone)
    assert not B.mask_errors(spark, str(tmp_path / "b")).count()


def test_crops_are_cut_where_the_picture_is(spark):
    pictures = [portrait(i) for i in range(3)]
    plan = spark.createDataFrame([(i, k, 3 * k, k, 40 + k, 50, None, None, "edge") for i in range(2) for k in (1, 2)], "image_id long, layer_idx int, l int, t int, r int, b int, own_l int, own_r int, detail string")
    got = B.cut_crops(plan, frame(spark, pictures)).collect()
    assert sorted((r.image_id, r.layer_idx) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 2)]
    for r in got:
        assert (rasters.unpack(r.asDict()) == pictures[r.image_id][r.t : r.b, r.l : r.r]).all() and (r.frame_h, r.frame_w) == (90, 120)


def test_no_picture_or_mask_is_broadcast(spark, tmp_path):
    """Masks that repeat are next to nothing as files, but not in memory."""
    pictures = frame(spark, [portrait(0)] * 40)
    B.predicted(B.whole_pictures(pictures), lambda: lambda a: a[..., 0]).write.parquet(str(tmp_path / "whole"))
    whole = spark.read.parquet(str(tmp_path / "whole")).drop("error")
    plan = B.planned_crops(whole.withColumns({"image_w": F.col("frame_w"), "image_h": F.col("frame_h"), "channels": F.lit(1), "bits": F.lit(8)}))
    for job in (B.cut_crops(plan, pictures), mattes.finished_mattes(pictures, whole)):
        job.write.format("noop").mode("overwrite").save()
        said = job._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in said and "Broadcast" not in said


def test_stamps_change_their_box_only():
    a, source = (RNG.integers(0, 256, (40, 50, 4)).astype(np.uint8) for _ in range(2))
    for x, y, radius in ((10.0, 12.0, 6.0), (0.0, 0.0, 9.5), (49.5, 39.5, 3.0), (-20.0, 5.0, 4.0), (25.0, 20.0, 100.0)):
        cover = M.coverage(40, 50, x, y, radius)
        erased, restored = M.erase(a, x, y, radius), M.restore(a, source, x, y, radius)
        assert (erased[..., 3] == np.clip(np.rint(a[..., 3] * (1 - cover)), 0, 255)).all() and (erased[..., :3] == a[..., :3]).all()
        over = source[..., 3] / 255 * cover
        assert (restored[cover == 0] == a[cover == 0]).all()
        assert (restored[..., 3] == np.clip(np.rint((over + a[..., 3] / 255 * (1 - over)) * 255), 0, 255))[cover > 0].all()


def test_model_inputs_and_masks():
    a = np.full((30, 60, 4), 255, np.uint8)
    t = B.model_input(a, 16)
    assert t.shape == (3, 16, 16) and t.dtype == np.float32
    assert np.allclose(t[:, 0, 0], (1 - np.array([0.485, 0.456, 0.406])) / np.array([0.229, 0.224, 0.225]), atol=1e-5)
    assert B.sigmoid_masks(np.array([-50.0, 0.0, 50.0])).tolist() == [0, 127, 255]
    assert selections.normalised(np.zeros((4, 6, 3), np.uint8), 8)[:, 4:, :].any() == np.False_


def test_selections_equal_kernels(spark):
    masks = [RNG.integers(0, 256, (20, 30, 1)).astype(np.uint8) for _ in range(5)]
    pictures = [RNG.integers(0, 256, (20, 30, 4)).astype(np.uint8) for _ in range(5)]
    points = [(i, k, float(RNG.uniform(0, 30)), float(RNG.uniform(0, 20)), 4.0, int(k % 3 > 0)) for i in range(4) for k in range(6)]
    got = selections.refine_selections(frame(spark, masks), frame(spark, pictures), spark.createDataFrame(points, POINTS)).collect()
    assert len(got) == 5
    for r in got:
        want = S.refine(masks[r.image_id][..., 0], pictures[r.image_id], [p[2:5] for p in points if p[0] == r.image_id and p[5]])
        assert (rasters.unpack(r.asDict())[..., 0] == want * 255).all() and r.n_selected == want.sum()


def test_best_prompted_mask(spark):
    a = np.full((20, 40, 4), 255, np.uint8)

    def load():
        def predict(inputs, points, labels, height, width):
            assert inputs.shape == (3, 64, 64) and points.max() <= 64 and len(points) == len(labels)
            m = np.zeros((3, height, width), np.uint8)
            m[0, 5:15, 5:15] = m[1, 5:15, 25:35] = m[2] = 1
            return m, [0.9, 0.95, 0.99]

        return predict

    p = spark.createDataFrame([(0, 0, 10.0, 10.0, 5.0, 1), (0, 1, 30.0, 10.0, 5.0, 0)], POINTS)
    r = selections.prompted_masks(frame(spark, [a, a]), p, load, 64).collect()
    assert len(r) == 1 and r[0].mask_idx == 0 and rasters.unpack(r[0].asDict()).sum() == 100 * 255
    assert abs(r[0].score - (0.9 + 2.5)) < 1e-9
    assert S.prompt_score(np.zeros((4, 4)), 0.5, [(1.0, 1.0, 1.0)], []) == 0.5 - 2.25


@pytest.mark.parametrize("size, halo", [(8, 2), (11, 5), (64, 3)])
def test_stencil_over_tiles_equals_whole_frame(spark, size, halo):
    blur = lambda a: (sum(K.shifted(a.astype(int), dy, dx) for dy in range(-halo, halo + 1) for dx in range(-halo, halo + 1)) // (2 * halo + 1) ** 2).astype(a.dtype)
    whole = [RNG.integers(0, 60000, (h, w, 3)).astype(np.uint16) for h, w in ((33, 47), (16, 16), (1, 30), (41, 9))]
    got = arrays_of(tiles.join(tiles.stencil(tiles.split(frame(spark, whole), size), halo, blur)))
    assert all((got[i] == blur(a)).all() for i, a in enumerate(whole)) and len(got) == 4


def spiral(n):
    a = np.zeros((n, n, 1), np.uint8)
    y, x, dy, dx = 0, 0, 0, 1
    for _ in range(n * n):
        a[y, x] = 255
        ahead = lambda k: (y + dy * k, x + dx * k)  # noqa: B023,E731
        free = lambda p: 0 <= p[0] < n and 0 <= p[1] < n
        if not free(ahead(1)) or free(ahead(2)) and a[ahead(2)].any():
            dy, dx = dx, -dy
            if not free(ahead(1)) or a[ahead(1)].any() or free(ahead(2)) and a[ahead(2)].any():
                break
        y, x = ahead(1)
    return a


def test_components_over_tiles_equal_whole_frames(spark):
    whole = [spiral(29), (RNG.random((40, 33, 1)) < 0.35).astype(np.uint8) * 255, np.zeros((9, 9, 1), np.uint8), np.full((20, 20, 1), 255, np.uint8)]
    got = {tuple(r) for r in tiles.components(tiles.split(frame(spark, whole), 5), 128).select("image_id", "area", "min_x", "min_y", "max_x", "max_y", "first_pixel").collect()}
    want = {(i, *s[1:]) for i, a in enumerate(whole) for s in K.component_stats(*K.components(a[..., 0] >= 128))}
    assert got == want


def test_files_hold_the_last_of_equal_names(spark, tmp_path):
    rows = [(1, 1, "a.png", 1, b"one"), (2, 1, "a.png", 2, b"two"), (3, 2, "a.png", 1, b""), (4, 2, "../../up.png", 2, b"x"), (5, 2, "..", 3, b"x"), (6, 2, None, 4, None)]
    df = spark.createDataFrame(rows, "image_id long, job_id long, name string, seq long, content binary")
    for _ in range(2):
        out = {r.image_id: r.error for r in files.write_files(df, str(tmp_path / "out")).collect()}
    assert (tmp_path / "out/1/a.png").read_bytes() == b"two" and (tmp_path / "out/2/a.png").read_bytes() == b""
    assert sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file()) == [".._.._up.png", "a.png", "a.png"]
    assert out == {5: "no file name", 6: "no file name"}


def test_model_sees_batches_of_one_shape_and_failures_stand_alone(spark, tmp_path):
    sizes = [(4, 6), (8, 8), (4, 6), (5, 5)] * 9
    pictures = [np.full((*s, 3), i, np.uint8) for i, s in enumerate(sizes)]
    log = str(tmp_path)

    def load():
        def predict(stack):
            with open(f"{log}/calls", "a") as f:
                f.write(f"{','.join(map(str, sorted(stack[:, 0, 0, 0].tolist())))}\n")
            if (stack == 7).any():
                raise ValueError("seven")
            return stack[..., 0] + 1

        return predict

    crops = B.whole_pictures(frame(spark, pictures)).coalesce(1)
    got = {r.image_id: r for r in B.predicted(crops, load, batch=5).collect()}
    assert len(got) == 36 and {i for i, r in got.items() if r.error} == {7} and got[7].error == "seven" and got[7].data is None
    assert all((r.height, r.width) == sizes[i] and set(r.data) == {i + 1} for i, r in got.items() if i != 7)
    calls = [list(map(int, x.split(","))) for x in (tmp_path / "calls").read_text().split()]
    whole = [c for c in calls if len(c) == 5]
    assert len(whole) == 3 + 1 + 1 and all(len({sizes[i] for i in c}) == 1 for c in calls)  # 18, 9 and 9 crops of three shapes
    seen = [i for c in calls if 7 not in c for i in c]
    assert len(seen) == len(set(seen)) and set(seen) | {7} == set(range(36))
    held, B.HELD = B.HELD, 0
    try:
        assert {r.image_id for r in B.predicted(crops, load, batch=5).collect() if not r.error} == set(got) - {7}
    finally:
        B.HELD = held
    short = B.predicted(crops, lambda: lambda stack: stack[:1, ..., 0] if len(stack) > 1 else stack[..., 0], batch=5).collect()
    assert len(short) == 36 and not [r for r in short if r.error]
    helped = B.predicted(crops, load, batch=5, fallback=lambda: lambda stack: stack[..., 0] * 0).collect()
    assert not [r for r in helped if r.error] and set(next(r for r in helped if r.image_id == 7).data) == {0}
    broken = B.predicted(crops, load, prepare=lambda a: a.reshape(8, 8, 3), batch=4).collect()
    assert len(broken) == 36 and sum(r.error is None for r in broken) == 9


def test_crops_scaled_before_they_move_give_the_same_inputs(spark):
    pictures = [portrait(i) for i in range(2)]
    plan = spark.createDataFrame([(i, k, 3 * k, k, 40 + 30 * k, 50, None, None, "edge") for i in range(2) for k in (1, 2)], "image_id long, layer_idx int, l int, t int, r int, b int, own_l int, own_r int, detail string")
    for r in B.cut_crops(plan, frame(spark, pictures), edge=32).collect():
        small = rasters.unpack(r.asDict())
        assert max(small.shape[:2]) == 32
        assert (B.model_input(small, 32) == B.model_input(pictures[r.image_id][r.t : r.b, r.l : r.r], 32)).all()


def test_tasks_weigh_alike_however_sizes_differ(spark):
    r = np.random.default_rng(1)
    pixels = np.where(np.arange(20_000) % 100 == 0, 100_000_000, r.integers(1, 2_000_000, 20_000))
    rows = spark.createDataFrame([(i, int(p)) for i, p in enumerate(pixels)] + [(20_000, None), (20_001, -5)], "image_id long, pixels long").repartition(5)
    got = scan.balanced(rows, "pixels", ["image_id"], 16)
    tasks = got.select("image_id", "pixels", F.spark_partition_id().alias("task")).groupBy("task").agg(F.sum("pixels").alias("w"), F.count(F.lit(1)).alias("n")).collect()
    assert len(tasks) == 16 and sum(t.n for t in tasks) == 20_002
    assert max(t.w for t in tasks) <= 1.1 * pixels.sum() / 16
    assert scan.balanced(rows.limit(0), "pixels", ["image_id"], 3).count() == 0
