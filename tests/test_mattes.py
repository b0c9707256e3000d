"""Layer fusion, band recovery, brushes and replay against slow loops."""

import math

import numpy as np

from imgspark.functions import matte as M
from imgspark.operators import mattes, rasters
from imgspark.sources import derived

RNG = np.random.default_rng(8)


def loop_fuse(h, w, layers):
    alpha = [[0.0] * w for _ in range(h)]
    votes, veto, lowest = np.zeros((h, w), int), np.zeros((h, w), bool), np.full((h, w), 255.0)
    voters = sum(x.band is not None for x in layers[1:])
    up = lambda v: math.floor(v + 0.5)
    for i, q in enumerate(layers):
        qh, qw = q.bottom - q.top, q.right - q.left
        mh, mw = q.mask.shape
        margin = max(2, up(min(qh, qw) * 0.04))
        for y in range(qh):
            for x in range(qw):
                sy, sx = (y + 0.5) * mh / qh - 0.5, (x + 0.5) * mw / qw - 0.5
                ly, lx = min(mh - 1, max(0, math.floor(sy))), min(mw - 1, max(0, math.floor(sx)))
                hy, hx = min(mh - 1, ly + 1), min(mw - 1, lx + 1)
                wy, wx = min(1, max(0, sy - ly)), float(np.float32(min(1, max(0, sx - lx))))
                row = lambda k: float(q.mask[k, lx]) * (1 - wx) + float(q.mask[k, hx]) * wx  # noqa: B023,E731
                p = row(ly) * (1 - wy) + row(hy) * wy
                oy, ox = q.top + y, q.left + x
                if i and q.band and voters >= 2 and margin <= x < qw - margin and margin <= y < qh - margin:
                    if p <= 56:
                        votes[oy, ox] += 1
                        lowest[oy, ox] = min(lowest[oy, ox], up(p))
                    elif p >= 210:
                        veto[oy, ox] = True
                if q.band and not q.band[0] <= ox < q.band[1]:
                    continue
                if i == 0:
                    alpha[oy][ox] = float(np.clip(np.rint(p), 0, 255))
                    continue
                old = alpha[oy][ox]
                safe = old + (p - old) * (1 - abs(old - 127.5) / 127.5)
                if q.band:
                    f = max(2, up((q.band[1] - q.band[0]) * 0.12))
                    v = max(2, up(qh * 0.035))
                    s = min(1, (ox - q.band[0]) / f, (q.band[1] - 1 - ox) / f, y / v, (qh - 1 - y) / v)
                else:
                    s = min(1, min(x, y, qw - 1 - x, qh - 1 - y) / max(2, up(min(qw, qh) * 0.035)))
                s = max(0, s)
                s = s * s * (3 - 2 * s)
                alpha[oy][ox] = up(old * (1 - s) + safe * s)
    a = np.array(alpha)
    return np.where((votes >= 2) & ~veto, np.minimum(a, lowest), a).astype(np.uint8)


def test_fusion_equals_loop(spark, sf_dir):
    for _ in range(6):
        mask = lambda: RNG.integers(0, 256, (int(RNG.integers(1, 9)), int(RNG.integers(1, 9)))).astype(np.uint8)
        layers = [M.Layer(mask(), 0, 0, 30, 26), M.Layer(mask(), 3, 2, 27, 24, (5, 20)), M.Layer(mask() // 5, 6, 1, 29, 25, (9, 26)), M.Layer(mask(), 4, 4, 20, 18)]
        assert (M.fuse(26, 30, layers) == loop_fuse(26, 30, layers)).all()
    rows = derived.layers(spark, sf_dir).filter("image_id < 5").collect()
    got = {r.image_id: rasters.unpack(r.asDict())[..., 0] for r in mattes.fuse_layers(derived.layers(spark, sf_dir).filter("image_id < 5").repartition(3)).collect()}
    for i in range(5):
        own = [M.Layer(np.frombuffer(r.data, np.uint8).reshape(8, 8), r.l, r.t, r.r, r.b, None if r.own_l is None else (r.own_l, r.own_r)) for r in sorted((r for r in rows if r.image_id == i), key=lambda r: r.layer_idx)]
        assert (got[i] == loop_fuse(24, 24, own)).all()


def test_band_recovery_by_search():
    for _ in range(8):
        visible, on = RNG.random((15, 17)) < 0.8, RNG.random((15, 17)) < 0.06
        got, band = M.recover_band(on, visible, 12), 3

        def search(starts, first):
            d = {p: first for p in starts}
            front = list(starts)
            while front:
                new = []
                for y, x in front:
                    for q in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                        if 0 <= q[0] < 15 and 0 <= q[1] < 17 and visible[q] and q not in d:
                            d[q] = d[y, x] + 1
                            new.append(q)
                front = new
            return d

        inside = search([(y, x) for y, x in map(tuple, np.argwhere(on & visible))], 0)
        edge = [(y, x) for y, x in map(tuple, np.argwhere(visible)) if y in (0, 14) or x in (0, 16) or not visible[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].all()]
        border = search(edge, 1)
        want = on.copy()
        for p in inside:
            if p in border and inside[p] + border[p] <= band + 1:
                want[p] = True
        assert (got == want).all()


def test_brushes_and_replay(spark, sf_dir):
    a = RNG.integers(0, 256, (24, 24, 4)).astype(np.uint8)
    once = M.erase(a, 12, 12, 6)
    assert once[12, 12, 3] == 0 and (once[..., 3] <= a[..., 3]).all() and (once[0] == a[0]).all() and (once[..., :3] == a[..., :3]).all()
    solid = a.copy()
    solid[..., 3] = 255
    assert (M.restore(once, solid, 12, 12, 6)[12, 12] == solid[12, 12]).all()
    rows = [(1, 7, 1, 3.0, 3.0, 4.0, "erase"), (1, 7, 2, 15.0, 3.0, 4.0, "erase"), (1, 8, 3, 9.0, 9.0, 5.0, "erase"), (1, 9, 4, 0.0, 0.0, 1.0, "undo"), (2, 7, 1, 9.0, 9.0, 5.0, "erase"), (2, 7, 2, 0.0, 0.0, 1.0, "reset")]
    log = spark.createDataFrame(rows, "image_id long, stroke_id long, seq long, x double, y double, radius double, tool string")
    images = spark.createDataFrame([rasters.pack(i, a) for i in (1, 2, 3)], rasters.RASTER)
    got = {r.image_id: rasters.unpack(r.asDict()) for r in mattes.replay_edits(images, images, log).collect()}
    want = M.erase(a, 3, 3, 4)
    steps = math.ceil(12 / max(1, 0.42 * 4))
    for k in range(1, steps + 1):
        want = M.erase(want, 3 + 12 * k / steps, 3, 4)
    assert (got[1] == want).all() and (got[2] == a).all() and (got[3] == a).all()


def test_pockets_by_distance():
    mask = np.full((80, 90), 220, np.uint8)
    mask[30:38, 40:48] = 10
    mask[60:63, 10:13] = 10
    mask[0:10, 70:80] = 10
    got = M.expand_pockets(mask)
    for y in range(80):
        for x in range(90):
            d = math.hypot(max(30 - y, 0, y - 37), max(40 - x, 0, x - 47))
            cap = 0 if d <= 6 else math.floor((d - 6) / 3 * 255 + 0.5) if d <= 9 else 255
            assert got[y, x] == min(mask[y, x], cap)
    assert (M.expand_pockets(np.zeros((5, 5), np.uint8)) == 0).all()


def test_background_job_with_a_stub_model(spark):
    from imgspark.plans.background import CROPS, crop_plan, refine_masks

    crop = "image_id long, rank int, l int, t int, r int, b int, own_l int, own_r int"
    structural = spark.createDataFrame([(1, k, k, 1, k + 9, 11, None, None) for k in range(9)] + [(2, 1, 2, 2, 12, 12, None, None)], crop)
    edges = spark.createDataFrame([(1, k, 2, k, 10, k + 8, None, None) for k in range(5)], crop)
    plan = crop_plan(structural, edges)
    rows = sorted(map(tuple, plan.filter("image_id = 1").select("layer_idx", "l", "t").collect()))
    assert [r[0] for r in rows] == list(range(1, CROPS + 1)) and [r[1:] for r in rows] == [(k, 1) for k in range(7)] + [(2, k) for k in range(5)]
    pictures = {i: RNG.integers(0, 256, (16, 20, 3)).astype(np.uint8) for i in (1, 2, 3)}
    images = spark.createDataFrame([rasters.pack(i, a) for i, a in pictures.items()], rasters.RASTER)
    model = lambda a: a.mean(axis=-1)
    out = {r.image_id: rasters.unpack(r.asDict())[..., 0] for r in refine_masks(images, plan, lambda: model).collect()}
    crops = {i: [tuple(r) for r in plan.filter(f"image_id = {i}").orderBy("layer_idx").select("l", "t", "r", "b").collect()] for i in pictures}
    for i, a in pictures.items():
        to8 = lambda x: np.clip(np.rint(model(x)), 0, 255).astype(np.uint8)
        layers = [M.Layer(to8(a), 0, 0, 20, 16)] + [M.Layer(to8(a[t:b, l:r]), l, t, r, b) for l, t, r, b in crops[i]]
        assert (out[i] == loop_fuse(16, 20, layers)).all()
