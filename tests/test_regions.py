"""Enclosed regions over tiles against one look at the whole frame."""

import numpy as np
import pytest

from imgspark.functions import kernels as K
from imgspark.operators import rasters, regions, tiles


def expected(a, least_count, share, least, most_share, fill, room):
    h, w = a.shape[:2]
    n, solid, matte = h * w, a[..., 3] >= 128, a[..., 4]
    r, g, b = (a[..., k].astype(int) // 16 for k in range(3))
    bucket = r + 16 * g + 256 * b
    seeds = np.zeros((h, w), bool)
    for y, x in zip(*np.nonzero(solid & (matte >= 224))):
        same = solid & (bucket == bucket[y, x])
        bg, fg = (same & (matte <= 24)).sum(), (same & (matte >= 232)).sum()
        seeds[y, x] = bg >= max(least_count, int(n * 1e-5 + 0.5)) and bg / (bg + fg) >= share
    small = max(least, int(n * 4e-5 + 0.5))
    out = []
    for _, area, x0, y0, x1, y1, first in K.component_stats(*K.components(seeds)):
        bw, bh = x1 - x0 + 1, y1 - y0 + 1
        m = max(room, min(max(room, int(min(w, h) * 0.08 + 0.5)), int(np.ceil(max(bw, bh) * 1.2))))
        inside = x0 - m > 0 and y0 - m > 0 and x1 + m < w - 1 and y1 + m < h - 1
        if small <= area <= max(small, int(n * most_share + 0.5)) and area / (bw * bh) >= fill and inside and (matte[y0 - m : y1 + m + 1, x0 - m : x1 + m + 1] > 24).all():
            out.append((area, x0, y0, x1, y1, first))
    return out


@pytest.mark.parametrize("size", [8, 30, 200])
def test_enclosed_regions_over_tiles(spark, size):
    r = np.random.default_rng(3)
    frames = []
    for k in range(4):
        a = np.zeros((60 + 11 * k, 83, 5), np.uint8)
        a[..., :3], a[..., 3], a[..., 4] = 200, 255, 255
        a[:, :9, :3], a[:, :9, 4] = 40, 0  # removed background
        for _ in range(9):
            y, x, s = r.integers(5, a.shape[0] - 8), r.integers(12, 75), r.integers(2, 7)
            a[y : y + s, x : x + s, :3] = 40 if r.random() < 0.8 else 90
        a[50, 50, 4] = 0
        frames.append(a)
    options = {"least_count": 24, "share": 0.5, "least": 4, "most_share": 0.01, "fill": 0.38, "room": 2}
    df = spark.createDataFrame([rasters.pack(i, a) for i, a in enumerate(frames)], rasters.RASTER)
    got = sorted(map(tuple, regions.enclosed_regions(tiles.split(df, size), size, **options).collect()))
    want = sorted((i, *x) for i, a in enumerate(frames) for x in expected(a, **options))
    assert got == want and len(want) > 4
