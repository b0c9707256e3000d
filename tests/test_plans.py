"""Crop rectangles around the largest regions, by a plain loop."""

import math

from imgspark.operators import rasters
from imgspark.sources import derived


def test_subject_rects(spark, sf_dir):
    parts = rasters.components(derived.masks(spark, sf_dir), 24)
    want, by = set(), {}
    for r in parts.collect():
        by.setdefault(r.image_id, []).append(r)
    for i, found in by.items():
        for rank, r in enumerate(sorted((r for r in found if r.area >= 32), key=lambda r: (-r.area, r.first_pixel))[:4], 1):
            left, top, right, bottom = math.floor(r.min_x * 10), math.floor(r.min_y * 10), math.ceil((r.max_x + 1) * 10), math.ceil((r.max_y + 1) * 10)
            pad = math.floor(0.14 * max(right - left, bottom - top) + 0.5)
            box = max(0, left - pad), max(0, top - pad), min(240, right + pad), min(240, bottom + pad)
            if 240 / max(box[2] - box[0], box[3] - box[1]) >= 1.15:
                want.add((i, rank, *box))
    got = {tuple(r) for r in rasters.subject_rects(parts, 24, 24, 240, 240).collect()}
    assert got == want and got
