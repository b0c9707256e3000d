"""Box sums over tiles and suppression in rounds against loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from imgspark.functions import kernels as K
from imgspark.operators import boxes, rasters, tiles


@pytest.mark.parametrize("size,few", [(5, 10**6), (8, 0), (64, 10**6)])
def test_box_sums_over_tiles(spark, size, few):
    r = np.random.default_rng(2)
    frames = {i: r.integers(0, 256, (h, w, 1)).astype(np.uint8) for i, (h, w) in enumerate([(1, 1), (23, 17), (40, 40), (8, 64), (5, 5)])}
    df = spark.createDataFrame([rasters.pack(i, a) for i, a in frames.items()], rasters.RASTER)
    asked = [(int(i), *map(int, r.integers(-5, 70, 4)), k) for k, i in enumerate(r.integers(0, 5, 200))] + [(99, 0, 0, 5, 5, 900), (1, 0, 0, 17, 23, 901), (1, 0, 0, 17, 23, 901)]
    rects = spark.createDataFrame(asked, "image_id long, l int, t int, r int, b int, box_sum_of long")
    got = boxes.box_sums(tiles.split(df, size), rects, size, few).collect()
    want = [(*q, int(frames[q[0]][max(0, q[2]) : max(0, q[4]), max(0, q[1]) : max(0, q[3]), 0].astype(int).sum()) if q[0] in frames else 0) for q in asked]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("cell", [7, 64, 1000])
def test_suppression_in_rounds(spark, cell):
    r, rows = random.Random(cell), []
    for i in range(12):
        for k in range(r.choice([0, 1, 5, 60])):
            l, t = r.randrange(80), r.randrange(80)
            rows.append((i, k, float(r.randrange(12)), l, t, l + r.randrange(40), t + r.randrange(40)))
    rows += [(50, k, 1.0, 0, 0, 10, 10) for k in range(30)]  # all alike: one stays
    rows += [(51, k, float(-k), 5 * k, 0, 5 * k + 10, 10) for k in range(40)]  # a chain, each overlaps the next by a third
    df = spark.createDataFrame(rows, "image_id long, cand long, score double, l long, t long, r long, b long")
    got = boxes.suppress_overlaps(df, F.lit(1000), cell=cell).collect()
    want = []
    for i in {q[0] for q in rows}:
        own = sorted((q for q in rows if q[0] == i), key=lambda q: q[1])
        want += [(*own[j], n) for n, j in enumerate(K.suppress_overlaps([q[2:] for q in own], 1000), 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert {q[1] for q in got if q[0] == 51} == set(range(0, 40, 2)) and len([q for q in got if q[0] == 50]) == 1
