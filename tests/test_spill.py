"""Colour cleaning over tiles against whole frames, with chains through many tiles."""

import numpy as np
import pytest

from imgspark.functions import finish as N
from imgspark.operators import rasters, spill, tiles


def pictures():
    r = np.random.default_rng(6)
    noise = r.integers(0, 256, (37, 41, 4)).astype(np.uint8)
    ramp = r.integers(0, 256, (6, 120, 4)).astype(np.uint8)
    ramp[..., 3] = np.linspace(255, 0, 120).astype(np.uint8)  # a chain of soft pixels along the whole picture
    steep = r.integers(0, 256, (90, 9, 4)).astype(np.uint8)
    steep[..., 3] = np.clip(255 - 3 * np.arange(90), 0, 255).astype(np.uint8)[:, None]
    solid = np.full((20, 20, 4), 255, np.uint8)
    disc = r.integers(0, 256, (50, 50, 4)).astype(np.uint8)
    y, x = np.mgrid[:50, :50]
    disc[..., 3] = np.clip(128 + 9 * (15 - np.hypot(y - 25, x - 25)), 0, 255)
    return [noise, ramp, steep, solid, disc]


@pytest.mark.parametrize("size,radius", [(7, 6), (16, 16), (200, 8), (9, 3)])
def test_tiles_give_what_the_whole_frame_gives(spark, size, radius):
    given = pictures()
    df = spark.createDataFrame([rasters.pack(i, a) for i, a in enumerate(given)], rasters.RASTER)
    got = {r.image_id: rasters.unpack(r.asDict()) for r in tiles.join(spill.decontaminate(tiles.split(df, size), radius)).collect()}
    for i, a in enumerate(given):
        want = N.decontaminate(a, a[..., 3], radius)
        assert (got[i] == want).all(), i
    assert any((got[i] != a).any() for i, a in enumerate(given))
