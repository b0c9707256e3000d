"""Crop plans from small masks. A plan is a function of one mask of 512 pixels at most, so planning takes one pass and no shuffle."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from ..functions import crops as C
from .rasters import over_rows, unpack

PLAN = "image_id long, layer_idx int, detail string, l int, t int, r int, b int, own_l int, own_r int"


def planned_crops(masks: DataFrame, plan: Callable[[np.ndarray, int, int], list[C.Crop]] = C.all_crops) -> DataFrame:
    """masks: raster rows of the whole-picture masks with image_w and image_h. Crops from 1 on; layer 0 is the picture itself.

    plan: all_crops, or person_crops, subject_crops, edge_crops for one kind."""

    def make(r: dict) -> list[dict]:
        found = plan(unpack(r)[..., 0], r["image_w"], r["image_h"])
        return [
            {"image_id": r["image_id"], "layer_idx": i, "detail": c.detail, "l": c.left, "t": c.top, "r": c.right, "b": c.bottom,
             "own_l": c.band and c.band[0], "own_r": c.band and c.band[1]}
            for i, c in enumerate(found, 1)
        ]

    return over_rows(masks, PLAN, make)
