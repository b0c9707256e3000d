"""Enclosed regions of background colour in tiled frames: colour counts, regions over tiles and sums over boxes, joined by numbers.

Tiles here have five channels: red, green, blue, the source's alpha, and the matte."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.finish import ISLAND_BACKGROUND, ISLAND_FOREGROUND, ISLAND_SEED, SEED_SHARE
from .boxes import box_sums
from .rasters import over_rows, pack, unpack
from .tiles import KEYS, TILE, components

COUNTS = "image_id long, bucket int, bg long, fg long"


def _buckets(a: np.ndarray) -> np.ndarray:
    r, g, b = (a[..., k].astype(np.int64) >> 4 for k in range(3))
    return r | g << 4 | b << 8


def colour_counts(tiles: DataFrame) -> DataFrame:
    """Per image and colour bucket the pixels of background and of foreground, counted in each tile and then added up."""

    def count(r: dict) -> list[dict]:
        a = unpack(r)
        bucket, solid, matte = _buckets(a), a[..., 3] >= 128, a[..., 4]
        bg = np.bincount(bucket[solid & (matte <= ISLAND_BACKGROUND)], minlength=4096)
        fg = np.bincount(bucket[solid & (matte >= ISLAND_FOREGROUND)], minlength=4096)
        return [{"image_id": r["image_id"], "bucket": int(k), "bg": int(bg[k]), "fg": int(fg[k])} for k in np.flatnonzero(bg + fg)]

    return over_rows(tiles, COUNTS, count, slice_rows=4).groupBy("image_id", "bucket").agg(F.sum("bg").alias("bg"), F.sum("fg").alias("fg"))


def _map(tiles: DataFrame, of: Callable[[np.ndarray, dict], np.ndarray]) -> DataFrame:
    """One channel for each tile, 255 where of() says so."""

    def make(r: dict) -> list[dict]:
        return [pack(r["image_id"], np.where(of(unpack(r), r), 255, 0).astype(np.uint8)[..., None]) | {k: r[k] for k in KEYS if k != "image_id"}]

    return over_rows(tiles, TILE, make, slice_rows=4)


def enclosed_regions(tiles: DataFrame, size: int, least_count: int = 24, share: float = SEED_SHARE, least: int = 64, most_share: float = 0.004, fill: float = 0.38, room: int = 12) -> DataFrame:
    """image_id, area, box and first pixel of the regions of opaque matte in a colour that is background elsewhere and that
    foreground lies around on all sides.

    A colour is background's if max(least_count, 1e-5 of all) pixels of removed background have it and they are `share` of those that
    have it. A region has an area of max(least, 4e-5 of all) to max(that, most_share of all), covers `fill` of its box, and within a margin
    of 1.2 times its longer side (`room` at least, room or 8 % of the shorter side of the frame at most) there is neither removed
    background nor the frame's edge. tiles: tiles.split(size) of five channels. Colours and boxes come to the tiles; pixels stay."""
    frames = tiles.groupBy("image_id").agg(F.first("frame_h").alias("_h"), F.first("frame_w").alias("_w"))
    n, short = F.col("_h") * F.col("_w"), F.least("_h", "_w")
    known = colour_counts(tiles).join(frames, "image_id").filter((F.col("bg") >= F.greatest(F.lit(least_count), F.floor(n * 1e-5 + 0.5))) & (F.col("bg") / (F.col("bg") + F.col("fg")) >= share))
    colours = known.groupBy("image_id").agg(F.collect_list("bucket").alias("_colours"))  # 4096 at most
    seeds = _map(tiles.join(colours, "image_id"), lambda a, r: np.isin(_buckets(a), r["_colours"]) & (a[..., 3] >= 128) & (a[..., 4] >= ISLAND_SEED))
    found = components(seeds, 128).join(frames, "image_id")
    smallest = F.greatest(F.lit(least), F.floor(n * 4e-5 + 0.5))
    w, h = F.col("max_x") - F.col("min_x") + 1, F.col("max_y") - F.col("min_y") + 1
    far = F.greatest(F.lit(room), F.floor(short * 0.08 + 0.5))
    margin = F.greatest(F.lit(room), F.least(far, F.ceil(F.greatest(w, h) * 1.2)))
    found = found.filter((F.col("area") >= smallest) & (F.col("area") <= F.greatest(smallest, F.floor(n * most_share + 0.5))) & (F.col("area") / (w * h) >= fill)).withColumn("_m", margin.cast("int"))
    found = found.filter("min_x - _m > 0 and min_y - _m > 0 and max_x + _m < _w - 1 and max_y + _m < _h - 1")
    columns = ["image_id", "area", "min_x", "min_y", "max_x", "max_y", "first_pixel"]
    boxes = found.select(*columns, (F.col("min_x") - F.col("_m")).alias("l"), (F.col("min_y") - F.col("_m")).alias("t"), (F.col("max_x") + F.col("_m") + 1).alias("r"), (F.col("max_y") + F.col("_m") + 1).alias("b"))
    removed = _map(tiles, lambda a, r: a[..., 4] <= ISLAND_BACKGROUND)
    return box_sums(removed, boxes, size).filter("box_sum = 0").select(*columns)
