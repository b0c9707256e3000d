"""Frames too large for one task, as tiles: image_id, tile_y, tile_x, frame_h, frame_w, top, left, height, width, channels, bits, data.

Stencils exchange only the borders of tiles. Components are labelled in each tile; the labels then meet along the borders, and only
labels, never pixels, go through the rounds that join them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..sources.shared import shared_dir
from .rasters import RASTER, over_rows, pack, unpack

PLACE = "image_id long, tile_y int, tile_x int, frame_h int, frame_w int, top int, left int"
TILE = PLACE + ", height int, width int, channels int, bits int, data binary"
KEYS = [x.split(" ")[0] for x in PLACE.split(", ")]


def split(rasters: DataFrame, size: int) -> DataFrame:
    """Tiles of size x size at most, in rows and columns."""

    def make(r: dict) -> list[dict]:
        a = unpack(r)
        h, w = a.shape[:2]
        return [
            pack(r["image_id"], a[y : y + size, x : x + size]) | {"tile_y": y // size, "tile_x": x // size, "frame_h": h, "frame_w": w, "top": y, "left": x}
            for y in range(0, h, size) for x in range(0, w, size)
        ]

    return over_rows(rasters, TILE, make, slice_rows=1)


def _strips(r: dict, halo: int) -> list[dict]:
    """The tile itself and what of it its eight neighbours need."""
    a = unpack(r)
    h, w = a.shape[:2]
    out = []
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            rows = slice(0, halo) if dy < 0 else slice(max(0, h - halo), h) if dy > 0 else slice(0, h)
            columns = slice(0, halo) if dx < 0 else slice(max(0, w - halo), w) if dx > 0 else slice(0, w)
            piece = np.ascontiguousarray(a[rows, columns])
            out.append(pack(r["image_id"], piece) | {"tile_y": r["tile_y"] + dy, "tile_x": r["tile_x"] + dx, "frame_h": r["frame_h"], "frame_w": r["frame_w"],
                                                     "top": r["top"] + (rows.start or 0), "left": r["left"] + (columns.start or 0), "own": not dy and not dx})
    return out


def stencil(tiles: DataFrame, halo: int, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """kernel over each tile with `halo` pixels around it, as if over the whole frame, if it reaches no farther than that.

    Tiles need `halo` rows and columns at least, those at the right and bottom excepted; the frame's own edges stay edges. A tile
    receives nine pieces at most, so the groups here are small whatever the frame."""

    def make(r: dict) -> list[dict]:
        own, a, top, left = around(r, halo)
        y, x = own["top"] - top, own["left"] - left
        done = pack(r["image_id"], np.ascontiguousarray(kernel(a)[y : y + own["height"], x : x + own["width"]]))
        return [done | {k: own[k] for k in KEYS[3:]} | {k: r[k] for k in KEYS[:3]}]

    return over_rows(with_pieces(tiles, halo), TILE, make, slice_rows=2)


def with_pieces(tiles: DataFrame, halo: int) -> DataFrame:
    """Each tile with what it needs of its neighbours: image_id, tile_y, tile_x and pieces, nine at most."""
    pieces = over_rows(tiles, TILE + ", own boolean", lambda r: _strips(r, halo), slice_rows=2)
    at = ["image_id", "tile_y", "tile_x"]
    met = pieces.groupBy(*at).agg(F.collect_list(F.struct(*[c for c in pieces.columns if c not in at])).alias("pieces"))
    return met.filter(F.exists("pieces", lambda p: p["own"]))


def around(r: dict, halo: int) -> tuple[dict, np.ndarray, int, int]:
    """(the tile's own piece, its pixels with those around it, the window's top and left in the frame) of a row of with_pieces()."""
    rows = r["pieces"]
    own = next(p for p in rows if p["own"])
    top, left = max(0, own["top"] - halo), max(0, own["left"] - halo)
    bottom, right = min(own["frame_h"], own["top"] + own["height"] + halo), min(own["frame_w"], own["left"] + own["width"] + halo)
    a = np.zeros((bottom - top, right - left, own["channels"]), np.uint16 if own["bits"] == 16 else np.uint8)
    for q in rows:
        p = unpack(q)[max(0, top - q["top"]) :, max(0, left - q["left"]) :]
        y, x = max(q["top"], top) - top, max(q["left"], left) - left
        p = p[: max(0, a.shape[0] - y), : max(0, a.shape[1] - x)]
        a[y : y + p.shape[0], x : x + p.shape[1]] = p
    return own, a, top, left


def join(tiles: DataFrame) -> DataFrame:
    """Whole rasters again, for frames that fit a task."""

    def make(r: dict) -> list[dict]:
        first = r["tiles"][0]
        a = np.zeros((first["frame_h"], first["frame_w"], first["channels"]), np.uint16 if first["bits"] == 16 else np.uint8)
        for t in r["tiles"]:
            a[t["top"] : t["top"] + t["height"], t["left"] : t["left"] + t["width"]] = unpack(t)
        return [pack(r["image_id"], a)]

    return over_rows(tiles.groupBy("image_id").agg(F.collect_list(F.struct(*[c for c in tiles.columns if c != "image_id"])).alias("tiles")), RASTER, make, slice_rows=1)


def _local(r: dict, threshold: int) -> list[dict]:
    """Each region of a tile (border false), and each border pixel with its region; a region is named by its first pixel in the frame."""
    on = unpack(r)[..., 0] >= threshold
    labels, n = K.components(on)
    stats = K.component_stats(labels, n)
    w, top, left = r["frame_w"], r["top"], r["left"]
    name = [0] + [(top + s[6] // on.shape[1]) * w + left + s[6] % on.shape[1] for s in stats]
    out = [
        {"image_id": r["image_id"], "part": name[s[0]], "area": s[1], "min_x": left + s[2], "min_y": top + s[3], "max_x": left + s[4], "max_y": top + s[5], "border": False}
        for s in stats
    ]
    rim = np.zeros(on.shape, bool)
    rim[[0, -1]] = rim[:, [0, -1]] = True
    for y, x in zip(*np.nonzero(rim & on), strict=True):
        out.append({"image_id": r["image_id"], "part": name[labels[y, x]], "area": 0, "min_x": left + int(x), "min_y": top + int(y), "max_x": 0, "max_y": 0, "border": True})
    return out


def components(tiles: DataFrame, threshold: int) -> DataFrame:
    """Area, box and first pixel of the 8-connected regions of whole frames at or above the threshold.

    Rounds of least neighbour and pointer jumping over labels that touch another tile's; each round is checkpointed to the shared
    folder. The number of rounds grows with the logarithm of the tiles that a region winds through."""
    names = ["part", "area", "min_x", "min_y", "max_x", "max_y"]
    found = over_rows(tiles, "image_id long, " + ", ".join(f"{n} long" for n in names) + ", border boolean", lambda r: _local(r, threshold), slice_rows=4)
    shared_dir(tiles.sparkSession)
    found = found.checkpoint()
    rim = found.filter("border").select("image_id", "part", F.col("min_y").alias("y"), F.col("min_x").alias("x"))
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in K.RING])
    beside = rim.select("image_id", F.col("part").alias("other"), "y", "x", F.explode(steps).alias("s")).select("image_id", "other", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    links = rim.join(beside, ["image_id", "y", "x"]).filter("part <> other").select("image_id", "part", "other").distinct().checkpoint()
    of = links.select("image_id", "part", F.col("part").alias("root")).distinct().checkpoint()
    while True:
        near = links.join(of.select("image_id", F.col("part").alias("other"), F.col("root").alias("near")), ["image_id", "other"]).groupBy("image_id", "part").agg(F.min("near").alias("near"))
        least = of.join(near, ["image_id", "part"]).select("image_id", "part", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = least.select("image_id", F.col("part").alias("root"), F.col("root").alias("farther"))
        # a root may stand for its own region's parts only after both have been lowered, so the jump takes the lower of the two
        new = least.join(jump, ["image_id", "root"], "left").select("image_id", "part", "old", F.least("root", F.coalesce("farther", "root")).alias("root")).checkpoint()
        moved = new.filter("root < old").limit(1).count()
        of = new.drop("old")
        if not moved:
            break
    named = found.filter("not border").join(of, ["image_id", "part"], "left").withColumn("first_pixel", F.coalesce("root", "part"))
    return named.groupBy("image_id", "first_pixel").agg(
        F.sum("area").alias("area"), F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y")
    )
