"""Colour cleaning of frames that are tiles, by levels of dependence.

A soft pixel is drawn to the most opaque pixel on its rays, and to that one's cleaned colour if it comes earlier in raster order. Such
chains may wind through many tiles, far beyond any halo. Each tile first settles all pixels whose chains stay inside of it. What
depends on a soft pixel of another tile becomes a row: its own numbers, and the pixel that it waits for. These rows alone go
through rounds: who waits for nobody that is open gets its colour, from the settled border pixels or from the rounds
before. Alpha rises by 12 at each link, so a chain has 21 links at most, and so have the rounds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.finish import SOFT_HIGH, SOFT_LOW, cleaned, pulls
from ..sources.shared import shared_dir
from .rasters import over_rows, pack
from .tiles import KEYS, TILE, around, with_pieces

#: Kinds: `tile` has what is settled in its pixels, `done` is a settled pixel near a border, `wait` one that waits for `inner`.
PARTS = TILE + ", kind string, p long, inner long, rgb int, state binary"
PLACE = [x.split(" ")[0] for x in TILE.split(", ")]
#: own, best, c, colour of the inner pixel, and colour and distance of what each of eight rays meets.
STATE = np.dtype([("own", "<i4"), ("best", "<i4"), ("c", "<f8", 3), ("inner", "<f8", 3), ("back", "<f8", (8, 3)), ("back_d", "<f8", 8)])


def _settled(r: dict, radius: int) -> list[dict]:
    own, a, top, left = around(r, radius)
    h, w = own["height"], own["width"]
    y0, x0, wide = own["top"] - top, own["left"] - left, a.shape[1]
    alpha, inside = a[..., 3], np.zeros(a.shape[:2], bool)
    inside[y0 : y0 + h, x0 : x0 + w] = True
    soft = (alpha > SOFT_LOW) & (alpha < SOFT_HIGH)
    p = pulls(a, alpha, np.flatnonzero(soft & inside), radius)
    at, inner = p["at"], p["inner"]
    before, now = a.reshape(-1, a.shape[-1])[:, :3].astype(np.float64), a.copy().reshape(-1, a.shape[-1])
    place = np.full(a.shape[0] * wide, -1)
    place[at] = np.arange(len(at))
    waits = (inner < at) & soft.ravel()[inner]
    abroad = waits & ~inside.ravel()[inner]
    blocked = waits & ~abroad & (place[inner] >= 0)
    open_ = np.ones(len(at), bool)
    while len(s := np.flatnonzero(open_ & ~abroad & ~(blocked & open_[place[inner]]))):
        toward = np.where((inner[s] < at[s])[:, None], now[inner[s], :3].astype(np.float64), before[inner[s]])
        now[at[s], :3] = cleaned(before[at[s]], toward, p["own"][s], p["best"][s], p["back"][:, s], p["back_d"][:, s], radius)
        open_[s] = False
    place_of = {k: own[k] for k in KEYS[3:]} | {k: r[k] for k in KEYS[:3]}
    index = lambda q: (top + q // wide) * own["frame_w"] + left + q % wide
    none = {"p": None, "inner": None, "rgb": None, "state": None}
    pixels = np.ascontiguousarray(now.reshape(a.shape)[y0 : y0 + h, x0 : x0 + w])
    out = [pack(r["image_id"], pixels) | place_of | {"kind": "tile"} | none]
    bare = {n: None for n in PLACE} | place_of
    ys, xs = at // wide - y0, at % wide - x0
    near = (np.minimum(np.minimum(ys, h - 1 - ys), np.minimum(xs, w - 1 - xs)) < radius) & ~open_
    for i in np.flatnonzero(near):
        out.append(bare | none | {"kind": "done", "p": int(index(at[i])), "rgb": _packed(now[at[i], :3])})
    for i in np.flatnonzero(open_):
        state = np.array([(p["own"][i], p["best"][i], before[at[i]], before[inner[i]], p["back"][:, i], p["back_d"][:, i])], STATE)
        out.append(bare | none | {"kind": "wait", "p": int(index(at[i])), "inner": int(index(inner[i])), "state": state.tobytes()})
    return out


def _packed(rgb: np.ndarray) -> int:
    return int(rgb[0]) << 16 | int(rgb[1]) << 8 | int(rgb[2])


def _unpacked(rgb: int) -> list[int]:
    return [rgb >> 16, rgb >> 8 & 255, rgb & 255]


def decontaminate(tiles: DataFrame, radius: int) -> DataFrame:
    """RGBA tiles (tiles.split) with the colours of their soft pixels cleaned as over the whole frame. Tiles need `radius` rows and
    columns at least, those at the right and bottom excepted."""
    shared_dir(tiles.sparkSession)
    parts = over_rows(with_pieces(tiles, radius), PARTS, lambda r: _settled(r, radius), slice_rows=2).checkpoint()
    known = parts.filter("kind = 'done'").select("image_id", "p", "rgb")
    waiting = parts.filter("kind = 'wait'").select("image_id", "tile_y", "tile_x", "p", "inner", "state")
    late = waiting.select("image_id", "tile_y", "tile_x", "p", F.lit(None).cast("int").alias("rgb")).limit(0)

    def finish(r: dict) -> list[dict]:
        s = np.frombuffer(r["state"], STATE)
        toward = np.array([_unpacked(r["toward"])], np.float64) if r["toward"] is not None else s["inner"]
        rgb = cleaned(s["c"], toward, s["own"].astype(np.int64), s["best"].astype(np.int64), s["back"].transpose(1, 0, 2), s["back_d"].T, radius)[0]
        return [{k: r[k] for k in ("image_id", "tile_y", "tile_x", "p")} | {"rgb": _packed(rgb)}]

    while not waiting.isEmpty():
        asked = waiting.join(waiting.select("image_id", F.col("p").alias("inner"), F.lit(True).alias("open")), ["image_id", "inner"], "left")
        ready = asked.filter("open is null").join(known.select("image_id", F.col("p").alias("inner"), F.col("rgb").alias("toward")), ["image_id", "inner"], "left")
        new = over_rows(ready.select("image_id", "tile_y", "tile_x", "p", "state", "toward"), "image_id long, tile_y int, tile_x int, p long, rgb int", finish, slice_rows=64).checkpoint()
        late, known = late.unionByName(new), known.unionByName(new.select("image_id", "p", "rgb"))
        waiting = asked.filter("open").drop("open").select(*waiting.columns).checkpoint()
    changes = late.groupBy("image_id", "tile_y", "tile_x").agg(F.collect_list(F.struct("p", "rgb")).alias("changes"))

    def paint(r: dict) -> list[dict]:
        a = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"]).copy()
        for c in r["changes"] or []:
            a[c["p"] // r["frame_w"] - r["top"], c["p"] % r["frame_w"] - r["left"], :3] = _unpacked(c["rgb"])
        return [{n: r[n] for n in PLACE} | {"data": a.tobytes()}]

    whole = parts.filter("kind = 'tile'").select(*PLACE)
    return over_rows(whole.join(changes, ["image_id", "tile_y", "tile_x"], "left"), TILE, paint, slice_rows=4)
