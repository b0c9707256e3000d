"""Sums over boxes of tiled frames, and greedy suppression of overlapping boxes, as joins of numbers."""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_dir
from .rasters import over_rows, unpack

EDGES = "image_id long, tile_y int, tile_x int, kind string, at int, total long"


def tile_edges(tiles: DataFrame) -> DataFrame:
    """What a tile's neighbours need of it, in numbers: its sum (`all`), and the sums of its first n rows (`rows`) and columns
    (`columns`) for every n."""

    def sums(r: dict) -> list[dict]:
        a = unpack(r)[..., 0].astype(np.int64)
        place = {k: r[k] for k in ("image_id", "tile_y", "tile_x")}
        out = [place | {"kind": "all", "at": 0, "total": int(a.sum())}]
        for kind, axis in (("rows", 1), ("columns", 0)):
            out += [place | {"kind": kind, "at": n, "total": t} for n, t in enumerate(np.cumsum(a.sum(axis=axis)).tolist(), 1)]
        return out

    return over_rows(tiles, EDGES, sums, slice_rows=4)


def carries(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corner, left, above) of every tile: the sum of all tiles above and left of it, of the first n rows of the tiles left of it,
    and of the first n columns of the tiles above it. Windows hold one row or column of tiles."""
    before = lambda *by: Window.partitionBy(*by)
    upto = (Window.unboundedPreceding, -1)
    none = lambda c: F.coalesce(c, F.lit(0))
    left = edges.filter("kind = 'rows'").withColumn("left", none(F.sum("total").over(before("image_id", "tile_y", "at").orderBy("tile_x").rowsBetween(*upto))))
    above = edges.filter("kind = 'columns'").withColumn("above", none(F.sum("total").over(before("image_id", "tile_x", "at").orderBy("tile_y").rowsBetween(*upto))))
    across = edges.filter("kind = 'all'").withColumn("across", none(F.sum("total").over(before("image_id", "tile_y").orderBy("tile_x").rowsBetween(*upto))))
    corner = across.withColumn("corner", none(F.sum("across").over(before("image_id", "tile_x").orderBy("tile_y").rowsBetween(*upto))))
    place = ["image_id", "tile_y", "tile_x"]
    return corner.select(*place, "corner"), left.select(*place, F.col("at").alias("in_y"), "left"), above.select(*place, F.col("at").alias("in_x"), "above")


def box_sums(tiles: DataFrame, boxes: DataFrame, size: int, few: int = 200_000) -> DataFrame:
    """boxes (image_id, l, t, r, b and any others; right and bottom exclusive) with box_sum, the sum of the first channel inside.

    tiles: frames by tiles.split(size). Of the four corners of a box each needs the sum over all pixels above and left of it: within
    its own tile, the first rows of the tiles left of that, the first columns of those above, and all tiles above and left.
    Only numbers are joined. Up to `few` places are broadcast to where the pixels lie; more of them meet the tiles in a
    join by place, which moves each tile once. Boxes are cut to the frame; of an empty box, or one outside of all tiles, the sum is 0."""
    shared_dir(tiles.sparkSession)
    frames = tiles.groupBy("image_id").agg(F.first("frame_h").alias("_h"), F.first("frame_w").alias("_w"))
    named = boxes.withColumn("_box", F.monotonically_increasing_id()).checkpoint()
    cut = named.join(frames, "image_id").select("_box", "image_id", *[F.least(F.greatest(F.col(c), F.lit(0)), F.col(m)).cast("int").alias(c) for c, m in (("l", "_w"), ("r", "_w"), ("t", "_h"), ("b", "_h"))]).filter("l < r and t < b")
    at = lambda y, x, sign: F.struct(F.col(y).alias("y"), F.col(x).alias("x"), F.lit(sign).alias("sign"))
    corners = cut.select("_box", "image_id", F.explode(F.array(at("b", "r", 1), at("t", "r", -1), at("b", "l", -1), at("t", "l", 1))).alias("c")).select("_box", "image_id", "c.*").filter("y > 0 and x > 0")
    tile, inside = lambda c: F.floor((F.col(c) - 1) / size).cast("int"), lambda c: (F.pmod(F.col(c) - 1, F.lit(size)) + 1).cast("int")
    corners = corners.select("_box", "image_id", "sign", tile("y").alias("tile_y"), tile("x").alias("tile_x"), inside("y").alias("in_y"), inside("x").alias("in_x"))
    place = ["image_id", "tile_y", "tile_x"]
    asked = corners.groupBy(*place).agg(F.sort_array(F.collect_set(F.struct("in_y", "in_x"))).alias("asked"))  # size * size at most
    asked = asked.checkpoint()
    own = _within(tiles.join(F.broadcast(asked) if asked.count() <= few else asked, place))
    corner, left, above = carries(tile_edges(tiles).checkpoint())
    met = corners.join(own, [*place, "in_y", "in_x"]).join(left, [*place, "in_y"]).join(above, [*place, "in_x"]).join(corner, place)
    total = met.groupBy("_box").agg(F.sum(F.col("sign") * (F.col("own") + F.col("left") + F.col("above") + F.col("corner"))).alias("_sum"))
    return named.join(total, "_box", "left").select(*boxes.columns, F.coalesce("_sum", F.lit(0)).cast("long").alias("box_sum"))


def _within(tiles: DataFrame) -> DataFrame:
    def read(r: dict) -> list[dict]:
        a = unpack(r)[..., 0].astype(np.int64).cumsum(0).cumsum(1)
        return [{"image_id": r["image_id"], "tile_y": r["tile_y"], "tile_x": r["tile_x"], "in_y": q["in_y"], "in_x": q["in_x"], "own": int(a[q["in_y"] - 1, q["in_x"] - 1])} for q in r["asked"]]

    return over_rows(tiles, "image_id long, tile_y int, tile_x int, in_y int, in_x int, own long", read, slice_rows=4)


def overlap_links(rects: DataFrame, most: Column, cell: int) -> DataFrame:
    """image_id, rank and better: pairs of rectangles whose overlap (IoU) exceeds most, the better one by rank.

    rects: image_id, rank and l, t, r, b. A pair is found in the first cell of a grid that both touch."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(hi) - 1) / cell))
    laid = rects.filter("l < r and t < b").withColumn("cy", F.explode(span("t", "b"))).withColumn("cx", F.explode(span("l", "r")))
    a, b = laid.alias("a"), laid.alias("b")
    wide = F.least("a.r", "b.r") - F.greatest("a.l", "b.l")
    high = F.least("a.b", "b.b") - F.greatest("a.t", "b.t")
    area = lambda t: (F.col(f"{t}.r") - F.col(f"{t}.l")) * (F.col(f"{t}.b") - F.col(f"{t}.t"))
    both = wide * high
    first = (F.col("a.cy") == F.floor(F.greatest("a.t", "b.t") / cell)) & (F.col("a.cx") == F.floor(F.greatest("a.l", "b.l") / cell))
    same = (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.rank") < F.col("b.rank"))
    met = a.join(b, same & first & (wide > 0) & (high > 0) & (both > most * (area("a") + area("b") - both)))
    return met.select("a.image_id", F.col("b.rank").alias("rank"), F.col("a.rank").alias("better"))


def suppress_overlaps(rects: DataFrame, limit: Column, most: float = 0.30, cell: int = 64, order: tuple[str, ...] = ("cand",)) -> DataFrame:
    """rects (image_id, score, l, t, r, b and what orders equal scores) that a greedy choice keeps: best score first, none that overlaps a
    kept one by more than most, `limit` (an expression over rects) of an image at most.

    Rounds over the graph of overlaps: a rectangle is kept once all better ones that overlap it are gone, and goes once one of them is
    kept. Each round settles at least the best of what is open, mostly far more, and is checkpointed; only numbers are joined."""
    shared_dir(rects.sparkSession)
    line = Window.partitionBy("image_id").orderBy(F.desc("score"), *order)
    ranked = rects.withColumns({"rank": F.row_number().over(line), "_limit": limit}).checkpoint()
    links = overlap_links(ranked.select("image_id", "rank", *[F.col(c).cast("double").alias(c) for c in "ltrb"]), F.lit(most), cell).checkpoint()
    known = ranked.join(links.select("image_id", "rank").distinct(), ["image_id", "rank"], "left_anti").select("image_id", "rank", F.lit(True).alias("kept"))
    while not links.isEmpty():
        said = links.join(known.select("image_id", F.col("rank").alias("better"), F.col("kept").alias("_kept")), ["image_id", "better"], "left")
        gone = F.coalesce(F.bool_or("_kept"), F.lit(False))
        free = F.bool_and(F.coalesce(~F.col("_kept"), F.lit(False)))
        new = said.groupBy("image_id", "rank").agg(gone.alias("gone"), free.alias("kept")).filter("gone or kept").select("image_id", "rank", "kept")
        known = known.unionByName(new).checkpoint()
        links = links.join(known.select("image_id", "rank"), ["image_id", "rank"], "left_anti").checkpoint()
    kept = ranked.join(known.filter("kept").select("image_id", "rank"), ["image_id", "rank"])
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("rank"))
    return kept.withColumn("place", place).filter("place <= _limit").select(*rects.columns, "place")
