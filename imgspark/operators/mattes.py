"""Mattes from layers, scored candidate masks, heads and bands, painted pixels, and the replay of edit logs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finish, matte
from .edits import effective_edits, expand_strokes
from .rasters import RASTER, over_rows, over_steps, pack, unpack


def fuse_layers(layers: DataFrame) -> DataFrame:
    """layers: image_id, layer_idx, frame_h, frame_w, l, t, r, b, own_l, own_r (null: no band), height, width, data. A matte for each image.

    An image has 13 layers at most (the plan's budget), so a group is small; masks move, not pixels."""

    def make(r: dict) -> list[dict]:
        first = r["layers"][0]
        return [pack(r["image_id"], matte.fuse(first["frame_h"], first["frame_w"], _layers(r))[..., None])]

    return over_rows(_gathered(layers, "frame_h", "frame_w"), RASTER, make)


def _gathered(layers: DataFrame, *more: str) -> DataFrame:
    """The layers of each image, in order, in one row."""
    names = ["layer_idx", "l", "t", "r", "b", "own_l", "own_r", "detail", "height", "width", "data", *more]
    whole = layers if "detail" in layers.columns else layers.withColumn("detail", F.lit("person"))
    return whole.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("layers"))


def _layers(r: dict) -> list[matte.Layer]:
    found = []
    for q in r["layers"]:
        band = None if q["own_l"] is None else (q["own_l"], q["own_r"])
        found.append(matte.Layer(np.frombuffer(q["data"], np.uint8).reshape(q["height"], q["width"]), q["l"], q["t"], q["r"], q["b"], band, q["detail"]))
    return found


def finished_mattes(images: DataFrame, layers: DataFrame, output: str = "image") -> DataFrame:
    """RGBA rasters cut out by their layers: fused, holes and detached bits cleared, edges snapped, colours cleaned, curves applied.

    layers: as in fuse_layers, with `detail` (person, hair, edge). output: "image", or "mask" for the alpha alone. Layers of an image
    (13 at most) are gathered in a row and meet its pixels in one join; images without layers, and layers without image, are no job.
    The join is a merge: of masks Spark knows the size of their files, which may be a hundredth of what a broadcast would hold."""

    def make(r: dict) -> list[dict]:
        a = finish.finish(unpack(r), _layers(r), output == "image")
        return [pack(r["image_id"], a if output == "image" else a[..., 3:])]

    return over_rows(images.join(_gathered(layers).hint("merge"), "image_id"), RASTER, make, slice_rows=4)


def snap_to_edges(rasters: DataFrame, radius: int) -> DataFrame:
    """RGBA rasters with their alpha moved to the colour edges."""

    def make(r: dict) -> list[dict]:
        a = unpack(r).copy()
        a[..., 3] = finish.snap_to_edges(a, a[..., 3].copy(), radius)
        return [pack(r["image_id"], a)]

    return over_rows(rasters, RASTER, make)


def decontaminate(rasters: DataFrame, radius: int) -> DataFrame:
    """RGBA rasters without the background's share in the colours of soft pixels."""
    return over_rows(rasters, RASTER, lambda r: [pack(r["image_id"], finish.decontaminate(a := unpack(r), np.ascontiguousarray(a[..., 3]), radius))])


def remove_detached(masks: DataFrame) -> DataFrame:
    """Masks without small regions beside the largest one."""
    return over_rows(masks, RASTER, lambda r: [pack(r["image_id"], finish.remove_detached(np.ascontiguousarray(unpack(r)[..., 0]))[..., None])])


def mask_scores(masks: DataFrame, prompts: DataFrame, focus: DataFrame) -> DataFrame:
    """masks: image_id, mask_idx, quality, y, x (selected pixels); prompts: image_id, y, x, label; focus: image_id, l, t, r, b.

    Terms of the score: share of positive and of negative prompts inside, share of the area outside the focus."""
    area = masks.join(focus, "image_id").groupBy("image_id", "mask_idx").agg(
        F.first("quality").alias("quality"), F.count(F.lit(1)).alias("area"),
        F.count_if((F.col("x") >= F.col("l")) & (F.col("x") < F.col("r")) & (F.col("y") >= F.col("t")) & (F.col("y") < F.col("b"))).alias("inside"),
    )
    positive = F.col("label") != 0
    given = prompts.groupBy("image_id").agg(F.count_if(positive).alias("n_pos"), F.count_if(~positive).alias("n_neg"))
    hits = masks.join(prompts, ["image_id", "y", "x"]).groupBy("image_id", "mask_idx").agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    s = area.join(given, "image_id", "left").join(hits, ["image_id", "mask_idx"], "left").fillna(0, ["pos", "neg", "n_pos", "n_neg"])
    share = lambda a, n: F.when(F.col(n) > 0, F.col(a) / F.col(n)).otherwise(0.0)
    score = F.col("quality") + 2.5 * share("pos", "n_pos") - 3.5 * share("neg", "n_neg") - 2.25 * (1 - F.col("inside") / F.col("area"))
    return s.select("image_id", "mask_idx", "area", score.alias("score"))


def best_mask(scores: DataFrame) -> DataFrame:
    order = Window.partitionBy("image_id").orderBy(F.col("score").desc(), "mask_idx")
    return scores.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")


def distinct_heads(heads: DataFrame, mask_w: int, most: int = 8) -> DataFrame:
    """heads: image_id, min_x, max_x, area, first_pixel. The largest, in order of min_x, less those whose centre isn't clearly right of the one before (kept or not)."""
    big = Window.partitionBy("image_id").orderBy(F.col("area").desc(), "first_pixel")
    line = Window.partitionBy("image_id").orderBy("min_x", F.col("area").desc(), "first_pixel")
    h = heads.withColumn("rank", F.row_number().over(big)).filter(F.col("rank") <= most).withColumn("center", (F.col("min_x") + F.col("max_x") + 1) / 2)
    h = h.withColumn("gap", F.col("center") - F.lag("center").over(line))
    return h.filter(F.col("gap").isNull() | (F.col("gap") >= 0.035 * mask_w)).drop("rank", "gap")


def ownership_bands(heads: DataFrame, body: DataFrame) -> DataFrame:
    """Bands of columns between the midpoints of neighbouring heads; body: image_id, min_x, max_x gives the outer edges."""
    line = Window.partitionBy("image_id").orderBy("center", "first_pixel")
    h = heads.join(body.select("image_id", F.col("min_x").alias("body_l"), (F.col("max_x") + 1).alias("body_r")), "image_id")
    before, after = F.lag("center").over(line), F.lead("center").over(line)
    return h.select("image_id", "first_pixel", F.coalesce((before + F.col("center")) / 2, "body_l").alias("own_l"), F.coalesce((after + F.col("center")) / 2, "body_r").alias("own_r"))


def painted_pixels(pixels: DataFrame, points: DataFrame) -> DataFrame:
    """Visible pixels whose centre lies within the core radius max(1.5, 0.32 r) of a stroke point.

    Each point names the few pixels that it reaches, so an equality join takes the place of a range join."""
    core = F.greatest(F.lit(1.5), 0.32 * F.col("radius"))
    p = points.select("image_id", F.col("x").alias("px"), F.col("y").alias("py"), core.alias("core"))
    around = lambda c: F.explode(F.sequence(F.floor(F.col(c) - F.col("core") - 0.5), F.ceil(F.col(c) + F.col("core") - 0.5)))
    p = p.withColumn("y", around("py")).withColumn("x", around("px"))
    dx, dy = F.col("x") + 0.5 - F.col("px"), F.col("y") + 0.5 - F.col("py")
    reached = p.filter(dx * dx + dy * dy <= F.col("core") * F.col("core")).select("image_id", "y", "x").distinct()
    return pixels.filter(F.col("a") > 4).join(reached, ["image_id", "y", "x"], "left_semi").select("image_id", "y", "x")


def replay_edits(rasters: DataFrame, sources: DataFrame, log: DataFrame) -> DataFrame:
    """RGBA rasters after their logs: strokes that were not undone, spread to steps, erase or restore in order.

    log: image_id, stroke_id, seq, x, y, radius, tool. A raster without a log comes out as it is; without a source it restores itself."""
    steps = expand_strokes(effective_edits(log))
    both = rasters.join(sources.select("image_id", F.col("data").alias("source")), "image_id", "left")

    def begin(r: dict) -> tuple:
        a = unpack(r)
        return r["image_id"], a, a.copy() if r["source"] is None else unpack(r | {"data": r["source"]})

    def apply(state: tuple, s: dict) -> tuple:
        i, a, source = state
        at = s["at_x"], s["at_y"], s["radius"]
        return i, matte.erase(a, *at, out=a) if s["tool"] == "erase" else matte.restore(a, source, *at, out=a), source

    return over_steps(both, steps, ["seq", "step"], RASTER, begin, apply, lambda state: pack(*state[:2]))
