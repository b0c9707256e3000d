"""Pixel tables (image_id, y, x, ...): histograms, down-maps, votes, joins with zones, small masks as rows.

This form is for aggregates and small masks; whole frames are worked on as raster rows (kernels.py)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pixels import color_bucket, merge_alpha, polish_alpha


def color_histogram(pixels: DataFrame) -> DataFrame:
    """Per image and colour bucket the pixels of background (alpha 24 or less) and foreground (232 or more)."""
    seen = pixels.filter(F.col("a") >= 128).withColumn("bucket", color_bucket(F.col("r"), F.col("g"), F.col("b")))
    seen = seen.filter((F.col("mask") <= 24) | (F.col("mask") >= 232))
    return seen.groupBy("image_id", "bucket").agg(F.count_if(F.col("mask") <= 24).alias("bg"), F.count_if(F.col("mask") >= 232).alias("fg"))


def max_pool(pixels: DataFrame, side: int, edge: int) -> DataFrame:
    """The largest mask value of each cell of an edge x edge map."""
    cell = lambda c: F.floor(F.col(c) * edge / side).cast("int")
    return pixels.groupBy("image_id", cell("y").alias("my"), cell("x").alias("mx")).agg(F.max("mask").alias("mask"))


def finished_alpha(pixels: DataFrame, fine: Column) -> DataFrame:
    return pixels.select("image_id", "y", "x", merge_alpha(polish_alpha(F.col("mask"), fine), F.col("a")).alias("alpha"))


def in_zones(pixels: DataFrame, zones: DataFrame) -> DataFrame:
    """Pixels inside any zone (left, top, right, bottom exclusive) of their image."""
    p, z = pixels.alias("p"), zones.alias("z")
    inside = "p.image_id = z.image_id and p.x >= z.l and p.x < z.r and p.y >= z.t and p.y < z.b"
    return p.join(z, F.expr(inside), "left_semi")


def layer_votes(layers: DataFrame) -> DataFrame:
    """layers: image_id, y, x, pred. Background votes (56 or less, at most 127), foreground veto (210 or more), lowest background prediction."""
    bg = F.col("pred") <= 56
    return layers.groupBy("image_id", "y", "x").agg(
        F.least(F.lit(127), F.count_if(bg)).cast("long").alias("bg_votes"), F.coalesce(F.bool_or(F.col("pred") >= 210), F.lit(False)).alias("fg_veto"), F.min(F.when(bg, F.floor(F.col("pred") + 0.5))).cast("long").alias("lowest_bg")
    )


def layer_evidence(preds: DataFrame, crops: DataFrame) -> DataFrame:
    """The two vote sets of a picture's layers: image_id, y, x, and votes, veto and lowest background of consensus, votes and veto of refinement.

    preds: image_id, layer_idx, y, x, pred; crops: image_id, layer_idx, l, t, r, b, own_l, own_r, detail. Only pixels inside of a crop by a
    margin of max(2, 4 % of its shorter side) count. Consensus is of person crops with a band of their own, if a picture has two of
    them, and counts pixels in and out of the band; refinement is of every layer but the first and counts the band's pixels only.
    Crops meet their pixels by picture and layer; all that is left is one partial aggregate a pixel."""
    c = F.col
    banded = (c("detail") == "person") & c("own_l").isNotNull()
    margin = F.greatest(F.lit(2), F.floor(F.least(c("r") - c("l"), c("b") - c("t")) * 0.04 + 0.5))
    several = crops.groupBy("image_id").agg((F.count_if(banded) >= 2).alias("_consensus"), (F.count(F.lit(1)) >= 2).alias("_refinement"))
    known = crops.join(several, "image_id").select("image_id", "layer_idx", "l", "t", "r", "b", "own_l", "own_r", margin.alias("m"), (c("_consensus") & banded).alias("_consensus"), (c("_refinement") & (c("layer_idx") > 0)).alias("_refinement"))
    inside = (c("x") >= c("l") + c("m")) & (c("x") < c("r") - c("m")) & (c("y") >= c("t") + c("m")) & (c("y") < c("b") - c("m"))
    met = preds.join(known, ["image_id", "layer_idx"]).filter(inside & (c("_consensus") | c("_refinement")))
    owned = c("_refinement") & (c("own_l").isNull() | (c("x") >= c("own_l")) & (c("x") < c("own_r")))
    bg, fg = c("pred") <= 56, c("pred") >= 210
    votes = lambda which: F.least(F.lit(127), F.count_if(which & bg)).cast("long")
    return met.groupBy("image_id", "y", "x").agg(
        votes(c("_consensus")).alias("consensus_votes"), F.bool_or(c("_consensus") & fg).alias("consensus_veto"), F.min(F.when(c("_consensus") & bg, F.floor(c("pred") + 0.5))).cast("long").alias("lowest_bg"),
        votes(owned).alias("refine_votes"), F.bool_or(owned & fg).alias("refine_veto"),
    )


def selected(pixels: DataFrame) -> DataFrame:
    return pixels.filter((F.col("mask") >= 128) & (F.col("a") > 4)).select("image_id", "y", "x")


def selection_size(pixels: DataFrame) -> DataFrame:
    chosen = (F.col("mask") >= 128) & (F.col("a") > 4)
    return pixels.groupBy("image_id").agg(F.count_if(chosen).alias("n_selected"))


def box_sums(pixels: DataFrame) -> DataFrame:
    """Summed-area table of the mask: the sum over all pixels above and left, own included."""
    across = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    rows = pixels.withColumn("row_sum", F.sum("mask").over(across))
    return rows.select("image_id", "y", "x", F.sum("row_sum").over(down).alias("area_sum"))


def iou(a: str, b: str) -> Column:
    side = lambda lo, hi: F.greatest(F.lit(0), F.least(F.col(f"{a}.{hi}"), F.col(f"{b}.{hi}")) - F.greatest(F.col(f"{a}.{lo}"), F.col(f"{b}.{lo}")))
    area = lambda t: (F.col(f"{t}.r") - F.col(f"{t}.l")) * (F.col(f"{t}.b") - F.col(f"{t}.t"))
    both = side("l", "r") * side("t", "b")
    return both / (area(a) + area(b) - both)


def drop_duplicate_rects(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates without an existing rectangle of the same image with area ratio 0.55 or more and IoU 0.58 or more."""
    area = lambda t: (F.col(f"{t}.r") - F.col(f"{t}.l")) * (F.col(f"{t}.b") - F.col(f"{t}.t"))
    ratio = F.least(area("c"), area("e")) / F.greatest(area("c"), area("e"))
    on = (F.col("c.image_id") == F.col("e.image_id")) & (ratio >= 0.55) & (iou("c", "e") >= 0.58)
    return candidates.alias("c").join(existing.alias("e"), on, "left_anti")


def keep_intersecting(rects: DataFrame, focus: DataFrame) -> DataFrame:
    on = "c.image_id = f.image_id and c.l < f.r and f.l < c.r and c.t < f.b and f.t < c.b"
    return rects.alias("c").join(focus.alias("f"), F.expr(on), "left_semi")


def apply_selection(pixels: DataFrame, selections: DataFrame) -> DataFrame:
    """Alpha taken out where a selection (image_id, y, x, mask) covers; half goes to even, as bytes are stored."""
    s = selections.select("image_id", "y", "x", F.col("mask").alias("taken"))
    out = F.rint(F.col("a") * (255 - F.coalesce("taken", F.lit(0))) / 255).cast("int")
    return pixels.join(s, ["image_id", "y", "x"], "left").select("image_id", "y", "x", out.alias("alpha"))
