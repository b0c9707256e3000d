"""Selections: prompted masks, their clean-up, placing in the frame, and brush lines. One row a selection, no pairs of pixels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import selection as S
from ..functions.kernels import flatten_alpha, half_up, resample
from .rasters import RASTER, over_rows, over_steps, pack, unpack

#: Means and deviations of the channels in the models' training pictures; longest edge of a prompted input.
MEAN, DEVIATION, PROMPTED_EDGE = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225), 1024


def gathered(points: DataFrame) -> DataFrame:
    """Stroke points of each image in one row, in order. They are what one person painted on one picture."""
    entry = F.struct("seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("radius").cast("double").alias("radius"), F.coalesce(F.col("label"), F.lit(1)).alias("label"))
    return points.groupBy("image_id").agg(F.array_sort(F.collect_list(entry)).alias("points"))


def _plain(points: list[dict] | None, positive: bool = True) -> list[S.Point]:
    return [(p["x"], p["y"], p["radius"]) for p in points or [] if (p["label"] != 0) == positive]


def refine_selections(masks: DataFrame, rasters: DataFrame, points: DataFrame) -> DataFrame:
    """Masks (255 or 0) cleaned up around the positive points; rasters are the RGBA pictures of the same size.

    A picture without points keeps all of its mask that is visible. Result: raster rows and n_selected, 0 of which is an error to show."""
    both = masks.join(rasters.select("image_id", F.col("data").alias("pixels")), "image_id").join(gathered(points), "image_id", "left")

    def make(r: dict) -> list[dict]:
        mask = unpack(r)[..., 0]
        on = S.refine(mask, np.frombuffer(r["pixels"], np.uint8).reshape(*mask.shape, 4), _plain(r["points"]))
        return [pack(r["image_id"], on[..., None].astype(np.uint8) * 255) | {"n_selected": int(on.sum())}]

    return over_rows(both, RASTER + ", n_selected long", make)


def normalised(rgb: np.ndarray, edge: int | None = None) -> np.ndarray:
    """Channels first, in single precision, less the mean over the deviation; padded with zeros to a square of `edge`."""
    a = ((rgb.astype(np.float32) / np.float32(255) - np.float32(MEAN)) / np.float32(DEVIATION)).transpose(2, 0, 1)
    return a if edge is None else np.pad(a, ((0, 0), (0, edge - a.shape[1]), (0, edge - a.shape[2])))


def prompted_masks(rasters: DataFrame, prompts: DataFrame, make_predict: Callable[[], Callable], edge: int = PROMPTED_EDGE) -> DataFrame:
    """The best of the model's masks for each picture with prompts, 255 or 0, with its number and score.

    predict(input, points, labels, height, width) -> (masks of that size, qualities); input is normalised and padded to edge x edge,
    points are scaled to it. prompts: sample_prompts(). The model is loaded once in a worker stream."""
    held: list = []

    def make(r: dict) -> list[dict]:
        if not held:
            held.append(make_predict())
        a = unpack(r)
        h, w = a.shape[:2]
        scale = edge / max(h, w)
        small = resample(flatten_alpha(a) if a.shape[2] == 4 else a[..., :3], *(max(1, int(half_up(np.float64(n * scale)))) for n in (h, w)))
        yes, no = _plain(r["points"]), _plain(r["points"], False)
        at = np.array([(p[0] * scale, p[1] * scale) for p in yes + no])
        found, quality = held[0](normalised(small, edge), at, np.array([1] * len(yes) + [0] * len(no)), h, w)
        scores = [S.prompt_score(m, float(q), yes, no) for m, q in zip(found, quality, strict=True)]
        best = int(np.argmax(scores))
        return [pack(r["image_id"], (found[best] != 0).astype(np.uint8)[..., None] * 255) | {"mask_idx": best, "score": scores[best]}]

    return over_rows(rasters.join(gathered(prompts), "image_id"), RASTER + ", mask_idx int, score double", make, slice_rows=4)


def place_selections(masks: DataFrame, windows: DataFrame) -> DataFrame:
    """Masks of crops at their place in empty frames; windows: image_id, l, t, r, b, frame_h, frame_w."""
    return over_rows(masks.join(windows, "image_id"), RASTER, lambda r: [pack(r["image_id"], S.place(unpack(r)[..., 0], (r["l"], r["t"], r["r"], r["b"]), r["frame_h"], r["frame_w"])[..., None])])


def edit_selections(selections: DataFrame, rasters: DataFrame, lines: DataFrame) -> DataFrame:
    """Selections after their brush lines in order of seq. lines: image_id, seq, x0, y0, x1, y1, radius, add (boolean).

    rasters: RGBA, for what is visible. A selection without lines comes out as it is."""
    drawn = lines.select("image_id", "seq", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "radius")], "add")
    both = selections.join(rasters.select("image_id", F.col("data").alias("pixels")), "image_id")

    def begin(r: dict) -> tuple:
        on = unpack(r)[..., 0]
        return r["image_id"], on, np.frombuffer(r["pixels"], np.uint8).reshape(*on.shape, 4)[..., 3]

    def apply(state: tuple, q: dict) -> tuple:
        i, on, alpha = state
        return i, S.brush(on, alpha, (q["x0"], q["y0"], q["x1"], q["y1"]), q["radius"], q["add"]), alpha

    return over_steps(both, drawn, ["seq", "x0", "y0", "x1", "y1", "radius", "add"], RASTER, begin, apply, lambda state: pack(state[0], state[1][..., None]))


def hint_boxes(masks: DataFrame, points: DataFrame) -> DataFrame:
    """The window around what was painted on each image, and the padded box of the mask's regions under the paint.

    masks: raster rows with image_w and image_h. Where no region is under the paint, the box is null."""
    names = [*"ltrb", "box_l", "box_t", "box_r", "box_b"]

    def make(r: dict) -> list[dict]:
        painted = _plain(r["points"])
        if not painted:
            return []
        found = S.seeded_box(unpack(r)[..., 0], painted, r["image_h"], r["image_w"])
        box = found[1] if found else (None,) * 4
        return [{"image_id": r["image_id"], "foreground": found and found[0]} | dict(zip(names, (*S.hint_box(painted, r["image_h"], r["image_w"]), *box), strict=True))]

    return over_rows(masks.join(gathered(points), "image_id"), "image_id long, foreground boolean, " + ", ".join(f"{n} int" for n in names), make)


def colour_selections(masks: DataFrame, rasters: DataFrame, points: DataFrame) -> DataFrame:
    """Selections (255 or 0) grown by colour from the positive points; masks are the model's, of the same size as the RGBA rasters."""
    both = masks.join(rasters.select("image_id", F.col("data").alias("pixels")), "image_id").join(gathered(points), "image_id")

    def make(r: dict) -> list[dict]:
        model = unpack(r)[..., 0]
        on = S.by_colour(np.frombuffer(r["pixels"], np.uint8).reshape(*model.shape, 4), model, _plain(r["points"]))
        return [pack(r["image_id"], on[..., None].astype(np.uint8) * 255) | {"n_selected": int(on.sum())}]

    return over_rows(both, RASTER + ", n_selected long", make)
