"""Background removal in two inference stages: the whole picture, then crops of what is uncertain, then one matte.

Crops are a table of their own, dealt by (image_id, layer_idx), so an image with twelve of them costs no more tasks' time than
twelve images with one. The model is passed in; masks are written between the stages, so a retry repeats no inference."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kernels import flatten_alpha, half_up, resample
from ..functions.matte import expand_pockets
from ..operators.crops import planned_crops
from ..operators.mattes import finished_mattes, fuse_layers
from ..operators.rasters import ARROW, RASTER, over_rows, pack, unpack
from ..operators.selections import normalised

CROPS, INPUT_EDGE = 12, 512
#: Bytes of prepared crops that wait in a task for others of their shape.
HELD = 64 << 20
#: Columns of a mask without its pixels.
KEPT = "image_id long, layer_idx int, frame_h int, frame_w int, l int, t int, r int, b int, own_l int, own_r int, detail string"

Predict = Callable[[], Callable[[np.ndarray], np.ndarray]]


def crop_plan(structural: DataFrame, edges: DataFrame, budget: int = CROPS) -> DataFrame:
    """Both kinds of crops of each image within the budget: edge crops keep theirs, structural ones take what is left and come first.

    Columns: image_id, rank (order within a kind), l, t, r, b, own_l, own_r."""
    taken = edges.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_edges"))
    left = budget - F.coalesce(F.col("n_edges"), F.lit(0))
    order = Window.partitionBy("image_id").orderBy("rank")
    first = structural.join(taken, "image_id", "left").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= left).drop("n_edges", "place")
    both = first.withColumn("kind", F.lit(0)).unionByName(edges.withColumn("kind", F.lit(1)))
    return both.withColumn("layer_idx", F.row_number().over(Window.partitionBy("image_id").orderBy("kind", "rank"))).drop("rank", "kind")


def model_input(pixels: np.ndarray, edge: int = INPUT_EDGE) -> np.ndarray:
    """A crop as the segmentation model takes it: alpha over black, no side longer than edge, stretched to edge x edge, normalised."""
    return normalised(resample(brought_down(pixels, edge), edge, edge))


def brought_down(pixels: np.ndarray, edge: int) -> np.ndarray:
    """Alpha over black, no side longer than edge; what is that already stays as it is."""
    a = flatten_alpha(pixels) if pixels.shape[2] == 4 else pixels[..., :3]
    scale = min(1, edge / max(a.shape[:2]))
    return resample(a, *(max(1, int(half_up(np.float64(n * scale)))) for n in a.shape[:2]))


def model_inputs(crops: DataFrame, edge: int = INPUT_EDGE) -> DataFrame:
    """crops: raster rows with layer_idx, l, t, r, b. image_id, layer_idx and the input tensor (3 x edge x edge, single precision, little-endian)."""
    make = lambda r: [{"image_id": r["image_id"], "layer_idx": r["layer_idx"], "edge": edge, "tensor": model_input(unpack(r)[r["t"] : r["b"], r["l"] : r["r"]], edge).astype("<f4").tobytes()}]
    return over_rows(crops, "image_id long, layer_idx int, edge int, tensor binary", make, slice_rows=4)


def sigmoid_masks(logits: np.ndarray) -> np.ndarray:
    """Bytes of a model's raw output: the fraction is cut off."""
    return (255 / (1 + np.exp(-logits.astype(np.float64)))).astype(np.uint8)


def predicted(crops: DataFrame, make_predict: Predict, prepare: Callable[[np.ndarray], np.ndarray] = lambda a: a, fallback: Predict | None = None, batch: int = 1, profile: ResourceProfile | None = None) -> DataFrame:
    """Rows with a crop's pixels in, the same rows with the mask's height, width and data out; a model is loaded once a worker stream.

    batch: with 1 the model takes an array and gives a mask; with more it takes a stack of prepared crops of one shape and gives as
    many masks. Crops wait for others of their shape, across Arrow batches, until there are so many, or until all that wait hold
    `HELD` bytes; the rest goes when the stream ends. A batch on which the model fails is halved until the crops that it
    fails on stand alone; those go to the fallback, and one that both fail on is a row with an error and no mask. Hair crops have their
    enclosed background pockets widened. prepare: model_input, or nothing for models that take pixels. profile: what an executor of this
    stage needs (an accelerator, say)."""
    names, held = [x.split(" ")[0] for x in KEPT.split(", ")], {}
    schema = KEPT + ", height int, width int, data binary, error string"
    fields = pa.schema([(n, ARROW[t]) for n, t in (x.split(" ") for x in schema.split(", "))])

    def masks_of(which: Predict, stack: list[np.ndarray]) -> list[np.ndarray]:
        if which not in held:
            held[which] = which()
        found = [held[which](stack[0])] if batch == 1 else list(held[which](np.stack(stack)))
        if len(found) != len(stack):
            raise ValueError(f"{len(stack)} crops, but {len(found)} masks")
        return [np.clip(np.rint(m), 0, 255).astype(np.uint8) for m in found]

    def settle(rows: list[tuple[dict, np.ndarray]], models: list[Predict], errors: tuple[str, ...] = ()) -> Iterator[dict]:
        if not models:
            yield from (row | {"height": None, "width": None, "data": None, "error": "; ".join(errors)} for row, _ in rows)
            return
        try:
            found = masks_of(models[0], [a for _, a in rows])
        except Exception as e:  # noqa: BLE001  a model may fail in any way; that fails the crop only
            if len(rows) > 1:
                yield from settle(rows[: len(rows) // 2], models, errors)
                yield from settle(rows[len(rows) // 2 :], models, errors)
            else:
                yield from settle(rows, models[1:], (*errors, str(e) or type(e).__name__))
            return
        for (row, _), mask in zip(rows, found, strict=True):
            mask = expand_pockets(mask) if row["detail"] == "hair" else mask
            yield row | {"height": mask.shape[0], "width": mask.shape[1], "data": mask.tobytes(), "error": None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [m for m in (make_predict, fallback) if m]
        waiting: dict[tuple, list] = defaultdict(list)
        size = 0

        def go(shape: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(list(settle(waiting.pop(shape), models)), fields)

        for b in batches:
            for i in range(b.num_rows):
                (r,) = b.slice(i, 1).to_pylist()
                row = {n: r[n] for n in names}
                try:
                    a = prepare(unpack(r))
                except Exception as e:  # noqa: BLE001  as above
                    yield pa.RecordBatch.from_pylist(list(settle([(row, None)], [], (str(e) or type(e).__name__,))), fields)
                    continue
                waiting[a.shape].append((row, a))
                size += a.nbytes
                while len(waiting[a.shape]) == batch or size > HELD:
                    shape = a.shape if len(waiting[a.shape]) == batch else max(waiting, key=lambda s: sum(x.nbytes for _, x in waiting[s]))
                    size -= sum(x.nbytes for _, x in waiting[shape])
                    yield go(shape)
        for shape in list(waiting):
            if waiting[shape]:
                yield go(shape)

    return crops.mapInArrow(run, schema, profile=profile)


def whole_pictures(images: DataFrame) -> DataFrame:
    """Each picture as its own crop, layer 0; nothing moves."""
    none = F.lit(None).cast("int")
    return images.withColumns(
        {"layer_idx": F.lit(0), "frame_h": F.col("height"), "frame_w": F.col("width"), "l": F.lit(0), "t": F.lit(0), "r": F.col("width"), "b": F.col("height"), "own_l": none, "own_r": none, "detail": F.lit("person")}
    )


def cut_crops(plan: DataFrame, images: DataFrame, edge: int | None = None) -> DataFrame:
    """The pixels of each planned crop as a raster row with its place, dealt by (image_id, layer_idx).

    The crops of a picture, CROPS at most, meet it as one row, by a merge as in finished_mattes(); only the crops move on. edge: crops of
    a longer side are brought down to it first, as model_input() would do, so that what moves is never more than CROPS * edge * edge
    pixels a picture, however large that is."""
    columns = ["layer_idx", "l", "t", "r", "b", "own_l", "own_r", "detail"]
    per_image = plan.groupBy("image_id").agg(F.collect_list(F.struct(*columns)).alias("crops"))

    def make(r: dict) -> list[dict]:
        a = unpack(r)
        size = {"frame_h": a.shape[0], "frame_w": a.shape[1]}
        pixels = lambda c: np.ascontiguousarray(a[c["t"] : c["b"], c["l"] : c["r"]])
        return [pack(r["image_id"], brought_down(pixels(c), edge) if edge else pixels(c)) | size | c for c in r["crops"]]

    return over_rows(images.join(per_image.hint("merge"), "image_id"), f"{RASTER}, {KEPT.partition(', ')[2]}", make).repartition("image_id", "layer_idx")


def refine_masks(images: DataFrame, plan: DataFrame, make_predict: Predict, fallback: Predict | None = None) -> DataFrame:
    """images: raster rows; plan: crop_plan(). The whole picture is layer 0; returns one fused mask an image. Crops without a
    mask are left out."""
    parts = plan.select("image_id", F.col("layer_idx").cast("int"), *[F.col(c).cast("int").alias(c) for c in ("l", "t", "r", "b", "own_l", "own_r")], F.lit("person").alias("detail"))
    masks = predicted(whole_pictures(images), make_predict, fallback=fallback).unionByName(predicted(cut_crops(parts, images), make_predict, fallback=fallback))
    return fuse_layers(masks.filter("error is null").drop("error"))


def remove_background(
    images: DataFrame, make_predict: Predict, at: str, prepare: Callable[[np.ndarray], np.ndarray] = lambda a: a, output: str = "image", fallback: Predict | None = None,
    edge: int | None = None, batch: int = 1, profile: ResourceProfile | None = None,
) -> DataFrame:
    """The whole job on RGBA rasters: masks of the pictures, plans from them, masks of the crops, finished mattes.

    at: a folder that all executors share; each stage's masks are written there and read back, so neither the planning nor the
    matte ever repeats inference. Masks are small; pixels are read again by id in each stage instead of being carried along. A
    picture without a mask has no result and a picture's crop without one is left out; mask_errors() names both.
    edge: the model's, where prepare is model_input; crops are then scaled before they move. batch, profile: as predicted() has them."""
    spark = images.sparkSession
    masks = lambda stage: spark.read.parquet(f"{at}/{stage}").filter("error is null").drop("error")
    infer = lambda crops: predicted(crops, make_predict, prepare, fallback, batch, profile)
    infer(whole_pictures(images)).write.mode("overwrite").parquet(f"{at}/whole")
    whole = masks("whole")
    sizes = {"image_w": F.col("frame_w"), "image_h": F.col("frame_h"), "channels": F.lit(1), "bits": F.lit(8)}
    plan = planned_crops(whole.withColumns(sizes))
    infer(cut_crops(plan, images, edge)).write.mode("overwrite").parquet(f"{at}/crops")
    return finished_mattes(images, whole.unionByName(masks("crops")), output)


def mask_errors(spark: SparkSession, at: str) -> DataFrame:
    """image_id, layer_idx and error of what remove_background() found no mask for in the folder `at`."""
    return spark.read.parquet(f"{at}/whole", f"{at}/crops").filter("error is not null").select("image_id", "layer_idx", "error")
