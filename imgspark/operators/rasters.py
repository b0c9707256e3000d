"""Raster rows (image_id, height, width, channels, bits, data): kernels run over them in Arrow batches, a row at a time in memory.

Nothing is shuffled here; rows carry pixels, so plans should join and group on ids and read pixels late."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K

RASTER = "image_id long, height int, width int, channels int, bits int, data binary"
ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
NAMES = ["image_id", "height", "width", "channels", "bits", "data"]


def unpack(row: dict) -> np.ndarray:
    return np.frombuffer(row["data"], "<u2" if row["bits"] == 16 else np.uint8).astype(np.uint16 if row["bits"] == 16 else np.uint8).reshape(row["height"], row["width"], row["channels"])


def pack(image_id: int, a: np.ndarray) -> dict:
    return dict(zip(NAMES, (image_id, *a.shape, 8 * a.itemsize, a.astype(a.dtype.newbyteorder("<")).tobytes()), strict=True))


def over_rows(frame: DataFrame, schema: str, make: Callable[[dict], list[dict]], slice_rows: int = 16) -> DataFrame:
    """make(row) for every row; slices keep few decoded rasters in memory."""
    fields = pa.schema([(n, ARROW[t]) for n, t in (x.split(" ") for x in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, slice_rows):
                rows = [out for row in b.slice(i, slice_rows).to_pylist() for out in make(row)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, fields)

    return frame.mapInArrow(run, schema)


def over_steps(rasters: DataFrame, steps: DataFrame, order: list[str], schema: str, begin: Callable[[dict], Any], apply: Callable[[Any, dict], Any], finish: Callable[[Any], dict], slice_rows: int = 16) -> DataFrame:
    """finish(state) of every raster, whose state is begin(raster) and then apply(state, step) for the steps of its image in order.

    An image's steps stream past its raster in sorted partitions, so a task holds one slice and one image, however many steps it has."""
    shapes = rasters.schema.simpleString(), steps.schema.simpleString()
    lone = lambda frame, i: frame.select("image_id", F.lit(i).alias("kind"), *[F.struct(*frame.columns).alias(n) if k == i else F.lit(None).cast(shapes[k]).alias(n) for k, n in enumerate(("raster", "step"))])
    rows = lone(rasters, 0).unionByName(lone(steps, 1)).repartition("image_id").sortWithinPartitions("image_id", "kind", *[f"step.{c}" for c in order])
    fields = pa.schema([(n, ARROW[t]) for n, t in (x.split(" ") for x in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image, states, open_ = None, [], False
        for b in batches:
            for i in range(0, b.num_rows, slice_rows):
                for r in b.slice(i, slice_rows).to_pylist():
                    if not open_ or r["image_id"] != image:
                        if states:
                            yield pa.RecordBatch.from_pylist([finish(s) for s in states], fields)
                        image, states, open_ = r["image_id"], [], True
                    if r["kind"] == 0:
                        states.append(begin(r["raster"]))
                    else:
                        states = [apply(s, r["step"]) for s in states]
        if states:
            yield pa.RecordBatch.from_pylist([finish(s) for s in states], fields)

    return rows.mapInArrow(run, schema)


def validate_frames(rasters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rasters whose data is long enough, the others with an error)."""
    enough = F.coalesce(F.octet_length("data") >= F.col("height") * F.col("width") * F.col("channels") * F.col("bits") / 8, F.lit(False)) & (F.col("channels") >= 1)
    return rasters.filter(enough), rasters.filter(~enough).select("image_id", F.lit("data is shorter than its size says").alias("error"))


def sharpen_frames(rasters: DataFrame) -> DataFrame:
    return over_rows(rasters, RASTER, lambda r: [pack(r["image_id"], K.sharpen16(unpack(r)))])


def to_rgba8(rasters: DataFrame) -> DataFrame:
    return over_rows(rasters, RASTER, lambda r: [pack(r["image_id"], K.to_rgba8(unpack(r)))])


def resample(rasters: DataFrame, height: int, width: int) -> DataFrame:
    return over_rows(rasters, RASTER, lambda r: [pack(r["image_id"], K.resample(unpack(r), height, width))])


def components(masks: DataFrame, threshold: int) -> DataFrame:
    """Area, box and first pixel of each 8-connected region at or above the threshold."""
    names = ["label", "area", "min_x", "min_y", "max_x", "max_y", "first_pixel"]

    def make(r: dict) -> list[dict]:
        labels, n = K.components(unpack(r)[..., 0] >= threshold)
        return [{"image_id": r["image_id"]} | dict(zip(names, s, strict=True)) for s in K.component_stats(labels, n)]

    return over_rows(masks, "image_id long, " + ", ".join(f"{n} long" for n in names), make)


def encode_png(rasters: DataFrame) -> DataFrame:
    """image_id, content and error: a raster that can't be written is a row too."""

    def make(r: dict) -> list[dict]:
        try:
            return [{"image_id": r["image_id"], "content": K.png(unpack(r)), "error": None}]
        except (ValueError, KeyError, TypeError) as e:
            return [{"image_id": r["image_id"], "content": None, "error": str(e)}]

    return over_rows(rasters, "image_id long, content binary, error string", make)


def pixel_rows(rasters: DataFrame) -> DataFrame:
    """image_id, y, x and one column for each of three channels: for aggregates and checks on small rasters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                a = unpack(r)
                columns = [np.full(a.shape[:2], r["image_id"], np.int64), *np.mgrid[: a.shape[0], : a.shape[1]].astype(np.int32), *(a[..., min(k, a.shape[2] - 1)].astype(np.int32) for k in range(3))]
                yield pa.RecordBatch.from_arrays([pa.array(c.ravel()) for c in columns], ["image_id", "y", "x", "c0", "c1", "c2"])

    return rasters.mapInArrow(run, "image_id long, y int, x int, c0 int, c1 int, c2 int")


def subject_rects(parts: DataFrame, mask_w: int, mask_h: int, width: int, height: int, count: int = 4) -> DataFrame:
    """Crops around the largest regions: at least max(32, 0.1% of the mask), padded by 14% of the longer side, kept if they gain 1.15."""
    from pyspark.sql import Window

    order = Window.partitionBy("image_id").orderBy(F.col("area").desc(), "first_pixel")
    least = max(32, int(0.001 * mask_w * mask_h + 0.5))
    p = parts.filter(F.col("area") >= least).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)
    left, right = F.floor(F.col("min_x") * width / mask_w), F.ceil((F.col("max_x") + 1) * width / mask_w)
    top, bottom = F.floor(F.col("min_y") * height / mask_h), F.ceil((F.col("max_y") + 1) * height / mask_h)
    pad = F.floor(0.14 * F.greatest(right - left, bottom - top) + 0.5)
    p = p.select(
        "image_id", "rank", F.greatest(F.lit(0), left - pad).cast("long").alias("l"), F.greatest(F.lit(0), top - pad).cast("long").alias("t"),
        F.least(F.lit(width), right + pad).cast("long").alias("r"), F.least(F.lit(height), bottom + pad).cast("long").alias("b"),
    )
    w, h = F.col("r") - F.col("l"), F.col("b") - F.col("t")
    return p.filter((w >= 2) & (h >= 2) & (max(width, height) / F.greatest(w, h) >= 1.15))
