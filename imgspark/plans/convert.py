"""Convert, resize and compress a manifest of files, with an encoder that the caller supplies.

encode(rgba, mime, quality) -> (bytes, mime). Bytes are read from rasters by id after planning; the manifest alone is
shuffled. A file that fails is a row with an error, never a failed task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators.rasters import NAMES as RASTER_NAMES
from ..operators.rasters import RASTER, over_rows, pack, unpack
from ..sources.shared import shared_dir


RESULT = "image_id long, name string, content binary, output_size long, status string, error string"


Encode = Callable[[np.ndarray, str, float | None], tuple[bytes, str]]
PIXEL_ROUTES = ("re-encode", "raw-8", "raw-16")


def convert_all(planned: DataFrame, rasters: DataFrame, files: DataFrame, encode: Encode) -> DataFrame:
    """One result or error row for every row of plan(): pixels re-encoded, bytes of pass-through rows copied, raw-16 sharpened as PNG.

    files: image_id and content of the source files. One pass: pixels and bytes are read once and stay where they are while the
    plan, which is narrow, comes to them (broadcast by its size), and one kernel goes by the route. Results are kept by a
    checkpoint, so that what had no source is told by their ids alone. Routes of other jobs and rows without source are errors."""
    shared_dir(planned.sparkSession)
    jobs = planned.select("image_id", "route", "out_w", "out_h", "out_mime", "out_name", "quality")
    pixels = [f"raster.{x.split(' ')[0]}" for x in RASTER.split(", ")[1:]]
    sources = rasters.select("image_id", F.struct(*RASTER_NAMES).alias("raster"), F.lit(None).cast("binary").alias("content"))
    sources = sources.unionByName(files.filter("content is not null").select("image_id", F.lit(None).cast(sources.schema["raster"].dataType).alias("raster"), "content"))
    needs = F.col("route").isin(*PIXEL_ROUTES) & F.col("raster").isNotNull() | (F.col("route") == "pass-through") & F.col("raster").isNull()
    met = sources.join(jobs, "image_id").filter(needs)
    done = _converted(met.select("image_id", *pixels, "content", "route", "out_w", "out_h", "out_mime", "out_name", "quality"), encode).checkpoint()
    why = F.when(F.col("route").isin(*PIXEL_ROUTES), "no pixels of this image").when(F.col("route") == "pass-through", "no file of this image")
    why = why.otherwise(F.concat(F.lit("not part of this job: "), F.coalesce("route", F.lit("no route"))))
    lost = jobs.join(done.select("image_id"), "image_id", "left_anti")
    none = F.lit(None)
    return done.unionByName(lost.select("image_id", F.col("out_name").alias("name"), none.cast("binary").alias("content"), none.cast("long").alias("output_size"), F.lit("error").alias("status"), why.alias("error")))


def process_images(planned: DataFrame, rasters: DataFrame, encode: Encode) -> DataFrame:
    """The routes re-encode and raw-8 alone; convert_all() serves a whole batch.

    planned: rows of plan(); result: image_id, name, content, output_size, status, error. The name follows the type that the encoder gave."""
    jobs = planned.filter(F.col("route").isin("re-encode", "raw-8")).select("image_id", "route", "out_w", "out_h", "out_mime", "out_name", "quality")
    return _converted(rasters.join(jobs, "image_id"), encode)


def _converted(met: DataFrame, encode: Encode) -> DataFrame:
    def work(r: dict) -> tuple[str, bytes]:
        if r["route"] == "pass-through":
            return r["out_name"], r["content"]
        if r["route"] == "raw-16":
            return r["out_name"], K.png(K.sharpen16(unpack(r)))
        a = K.to_rgba8(unpack(r)) if r["channels"] < 4 else unpack(r)
        a = K.resample(a, r["out_h"], r["out_w"], black=r["out_mime"] == "image/jpeg")
        content, mime = encode(a, r["out_mime"], r["quality"])
        return r["out_name"] if mime == r["out_mime"] else f"{r['out_name'].rpartition('.')[0]}.{mime.split('/')[1].replace('jpeg', 'jpg', 1)}", content

    def make(r: dict) -> list[dict]:
        try:
            name, content = work(r)
            return [{"image_id": r["image_id"], "name": name, "content": content, "output_size": len(content), "status": "done", "error": None}]
        except Exception as e:  # noqa: BLE001  an encoder may fail in any way; that fails the item only
            return [{"image_id": r["image_id"], "name": r["out_name"], "content": None, "output_size": None, "status": "error", "error": str(e) or type(e).__name__}]

    return over_rows(met, RESULT, make)


def predict_masks(inputs: DataFrame, make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """One mask raster for each input raster. make_predict loads the model, once for each batch stream of a worker."""
    held: list = []

    def make(r: dict) -> list[dict]:
        if not held:
            held.append(make_predict())
        mask = np.clip(np.rint(held[0](unpack(r))), 0, 255).astype(np.uint8)
        return [pack(r["image_id"], mask.reshape(*mask.shape[:2], 1))]

    return over_rows(inputs, RASTER, make)
