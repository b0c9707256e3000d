"""Manifests, results, progress events, pixels and strokes derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values, by doc_id % 10.
EXTENSIONS = "jpg png webp gif NEF dng txt avif JPG bmp".split()
MIMES = ["image/jpeg", "image/png", "image/webp", "image/gif", "", "image/x-adobe-dng", "text/plain", "image/avif", "image/jpg", "image/bmp"]
#: job_id, operation, format, percentage, opt_width, opt_height, keep_aspect, quality_percent
OPTIONS = [
    (0, "convert", "webp", None, None, None, True, 82),
    (1, "convert", "jpeg", None, None, None, True, 82),
    (2, "resize", "original", 50, None, None, True, 82),
    (3, "resize", "original", None, 800, None, True, 82),
    (4, "resize", "original", None, 640, 480, False, 82),
    (5, "compress", "jpeg", None, None, None, True, 82),
    (6, "remove-background", "png", None, None, None, True, 82),
    (7, "convert", "png", None, 100, None, False, 82),
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], by: str):
    return F.get(F.array(*[F.lit(v) for v in values]), F.expr(by).cast("int"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    name = F.concat(F.lit("img."), F.floor(d / 16).cast("string"), F.lit("."), pick(EXTENSIONS, "doc_id % 10"))
    return read(spark, sf_dir, "documents").select(
        d.alias("image_id"), d.alias("seq"), (d % 8).alias("job_id"), F.when(d % 97 == 0, "raw").otherwise(name).alias("name"), pick(MIMES, "doc_id % 10").alias("mime"),
        (F.col("n_chars") * 1237 + d).alias("size_bytes"), (16 + d * 37 % 6000).cast("int").alias("width"), (16 + d * 53 % 4000).cast("int").alias("height"),
    )


def options(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OPTIONS, "job_id long, operation string, format string, percentage int, opt_width int, opt_height int, keep_aspect boolean, quality_percent int")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    r = read(spark, sf_dir, "documents").select(d.alias("image_id"), (d % 8).alias("job_id"), F.concat(F.lit("img."), F.floor(d / 16).cast("string")).alias("name"), (F.col("n_chars") * 1237 + d).alias("original_size"), d)
    failed = d % 13 == 0
    return r.select(
        "image_id", "job_id", "name", "original_size", F.floor(F.col("original_size") * (40 + d * 7 % 90) / 100).alias("output_size"), F.when(failed, "error").otherwise("done").alias("status"),
        F.when(failed, F.concat(F.lit("decode failed at "), (d % 5).cast("string"))).alias("error"), (d * 7919 % 1000003).alias("finish_seq"),
    )


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "done").otherwise("progress")
    return read(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("job_id"), F.col("user_id").alias("image_id"), "event_id", "ts", (F.col("event_id") * 37 % 101).alias("progress_pct"), kind.alias("kind"))


def pixels(spark: SparkSession, sf_dir: str, side: int = 24) -> DataFrame:
    """r, g, b, a and mask of a small picture for each row of embeddings."""
    grid = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("x"))
    i, x, y = F.col("image_id"), F.col("x"), F.col("y")
    rad, cx, cy = 3 + i % 6, 6 + i * 7 % 12, 6 + i * 5 % 12
    mask = 128 + 10 * (rad * rad - ((x - cx) * (x - cx) + (y - cy) * (y - cy)))
    return grid.select(
        "image_id", "y", "x", ((i * 37 + x * 9 + y * 5) % 256).cast("int").alias("r"), ((i * 11 + x * 3 + y * 13) % 256).cast("int").alias("g"), ((i * 5 + x * 17 + y * 2) % 256).cast("int").alias("b"),
        F.when((i % 11 == 0) & (x < 4), 100).otherwise(255).alias("a"), F.greatest(F.lit(0), F.least(F.lit(255), mask)).cast("int").alias("mask"),
    )


def strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty points a picture, so that the number of painted pictures grows with the table."""
    e = F.col("event_id")
    tools = {"click": "restore", "view": "erase", "signup": "erase", "purchase": "undo", "error": "reset"}
    tool = F.lit(None)
    for kind, t in tools.items():
        tool = F.when(F.col("event_type") == kind, t).otherwise(tool)
    return read(spark, sf_dir, "events").select(F.expr("event_id div 20").alias("image_id"), F.col("user_id").alias("stroke_id"), e.alias("seq"), (e * 13 % 24).alias("x"), (e * 29 % 24).alias("y"), (1 + e % 4).alias("radius"), tool.alias("tool"))


def frames16(spark: SparkSession, sf_dir: str, side: int = 24) -> DataFrame:
    """A 16-bit frame for each row of embeddings, as raster rows."""
    import numpy as np

    from ..operators.rasters import RASTER, over_rows, pack

    def make(r: dict) -> list[dict]:
        y, x = np.mgrid[:side, :side]
        i = r["vec_id"]
        c = [i * 257 + x * 1021 + y * 509 + (x + y) % 2 * 9000, i * 131 + x * 613 + y * 2039, i * 71 + x * 4093 + y * 97]
        return [pack(i, (np.stack(c, axis=-1) % 65536).astype(np.uint16))]

    return over_rows(read(spark, sf_dir, "embeddings").select("vec_id"), RASTER, make)


def masks(spark: SparkSession, sf_dir: str, side: int = 24) -> DataFrame:
    """The mask of pixels() as raster rows, with a second disc."""
    import numpy as np

    from ..operators.rasters import RASTER, over_rows, pack

    def disc(i: int) -> np.ndarray:
        y, x = np.mgrid[:side, :side]
        return np.clip(128 + 10 * ((3 + i % 6) ** 2 - ((x - 6 - i * 7 % 12) ** 2 + (y - 6 - i * 5 % 12) ** 2)), 0, 255)

    make = lambda r: [pack(r["vec_id"], np.maximum(disc(r["vec_id"]), disc(r["vec_id"] + 3)).astype(np.uint8)[..., None])]
    return over_rows(read(spark, sf_dir, "embeddings").select("vec_id"), RASTER, make)


def layers(spark: SparkSession, sf_dir: str, side: int = 24) -> DataFrame:
    """Three layers for each row of embeddings: the frame, and two crops with bands of their own."""
    import numpy as np

    from ..operators.rasters import over_rows

    def make(r: dict) -> list[dict]:
        i = r["vec_id"]
        v = np.clip(np.floor(128 + 400 * np.array(r["embedding"], np.float32).astype(np.float64)), 0, 255).astype(np.uint8)
        rects = [(0, 0, side, side, None), (i % 8, i % 5, i % 8 + 14, i % 5 + 16, i % 8 + 2), ((i + 4) % 8, (i + 2) % 5, (i + 4) % 8 + 14, (i + 2) % 5 + 16, (i + 4) % 8 + 2)]
        return [
            {"image_id": i, "layer_idx": k, "frame_h": side, "frame_w": side, "l": a, "t": b, "r": c, "b": d, "own_l": o, "own_r": None if o is None else o + 10, "height": 8, "width": 8, "data": np.roll(v, 7 * k).tobytes()}
            for k, (a, b, c, d, o) in enumerate(rects)
        ]

    schema = "image_id long, layer_idx int, frame_h int, frame_w int, l int, t int, r int, b int, own_l int, own_r int, height int, width int, data binary"
    return over_rows(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), schema, make)


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RGBA rasters with the masks as alpha."""
    import numpy as np

    from ..operators.rasters import RASTER, over_rows, pack, unpack

    def make(r: dict) -> list[dict]:
        m = unpack(r)[..., 0].astype(int)
        y, x = np.indices(m.shape)
        i = r["image_id"]
        return [pack(i, np.stack([(i * 37 + x * 9 + y * 5) % 256, (i * 11 + x * 3 + y * 13) % 256, (i * 5 + x * 17 + y * 2) % 256, m], axis=-1).astype(np.uint8))]

    return over_rows(masks(spark, sf_dir), RASTER, make)
