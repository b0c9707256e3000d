"""Stroke logs: extents, interpolation, undo and reset, windows around a selection, uniform sampling."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.manifest import half_up
from ..sources.shared import shared_dir


def stroke_bounds(points: DataFrame) -> DataFrame:
    x, y, r = F.col("x"), F.col("y"), F.col("radius")
    return points.groupBy("image_id", "stroke_id").agg(F.min(x - r).alias("l"), F.min(y - r).alias("t"), F.max(x + r).alias("r"), F.max(y + r).alias("b"), F.max(r).alias("radius"))


def expand_strokes(points: DataFrame) -> DataFrame:
    """Points between two of a stroke at steps of 0.42 radius at most; the first point as it is (step 0). A column `tool` is handed on."""
    line = Window.partitionBy("image_id", "stroke_id").orderBy("seq")
    p = points.withColumns({"px": F.lag("x").over(line), "py": F.lag("y").over(line)})
    far = F.sqrt((F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py")))
    steps = F.greatest(F.lit(1), F.ceil(far / F.greatest(F.lit(1.0), 0.42 * F.col("radius")))).cast("int")
    p = p.withColumn("steps", F.when(F.col("px").isNull(), 0).otherwise(steps))
    p = p.withColumn("step", F.explode(F.when(F.col("steps") > 0, F.sequence(F.lit(1), F.col("steps"))).otherwise(F.array(F.lit(0)))))
    at = lambda a, b: F.when(F.col("steps") == 0, F.col(b).cast("double")).otherwise(F.col(a) + (F.col(b) - F.col(a)) * F.col("step") / F.col("steps"))
    return p.select("image_id", "stroke_id", "seq", "step", "steps", at("px", "x").alias("at_x"), at("py", "y").alias("at_y"), "radius", *[c for c in ("tool",) if c in points.columns])


def effective_edits(log: DataFrame, limit: int = 12) -> DataFrame:
    """The strokes that are still there: undo takes the newest of the last `limit`, reset clears.

    Rows up to an image's last reset go by an aggregate and a join. The others are dealt by ranges of (image, seq), so that one image's
    log lies in many tasks. A range says, for each number of strokes that could be undone when it begins, how many of these its
    undos take and how many can still be undone behind it; it keeps the last `limit` strokes of its own aside and knows all
    earlier ones as settled. These summaries pass in order, a row for each range, and tell how many of the strokes that a
    range has set aside were undone in later ones. Rows without image or seq are left out; equal rows count each."""
    at = F.struct(F.col("seq").alias("seq"), F.col("tool").alias("tool"))
    last = log.filter("tool = 'reset'").groupBy("image_id").agg(F.max(at).alias("_last"))
    rows = log.filter("image_id is not null and seq is not null").join(last, "image_id", "left").filter(F.col("_last").isNull() | (at > F.col("_last")))
    shared_dir(log.sparkSession)
    laid = rows.select("image_id", "seq", "tool", F.struct(*log.columns).alias("row"), F.monotonically_increasing_id().alias("_own"))
    laid = laid.repartitionByRange("image_id", "seq", "tool", "_own").sortWithinPartitions("image_id", "seq", "tool", "_own").withColumn("part", F.spark_partition_id())
    parts = laid.mapInArrow(_summaries(limit, laid.schema), _summary_schema(laid.schema)).checkpoint()
    sums = parts.filter("kind = 'sum'").select("image_id", "part", "taken", "left", "held").repartition("image_id").sortWithinPartitions("image_id", "part")
    undone = sums.mapInArrow(_undone, "image_id long, part int, undone int")
    held = parts.filter("kind = 'held'").join(undone, ["image_id", "part"]).filter("depth >= undone")
    return parts.filter("kind = 'settled'").select("row.*").unionByName(held.select("row.*"))


def _summary_schema(laid: T.StructType) -> T.StructType:
    ints = T.ArrayType(T.IntegerType())
    return T.StructType([T.StructField("image_id", laid["image_id"].dataType), T.StructField("part", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("depth", T.IntegerType()), T.StructField("taken", ints), T.StructField("left", ints), T.StructField("held", T.IntegerType()), T.StructField("row", laid["row"].dataType)])


def _summaries(limit: int, laid: T.StructType):
    """For each image of a range its settled rows, its last strokes with their depth, and taken and left by strokes before."""
    schema = to_arrow_schema(_summary_schema(laid))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image, part, own, taken, left = None, None, deque(), [], []

        def out(kind: str, rows: list, depths: list | None = None) -> pa.RecordBatch:
            n = 1 if kind == "sum" else len(rows)
            here = lambda x: [x if kind == "sum" else None] * n
            cells = [[image] * n, [part] * n, [kind] * n, depths or [None] * n, here(taken), here(left), here(len(own))]
            rows = pa.nulls(1, schema.field("row").type) if kind == "sum" else pa.concat_arrays(rows).cast(schema.field("row").type)
            return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(cells, schema, strict=False)), rows], schema=schema)

        def end() -> Iterator[pa.RecordBatch]:
            if own:
                yield out("held", list(own), list(range(len(own) - 1, -1, -1)))
            yield out("sum", [])

        for b in batches:
            rows, settled = b.column("row"), []
            for i, (of, tool, p) in enumerate(zip(*(b.column(c).to_pylist() for c in ("image_id", "tool", "part")), strict=True)):
                if of != image or part is None:
                    if settled:
                        yield out("settled", settled)
                        settled = []
                    if part is not None:
                        yield from end()
                    image, part, own, taken, left = of, p, deque(), [0] * (limit + 1), list(range(limit + 1))
                if tool != "undo":
                    own.append(rows.slice(i, 1))
                    if len(own) > limit:
                        settled.append(own.popleft())
                    room = limit - len(own)
                    if left[-1] > room:
                        left = [min(x, room) for x in left]
                elif own:
                    own.pop()
                else:
                    taken = [t + (x > 0) for t, x in zip(taken, left, strict=True)]
                    left = [max(0, x - 1) for x in left]
            if settled:
                yield out("settled", settled)
        if part is not None:
            yield from end()

    return run


def _undone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of the strokes that each range has set aside later ranges undo; a stack of counts, `limit` strokes in all."""
    image, stack = None, deque()  # [part, strokes that can still be undone, undone]

    for b in batches:
        gone: list[tuple] = []
        for of, part, taken, left, held in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if of != image:
                gone += [(image, p, n) for p, _, n in stack]
                image, stack = of, deque()
            before = sum(n for _, n, _ in stack)
            pops, stays = taken[before], left[before]
            while pops:
                top = stack[-1]
                took = min(pops, top[1])
                top[1], top[2], pops = top[1] - took, top[2] + took, pops - took
                if not top[1]:
                    gone.append((image, top[0], stack.pop()[2]))
            settled = sum(n for _, n, _ in stack) - stays
            while settled:
                took = min(settled, stack[0][1])
                stack[0][1], settled = stack[0][1] - took, settled - took
                if not stack[0][1]:
                    p, _, n = stack.popleft()
                    gone.append((image, p, n))
            if held:
                stack.append([part, held, 0])
        yield _counts(gone)
    yield _counts([(image, p, n) for p, _, n in stack])


def _counts(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["image_id", "part", "undone"])


def sample_prompts(points: DataFrame, positive: int = 14, negative: int = 6) -> DataFrame:
    """Evenly spread points of each label: if there are more than k, indices round(i (n - 1) / (k - 1))."""
    p = points.withColumn("positive", F.col("label") != 0)
    group = Window.partitionBy("image_id", "positive")
    p = p.withColumns({"i": F.row_number().over(group.orderBy("seq")) - 1, "n": F.count(F.lit(1)).over(group), "k": F.when(F.col("positive"), positive).otherwise(negative)})
    wanted = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: half_up(i * (F.col("n") - 1) / (F.col("k") - 1)))
    return p.filter((F.col("n") <= F.col("k")) | F.array_contains(wanted, F.col("i").cast("long"))).drop("i", "n", "k", "positive")


def selection_windows(bounds: DataFrame, images: DataFrame) -> DataFrame:
    """The padded crop around each stroke and the scale at which it is looked at.

    Pad max(48, 2.5 radius, 22% of the extent); no edge under max(192, 6 radius) while the image has room: half of what lacks goes
    before, and where one side has no room the other takes it. scale = min(1, 1024 / longest side)."""
    b = bounds.join(images.select("image_id", "width", "height"), "image_id")
    c = F.col
    pad = F.greatest(F.lit(48.0), 2.5 * c("radius"), 0.22 * F.greatest(F.lit(1), c("r") - c("l"), c("b") - c("t")))
    b = b.withColumns({"pad": pad, "edge": F.greatest(F.lit(192), F.ceil(6 * c("radius")))})

    def axis(b: DataFrame, low: str, high: str, size: str) -> DataFrame:
        inside = lambda v, least, most: F.least(F.greatest(v, least), most)
        b = b.withColumn("from", inside(F.floor(c(low) - c("pad")), F.lit(0), c(size) - 1))
        b = b.withColumn("to", inside(F.ceil(c(high) + c("pad")), c("from") + 1, c(size)))
        b = b.withColumn("lacks", F.greatest(F.lit(0), F.least(c(size), c("edge")) - (c("to") - c("from"))))
        b = b.withColumn("before", F.least(c("from"), F.ceil(c("lacks") / 2)))
        b = b.withColumn("after", F.least(c(size) - c("to"), c("lacks") - c("before")))
        start = F.greatest(F.lit(0), c("from") - c("before") - (c("lacks") - c("before") - c("after")))
        return b.withColumns({low: start.cast("long"), high: F.least(c(size), c("to") + c("after")).cast("long")})

    b = axis(axis(b, "l", "r", "width"), "t", "b", "height")
    scale = F.least(F.lit(1.0), 1024 / F.greatest(c("r") - c("l"), c("b") - c("t")))
    return b.select("image_id", "stroke_id", "l", "t", "r", "b", scale.alias("scale"))


def negative_prompts(bounds: DataFrame, windows: DataFrame, points: DataFrame, alpha: DataFrame, images: DataFrame) -> DataFrame:
    """Eight candidates on a ring 1.8 radii outside each stroke's box, in whole pixels inside the image; those stay that are in the
    crop, on alpha above 16, and farther than 1.45 of its radius from every point of the stroke.

    alpha: image_id, y, x, a. Returns x and y in the image and crop_x, crop_y, crop_radius at the window's scale."""
    c = F.col
    out = 1.8 * c("radius")
    xs = [c("l") - out, (c("l") + c("r")) / 2, c("r") + out]
    ys = [c("t") - out, (c("t") + c("b")) / 2, c("b") + out]
    within = lambda v, size: half_up(F.least(F.greatest(v, F.lit(0.0)), c(size) - 1.0)).cast("long")
    ring = F.array(*[F.struct(F.lit(3 * j + i).alias("place"), within(xs[i], "width").alias("x"), within(ys[j], "height").alias("y")) for j in range(3) for i in range(3) if (i, j) != (1, 1)])
    found = bounds.join(images.select("image_id", "width", "height"), "image_id").select("image_id", "stroke_id", "radius", F.explode(ring).alias("p")).select("image_id", "stroke_id", "radius", "p.*")
    crop = windows.select("image_id", "stroke_id", "scale", *[c(k).alias(f"win_{k}") for k in "ltrb"])
    found = found.join(crop, ["image_id", "stroke_id"]).filter("x >= win_l and x < win_r and y >= win_t and y < win_b")
    found = found.join(alpha.filter(c("a") > 16).select("image_id", c("y").cast("long").alias("y"), c("x").cast("long").alias("x")), ["image_id", "y", "x"], "left_semi")
    near = "c.image_id = s.image_id and c.stroke_id = s.stroke_id and (c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) <= 1.45D * 1.45D * s.radius * s.radius"
    kept = found.alias("c").join(points.select("image_id", "stroke_id", "x", "y", "radius").distinct().alias("s"), F.expr(near), "left_anti")
    return kept.select(
        "image_id", "stroke_id", "place", "x", "y", ((c("x") - c("win_l")) * c("scale")).alias("crop_x"), ((c("y") - c("win_t")) * c("scale")).alias("crop_y"),
        F.greatest(F.lit(1.0), c("radius") * c("scale")).alias("crop_radius"),
    )
