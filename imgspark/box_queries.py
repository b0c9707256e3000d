"""Queries of boxes over tiled masks, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import boxes as X
from .operators import pixels as P
from .operators import regions as G
from .operators import scan as S
from .operators import tiles as Z
from .operators.rasters import RASTER, over_rows, pack, unpack
from .raster_sql import DISC, GRID, MASKS, regions
from .sources import derived as D


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six boxes for each row of embeddings, some of them reaching out of the frame of 24 pixels."""
    i, k = F.col("image_id"), F.col("box")
    rows = D.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("box"))
    rows = rows.withColumns({"l": (i * 3 + k * 5) % 23 - 1, "t": (i * 7 + k * 3) % 22})
    return rows.withColumns({"r": F.col("l") + (i + k * 4) % 13, "b": F.col("t") + 1 + (i * 5 + k) % 17})


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty scored squares for each row of embeddings."""
    i, k = F.col("image_id"), F.col("cand")
    rows = D.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("cand"))
    rows = rows.withColumns({"score": (i * 31 + k * k * 17) % 50, "l": (i * 13 + k * 37) % 211, "t": (i * 17 + k * 53) % 197})
    side = 30 + (i + k) % 40
    return rows.withColumns({"r": F.col("l") + side, "b": F.col("t") + side})


def layer_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four crops a picture: the frame, two persons (every third picture has one) with bands, and an edge tile without."""
    i = F.col("image_id")
    k = F.col("layer_idx")
    rows = D.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("layer_idx")).filter((k != 2) | (i % 3 != 0))
    rows = rows.withColumns({"l": F.when(k == 0, 0).otherwise((i + 4 * k) % 9), "t": F.when(k == 0, 0).otherwise((i * 3 + k) % 7)})
    rows = rows.withColumns({"r": F.when(k == 0, 24).otherwise(F.col("l") + 14), "b": F.when(k == 0, 24).otherwise(F.col("t") + 15), "detail": F.when(k == 3, "edge").otherwise("person")})
    band = (k == 1) | (k == 2)
    return rows.withColumns({"own_l": F.when(band, F.col("l") + 3), "own_r": F.when(band, F.col("l") + 11)})


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    crops = layer_crops(spark, sf_dir)
    pred = (F.col("mask") * (F.col("layer_idx") + 1) + F.col("image_id") * 7 + F.col("x") * F.col("layer_idx") * 31) % 256
    preds = D.pixels(spark, sf_dir).join(crops.select("image_id", "layer_idx"), "image_id").select("image_id", "layer_idx", "y", "x", pred.alias("pred"))
    return P.layer_evidence(preds, crops)


def five_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse colours on a grid, a source that is see-through at every eleventh picture's left, and the masks as mattes."""

    def make(r: dict) -> list[dict]:
        m, i = unpack(r)[..., 0], r["image_id"]
        y, x = np.indices(m.shape)
        return [pack(i, np.stack([64 * ((x // 3 + i) % 4), 64 * (y // 4 % 4), 0 * x, np.where((i % 11 == 0) & (x < 4), 100, 255), m], axis=-1).astype(np.uint8))]

    return over_rows(D.masks(spark, sf_dir), RASTER, make)


def enclosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = Z.split(five_channels(spark, sf_dir), 7)
    return G.enclosed_regions(tiles, 7, least_count=4, share=0.7, least=3, most_share=0.05, fill=0.3, room=1)


def balanced_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of eight parts of equal weight in pixels each picture of the manifest goes to, and the parts' weights."""
    rows = D.manifest(spark, sf_dir).select("image_id", (F.col("width").cast("long") * F.col("height")).alias("pixels"))
    return S.with_parts(rows, "pixels", ["image_id"], 8).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("pixels").alias("pixels"), F.min("image_id").alias("first"), F.max("image_id").alias("last"))


BOXES = """boxes AS (SELECT *, l + (image_id + box * 4) % 13 AS r, t + 1 + (image_id * 5 + box) % 17 AS b FROM (SELECT vec_id AS image_id, box, (vec_id * 3 + box * 5) % 23 - 1 AS l, (vec_id * 7 + box * 3) % 22 AS t FROM embeddings, (SELECT range AS box FROM range(6))))"""
CANDIDATES = """cands AS (SELECT *, l + 30 + (image_id + cand) % 40 AS r, t + 30 + (image_id + cand) % 40 AS b FROM (SELECT vec_id AS image_id, cand, (vec_id * 31 + cand * cand * 17) % 50 AS score, (vec_id * 13 + cand * 37) % 211 AS l, (vec_id * 17 + cand * 53) % 197 AS t FROM embeddings, (SELECT range AS cand FROM range(40))))"""

TABLE = {
    "tiled_box_sums": (lambda s, d: X.box_sums(Z.split(D.masks(s, d), 7), boxes(s, d), 7), f"WITH {MASKS}, {BOXES}" + """ SELECT b.image_id, b.box, b.l, b.t, b.r, b.b, CAST(coalesce(sum(v), 0) AS BIGINT) AS box_sum
 FROM boxes b LEFT JOIN masks m ON m.image_id = b.image_id AND x >= b.l AND x < b.r AND y >= b.t AND y < b.b GROUP BY ALL"""),
    "suppressed_overlaps": (lambda s, d: X.suppress_overlaps(candidates(s, d), 2 + F.col("image_id") % 3), f"WITH RECURSIVE {CANDIDATES}," + """ c AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, cand) AS n FROM cands),
 g AS (SELECT DISTINCT image_id, 0::BIGINT AS n, []::BIGINT[][] AS kept FROM cands UNION ALL
 SELECT g.image_id, c.n, CASE WHEN len(list_filter(kept, lambda k: greatest(0, least(k[4], r) - greatest(k[2], l)) * greatest(0, least(k[5], b) - greatest(k[3], t)) * 10 >
 3 * ((k[4] - k[2]) * (k[5] - k[3]) + (r - l) * (b - t) - greatest(0, least(k[4], r) - greatest(k[2], l)) * greatest(0, least(k[5], b) - greatest(k[3], t))))) > 0 THEN kept ELSE list_append(kept, [cand, l, t, r, b]) END FROM g JOIN c ON c.image_id = g.image_id AND c.n = g.n + 1),
 f AS (SELECT image_id, arg_max(kept, n) AS kept FROM g GROUP BY image_id), u AS (SELECT image_id, unnest(range(1, len(kept) + 1)) AS place, kept FROM f)
 SELECT u.image_id, cand, score, l, t, r, b, CAST(place AS INT) AS place FROM u JOIN cands c ON c.image_id = u.image_id AND c.cand = kept[place][1] WHERE place <= 2 + u.image_id % 3"""),
    "balanced_parts": (balanced_parts, """WITH m AS (SELECT doc_id AS image_id, CAST((16 + doc_id * 37 % 6000) * (16 + doc_id * 53 % 4000) AS BIGINT) AS pixels FROM documents),
 s AS (SELECT *, coalesce(sum(pixels) OVER (ORDER BY image_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(pixels) OVER () AS total FROM m),
 p AS (SELECT *, CAST(least(7, (2 * before + pixels) * 8 // (2 * total)) AS INT) AS part FROM s)
 SELECT part, count(*) AS n, CAST(sum(pixels) AS BIGINT) AS pixels, min(image_id) AS first, max(image_id) AS last FROM p GROUP BY part"""),
    "enclosed_regions": (enclosed, f"WITH RECURSIVE {MASKS}," + """ f AS (SELECT image_id, y, x, v, (x // 3 + image_id) % 4 + 4 * (y // 4 % 4) AS bucket, NOT (image_id % 11 = 0 AND x < 4) AS solid FROM masks),
 k AS (SELECT image_id, bucket FROM f WHERE solid GROUP BY ALL HAVING count(*) FILTER (v <= 24) >= 4 AND count(*) FILTER (v <= 24) / count(*) FILTER (v <= 24 OR v >= 232) >= 0.7::DOUBLE),
 """ + regions("SELECT image_id, y * 24 + x AS p FROM f SEMI JOIN k USING (image_id, bucket) WHERE solid AND v >= 224") + """,
 c AS (SELECT *, greatest(1, least(2, CAST(ceil(greatest(x1 - x0 + 1, y1 - y0 + 1) * 1.2) AS BIGINT))) AS m FROM parts WHERE area >= 3 AND area <= 29 AND area / ((x1 - x0 + 1) * (y1 - y0 + 1)) >= 0.3::DOUBLE)
 SELECT image_id, CAST(area AS BIGINT) AS area, x0 AS min_x, y0 AS min_y, x1 AS max_x, y1 AS max_y, first_pixel FROM c WHERE x0 - m > 0 AND y0 - m > 0 AND x1 + m < 23 AND y1 + m < 23
 AND NOT EXISTS (SELECT 1 FROM f WHERE f.image_id = c.image_id AND v <= 24 AND x >= x0 - m AND x <= x1 + m AND y >= y0 - m AND y <= y1 + m)"""),
    "layer_evidence": (evidence, f"WITH masks AS (SELECT vec_id AS image_id, y, x, CAST(greatest(0, least(255, {DISC.format(s=0)})) AS BIGINT) AS v FROM embeddings, {GRID})," + """ k AS (SELECT vec_id AS image_id, layer_idx FROM embeddings, (SELECT range AS layer_idx FROM range(4)) WHERE layer_idx <> 2 OR vec_id % 3 <> 0),
 p AS (SELECT *, CASE layer_idx WHEN 0 THEN 0 ELSE (image_id + 4 * layer_idx) % 9 END AS l, CASE layer_idx WHEN 0 THEN 0 ELSE (image_id * 3 + layer_idx) % 7 END AS t FROM k),
 c AS (SELECT *, CASE layer_idx WHEN 0 THEN 24 ELSE l + 14 END AS r, CASE layer_idx WHEN 0 THEN 24 ELSE t + 15 END AS b, layer_idx IN (1, 2) AS banded, count(*) FILTER (layer_idx IN (1, 2)) OVER (PARTITION BY image_id) >= 2 AS two FROM p),
 v AS (SELECT c.*, y, x, (v * (layer_idx + 1) + image_id * 7 + x * layer_idx * 31) % 256 AS pred, banded AND two AS cons, layer_idx > 0 AND (NOT banded OR x >= l + 3 AND x < l + 11) AS refi FROM c JOIN masks USING (image_id) WHERE x >= l + 2 AND x < r - 2 AND y >= t + 2 AND y < b - 2)
 SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, count(*) FILTER (cons AND pred <= 56) AS consensus_votes, bool_or(cons AND pred >= 210) AS consensus_veto, min(pred) FILTER (cons AND pred <= 56) AS lowest_bg,
 count(*) FILTER (refi AND pred <= 56) AS refine_votes, bool_or(refi AND pred >= 210) AS refine_veto FROM v WHERE layer_idx > 0 GROUP BY image_id, y, x"""),
}
