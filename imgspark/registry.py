"""All queries of the library with their SQL, for the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from . import box_queries, file_queries, raster_sql, stream_queries
from .functions import kernels as K
from .functions import manifest as M
from .operators import crops as Q
from .operators import edits as E
from .operators import manifest as O
from .operators import mattes as T
from .operators import pixels as P
from .operators import progress as G
from .operators import rasters as R
from .operators import selections as L
from .operators import spill as V
from .operators import tiles as Z
from .plans import background as B
from .plans import convert as C
from .sources import derived as D
from .sources import files as FS
from .sources.shared import fresh

EXT = "['" + "','".join(D.EXTENSIONS) + "']"
MIME = "['" + "','".join(D.MIMES) + "']"
MANIFEST = f"""manifest AS (SELECT doc_id AS image_id, doc_id AS seq, doc_id % 8 AS job_id,
 CASE WHEN doc_id % 97 = 0 THEN 'raw' ELSE 'img.' || (doc_id // 16) || '.' || {EXT}[doc_id % 10 + 1] END AS name, {MIME}[doc_id % 10 + 1] AS mime,
 n_chars * 1237 + doc_id AS size_bytes, CAST(16 + doc_id * 37 % 6000 AS INT) AS width, CAST(16 + doc_id * 53 % 4000 AS INT) AS height FROM documents)"""
RAW = f"(list_contains({M.RAW_EXTENSIONS!r}, lower(split_part(name, '.', -1))) OR regexp_matches(mime, '{M.RAW_MIME}'))"
ACCEPTED = f"accepted AS (SELECT *, {RAW} AS raw FROM manifest WHERE mime LIKE 'image/%' OR {RAW})"
STAGES = ["decode", "removal", "sharpen", "png", "refine", "whole"]
value = lambda v: "NULL" if v is None else repr(v) if isinstance(v, str) else str(v).upper()
OPTIONS = "options(job_id, operation, format, percentage, opt_width, opt_height, keep_aspect, quality_percent) AS (VALUES " + ", ".join(f"({', '.join(map(value, o))})" for o in D.OPTIONS) + ")"
PLAN = f"""{MANIFEST}, {ACCEPTED}, {OPTIONS},
a AS (SELECT m.*, operation, percentage, opt_width, opt_height, keep_aspect, quality_percent, CASE WHEN mime = 'image/jpg' THEN 'image/jpeg' ELSE mime END AS norm,
 CASE operation WHEN 'resize' THEN 'original' WHEN 'remove-background' THEN 'png' ELSE format END AS fmt FROM accepted m JOIN options o ON m.job_id = o.job_id),
b AS (SELECT *, CASE WHEN fmt <> 'original' THEN 'image/' || fmt WHEN raw THEN 'image/jpeg' WHEN norm IN ('image/png', 'image/jpeg', 'image/webp', 'image/avif') THEN norm ELSE 'image/png' END AS out_mime FROM a),
c AS (SELECT *, CASE WHEN operation = 'remove-background' THEN operation WHEN raw AND fmt = 'png' AND operation <> 'resize' THEN 'raw-16' WHEN raw THEN 'raw-8' WHEN operation = 'convert' AND norm = out_mime THEN 'pass-through' ELSE 're-encode' END AS route,
 CASE WHEN operation <> 'resize' THEN 1.0::DOUBLE WHEN coalesce(percentage, 0) <> 0 THEN percentage::DOUBLE / 100 ELSE least(CASE WHEN coalesce(opt_width, 0) <> 0 THEN opt_width::DOUBLE / width ELSE 1.0::DOUBLE END, CASE WHEN coalesce(opt_height, 0) <> 0 THEN opt_height::DOUBLE / height ELSE 1.0::DOUBLE END) END AS scale FROM b),
d AS (SELECT *, regexp_replace(name, '\\.[^/.]+$', '') AS stem, route IN ('pass-through', 'remove-background') AS whole,
 greatest(1, floor(CASE WHEN keep_aspect OR coalesce(opt_width, 0) = 0 THEN width * scale ELSE opt_width END + 0.5)) AS w,
 greatest(1, floor(CASE WHEN keep_aspect OR coalesce(opt_height, 0) = 0 THEN height * scale ELSE opt_height END + 0.5)) AS h FROM c),
plan AS (SELECT image_id, seq, job_id, name, mime, size_bytes, width, height, route, out_mime, CASE WHEN whole THEN NULL ELSE CAST(w AS BIGINT) END AS out_w, CASE WHEN whole THEN NULL ELSE CAST(h AS BIGINT) END AS out_h,
 CASE route WHEN 'pass-through' THEN name WHEN 'remove-background' THEN stem || '-no-bg.png' ELSE stem || '.' || replace(split_part(out_mime, '/', 2), 'jpeg', 'jpg') END AS out_name,
 CASE WHEN out_mime = 'image/png' THEN NULL WHEN operation = 'compress' THEN quality_percent::DOUBLE / 100 ELSE 1.0::DOUBLE END AS quality FROM d)"""
RESULTS = """results AS (SELECT doc_id AS image_id, doc_id % 8 AS job_id, 'img.' || (doc_id // 16) AS name, n_chars * 1237 + doc_id AS original_size,
 CAST(floor((n_chars * 1237 + doc_id) * (40 + doc_id * 7 % 90) / 100) AS BIGINT) AS output_size, CASE WHEN doc_id % 13 = 0 THEN 'error' ELSE 'done' END AS status,
 CASE WHEN doc_id % 13 = 0 THEN 'decode failed at ' || (doc_id % 5) END AS error, doc_id * 7919 % 1000003 AS finish_seq FROM documents)"""
EVENTS = """progress AS (SELECT user_id % 8 AS job_id, user_id AS image_id, event_id, ts, event_id * 37 % 101 AS progress_pct,
 CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' ELSE 'progress' END AS kind FROM events)"""
TIMED = """timed AS (SELECT *, epoch_us(ts) AS at_us, kind IN ('done', 'failed') AS ended, coalesce(epoch_us(lead(ts) OVER w), (SELECT max(epoch_us(ts)) FROM progress)) AS following,
 count(*) FILTER (kind IN ('done', 'failed')) OVER (PARTITION BY job_id, image_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM progress WINDOW w AS (PARTITION BY job_id, image_id ORDER BY ts, event_id))"""
PIXELS = """pixels AS (SELECT vec_id AS image_id, y, x, CAST((vec_id * 37 + x * 9 + y * 5) % 256 AS INT) AS r, CAST((vec_id * 11 + x * 3 + y * 13) % 256 AS INT) AS g, CAST((vec_id * 5 + x * 17 + y * 2) % 256 AS INT) AS b,
 CASE WHEN vec_id % 11 = 0 AND x < 4 THEN 100 ELSE 255 END AS a,
 CAST(greatest(0, least(255, 128 + 10 * ((3 + vec_id % 6) * (3 + vec_id % 6) - ((x - 6 - vec_id * 7 % 12) * (x - 6 - vec_id * 7 % 12) + (y - 6 - vec_id * 5 % 12) * (y - 6 - vec_id * 5 % 12))))) AS INT) AS mask
 FROM embeddings, (SELECT CAST(range AS INT) AS y FROM range(24)), (SELECT CAST(range AS INT) AS x FROM range(24)))"""
STROKES = """strokes AS (SELECT event_id // 20 AS image_id, user_id AS stroke_id, event_id AS seq, event_id * 13 % 24 AS x, event_id * 29 % 24 AS y, 1 + event_id % 4 AS radius FROM events)"""
FRAMES = """frames AS (SELECT vec_id AS image_id, y, x, unnest([0, 1, 2]) AS k, unnest([(vec_id * 257 + x * 1021 + y * 509 + (x + y) % 2 * 9000) % 65536, (vec_id * 131 + x * 613 + y * 2039) % 65536, (vec_id * 71 + x * 4093 + y * 97) % 65536]) AS c
 FROM embeddings, (SELECT CAST(range AS INT) AS y FROM range(24)), (SELECT CAST(range AS INT) AS x FROM range(24)))"""
DISC = "128 + 10 * ((3 + (vec_id + {s}) % 6) ** 2 - ((x - 6 - (vec_id + {s}) * 7 % 12) ** 2 + (y - 6 - (vec_id + {s}) * 5 % 12) ** 2))"
RECTS = "rects AS (SELECT vec_id AS image_id, vec_id % 8 AS l, vec_id % 5 AS t, vec_id % 8 + 14 AS r, vec_id % 5 + 16 AS b FROM embeddings), others AS (SELECT vec_id AS image_id, (vec_id + 4) % 8 AS l, (vec_id + 2) % 5 AS t, (vec_id + 4) % 8 + 14 AS r, (vec_id + 2) % 5 + 16 AS b FROM embeddings)"


def with_(*tables: str) -> str:
    return "WITH " + ", ".join(tables) + " "


def rects(spark, sf_dir, shift=0, drop=0):
    i = F.col("vec_id")
    left, top = (i + shift) % 8, (i + drop) % 5
    return D.read(spark, sf_dir, "embeddings").select(i.alias("image_id"), left.alias("l"), top.alias("t"), (left + 14).alias("r"), (top + 16).alias("b"))


def focused(s, d):
    i = F.col("vec_id")
    left, top = i % 5 * 5, i % 7 * 3
    return D.read(s, d, "embeddings").select(i.alias("image_id"), left.alias("l"), top.alias("t"), (left + 4).alias("r"), (top + 4).alias("b"))


def planned(s, d):
    return O.plan(O.accepted(D.manifest(s, d)), D.options(s))


def savings_report(s, d):
    jobs = O.savings_summary(D.results(s, d)).join(O.run_summary(D.results(s, d)).select("job_id", "failed"), "job_id")
    return jobs.withColumn("saved_text", M.format_bytes(F.col("saved_bytes")))


def refined(s, d):
    edits = D.results(s, d).filter("image_id % 3 = 0").select("image_id", (F.col("output_size") + 7).alias("output_size"))
    return O.upsert_refinements(D.results(s, d), edits).select("image_id", "job_id", "output_size", "status")


def remaining(s, d):
    done = D.results(s, d).filter("status = 'done'")
    return O.drop_items(D.manifest(s, d), done).select("image_id", "name")


def restored(s, d):
    m = D.manifest(s, d).select("image_id", "width", "height")
    half = m.select("image_id", F.floor(F.col("width") / 2).alias("width"), F.floor(F.col("height") / 2).alias("height"))
    return O.with_restore_source(half, m.filter("image_id % 5 <> 0"))


def appended(s, d):
    m = D.manifest(s, d)
    return O.append_items(m, m.filter("job_id = 1")).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("total_bytes"))


def formatted(s, d):
    r = D.manifest(s, d)
    return r.select("image_id", M.format_bytes(F.col("size_bytes")).alias("size_text"), M.format_eta(F.col("image_id") % 500).alias("eta_text"))


def votes(s, d):
    p = D.pixels(s, d)
    layers = p.select("image_id", "y", "x", F.explode(F.array(F.col("mask").cast("long"), 255 - F.col("mask"), (F.col("mask") * 3 + F.col("image_id")) % 256)).alias("pred"))
    return P.layer_votes(layers)


def light(s, d):
    from .functions import pixels as X

    p = D.pixels(s, d)
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return p.select("image_id", "y", "x", F.floor(X.luminance(r, g, b) * 1000 + 0.5).cast("long").alias("luminance_milli"), X.chroma(r, g, b).alias("chroma"), X.color_bucket(r, g, b).alias("bucket"))


def sampled(s, d):
    p = D.strokes(s, d).select("image_id", "seq", "x", "y", (F.col("seq") % 3).alias("label"))
    return E.sample_prompts(p)


def scored(s, d):
    p = D.pixels(s, d)
    masks = p.select("image_id", "y", "x", "mask", F.explode(F.array(*[F.struct(F.lit(k).alias("mask_idx"), F.lit(q).alias("quality"), F.lit(t).alias("at")) for k, (q, t) in enumerate(((0.9, 64), (0.8, 128), (0.7, 192)))])).alias("m")).select("image_id", "y", "x", "mask", "m.*").filter("mask >= at")
    prompts = D.strokes(s, d).select("image_id", "y", "x", (F.col("seq") % 3).alias("label"))
    best = T.best_mask(T.mask_scores(masks, prompts, rects(s, d)))
    return best.select("image_id", F.col("mask_idx").cast("long"), "area", F.floor(F.col("score") * 1000 + 0.5).cast("long").alias("score_milli"))


def negatives(s, d):
    points = D.strokes(s, d)
    bounds = E.stroke_bounds(points)
    images = D.read(s, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(24).alias("width"), F.lit(24).alias("height"))
    return E.negative_prompts(bounds, E.selection_windows(bounds, images), points, D.pixels(s, d).select("image_id", "y", "x", F.col("mask").alias("a")), images)


def heads(s, d):
    b = E.stroke_bounds(D.strokes(s, d))
    return b.select("image_id", F.col("l").alias("min_x"), F.col("r").alias("max_x"), ((F.col("r") - F.col("l")) * (F.col("b") - F.col("t"))).alias("area"), F.col("stroke_id").alias("first_pixel"))


def bands(s, d):
    h = heads(s, d)
    body = h.groupBy("image_id").agg(F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"))
    b = T.ownership_bands(T.distinct_heads(h, 24), body)
    return b.select("image_id", "first_pixel", (F.col("own_l") * 4).cast("long").alias("own_l4"), (F.col("own_r") * 4).cast("long").alias("own_r4"))


def replayed(s, d):
    pictures = D.pictures(s, d)
    return T.replay_edits(pictures, pictures, D.strokes(s, d)).select("image_id", F.sha2("data", 256).alias("data_sha256"))


def digest(rasters, *more):
    return rasters.select("image_id", "height", "width", *more, F.sha2("data", 256).alias("data_sha256"))


def detailed(s, d):
    return D.layers(s, d).withColumn("detail", F.when(F.col("layer_idx") == 1, "hair").when(F.col("layer_idx") == 2, "edge").otherwise("person"))


def prompts(s, d):
    return D.strokes(s, d).select("image_id", "seq", "x", "y", "radius", (F.col("seq") % 3).alias("label"))


def bright(pixels):
    """Stands in for a segmentation model: how bright a pixel is."""
    return pixels[..., :3].mean(-1)


def by_light(inputs, points, labels, height, width):
    """Stands in for a prompted model: three thresholds on the input."""
    rows, columns = np.arange(height) * inputs.shape[1] // max(height, width), np.arange(width) * inputs.shape[2] // max(height, width)
    light = inputs.mean(0)[rows][:, columns]
    return [light >= t for t in (-0.5, 0.0, 0.5)], [0.7, 0.8, 0.9]


def composed(s, d):
    e = D.progress_events(s, d)
    return e.select("event_id", F.floor(M.compose_progress(D.pick(STAGES, "event_id % 6"), F.col("progress_pct") / 100) * 10000 + 0.5).cast("long").alias("points"))


def budgeted(s, d):
    i = F.col("vec_id")
    crops = lambda n, shift: D.read(s, d, "embeddings").select(i.alias("image_id"), F.explode(F.sequence(F.lit(1), n)).alias("rank")).filter(F.col("rank") <= n).select("*", *[(F.col("rank") + shift + k).alias(c) for k, c in enumerate(("l", "t", "r", "b", "own_l", "own_r"))])
    plan = B.crop_plan(crops((i % 15 + 1).cast("int"), 0), crops((i * 7 % 9 + 1).cast("int"), 100).filter("image_id * 7 % 9 > 0"))
    return plan.select("image_id", F.col("layer_idx").cast("long"), F.col("l").cast("long"))


def frames_checked(s, d):
    """16-bit frames, every seventh of which lacks its last byte."""
    frames = D.frames16(s, d).withColumn("data", F.when(F.col("image_id") % 7 == 0, F.expr("substring(data, 1, octet_length(data) - 1)")).otherwise(F.col("data")))
    good, bad = R.validate_frames(frames)
    return good.select("image_id", F.lit(True).alias("valid")).unionByName(bad.select("image_id", F.lit(False).alias("valid")))


def flattened(s, d):
    return R.pixel_rows(R.over_rows(D.pictures(s, d), R.RASTER, lambda r: [R.pack(r["image_id"], K.flatten_alpha(R.unpack(r)))]))


def embedded(s, d):
    """Files of text with two pictures behind it, whose scans differ in length."""
    p = F.col("page_id")
    word = lambda c: F.lpad(F.hex(c), 4, "0")
    picture = lambda w, h, scan: F.unhex(F.concat(F.lit("FFD8FFE00004" + "00" * 2 + "FFC0000B08"), word(h), word(w), F.lit("01" + "00" * 3 + "FFDA0004" + "00" * 2), F.repeat(F.lit("5A"), scan.cast("int")), F.lit("FFD9")))
    two = picture(p % 200 + 1, p % 90 + 1, p % 50), picture(p % 70 + 1, p % 300 + 1, p * 7 % 50)
    pages = D.read(s, d, "pages").select(p.cast("string").alias("path"), F.concat(F.coalesce("html", F.lit("")).cast("binary"), *two).alias("content"))
    best = FS.best_embedded_jpeg(FS.jpeg_candidates(pages, 1000))  # small ranges, so that headers and scans cross their edges
    return best.select(F.col("path").cast("long").alias("page_id"), F.col("start").alias("start_at"), F.col("end").alias("end_at"), "width", "height")


def converted(s, d):
    plan, files = planned(s, d), D.manifest(s, d).filter("image_id % 11 <> 0").select("image_id", F.col("name").cast("binary").alias("content"))
    done = C.convert_all(plan, D.pictures(s, d), files, lambda rgba, mime, quality: (f"{mime}:{rgba.shape[1]}x{rgba.shape[0]}".encode(), mime))
    png = F.substring("content", 2, 3) == F.lit("PNG").cast("binary")  # made by zlib, which SQL has not
    return done.select("image_id", "name", "status", F.when(~png, F.sha2("content", 256)).alias("content_sha256"), F.when(png, True).alias("png"))


def written(s, d):
    """8- and 16-bit frames as PNG files: size, depth and colour kind of their headers, and how many bytes of lines they hold."""
    frames = D.frames16(s, d).unionByName(D.pictures(s, d).withColumn("image_id", F.col("image_id") + (1 << 40)))
    head = lambda at, n: F.conv(F.hex(F.expr(f"substring(content, {at}, {n})")), 16, 10).cast("long")
    return R.encode_png(frames).select("image_id", head(17, 4).alias("width"), head(21, 4).alias("height"), head(25, 1).alias("bits"), head(26, 1).alias("kind"), F.hex(F.expr("right(content, 8)")).alias("end_hex"))


def background(s, d):
    return digest(B.remove_background(D.pictures(s, d), lambda: bright, fresh(s, "background")))


def edited(s, d):
    c = F.col
    lines = D.strokes(s, d).select("image_id", "seq", c("x").alias("x0"), c("y").alias("y0"), (c("seq") * 7 % 24).alias("x1"), (c("seq") * 11 % 24).alias("y1"), "radius", (c("seq") % 3 != 0).alias("add"))
    return digest(L.edit_selections(D.masks(s, d), D.pictures(s, d), lines))


def stepped(s, d):
    m = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("long").alias(c)
    return E.expand_strokes(D.strokes(s, d).drop("tool")).select("image_id", "stroke_id", "seq", F.col("step").cast("long"), m("at_x"), m("at_y"))


def windows(s, d):
    images = D.manifest(s, d).select("image_id", "width", "height")
    return E.selection_windows(E.stroke_bounds(D.strokes(s, d)), images)


def axis(low, high, size):
    """The SQL of one axis of a selection window."""
    return f"""{low}0 AS (SELECT *, least(greatest(floor({low} - pad), 0), {size} - 1) AS f, least(greatest(ceil({high} + pad), least(greatest(floor({low} - pad), 0), {size} - 1) + 1), {size}) AS e FROM {{0}}),
 {low}1 AS (SELECT *, greatest(0, least({size}, edge) - (e - f)) AS lacks, least(f, ceil(greatest(0, least({size}, edge) - (e - f)) / 2)) AS before FROM {low}0),
 {low}2 AS (SELECT *, least({size} - e, lacks - before) AS after FROM {low}1),
 {{1}} AS (SELECT * EXCLUDE (f, e, lacks, before, after) REPLACE (CAST(greatest(0, f - before - (lacks - before - after)) AS BIGINT) AS {low}, CAST(least({size}, e + after) AS BIGINT) AS {high}) FROM {low}2)"""


BOXED = axis("l", "r", "width").format("p", "wide") + ", " + axis("t", "b", "height").format("wide", "boxed")

TABLE = {
    "savings_report": (savings_report, with_(RESULTS) + """SELECT job_id, count(*) FILTER (status = 'done') AS n_results, CAST(sum(CASE WHEN status = 'done' THEN greatest(0, original_size - output_size) ELSE 0 END) AS BIGINT) AS saved_bytes, count(*) FILTER (status = 'error') AS failed,
 CASE WHEN sum(CASE WHEN status = 'done' THEN greatest(0, original_size - output_size) ELSE 0 END) < 1024 THEN sum(CASE WHEN status = 'done' THEN greatest(0, original_size - output_size) ELSE 0 END) || ' B'
 WHEN sum(CASE WHEN status = 'done' THEN greatest(0, original_size - output_size) ELSE 0 END) < 1048576 THEN ((sum(CASE WHEN status = 'done' THEN greatest(0, original_size - output_size) ELSE 0 END) * 10 + 512) // 1024 // 10) || '.' || ((sum(CASE WHEN status = 'done' THEN greatest(0, original_size - output_size) ELSE 0 END) * 10 + 512) // 1024 % 10) || ' KB'
 ELSE ((sum(CASE WHEN status = 'done' THEN greatest(0, original_size - output_size) ELSE 0 END) * 10 + 524288) // 1048576 // 10) || '.' || ((sum(CASE WHEN status = 'done' THEN greatest(0, original_size - output_size) ELSE 0 END) * 10 + 524288) // 1048576 % 10) || ' MB' END AS saved_text FROM results GROUP BY job_id"""),
    "plan": (planned, "WITH " + PLAN + " SELECT * FROM plan"),
    "keep_last_by_name": (lambda s, d: O.keep_last(planned(s, d), "job_id", "out_name", "seq").select("image_id", "job_id", "out_name"), "WITH " + PLAN + " SELECT image_id, job_id, out_name FROM plan QUALIFY row_number() OVER (PARTITION BY job_id, out_name ORDER BY seq DESC) = 1"),
    "queue_summary": (lambda s, d: O.queue_summary(D.manifest(s, d)), with_(MANIFEST) + "SELECT job_id, count(*) AS n_items, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM manifest GROUP BY job_id"),
    "run_summary": (lambda s, d: O.run_summary(D.results(s, d)), with_(RESULTS) + "SELECT job_id, count(*) FILTER (status <> 'error') AS completed, count(*) FILTER (status = 'error') AS failed, arg_min(name || ': ' || error, finish_seq) FILTER (status = 'error') AS first_failure FROM results GROUP BY job_id"),
    "remaining_queue": (remaining, with_(MANIFEST, RESULTS) + "SELECT image_id, name FROM manifest WHERE image_id NOT IN (SELECT image_id FROM results WHERE status = 'done')"),
    "appended_queue": (appended, with_(MANIFEST) + "SELECT job_id, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM (SELECT * FROM manifest UNION ALL SELECT * FROM manifest WHERE job_id = 1) GROUP BY job_id"),
    "refinement_upsert": (refined, with_(RESULTS) + "SELECT image_id, job_id, CASE WHEN image_id % 3 = 0 THEN output_size + 7 ELSE output_size END AS output_size, status FROM results"),
    "restore_source": (restored, with_(MANIFEST) + "SELECT image_id, CAST(width // 2 AS BIGINT) AS width, CAST(height // 2 AS BIGINT) AS height, CAST(CASE WHEN image_id % 5 <> 0 THEN width ELSE width // 2 END AS BIGINT) AS source_w, CAST(CASE WHEN image_id % 5 <> 0 THEN height ELSE height // 2 END AS BIGINT) AS source_h FROM manifest"),
    "size_and_eta_text": (formatted, with_(MANIFEST) + """SELECT image_id, CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN ((size_bytes * 10 + 512) // 1024 // 10) || '.' || ((size_bytes * 10 + 512) // 1024 % 10) || ' KB' ELSE ((size_bytes * 10 + 524288) // 1048576 // 10) || '.' || ((size_bytes * 10 + 524288) // 1048576 % 10) || ' MB' END AS size_text,
 CASE WHEN image_id % 500 = 0 THEN NULL WHEN image_id % 500 < 60 THEN (image_id % 500) || 's' ELSE ((image_id % 500 + 59) // 60) || ' min' END AS eta_text FROM manifest"""),
    "batch_progress": (lambda s, d: G.batch_progress(D.manifest(s, d), D.progress_events(s, d), 600), with_(MANIFEST, EVENTS) + """, l AS (SELECT * FROM progress QUALIFY row_number() OVER (PARTITION BY job_id, image_id ORDER BY ts DESC, event_id DESC) = 1),
 i AS (SELECT m.job_id, coalesce(kind IN ('done', 'failed'), FALSE) AS ended, coalesce(progress_pct, 0) AS pct FROM manifest m LEFT JOIN l USING (job_id, image_id)),
 j AS (SELECT job_id, count(*) AS total, count(*) FILTER (ended) AS finished, sum(CASE WHEN ended THEN 100 ELSE pct END)::DOUBLE / (count(*) * 100) AS mean FROM i GROUP BY job_id)
 SELECT job_id, total, finished, CAST(least(99, floor(mean * 100 + 0.5)) AS BIGINT) AS percent, CASE WHEN mean > 0.03 THEN CAST(greatest(0, floor(600 / mean - 600 + 0.5)) AS BIGINT) END AS seconds_left, least(finished + 1, total) AS current FROM j"""),
    "stalled_items": (lambda s, d: G.stalled_items(D.progress_events(s, d)), with_(EVENTS, TIMED) + "SELECT job_id, image_id, max(following - at_us) AS longest_us, count(*) AS stalls FROM timed WHERE NOT ended AND following - at_us > 180000000 GROUP BY ALL"),
    "overdue_items": (lambda s, d: G.overdue_items(D.progress_events(s, d)), with_(EVENTS, TIMED) + "SELECT job_id, image_id, run, max(CASE WHEN ended THEN at_us ELSE following END) - min(at_us) AS span_us FROM timed GROUP BY ALL HAVING max(CASE WHEN ended THEN at_us ELSE following END) - min(at_us) > 90000000"),
    "light_and_buckets": (light, with_(PIXELS) + "SELECT image_id, y, x, CAST(floor((0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b) * 1000 + 0.5) AS BIGINT) AS luminance_milli, greatest(r, g, b) - least(r, g, b) AS chroma, r // 16 + g // 16 * 16 + b // 16 * 256 AS bucket FROM pixels"),
    "color_histogram": (lambda s, d: P.color_histogram(D.pixels(s, d)), with_(PIXELS) + "SELECT image_id, r // 16 + g // 16 * 16 + b // 16 * 256 AS bucket, count(*) FILTER (mask <= 24) AS bg, count(*) FILTER (mask >= 232) AS fg FROM pixels WHERE a >= 128 AND (mask <= 24 OR mask >= 232) GROUP BY ALL"),
    "max_pool": (lambda s, d: P.max_pool(D.pixels(s, d), 24, 7), with_(PIXELS) + "SELECT image_id, CAST(floor(y * 7 / 24) AS INT) AS my, CAST(floor(x * 7 / 24) AS INT) AS mx, max(mask) AS mask FROM pixels GROUP BY ALL"),
    "finished_alpha": (lambda s, d: P.finished_alpha(D.pixels(s, d), F.col("y") < 8), with_(PIXELS) + """, n AS (SELECT *, mask / 255 AS v, y < 8 AS fine FROM pixels), p AS (SELECT *, CAST(CASE WHEN fine THEN CASE WHEN v <= 0.003 THEN 0 WHEN v >= 0.997 THEN 255 ELSE floor(pow(v, 2.2) / (pow(v, 2.2) + pow(1 - v, 2.2)) * 255 + 0.5) END
 ELSE CASE WHEN v <= 0.015 THEN 0 WHEN v >= 0.985 THEN 255 ELSE floor(pow(v, 4) / (pow(v, 4) + pow(1 - v, 4)) * 255 + 0.5) END END AS INT) AS q FROM n) SELECT image_id, y, x, CAST(floor(q * a / 255 + 0.5) AS INT) AS alpha FROM p"""),
    "layer_votes": (votes, with_(PIXELS) + """, l AS (SELECT image_id, y, x, unnest([mask::BIGINT, 255 - mask, (mask * 3 + image_id) % 256]) AS pred FROM pixels) SELECT image_id, y, x, count(*) FILTER (pred <= 56) AS bg_votes, bool_or(pred >= 210) AS fg_veto, min(pred) FILTER (pred <= 56) AS lowest_bg FROM l GROUP BY ALL"""),
    "in_zones": (lambda s, d: P.in_zones(D.pixels(s, d).select("image_id", "y", "x", "mask"), rects(s, d)), with_(PIXELS, RECTS) + "SELECT image_id, y, x, mask FROM pixels p WHERE EXISTS (SELECT 1 FROM rects z WHERE z.image_id = p.image_id AND x >= l AND x < z.r AND y >= t AND y < z.b)"),
    "duplicate_rects": (lambda s, d: P.drop_duplicate_rects(rects(s, d), rects(s, d, 4, 2)), with_(RECTS) + ", m AS (SELECT c.*, (least(c.r, o.r) - greatest(c.l, o.l)) * (least(c.b, o.b) - greatest(c.t, o.t)) AS shared FROM rects c JOIN others o USING (image_id)) SELECT image_id, l, t, r, b FROM m WHERE NOT (shared / (448 - shared) >= 0.58)"),
    "intersecting_rects": (lambda s, d: P.keep_intersecting(rects(s, d), focused(s, d)), with_(RECTS, "focused AS (SELECT vec_id AS image_id, vec_id % 5 * 5 AS l, vec_id % 7 * 3 AS t, vec_id % 5 * 5 + 4 AS r, vec_id % 7 * 3 + 4 AS b FROM embeddings)") + "SELECT c.* FROM rects c JOIN focused f USING (image_id) WHERE c.l < f.r AND f.l < c.r AND c.t < f.b AND f.t < c.b"),
    "selected_pixels": (lambda s, d: P.selected(D.pixels(s, d)), with_(PIXELS) + "SELECT image_id, y, x FROM pixels WHERE mask >= 128 AND a > 4"),
    "selection_size": (lambda s, d: P.selection_size(D.pixels(s, d)), with_(PIXELS) + "SELECT image_id, count(*) FILTER (mask >= 128 AND a > 4) AS n_selected FROM pixels GROUP BY image_id"),
    "summed_area": (lambda s, d: P.box_sums(D.pixels(s, d)), with_(PIXELS) + ", a AS (SELECT image_id, y, x, sum(mask) OVER (PARTITION BY image_id, y ORDER BY x) AS s FROM pixels) SELECT image_id, y, x, CAST(sum(s) OVER (PARTITION BY image_id, x ORDER BY y) AS BIGINT) AS area_sum FROM a"),
    "stroke_bounds": (lambda s, d: E.stroke_bounds(D.strokes(s, d)), with_(STROKES) + "SELECT image_id, stroke_id, min(x - radius) AS l, min(y - radius) AS t, max(x + radius) AS r, max(y + radius) AS b, max(radius) AS radius FROM strokes GROUP BY image_id, stroke_id"),
    "stroke_steps": (stepped, with_(STROKES) + """, p AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM strokes WINDOW w AS (PARTITION BY image_id, stroke_id ORDER BY seq)),
 q AS (SELECT *, CASE WHEN px IS NULL THEN 0 ELSE CAST(greatest(1, ceil(sqrt((x - px) * (x - px) + (y - py) * (y - py)) / greatest(1.0::DOUBLE, 0.42::DOUBLE * radius))) AS BIGINT) END AS steps FROM p),
 r AS (SELECT *, unnest(range(CASE WHEN steps = 0 THEN 0 ELSE 1 END, steps + 1)) AS step FROM q)
 SELECT image_id, stroke_id, seq, step, CAST(floor((CASE WHEN steps = 0 THEN x ELSE px + (x - px) * step / steps END) * 1000 + 0.5) AS BIGINT) AS at_x, CAST(floor((CASE WHEN steps = 0 THEN y ELSE py + (y - py) * step / steps END) * 1000 + 0.5) AS BIGINT) AS at_y FROM r"""),
    "selection_windows": (windows, with_(STROKES, MANIFEST) + f""", b AS (SELECT image_id, stroke_id, min(x - radius) AS l, min(y - radius) AS t, max(x + radius) AS r, max(y + radius) AS b, max(radius) AS radius FROM strokes GROUP BY image_id, stroke_id),
 p AS (SELECT b.*, width, height, greatest(48, 2.5 * radius, 0.22::DOUBLE * greatest(1, r - l, b - t)) AS pad, greatest(192, ceil(6 * radius)) AS edge FROM b JOIN manifest USING (image_id)), {BOXED}
 SELECT image_id, stroke_id, l, t, r, b, least(1.0::DOUBLE, 1024 / greatest(r - l, b - t)) AS scale FROM boxed"""),
    "sampled_prompts": (sampled, with_(STROKES) + """, p AS (SELECT image_id, seq, x, y, seq % 3 AS label, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY image_id, seq % 3 <> 0) AS n, CASE WHEN seq % 3 <> 0 THEN 14 ELSE 6 END AS k FROM strokes WINDOW w AS (PARTITION BY image_id, seq % 3 <> 0 ORDER BY seq))
 SELECT image_id, seq, x, y, label FROM p WHERE n <= k OR list_contains(list_transform(range(k), lambda j: CAST(floor(j * (n - 1) / (k - 1) + 0.5) AS BIGINT)), i)"""),
    "sharpened_frames": (lambda s, d: R.pixel_rows(R.sharpen_frames(D.frames16(s, d))), with_(FRAMES) + """, n AS (SELECT *, coalesce(lag(c) OVER h, c) + coalesce(lead(c) OVER h, c) + coalesce(lag(c) OVER v, c) + coalesce(lead(c) OVER v, c) AS ring FROM frames WINDOW h AS (PARTITION BY image_id, k, y ORDER BY x), v AS (PARTITION BY image_id, k, x ORDER BY y)),
 o AS (SELECT *, (4 * c + ring)::DOUBLE / 8 AS blur FROM n), p AS (SELECT *, CASE WHEN abs(c - blur) >= 256 THEN greatest(0, least(65535, floor(c + 0.42::DOUBLE * (c - blur) + 0.5))) ELSE c END AS s FROM o)
 SELECT image_id, y, x, CAST(max(s) FILTER (k = 0) AS INT) AS c0, CAST(max(s) FILTER (k = 1) AS INT) AS c1, CAST(max(s) FILTER (k = 2) AS INT) AS c2 FROM p GROUP BY image_id, y, x"""),
    "rgba_frames": (lambda s, d: R.pixel_rows(R.to_rgba8(D.frames16(s, d))), with_(FRAMES) + ", p AS (SELECT *, CAST((c + 128) // 257 AS INT) AS s FROM frames) SELECT image_id, y, x, max(s) FILTER (k = 0) AS c0, max(s) FILTER (k = 1) AS c1, max(s) FILTER (k = 2) AS c2 FROM p GROUP BY image_id, y, x"),
    "mask_components": (lambda s, d: R.components(D.masks(s, d), 128).select("image_id", "area", "min_x", "min_y", "max_x", "max_y", "first_pixel"), f"""WITH RECURSIVE on_ AS (SELECT vec_id AS image_id, y * 24 + x AS p FROM embeddings, (SELECT range AS y FROM range(24)), (SELECT range AS x FROM range(24)) WHERE greatest({DISC.format(s=0)}, {DISC.format(s=3)}) >= 128),
 e AS (SELECT a.image_id, a.p, b.p AS q FROM on_ a JOIN on_ b ON a.image_id = b.image_id AND abs(a.p % 24 - b.p % 24) <= 1 AND abs(a.p // 24 - b.p // 24) <= 1),
 r AS (SELECT image_id, p AS root, p FROM on_ WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.image_id = on_.image_id AND e.p = on_.p AND e.q < on_.p) UNION SELECT r.image_id, r.root, e.q FROM r JOIN e ON e.image_id = r.image_id AND e.p = r.p),
 l AS (SELECT image_id, p, min(root) AS root FROM r GROUP BY image_id, p)
 SELECT image_id, count(*) AS area, min(p % 24) AS min_x, min(p // 24) AS min_y, max(p % 24) AS max_x, max(p // 24) AS max_y, root AS first_pixel FROM l GROUP BY image_id, root"""),
    "painted_pixels": (lambda s, d: T.painted_pixels(D.pixels(s, d), D.strokes(s, d)), with_(PIXELS, STROKES) + "SELECT image_id, y, x FROM pixels p WHERE a > 4 AND EXISTS (SELECT 1 FROM strokes s WHERE s.image_id = p.image_id AND (p.x + 0.5 - s.x) ** 2 + (p.y + 0.5 - s.y) ** 2 <= greatest(1.5, 0.32 * radius) ** 2)"),
    "best_candidate_mask": (scored, with_(PIXELS, STROKES, RECTS) + """, k(mask_idx, quality, lim) AS (VALUES (0::BIGINT, 0.9::DOUBLE, 64), (1, 0.8, 128), (2, 0.7, 192)), m AS (SELECT image_id, y, x, mask_idx, quality FROM pixels, k WHERE mask >= lim),
 a AS (SELECT m.image_id, mask_idx, any_value(quality) AS quality, count(*) AS area, count(*) FILTER (x >= l AND x < r AND y >= t AND y < b) AS inside FROM m JOIN rects USING (image_id) GROUP BY m.image_id, mask_idx),
 g AS (SELECT image_id, count(*) FILTER (seq % 3 <> 0) AS n_pos, count(*) FILTER (seq % 3 = 0) AS n_neg FROM strokes GROUP BY image_id),
 h AS (SELECT m.image_id, mask_idx, count(*) FILTER (seq % 3 <> 0) AS pos, count(*) FILTER (seq % 3 = 0) AS neg FROM m JOIN strokes s ON m.image_id = s.image_id AND m.x = s.x AND m.y = s.y GROUP BY ALL),
 z AS (SELECT a.image_id, a.mask_idx, area, quality + 2.5::DOUBLE * CASE WHEN n_pos > 0 THEN coalesce(pos, 0) / n_pos ELSE 0 END - 3.5::DOUBLE * CASE WHEN n_neg > 0 THEN coalesce(neg, 0) / n_neg ELSE 0 END - 2.25::DOUBLE * (1 - inside / area) AS score
 FROM a LEFT JOIN g USING (image_id) LEFT JOIN h USING (image_id, mask_idx))
 SELECT image_id, mask_idx, area, CAST(floor(score * 1000 + 0.5) AS BIGINT) AS score_milli FROM z QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, mask_idx) = 1"""),
    "ownership_bands": (bands, with_(STROKES) + """, h AS (SELECT image_id, min(x - radius) AS min_x, max(x + radius) AS max_x, (max(x + radius) - min(x - radius)) * (max(y + radius) - min(y - radius)) AS area, stroke_id AS first_pixel FROM strokes GROUP BY image_id, stroke_id),
 o AS (SELECT image_id, min(min_x) AS body_l, max(max_x) + 1 AS body_r FROM h GROUP BY image_id),
 e AS (SELECT *, (min_x + max_x + 1) / 2 AS center FROM h QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY area DESC, first_pixel) <= 8),
 f AS (SELECT *, center - lag(center) OVER (PARTITION BY image_id ORDER BY min_x, area DESC, first_pixel) AS gap FROM e), g AS (SELECT * FROM f WHERE gap IS NULL OR gap >= 0.035 * 24),
 b AS (SELECT image_id, first_pixel, coalesce((lag(center) OVER w + center) / 2, body_l) AS l, coalesce((lead(center) OVER w + center) / 2, body_r) AS r FROM g JOIN o USING (image_id) WINDOW w AS (PARTITION BY image_id ORDER BY center, first_pixel))
 SELECT image_id, first_pixel, CAST(l * 4 AS BIGINT) AS own_l4, CAST(r * 4 AS BIGINT) AS own_r4 FROM b"""),
    "applied_selection": (lambda s, d: P.apply_selection(D.pixels(s, d), D.pixels(s, d).filter("(x + y) % 2 = 0")), with_(PIXELS) + "SELECT image_id, y, x, CAST(round_even(a * (255 - CASE WHEN (x + y) % 2 = 0 THEN mask ELSE 0 END) / 255, 0) AS INT) AS alpha FROM pixels"),
    "negative_prompts": (negatives, with_(STROKES, PIXELS) + f""", g AS (SELECT image_id, stroke_id, min(x - radius) AS l, min(y - radius) AS t, max(x + radius) AS r, max(y + radius) AS b, max(radius) AS radius FROM strokes WHERE image_id IN (SELECT vec_id FROM embeddings) GROUP BY image_id, stroke_id),
 p AS (SELECT *, 24 AS width, 24 AS height, greatest(48, 2.5 * radius, 0.22::DOUBLE * greatest(1, r - l, b - t)) AS pad, greatest(192, ceil(6 * radius)) AS edge FROM g), {BOXED},
 o AS (SELECT g.*, 1.8::DOUBLE * g.radius AS ring, w.l AS wl, w.t AS wt, w.r AS wr, w.b AS wb, least(1.0::DOUBLE, 1024 / greatest(w.r - w.l, w.b - w.t)) AS scale FROM g JOIN boxed w USING (image_id, stroke_id)),
 c AS (SELECT image_id, stroke_id, radius, wl, wt, wr, wb, scale, CAST(3 * j + i AS INT) AS place, CAST(floor(least(23, greatest(0, [l - ring, (l + r) / 2, r + ring][i + 1])) + 0.5) AS BIGINT) AS x,
 CAST(floor(least(23, greatest(0, [t - ring, (t + b) / 2, b + ring][j + 1])) + 0.5) AS BIGINT) AS y FROM o, (SELECT range AS i FROM range(3)), (SELECT range AS j FROM range(3)) WHERE NOT (i = 1 AND j = 1))
 SELECT image_id, stroke_id, place, x, y, (x - wl) * scale AS crop_x, (y - wt) * scale AS crop_y, greatest(1.0::DOUBLE, radius * scale) AS crop_radius FROM c WHERE x >= wl AND x < wr AND y >= wt AND y < wb
 AND EXISTS (SELECT 1 FROM pixels q WHERE q.image_id = c.image_id AND q.x = c.x AND q.y = c.y AND mask > 16)
 AND NOT EXISTS (SELECT 1 FROM strokes s WHERE s.image_id = c.image_id AND s.stroke_id = c.stroke_id AND (c.x - s.x) ** 2 + (c.y - s.y) ** 2 <= 1.45::DOUBLE * 1.45::DOUBLE * s.radius * s.radius)"""),
    "fused_mattes": (lambda s, d: T.fuse_layers(D.layers(s, d)).select("image_id", F.sha2("data", 256).alias("data_sha256")), None),
    "replayed_edits": (replayed, None),
    "finished_mattes": (lambda s, d: digest(T.finished_mattes(D.pictures(s, d), detailed(s, d))), None),
    "edge_snapped": (lambda s, d: digest(T.snap_to_edges(D.pictures(s, d), 6)), None),
    "colours_cleaned": (lambda s, d: digest(T.decontaminate(D.pictures(s, d), 8)), None),
    "tiled_colours": (lambda s, d: digest(Z.join(V.decontaminate(Z.split(D.pictures(s, d), 9), 8))), None),
    "detached_removed": (lambda s, d: digest(T.remove_detached(D.masks(s, d))), None),
    "planned_crops": (lambda s, d: Q.planned_crops(D.masks(s, d).withColumns({"image_w": F.lit(480), "image_h": F.lit(480)})), None),
    "background_removed": (background, None),
    "model_inputs": (lambda s, d: B.model_inputs(detailed(s, d).select("image_id", "layer_idx", "l", "t", "r", "b").join(D.pictures(s, d), "image_id"), 32).select("image_id", "layer_idx", F.sha2("tensor", 256).alias("tensor_sha256")), None),
    "refined_selections": (lambda s, d: digest(L.refine_selections(D.masks(s, d), D.pictures(s, d), prompts(s, d)), "n_selected"), None),
    "colour_selections": (lambda s, d: digest(L.colour_selections(D.masks(s, d), D.pictures(s, d), prompts(s, d)), "n_selected"), None),
    "prompted_masks": (lambda s, d: digest(L.prompted_masks(D.pictures(s, d), E.sample_prompts(prompts(s, d)), lambda: by_light, 64), "mask_idx"), None),
    "placed_selections": (lambda s, d: digest(L.place_selections(D.masks(s, d), rects(s, d).withColumns({"frame_h": F.lit(48), "frame_w": F.lit(48)}))), None),
    "edited_selections": (edited, None),
    "hint_boxes": (lambda s, d: L.hint_boxes(D.masks(s, d).withColumns({"image_w": F.lit(240), "image_h": F.lit(240)}), prompts(s, d)), None),
    "tiled_sharpening": (lambda s, d: R.pixel_rows(Z.join(Z.stencil(Z.split(D.frames16(s, d), 10), 1, K.sharpen16))), None),
    "tiled_components": (lambda s, d: Z.components(Z.split(D.masks(s, d), 7), 128).select("image_id", "area", "min_x", "min_y", "max_x", "max_y", "first_pixel"), None),
    "subject_rects": (lambda s, d: R.subject_rects(R.components(D.masks(s, d), 24), 24, 24, 240, 240), None),
    "composed_progress": (composed, with_(EVENTS) + "SELECT event_id, CAST(floor(([0, 0.42, 0.36, 0.62, 0.68, 0][event_id % 6 + 1]::DOUBLE + [0.42, 0.58, 0.25, 0.36, 0.16, 1][event_id % 6 + 1]::DOUBLE * (progress_pct / 100)) * 10000 + 0.5) AS BIGINT) AS points FROM progress"),
    "crop_budget": (budgeted, """WITH n AS (SELECT vec_id AS image_id, vec_id % 15 + 1 AS ns, CASE WHEN vec_id * 7 % 9 > 0 THEN vec_id * 7 % 9 + 1 ELSE 0 END AS ne FROM embeddings),
 c AS (SELECT image_id, 0 AS kind, unnest(range(1, least(ns, 12 - ne) + 1)) AS rank FROM n UNION ALL SELECT image_id, 1, unnest(range(1, ne + 1)) FROM n)
 SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY kind, rank) AS layer_idx, rank + kind * 100 AS l FROM c"""),
    "validated_frames": (frames_checked, "SELECT vec_id AS image_id, vec_id % 7 <> 0 AS valid FROM embeddings"),
    "flattened_pixels": (flattened, f"""WITH p AS (SELECT vec_id AS i, y, x, greatest(0, least(255, greatest({DISC.format(s=0)}, {DISC.format(s=3)}))) / 255::DOUBLE AS a FROM embeddings, (SELECT CAST(range AS INT) AS y FROM range(24)), (SELECT CAST(range AS INT) AS x FROM range(24)))
 SELECT i AS image_id, y, x, CAST(round_even((i * 37 + x * 9 + y * 5) % 256 * a, 0) AS INT) AS c0, CAST(round_even((i * 11 + x * 3 + y * 13) % 256 * a, 0) AS INT) AS c1, CAST(round_even((i * 5 + x * 17 + y * 2) % 256 * a, 0) AS INT) AS c2 FROM p"""),
    "halved_frames": (lambda s, d: R.pixel_rows(R.resample(D.frames16(s, d), 12, 12)), with_(FRAMES) + """, h AS (SELECT image_id, y // 2 AS y, x // 2 AS x, k, CAST(round_even(sum(c) / 4, 0) AS INT) AS v FROM frames GROUP BY ALL)
 SELECT image_id, y, x, max(v) FILTER (k = 0) AS c0, max(v) FILTER (k = 1) AS c1, max(v) FILTER (k = 2) AS c2 FROM h GROUP BY image_id, y, x"""),
    "embedded_pictures": (embedded, """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, 29 + page_id % 50 AS a, 29 + page_id * 7 % 50 AS b, page_id % 200 + 1 AS wa, page_id % 90 + 1 AS ha, page_id % 70 + 1 AS wb, page_id % 300 + 1 AS hb FROM pages),
 q AS (SELECT *, a > b OR a = b AND wa * ha >= wb * hb AS one FROM p)
 SELECT page_id, CASE WHEN one THEN n ELSE n + a END AS start_at, CASE WHEN one THEN n + a ELSE n + a + b END AS end_at, CASE WHEN one THEN wa ELSE wb END AS width, CASE WHEN one THEN ha ELSE hb END AS height FROM q"""),
    "converted_files": (converted, "WITH " + PLAN + """, e AS (SELECT p.*, v.vec_id IS NOT NULL AS pixels FROM plan p LEFT JOIN embeddings v ON v.vec_id = p.image_id),
 z AS (SELECT *, CASE WHEN route = 'pass-through' THEN image_id % 11 <> 0 WHEN route = 'remove-background' THEN FALSE ELSE pixels END AS good FROM e)
 SELECT image_id, out_name AS name, CASE WHEN good THEN 'done' ELSE 'error' END AS status,
 CASE WHEN NOT good OR route = 'raw-16' THEN NULL WHEN route = 'pass-through' THEN sha256(name) ELSE sha256(out_mime || ':' || out_w || 'x' || out_h) END AS content_sha256, CASE WHEN good AND route = 'raw-16' THEN TRUE END AS png FROM z"""),
    "written_pngs": (written, "SELECT vec_id + k * 1099511627776 AS image_id, 24::BIGINT AS width, 24::BIGINT AS height, CASE k WHEN 0 THEN 16 ELSE 8 END::BIGINT AS bits, CASE k WHEN 0 THEN 2 ELSE 6 END::BIGINT AS kind, '49454E44AE426082' AS end_hex FROM embeddings, (SELECT unnest([0, 1]) AS k)"),
    "effective_edits": (lambda s, d: E.effective_edits(D.strokes(s, d)).select("image_id", "seq", "tool"), None),
}

# SQL on whole rasters has a module of its own
for _name, _sql in raster_sql.SQL.items():
    TABLE[_name] = TABLE[_name][0], _sql

# whole frames and tiles give the same rows, so the SQL of the one holds for the other
TABLE["tiled_sharpening"] = TABLE["tiled_sharpening"][0], TABLE["sharpened_frames"][1]
TABLE["tiled_colours"] = TABLE["tiled_colours"][0], TABLE["colours_cleaned"][1]
TABLE["tiled_components"] = TABLE["tiled_components"][0], TABLE["mask_components"][1]

TABLE |= box_queries.TABLE | file_queries.TABLE | stream_queries.table(MANIFEST, EVENTS, RAW)

QUERIES = {name: q for name, (q, _) in TABLE.items()}
ORACLE = {name: sql for name, (_, sql) in TABLE.items() if sql}
