"""The DuckDB SQL of the queries on whole rasters: pictures and masks of 24 x 24 as one row a pixel, digests of their bytes.

Regions and floods are recursive queries, brushes are recursive over the lines of a log."""

from __future__ import annotations

SIDE = 24
GRID = f"(SELECT range AS y FROM range({SIDE})), (SELECT range AS x FROM range({SIDE}))"
DISC = "128 + 10 * ((3 + (vec_id + {s}) % 6) ** 2 - ((x - 6 - (vec_id + {s}) * 7 % 12) ** 2 + (y - 6 - (vec_id + {s}) * 5 % 12) ** 2))"
MASKS = f"masks AS (SELECT vec_id AS image_id, y, x, CAST(greatest(0, least(255, greatest({DISC.format(s=0)}, {DISC.format(s=3)}))) AS BIGINT) AS v FROM embeddings, {GRID})"
PICTURES = MASKS + """, pictures AS (SELECT image_id, y, x, (image_id * 37 + x * 9 + y * 5) % 256 AS r, (image_id * 11 + x * 3 + y * 13) % 256 AS g, (image_id * 5 + x * 17 + y * 2) % 256 AS b, v AS a FROM masks)"""
LOG = """log AS (SELECT event_id // 20 AS image_id, user_id AS stroke_id, event_id AS seq, event_id * 13 % 24 AS x, event_id * 29 % 24 AS y, 1 + event_id % 4 AS radius,
 CASE event_type WHEN 'click' THEN 'restore' WHEN 'view' THEN 'erase' WHEN 'signup' THEN 'erase' WHEN 'purchase' THEN 'undo' WHEN 'error' THEN 'reset' END AS tool,
 row_number() OVER (PARTITION BY event_id // 20 ORDER BY event_id) AS n FROM events)"""
#: Strokes that no undo or reset took: of each log the settled ones and the twelve that an undo can still take.
KEPT = LOG + """, stacks AS (SELECT DISTINCT image_id, 0::BIGINT AS n, []::BIGINT[] AS settled, []::BIGINT[] AS held FROM log UNION ALL
 SELECT s.image_id, l.n, CASE WHEN tool = 'reset' THEN [] WHEN tool = 'undo' OR len(held) < 12 THEN settled ELSE list_append(settled, held[1]) END,
 CASE WHEN tool = 'reset' THEN [] WHEN tool = 'undo' THEN held[1:len(held) - 1] WHEN len(held) < 12 THEN list_append(held, seq) ELSE list_append(held[2:], seq) END
 FROM stacks s JOIN log l ON l.image_id = s.image_id AND l.n = s.n + 1),
 tops AS (SELECT image_id, arg_max(list_concat(settled, held), n) AS seqs FROM stacks GROUP BY image_id),
 kept AS (SELECT log.* FROM (SELECT image_id, unnest(seqs) AS seq FROM tops) JOIN log USING (image_id, seq))"""


def digest(table: str, height: int = SIDE, width: int = SIDE, values: str = "v", size: bool = True) -> str:
    """The last SELECT: digests of the bytes in raster order."""
    hexed = " || ".join(f"printf('%02x', CAST({v} AS BIGINT))" for v in values.split())
    shape = f"{height}::INT AS height, {width}::INT AS width, " if size else ""
    return f" SELECT image_id, {shape}sha256(from_hex(string_agg({hexed}, '' ORDER BY y, x))) AS data_sha256 FROM {table} GROUP BY image_id"


def regions(lit: str, name: str = "") -> str:
    """own and parts, prefixed with name: the 8-connected regions of a query of image_id and p, the pixel's number."""
    return f"""{name}lit AS ({lit}),
 {name}beside AS (SELECT a.image_id, a.p, b.p AS q FROM {name}lit a JOIN (VALUES (-25), (-24), (-23), (-1), (1), (23), (24), (25)) d(d) ON TRUE JOIN {name}lit b ON b.image_id = a.image_id AND b.p = a.p + d AND abs(b.p % {SIDE} - a.p % {SIDE}) <= 1),
 {name}walk AS (SELECT image_id, p AS root, p FROM {name}lit l WHERE NOT EXISTS (SELECT 1 FROM {name}beside e WHERE e.image_id = l.image_id AND e.p = l.p AND e.q < l.p) UNION SELECT w.image_id, w.root, e.q FROM {name}walk w JOIN {name}beside e ON e.image_id = w.image_id AND e.p = w.p),
 {name}own AS (SELECT image_id, p, min(root) AS root FROM {name}walk GROUP BY image_id, p),
 {name}parts AS (SELECT image_id, count(*) AS area, min(p % {SIDE}) AS x0, min(p // {SIDE}) AS y0, max(p % {SIDE}) AS x1, max(p // {SIDE}) AS y1, root AS first_pixel FROM {name}own GROUP BY image_id, root)"""


def above(threshold: int) -> str:
    return f"SELECT image_id, y * {SIDE} + x AS p FROM masks WHERE v >= {threshold}"


EFFECTIVE_EDITS = "WITH RECURSIVE " + KEPT + " SELECT image_id, seq, tool FROM kept"

SUBJECT_RECTS = "WITH RECURSIVE " + MASKS + ", " + regions(above(24)) + """, big AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, first_pixel) AS rank, x0 * 10 AS l, y0 * 10 AS t, (x1 + 1) * 10 AS r, (y1 + 1) * 10 AS b FROM parts WHERE area >= 32),
 padded AS (SELECT *, CAST(floor(0.14::DOUBLE * greatest(r - l, b - t) + 0.5) AS BIGINT) AS pad FROM big WHERE rank <= 4),
 cut AS (SELECT image_id, CAST(rank AS INT) AS rank, greatest(0, l - pad) AS l, greatest(0, t - pad) AS t, least(240, r + pad) AS r, least(240, b + pad) AS b FROM padded)
 SELECT * FROM cut WHERE r - l >= 2 AND b - t >= 2 AND 240 / greatest(r - l, b - t) >= 1.15::DOUBLE"""

DETACHED = "WITH RECURSIVE " + MASKS + ", " + regions(above(128)) + """, main AS (SELECT *, y0 + (y1 - y0 + 1) * 0.48::DOUBLE AS low, greatest(8, floor(area * 0.012::DOUBLE + 0.5)) AS most FROM parts QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY area DESC, first_pixel) = 1),
 gone AS (SELECT p.image_id, greatest(0, p.y0 - 1) AS top, least(23, p.y1 + 1) + 1 AS bottom, greatest(0, p.x0 - 1) AS lft, least(23, p.x1 + 1) + 1 AS rgt FROM parts p JOIN main m USING (image_id)
 WHERE p.first_pixel <> m.first_pixel AND p.y0 >= low AND (p.x1 < m.x0 OR p.x0 > m.x1) AND p.area <= most),
 left_over AS (SELECT image_id, y, x, CASE WHEN EXISTS (SELECT 1 FROM gone g WHERE g.image_id = k.image_id AND y >= top AND y <= bottom AND x >= lft AND x <= rgt) THEN 0 ELSE v END AS v FROM masks k)""" + digest("left_over")

#: Solid pixels that a soft one meets first on each of eight rays decide what its alpha should be.
EDGE_SNAPPED = "WITH " + PICTURES + """, rays(k, dx, dy) AS (VALUES (0, -1, 0), (1, 1, 0), (2, 0, -1), (3, 0, 1), (4, -1, -1), (5, 1, -1), (6, -1, 1), (7, 1, 1)),
 steps AS (SELECT k, dx, dy, step, step * CASE WHEN dx <> 0 AND dy <> 0 THEN sqrt(2) ELSE 1 END AS d FROM rays, (SELECT range AS step FROM range(1, 7))),
 met AS (SELECT s.image_id, s.y, s.x, k, arg_min(q.a, step) AS a, min(d) AS d, arg_min([q.r, q.g, q.b], step) AS c FROM pictures s JOIN steps ON TRUE JOIN pictures q ON q.image_id = s.image_id AND q.y = s.y + dy * step AND q.x = s.x + dx * step
 WHERE s.a > 12 AND s.a < 243 AND NOT (q.a > 12 AND q.a < 243) GROUP BY ALL),
 sides AS (SELECT image_id, y, x, arg_min(c, (d, k)) FILTER (a <= 12) AS back, min(d) FILTER (a <= 12) AS back_d, arg_min(c, (d, k)) FILTER (a >= 243) AS fore, min(d) FILTER (a >= 243) AS fore_d FROM met GROUP BY ALL),
 lines AS (SELECT p.image_id, p.y, p.x, p.a, greatest(back_d, fore_d) AS far, (fore[1] - back[1]) ** 2 + (fore[2] - back[2]) ** 2 + (fore[3] - back[3]) ** 2 AS contrast,
 (p.r - back[1]) * (fore[1] - back[1]) + (p.g - back[2]) * (fore[2] - back[2]) + (p.b - back[3]) * (fore[3] - back[3]) AS dot FROM pictures p JOIN sides USING (image_id, y, x) WHERE back IS NOT NULL AND fore IS NOT NULL),
 moved AS (SELECT *, greatest(0, least(1, dot / contrast)) AS aim, greatest(0, least(0.82::DOUBLE, (sqrt(contrast / 3) - 8) / 48)) * greatest(0.35::DOUBLE, 1 - far / 12) AS sure FROM lines WHERE contrast >= 192),
 snapped AS (SELECT p.* REPLACE (CASE WHEN sure IS NULL THEN p.a ELSE greatest(0, least(255, floor((p.a / 255 * (1 - sure) + aim * sure) * 255 + 0.5))) END AS a) FROM pictures p LEFT JOIN moved m USING (image_id, y, x))""" + digest("snapped", values="r g b a")

HINT_BOXES = "WITH RECURSIVE " + MASKS + ", " + LOG + """, paint AS (SELECT * FROM log WHERE seq % 3 <> 0 AND image_id IN (SELECT vec_id FROM embeddings)),
 hint AS (SELECT image_id, min(x - radius) - greatest(24, 2.5 * max(radius)) AS l, min(y - radius) - greatest(24, 2.5 * max(radius)) AS t, max(x + radius) + greatest(24, 2.5 * max(radius)) AS r, max(y + radius) + greatest(24, 2.5 * max(radius)) AS b FROM paint GROUP BY image_id),
 seed AS (SELECT image_id, y, x, v FROM masks m WHERE EXISTS (SELECT 1 FROM paint p WHERE p.image_id = m.image_id AND ((m.x + 0.5 - p.x::DOUBLE / 240 * 24) / greatest(1, p.radius::DOUBLE / 240 * 24)) ** 2 + ((m.y + 0.5 - p.y::DOUBLE / 240 * 24) / greatest(1, p.radius::DOUBLE / 240 * 24)) ** 2 <= 1)),
 meant AS (SELECT image_id, avg(v) >= 127.5 AS foreground FROM seed GROUP BY image_id),
 side AS (SELECT image_id, y, x FROM masks JOIN meant USING (image_id) WHERE CASE WHEN foreground THEN v ELSE 255 - v END >= 32),
 flood AS (SELECT image_id, y, x FROM seed SEMI JOIN side USING (image_id, y, x) UNION SELECT s.image_id, s.y, s.x FROM flood f JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) d(dy, dx) ON TRUE JOIN side s ON s.image_id = f.image_id AND s.y = f.y + dy AND s.x = f.x + dx),
 box AS (SELECT image_id, floor(min(x) / 24 * 240) AS l, floor(min(y) / 24 * 240) AS t, ceil((max(x) + 1) / 24 * 240) AS r, ceil((max(y) + 1) / 24 * 240) AS b FROM flood GROUP BY image_id),
 wide AS (SELECT *, greatest(4, floor(greatest(r - l, b - t) * 0.1::DOUBLE + 0.5)) AS pad FROM box),
 clipped AS (SELECT image_id, greatest(0, l - pad) AS l, greatest(0, t - pad) AS t, least(240, r + pad) AS r, least(240, b + pad) AS b FROM wide)
 SELECT h.image_id, CASE WHEN c.l IS NOT NULL THEN foreground END AS foreground, CAST(greatest(0, floor(h.l)) AS INT) AS l, CAST(greatest(0, floor(h.t)) AS INT) AS t, CAST(greatest(greatest(0, floor(h.l)) + 1, least(240, ceil(h.r))) AS INT) AS r, CAST(greatest(greatest(0, floor(h.t)) + 1, least(240, ceil(h.b))) AS INT) AS b,
 CAST(c.l AS INT) AS box_l, CAST(c.t AS INT) AS box_t, CAST(greatest(c.l + 1, c.r) AS INT) AS box_r, CAST(greatest(c.t + 1, c.b) AS INT) AS box_b FROM hint h LEFT JOIN meant USING (image_id) LEFT JOIN clipped c USING (image_id)"""


def shrunk(table: str, by: str, at: str, count: int) -> str:
    """A table of pixels reduced to `count` places along one axis by area: differences of running sums at fractional edges."""
    step = f"({SIDE} / {count}::DOUBLE)"
    return f"""sums_{at} AS (SELECT image_id, {by}, {at} + 1 AS j, sum(v::DOUBLE) OVER (PARTITION BY image_id, {by} ORDER BY {at}) AS s FROM {table} UNION ALL SELECT DISTINCT image_id, {by}, 0, 0 FROM {table}),
 edges_{at} AS (SELECT range AS k, CAST(least({SIDE}, floor(range * {step})) AS BIGINT) AS j, range * {step} - least({SIDE}, floor(range * {step})) AS part FROM range({count + 1})),
 cuts_{at} AS (SELECT a.image_id, a.{by}, k, a.s + part * (b.s - a.s) AS s FROM edges_{at} e JOIN sums_{at} a ON a.j = e.j JOIN sums_{at} b ON b.image_id = a.image_id AND b.{by} = a.{by} AND b.j = least({SIDE}, e.j + 1)),
 less_{at} AS (SELECT a.image_id, a.{by}, a.k AS {at}, (b.s - a.s) / {step} AS v FROM cuts_{at} a JOIN cuts_{at} b ON b.image_id = a.image_id AND b.{by} = a.{by} AND b.k = a.k + 1)"""


PLACED = "WITH " + MASKS + ", " + shrunk("masks", "x", "y", 16) + ", " + shrunk("less_y", "y", "x", 14) + """, framed AS (SELECT f.image_id, f.y, f.x, CASE WHEN m.v IS NULL THEN 0 ELSE greatest(0, least(255, round_even(m.v, 0))) END AS v
 FROM (SELECT vec_id AS image_id, y.range AS y, x.range AS x FROM embeddings, range(48) y, range(48) x) f LEFT JOIN less_x m ON m.image_id = f.image_id AND m.y = f.y - f.image_id % 5 AND m.x = f.x - f.image_id % 8)""" + digest("framed", 48, 48)

EDITED = "WITH RECURSIVE " + MASKS + ", " + LOG + """, lines AS (SELECT *, x AS x0, y AS y0, seq * 7 % 24 AS x1, seq * 11 % 24 AS y1, seq % 3 <> 0 AS adds, (seq * 7 % 24 - x) ** 2 + (seq * 11 % 24 - y) ** 2 AS len2 FROM log),
 near AS (SELECT m.image_id, n, m.y, m.x, m.v AS seen, adds, m.x >= least(x0, x1) - radius AND m.x < greatest(x0, x1) + radius AND m.y >= least(y0, y1) - radius AND m.y < greatest(y0, y1) + radius AS boxed, radius, x0, y0, x1 - x0 AS dx, y1 - y0 AS dy,
 CASE WHEN len2 > 0 THEN greatest(0, least(1, ((m.x + 0.5 - x0) * (x1 - x0) + (m.y + 0.5 - y0) * (y1 - y0)) / len2)) ELSE 0 END AS t FROM masks m JOIN lines l ON l.image_id = m.image_id),
 covers AS (SELECT image_id, n, y, x, seen, adds, CASE WHEN boxed THEN greatest(0, least(1, radius + 0.5 - sqrt((x + 0.5 - x0 - t * dx) ** 2 + (y + 0.5 - y0 - t * dy) ** 2))) ELSE 0 END AS cover FROM near),
 drawn AS (SELECT image_id, 0::BIGINT AS n, y, x, v::DOUBLE AS v FROM masks UNION ALL
 SELECT d.image_id, c.n, d.y, d.x, CASE WHEN adds AND seen <= 4 THEN 0 WHEN adds THEN round_even(v + (255 - v) * cover, 0) ELSE round_even(v * (1 - cover), 0) END FROM drawn d JOIN covers c ON c.image_id = d.image_id AND c.n = d.n + 1 AND c.y = d.y AND c.x = d.x),
 last AS (SELECT image_id, y, x, arg_max(v, n) AS v FROM drawn GROUP BY ALL)""" + digest("last")

REPLAYED = "WITH RECURSIVE " + PICTURES + ", " + KEPT + """, before AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM kept WINDOW w AS (PARTITION BY image_id, stroke_id ORDER BY seq)),
 counted AS (SELECT *, CASE WHEN px IS NULL THEN 0 ELSE CAST(greatest(1, ceil(sqrt((x - px) ** 2 + (y - py) ** 2) / greatest(1, 0.42::DOUBLE * radius))) AS BIGINT) END AS steps FROM before),
 spread AS (SELECT *, unnest(range(least(1, steps), steps + 1)) AS step FROM counted),
 dabs AS (SELECT image_id, tool, radius, CASE WHEN steps = 0 THEN x ELSE px + (x - px) * step / steps END AS at_x, CASE WHEN steps = 0 THEN y ELSE py + (y - py) * step / steps END AS at_y, row_number() OVER (PARTITION BY image_id ORDER BY seq, step) AS m FROM spread),
 reach AS (SELECT p.*, m, tool, radius, sqrt((p.x + 0.5 - at_x) ** 2 + (p.y + 0.5 - at_y) ** 2) AS d FROM pictures p JOIN dabs USING (image_id)),
 brushes AS (SELECT *, CASE WHEN d < radius THEN greatest(0, least(1, (1 - (d - 0.42::DOUBLE * radius) / (0.58::DOUBLE * radius)) / 0.45::DOUBLE)) ELSE 0 END AS cover FROM reach),
 painted AS (SELECT image_id, 0::BIGINT AS m, y, x, [r, g, b, a]::DOUBLE[] AS c FROM pictures UNION ALL
 SELECT o.image_id, s.m, o.y, o.x, CASE WHEN cover = 0 THEN c WHEN tool = 'erase' THEN [c[1], c[2], c[3], round_even(c[4] * (1 - cover), 0)]
 WHEN a / 255 * cover + c[4] / 255 * (1 - a / 255 * cover) > 0 THEN list_transform([r, g, b], lambda v, i: round_even((v * (a / 255 * cover) + c[i] * (c[4] / 255 * (1 - a / 255 * cover))) / (a / 255 * cover + c[4] / 255 * (1 - a / 255 * cover)), 0)) || [round_even((a / 255 * cover + c[4] / 255 * (1 - a / 255 * cover)) * 255, 0)]
 ELSE [0, 0, 0, 0] END FROM painted o JOIN brushes s ON s.image_id = o.image_id AND s.m = o.m + 1 AND s.y = o.y AND s.x = o.x),
 last AS (SELECT image_id, y, x, arg_max(c, m) AS c FROM painted GROUP BY ALL)""" + digest("last", values="c[1] c[2] c[3] c[4]", size=False)

#: The frame and two crops with bands: bilinear in the crop, then reshaped by strength, then cleared where both crops vote for background.
FUSED = """WITH grown AS (SELECT vec_id AS image_id, list_transform(embedding, lambda e: CAST(greatest(0, least(255, floor(128 + 400 * e::DOUBLE))) AS BIGINT)) AS d FROM embeddings),
 crops AS (SELECT image_id, k, d[65 - 7 * k:] || d[:64 - 7 * k] AS d, CASE k WHEN 0 THEN 0 WHEN 1 THEN image_id % 8 ELSE (image_id + 4) % 8 END AS l, CASE k WHEN 0 THEN 0 WHEN 1 THEN image_id % 5 ELSE (image_id + 2) % 5 END AS t, CASE k WHEN 0 THEN 24 ELSE 14 END AS w, CASE k WHEN 0 THEN 24 ELSE 16 END AS h FROM grown, (SELECT unnest([0, 1, 2]) AS k)),
 places AS (SELECT n, range AS j, (range + 0.5::DOUBLE) * 8 / n - 0.5 AS spot FROM (SELECT unnest([14, 16, 24]) AS n), range(24) WHERE range < n),
 taps AS (SELECT n, j, CAST(greatest(0, least(7, floor(spot))) AS BIGINT) AS low, CAST(least(7, greatest(0, least(7, floor(spot))) + 1) AS BIGINT) AS up, greatest(0, least(1, spot - greatest(0, least(7, floor(spot))))) AS part FROM places),
 laid AS (SELECT image_id, k, l, h, w, v.j AS jy, u.j AS jx, t + v.j AS y, l + u.j AS x, (d[8 * v.low + u.low + 1] * (1 - u.part::FLOAT::DOUBLE) + d[8 * v.low + u.up + 1] * u.part::FLOAT::DOUBLE) * (1 - v.part) + (d[8 * v.up + u.low + 1] * (1 - u.part::FLOAT::DOUBLE) + d[8 * v.up + u.up + 1] * u.part::FLOAT::DOUBLE) * v.part AS p
 FROM crops JOIN taps v ON v.n = h JOIN taps u ON u.n = w),
 near AS (SELECT *, greatest(0, least(1, least(least(jx - 2, 11 - jx) / 2, least(jy, 15 - jy) / 2))) AS s FROM laid WHERE k > 0 AND jx >= 2 AND jx < 12),
 strong AS (SELECT *, s * s * (3 - 2 * s) AS f FROM near),
 alpha0 AS (SELECT image_id, y, x, greatest(0, least(255, round_even(p, 0))) AS v FROM laid WHERE k = 0),
 alpha1 AS (SELECT o.image_id, o.y, o.x, CASE WHEN p IS NULL THEN v ELSE greatest(0, least(255, floor(v * (1 - f) + (v + (p - v) * (1 - abs(v - 127.5) / 127.5)) * f + 0.5))) END AS v FROM alpha0 o LEFT JOIN strong s ON s.k = 1 AND s.image_id = o.image_id AND s.y = o.y AND s.x = o.x),
 alpha2 AS (SELECT o.image_id, o.y, o.x, CASE WHEN p IS NULL THEN v ELSE greatest(0, least(255, floor(v * (1 - f) + (v + (p - v) * (1 - abs(v - 127.5) / 127.5)) * f + 0.5))) END AS v FROM alpha1 o LEFT JOIN strong s ON s.k = 2 AND s.image_id = o.image_id AND s.y = o.y AND s.x = o.x),
 votes AS (SELECT image_id, y, x, count(*) FILTER (p <= 56) AS n, bool_or(p >= 210) AS veto, min(floor(p + 0.5)) FILTER (p <= 56) AS lowest FROM laid WHERE k > 0 AND jx >= 2 AND jx < 12 AND jy >= 2 AND jy < 14 GROUP BY ALL),
 fused AS (SELECT o.image_id, o.y, o.x, CASE WHEN n >= 2 AND NOT veto THEN least(v, lowest) ELSE v END AS v FROM alpha2 o LEFT JOIN votes USING (image_id, y, x))""" + digest("fused", size=False)

RING = "(VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) ring(dy, dx)"
NUMBERED = f"SELECT image_id, y * {SIDE} + x AS p FROM "


def pinholes(before: str, after: str) -> str:
    return f"""{after} AS (SELECT image_id, y, x FROM {before} UNION SELECT image_id, y, x FROM (SELECT image_id, y + dy AS y, x + dx AS x FROM {before}, {RING}) SEMI JOIN seen USING (image_id, y, x) WHERE y BETWEEN 1 AND 22 AND x BETWEEN 1 AND 22 GROUP BY ALL HAVING count(*) >= 5)"""


def distances(start: str, first: int, name: str) -> str:
    """Steps over visible pixels, as far as the band of the image's radius and one more."""
    return f"""{name}_walk AS (SELECT image_id, y, x, {first} AS step FROM {start} UNION SELECT w.image_id, s.y, s.x, step + 1 FROM {name}_walk w JOIN bands USING (image_id) JOIN {RING} ON TRUE JOIN seen s ON s.image_id = w.image_id AND s.y = w.y + dy AND s.x = w.x + dx WHERE step <= band),
 {name} AS (SELECT image_id, y, x, min(step) AS d FROM {name}_walk GROUP BY ALL)"""


def alike(before: str, after: str) -> str:
    return f"""{after} AS (SELECT image_id, y, x FROM {before} UNION SELECT p.image_id, p.y, p.x FROM lights p JOIN {RING} ON TRUE JOIN {before} n ON n.image_id = p.image_id AND n.y = p.y + dy AND n.x = p.x + dx JOIN lights q ON q.image_id = n.image_id AND q.y = n.y AND q.x = n.x
 WHERE p.a > 4 AND p.y BETWEEN 1 AND 22 AND p.x BETWEEN 1 AND 22 AND (p.r - q.r) ** 2 + (p.g - q.g) ** 2 + (p.b - q.b) ** 2 <= 118 ** 2 AND abs(p.light - q.light) <= 72 AND abs(p.chroma - q.chroma) <= 48)"""


#: Tables hold the selected pixels only: bridged, without pinholes, prompted, filled, with its band, and grown by colour twice.
REFINED = "WITH RECURSIVE " + PICTURES + ", " + LOG + f""", dots AS (SELECT image_id, x, y, radius FROM log WHERE seq % 3 <> 0),
 radii AS (SELECT vec_id AS image_id, greatest(1, coalesce(max(radius), 1)) AS radius FROM embeddings LEFT JOIN dots ON image_id = vec_id GROUP BY vec_id),
 bands AS (SELECT image_id, radius, least(8, greatest(3, floor(0.26::DOUBLE * radius + 0.5))) AS band, least(8, greatest(2, floor(0.72::DOUBLE * radius + 0.5))) AS gap, least(512, greatest(24, floor(0.35::DOUBLE * radius * radius + 0.5))) AS most FROM radii),
 seen AS (SELECT image_id, y, x FROM masks WHERE v > 4), lit0 AS (SELECT image_id, y, x FROM masks WHERE v >= 128),
 paint AS (SELECT image_id, y, x FROM seen s WHERE EXISTS (SELECT 1 FROM dots d WHERE d.image_id = s.image_id AND (s.x + 0.5 - d.x) ** 2 + (s.y + 0.5 - d.y) ** 2 <= greatest(1.5::DOUBLE, 0.32::DOUBLE * radius) ** 2)),
 spans AS (SELECT dy, dx, dy * dy + dx * dx AS d2, CASE WHEN 2 * abs(dy) < abs(dx) THEN CASE WHEN dx > 0 THEN 0 ELSE 4 END WHEN 2 * abs(dx) < abs(dy) THEN CASE WHEN dy > 0 THEN 2 ELSE 6 END WHEN dx > 0 THEN CASE WHEN dy > 0 THEN 1 ELSE 7 END ELSE CASE WHEN dy > 0 THEN 3 ELSE 5 END END AS octant
 FROM (SELECT range AS dy FROM range(-8, 9)), (SELECT range AS dx FROM range(-8, 9)) WHERE dy <> 0 OR dx <> 0),
 around AS (SELECT p.image_id, p.y, p.x, bit_or(1 << octant::INT) AS bits FROM paint p JOIN bands USING (image_id) JOIN spans ON d2 <= gap * gap JOIN lit0 l ON l.image_id = p.image_id AND l.y = p.y + dy AND l.x = p.x + dx GROUP BY ALL),
 lit1 AS (SELECT * FROM lit0 UNION SELECT image_id, y, x FROM around WHERE bits & (bits >> 4) & 15 <> 0), {pinholes("lit1", "lit2")}, {pinholes("lit2", "lit3")},
 {regions(NUMBERED + "lit3", "on_")}, prompted AS (SELECT DISTINCT image_id, root FROM on_own JOIN ({NUMBERED} paint) USING (image_id, p)),
 lit4 AS (SELECT image_id, p // {SIDE} AS y, p % {SIDE} AS x FROM on_own o WHERE EXISTS (SELECT 1 FROM prompted t WHERE t.image_id = o.image_id AND t.root = o.root) OR image_id NOT IN (SELECT image_id FROM prompted)),
 unseen AS (SELECT image_id, y, x FROM masks WHERE v <= 4), rim AS (SELECT image_id, y, x FROM seen WHERE y IN (0, 23) OR x IN (0, 23) UNION SELECT image_id, y + dy, x + dx FROM unseen, {RING}),
 edge AS (SELECT * FROM rim SEMI JOIN seen USING (image_id, y, x)), {regions(NUMBERED + "(SELECT * FROM seen ANTI JOIN lit4 USING (image_id, y, x))", "off_")},
 open_ AS (SELECT DISTINCT image_id, root AS first_pixel FROM off_own JOIN ({NUMBERED} edge) USING (image_id, p)),
 holes AS (SELECT image_id, first_pixel AS root FROM off_parts ANTI JOIN open_ USING (image_id, first_pixel) JOIN bands USING (image_id) WHERE area <= most),
 lit5 AS (SELECT * FROM lit4 UNION SELECT image_id, p // {SIDE}, p % {SIDE} FROM off_own JOIN holes USING (image_id, root)),
 {distances("(SELECT * FROM lit5 SEMI JOIN seen USING (image_id, y, x))", 0, "inner_")}, {distances("edge", 1, "outer_")},
 lit6 AS (SELECT * FROM lit5 UNION SELECT image_id, y, x FROM inner_ i JOIN outer_ o USING (image_id, y, x) JOIN bands USING (image_id) WHERE i.d + o.d <= band + 1),
 lights AS (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS light, greatest(r, g, b) - least(r, g, b) AS chroma FROM pictures), {alike("lit6", "lit7")}, {alike("lit7", "lit8")},
 filled AS (SELECT m.image_id, m.y, m.x, CASE WHEN l.y IS NULL THEN 0 ELSE 255 END AS v FROM masks m LEFT JOIN lit8 l USING (image_id, y, x)), sizes AS (SELECT image_id, count(*) FILTER (v = 255) AS n_selected FROM filled GROUP BY image_id)
 SELECT * FROM sizes JOIN ({digest("filled")}) USING (image_id)"""


def spill(radius: int) -> str:
    """colours: soft pixels un-mixed from the background on their rays and drawn to the most opaque pixel there; one level of a chain is
    one step of the recursion. Sums go in the order of the rays, as single precision where the kernel stores it so."""
    whole = "list_reduce(list_prepend(0::DOUBLE, {}), lambda a, b: a + b)"
    single = "list_reduce(list_prepend(0::DOUBLE, {}), lambda a, b: CAST(CAST(a + b AS FLOAT) AS DOUBLE))"
    mean = ", ".join(f"CAST(CAST({single.format(f'list_transform(alike, lambda m: m.c[{j}] * m.w)')} / greatest(weights, CASE WHEN weights > 0 THEN 0 ELSE 1 END) AS FLOAT) AS DOUBLE)" for j in (1, 2, 3))
    unit = "greatest(0, least(1, {}))"
    each = lambda x: "[" + ", ".join(x.replace("#", f"[{j}]") for j in (1, 2, 3)) + "]"

    def step(source: str) -> str:
        return f"""SELECT image_id, p, {each("CAST(greatest(0, least(255, floor(CASE WHEN near_d IS NULL THEN c# * (1 - pull) + toward# * pull WHEN contrast = 0 THEN c# ELSE c# * (1 - strength) + (CAST(CAST(pure# AS FLOAT) AS DOUBLE) * trust + toward# * (1 - trust)) * strength END + 0.5::DOUBLE))) AS DOUBLE)")} AS rgb
 FROM (SELECT *, {unit.format("(share - 0.08::DOUBLE) / 0.42::DOUBLE")} * {unit.format("1 - (abs(raw[1] - pure[1]) + abs(raw[2] - pure[2]) + abs(raw[3] - pure[3])) / 480")} * close AS trust, least(0.92::DOUBLE, (1 - share) * 1.35::DOUBLE) * contrast * close AS strength
 FROM (SELECT *, {each("greatest(0, least(255, raw#))")} AS pure, {unit.format("(sqrt(((toward[1] - mean[1]) * (toward[1] - mean[1]) + (toward[2] - mean[2]) * (toward[2] - mean[2]) + (toward[3] - mean[3]) * (toward[3] - mean[3])) / 3) - 6) / 42")} AS contrast
 FROM (SELECT *, {each("(c# - (1 - solve) * mean#) / solve")} AS raw FROM ({source}))))"""

    return PICTURES + f""", rays(k, dx, dy) AS (VALUES (0, -1, 0), (1, 1, 0), (2, 0, -1), (3, 0, 1), (4, -1, -1), (5, 1, -1), (6, -1, 1), (7, 1, 1)),
 steps AS (SELECT k, dx, dy, step, step * CASE WHEN dx <> 0 AND dy <> 0 THEN sqrt(2) ELSE 1 END AS d FROM rays, (SELECT range AS step FROM range(1, {radius + 1}))),
 looked AS (SELECT s.image_id, s.y * {SIDE} + s.x AS p, s.a AS own, [s.r, s.g, s.b]::DOUBLE[] AS c, k, step, d, q.y * {SIDE} + q.x AS q, q.a AS qa, [q.r, q.g, q.b]::DOUBLE[] AS qc
 FROM pictures s JOIN steps ON TRUE LEFT JOIN pictures q ON q.image_id = s.image_id AND q.y = s.y + dy * step AND q.x = s.x + dx * step WHERE s.a > 5 AND s.a < 250),
 seen AS (SELECT * FROM looked WHERE q IS NOT NULL QUALIFY count(*) FILTER (q IS NULL OR qa <= 5 OR qa >= 250) OVER (PARTITION BY image_id, p, k ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0),
 pulled AS (SELECT image_id, p, any_value(own) AS own, any_value(c) AS c, first(qa ORDER BY qa DESC, d, k, step) AS best, first(q ORDER BY qa DESC, d, k, step) AS inner_p, first(qc ORDER BY qa DESC, d, k, step) AS inner_c,
 min(d) FILTER (qa <= 5) AS near_d, first(qc ORDER BY d, k) FILTER (qa <= 5) AS nearest, list({{'c': qc, 'd': d}} ORDER BY k) FILTER (qa <= 5) AS backs FROM seen GROUP BY image_id, p HAVING best >= own + 12),
 weighed AS (SELECT *, list_transform(list_filter(coalesce(backs, []), lambda m: (m.c[1] - nearest[1]) * (m.c[1] - nearest[1]) + (m.c[2] - nearest[2]) * (m.c[2] - nearest[2]) + (m.c[3] - nearest[3]) * (m.c[3] - nearest[3]) <= 15552),
 lambda m: {{'c': m.c, 'w': 1 / greatest(1, CAST(CAST(m.d AS FLOAT) AS DOUBLE))}}) AS alike FROM pulled),
 summed AS (SELECT *, {whole.format("list_transform(alike, lambda m: m.w)")} AS weights FROM weighed),
 todo AS (SELECT image_id, p, inner_p, inner_c, c, near_d, [{mean}] AS mean, own / 255::DOUBLE AS share, greatest(0.08::DOUBLE, own / 255::DOUBLE) AS solve,
 least(0.75::DOUBLE, (best - own) / 255::DOUBLE + (1 - own / 255::DOUBLE) * 0.25::DOUBLE) AS pull, greatest(0.25::DOUBLE, 1 - coalesce(near_d, 0) / ({radius} * 1.5::DOUBLE)) AS close,
 inner_p < p AND EXISTS (SELECT 1 FROM summed o WHERE o.image_id = summed.image_id AND o.p = summed.inner_p) AS waits FROM summed),
 cleaned AS ({step("SELECT *, inner_c AS toward FROM todo WHERE NOT waits")}
 UNION ALL {step("SELECT t.*, r.rgb AS toward FROM todo t JOIN cleaned r ON t.image_id = r.image_id AND t.inner_p = r.p WHERE t.waits")}),
 colours AS (SELECT q.image_id, q.y, q.x, coalesce(rgb[1], r) AS r, coalesce(rgb[2], g) AS g, coalesce(rgb[3], b) AS b, a FROM pictures q LEFT JOIN cleaned ON cleaned.image_id = q.image_id AND p = q.y * {SIDE} + q.x)"""


COLOURS_CLEANED = "WITH RECURSIVE " + spill(8) + digest("colours", values="r g b a")


SQL = {
    "colours_cleaned": COLOURS_CLEANED,
    "fused_mattes": FUSED,
    "refined_selections": REFINED,
    "effective_edits": EFFECTIVE_EDITS,
    "subject_rects": SUBJECT_RECTS,
    "detached_removed": DETACHED,
    "edge_snapped": EDGE_SNAPPED,
    "hint_boxes": HINT_BOXES,
    "placed_selections": PLACED,
    "edited_selections": EDITED,
    "replayed_edits": REPLAYED,
}
