"""DuckDB SQL of the queries that SQL can express over whole tables.

Not here: op2 and op3 (64-bit hashes of shingles, merges), op7 (alignment), op8 (trained models), op10 (CRC-32); they are
held against brute force in tests/llm.
"""

from __future__ import annotations

from .line_dedup import WILDCARD
from .quality_rules import BOILERPLATE, MENU, PHRASE_WORDS, SYMBOLS

GAP = r"[\x20\x09-\x0D]+"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{GAP}'), lambda w: w <> '')"
#: How many characters of a set a string has.
among = lambda x, chars: f"(length({x}) - length(translate({x}, '{chars}', '')))"

OP1 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT doc_id, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM g WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
n AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
f AS (SELECT doc_id, line, trim(line, {BLANKS}) AS b FROM l),
v AS (SELECT doc_id, line, b, len(regexp_split_to_array(b, '{GAP}')) AS n, {among("b", "#*$%&<>!")} AS marks, {among("b", "|»•›")} AS bars FROM f WHERE b <> ''),
k AS (SELECT doc_id, line, length(regexp_replace(line, '{GAP}', '', 'g')) AS c, ((bars >= 3 AND bars * 3 >= n - bars) OR regexp_matches(b, '{MENU}')) OR (regexp_matches(b, '{BOILERPLATE}') AND len(regexp_extract_all(b, '{BOILERPLATE}')) * {PHRASE_WORDS} >= n)
 OR (marks >= 3 AND marks >= n) OR (right(b, 1) NOT IN ('.', '!', '?', '…', ':', ';', ',', '"', chr(39), ')', ']', '”', '»', '。') AND n < 4) AS fails FROM v),
s AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (fails) AS n_lines_removed, CAST(sum(c) AS BIGINT) AS n_chars_lines, CAST(coalesce(sum(c) FILTER (NOT fails), 0) AS BIGINT) AS n_chars_kept, count(*) - count(DISTINCT line) AS n_dup_lines FROM k GROUP BY doc_id),
a AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(t, '{GAP}', '', 'g')) AS word_chars, {among("t", SYMBOLS)} AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
 coalesce(n_lines, 0) AS n_lines, coalesce(n_lines_removed, 0) AS n_lines_removed, coalesce(n_chars_lines, 0) AS n_chars_lines, coalesce(n_chars_kept, 0) AS n_chars_kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)),
z AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND 100 * n_chars_kept >= 50 * n_chars_lines AS kept FROM z
"""

OP4 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER o AS keep_id, count(*) OVER o AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM d WINDOW o AS (PARTITION BY t)
"""

OP5 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages), f AS (SELECT *, strlen(h) AS n, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, url, n AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""

OP6 = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
m AS (SELECT *, string_split(regexp_replace(regexp_replace(trim(line, {BLANKS}), '{GAP}', ' ', 'g'), '[^ ]*[0-9][^ ]*', '{WILDCARD}', 'g'), ' ') AS masked FROM l),
d AS (SELECT masked, len(masked) AS n, masked[1:2] AS lead, count(DISTINCT doc_id) AS docs FROM m WHERE len(masked) >= 3 GROUP BY masked),
f AS (SELECT n, lead, sum(docs) AS full FROM d GROUP BY n, lead HAVING sum(docs) >= 5),
t AS (SELECT masked, n, lead, docs, unnest(masked) AS token, generate_subscripts(masked, 1) AS pos FROM d SEMI JOIN f USING (n, lead)),
k AS (SELECT *, token <> '{WILDCARD}' AND sum(docs) OVER (PARTITION BY n, lead, pos, token) >= 5 AS stays FROM t),
g AS (SELECT masked, n, lead, list(CASE WHEN stays THEN token ELSE '{WILDCARD}' END ORDER BY pos) AS template FROM k GROUP BY masked, n, lead HAVING 2 * count(*) FILTER (stays) >= n),
c AS (SELECT lead, template, min(doc_id) AS first FROM m JOIN g USING (masked) GROUP BY lead, template HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT m.*, coalesce(doc_id <> first, FALSE) AS gone FROM m LEFT JOIN (SELECT masked, first FROM g JOIN c USING (lead, template)) USING (masked))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_lines_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS clean_sha256 FROM j GROUP BY doc_id
"""

OP9 = f"""
WITH b AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS pos, coalesce('s' || source, 'n') AS name FROM documents),
s AS (SELECT source, name, CAST(sum(size) AS BIGINT) AS source_size, CAST(ceil(count(*) / 2000) AS BIGINT) AS n_shards FROM b GROUP BY source, name),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight, source_size * 2 AS most FROM s),
l AS (SELECT *, coalesce(sum(weight) OVER o, 0) AS fw, (sum(source_size) OVER () * 150 / 100 - coalesce(sum(most) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
 FROM w WINDOW o AS (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT min(fw) AS open_fw, arg_min(level, fw) AS open_level FROM l WHERE most > level * weight),
t AS (SELECT source, name, source_size, n_shards, CASE WHEN open_fw IS NULL OR fw < open_fw THEN CAST(most AS DOUBLE) ELSE open_level * weight END AS target FROM l, o),
u AS (SELECT *, CAST(floor(sum(target) OVER () / 8 + 0.5) AS BIGINT) AS seats, sum(target) OVER () AS votes, count(*) OVER () AS n FROM t),
c AS (SELECT name, target, seats, unnest(range(CAST(ceil(CASE WHEN votes > 0 THEN target * seats / votes ELSE 0 END) AS BIGINT) + n + 2)) AS k FROM u WHERE target > 0),
q AS (SELECT name, count(*) AS source_quota FROM (SELECT name FROM c QUALIFY row_number() OVER (ORDER BY target / (2 * k + 1) DESC, name) <= seats) GROUP BY name),
r AS (SELECT b.*, source_size, target, coalesce(source_quota, 0) AS source_quota, CAST('0x' || substr(pos, 1, 8) AS BIGINT) % n_shards AS shard FROM b JOIN t USING (name) LEFT JOIN q USING (name)),
h AS (SELECT name, shard, CAST(sum(size) AS BIGINT) AS shard_size, any_value(source_quota) AS seats FROM r GROUP BY name, shard),
i AS (SELECT *, sum(shard_size) OVER (PARTITION BY name) AS votes, count(*) OVER (PARTITION BY name) AS n FROM h),
e AS (SELECT name, shard, shard_size, seats, unnest(range(CAST(ceil(CASE WHEN votes > 0 THEN shard_size * seats / votes ELSE 0 END) AS BIGINT) + n + 2)) AS k FROM i WHERE shard_size > 0),
f AS (SELECT name, shard, count(*) AS quota FROM (SELECT name, shard FROM e QUALIFY row_number() OVER (PARTITION BY name ORDER BY shard_size / (2 * k + 1) DESC, shard) <= seats) GROUP BY name, shard),
g AS (SELECT r.*, shard_size, least(coalesce(quota, 0) * 8, 2 * shard_size) AS words, CAST(sum(size) OVER (PARTITION BY name, shard ORDER BY pos, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM r JOIN h USING (name, shard) LEFT JOIN f USING (name, shard)),
z AS (SELECT *, CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END AS turns FROM g)
SELECT doc_id, source, size, source_size, target, CAST(turns * size + greatest(0, least(size, words - turns * shard_size - (upto - size))) AS BIGINT) AS taken FROM z
"""

ORACLE: dict[str, str] = {"op1_quality_rules": OP1, "op4_exact_dedup": OP4, "op5_warc_revisits": OP5, "op6_line_dedup": OP6, "op9_source_mix": OP9}
