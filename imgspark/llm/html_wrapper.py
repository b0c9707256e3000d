"""Main text of web pages by wrappers: union-free regular expressions inferred from pages of one host.

A page is a stream of tags and text slots. A wrapper is such a stream in which parts may be optional or repeated. It is
inferred by aligning one page after the other with it by tags alone: equal parts stay, a run of equal neighbours becomes one
repeated part, what only one side has becomes optional. There are no alternatives (unions). Each text slot of a wrapper counts
the texts that met in it and how many of them stand in an article by the markup of their own page (the article or main element,
fixed lists of tags and names); most of them decide for the slot, and so for every page of the host: a page whose own markup is
broken or odd gets its text from what its neighbours have at that place. A page that the wrapper doesn't match as a pattern is
aligned with it, and only slots without a counterpart go by their own page.

Texts are compared between the pages of a host where no article or main element tells what the article is. A block is the
text between two tags that are not inside of a line; its place is the chain of open elements. A block that stands at the same
place with the same text on more than half of the host's different pages, and on three at least, is template and left out;
blocks that vary are content. All pages count, each set of blocks once, in partial counts; so at most twice as many blocks of
a host are template as a page has on average. A page of nothing but template keeps its text.

A wrapper is fitted on all pages of its host; copies of one page count once. Pages of one stream of tags are counted and
aligned once; what is different is aligned in groups of fan_in by a hash of the stream, then the wrappers of these groups in
turn, so no task holds a whole host but in its last few wrappers. In a group the wrapper of most pages comes first. A wrapper
grows with the variety of its host's pages alone. Alignment is exact and needs about the square root of one side's parts times
the other's in bits. Wrappers go to the tasks by broadcast while their size, which is checked, is below broadcast_bytes, else
by a join on the host.

Defined cases: a null page counts as empty and gives an empty text; a null or odd URL gives the host ''; repeated rows are
extracted each for itself; a page without article or main element counts as article as a whole, less what is left out
anywhere; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join, whole

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|template|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|[^<]+|<", re.S | re.I)
ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements that hold no article text, and elements inside of a line.
LEFT_OUT = frozenset("nav header footer aside form button select dialog menu".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Words in class, id and role that name such elements.
NAMED = re.compile(r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|notice|gdpr|comments?|disqus|replies|respond|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|related|share|sharing|social|newsletter|subscribe|signup|popup|modal|widget|toolbar)(?:$|[\s_-])")
SLOT = "\x00"
#: Elements that end where the next of their kind begins.
UNCLOSED = frozenset("p li dt dd tr td th option".split())


def tokens(page: str) -> Iterator[tuple[str, str, bool]]:
    """(kind, value, named): kind is text, open or close; named tells that class, id or role name what is left out."""
    for m in TOKEN.finditer(page):
        x = m.group()
        if m[3]:
            name = m[3].lower()
            if m[2]:
                yield "close", name, False
            else:
                yield "open", name, any(NAMED.search("".join(a)) for a in ATTR.findall(m[4]))
        elif x[0] != "<" or x == "<":
            yield "text", x, False


def stream(page: str) -> tuple[list[str], list[str], list[bool]]:
    """The page's parts: shapes (tags, SLOT for a text), their texts ('' for tags) and whether they are article text."""
    found = list(tokens(page))
    inner = next((t for t in ("article", "main") if any(k == "open" and v == t and not n for k, v, n in found)), None)
    shapes, texts, labels = [], [], []
    depth = resume = 0  # of the article; where an element that is left out ends
    for i, (kind, value, named) in enumerate(found):
        if kind == "text":
            shapes.append(SLOT)
            texts.append(value)
            labels.append(i >= resume and (inner is None or depth > 0))
            continue
        if value not in VOID and i >= resume:
            if kind == "open" and (named or value in LEFT_OUT and not (value == "header" and depth)):
                resume = end_of(found, i)
            elif value == inner:
                depth = max(0, depth + (1 if kind == "open" else -1))
        shapes.append(f"{'/' * (kind == 'close')}{value}{'!' * named}")
        texts.append("")
        labels.append(False)
    return shapes, texts, labels


def end_of(found: list[tuple[str, str, bool]], start: int) -> int:
    """Where the element that opens at start ends; one that is never closed ends at the next article or main."""
    name, level = found[start][1], 0
    for i in range(start, len(found)):
        kind, value, _ = found[i]
        if value == name and kind != "text":
            level += 1 if kind == "open" else -1
            if level == 0:
                return i
    return next((i for i in range(start + 1, len(found)) if found[i][0] == "open" and found[i][1] in ("article", "main")), len(found))


# A wrapper is a list of parts: [tag, 0], [SLOT, [texts, article texts, places]] or [[part, ...], mark] with mark "?"
# (optional), "+" (repeated) or "*" (both). places: the slots of the page, for the parts of a page at hand.


def is_group(part: list) -> bool:
    return not isinstance(part[0], str)


def key_of(part: list) -> str:
    """What alignment compares: the tags alone. One optional part counts as that part."""
    inside = lambda x: [inside(y) for y in x[0]] if is_group(x) else x[0]
    one = bare(part)[0]
    return json.dumps(inside(one)) if is_group(one) else one[0]


def bare(part: list) -> tuple[list, bool]:
    """The part of an optional group of one, and whether it was optional."""
    return (part[0][0], True) if is_group(part) and part[1] == "?" and len(part[0]) == 1 else (part, False)


def merged(a: list, b: list) -> list:
    """Two parts of one key as one; the texts of their slots are counted together."""
    (a, may_a), (b, may_b) = bare(a), bare(b)
    if is_group(a):
        out = [[merged(x, y) for x, y in zip(a[0], b[0], strict=True)], a[1] if a[1] == b[1] else "*"]
    else:
        out = [SLOT, [x + y for x, y in zip(a[1], b[1], strict=True)]] if a[0] == SLOT else a
    return [[out], "?"] if may_a or may_b else out


def fold(parts: list, longest: int = 12) -> list:
    """Runs of equal neighbours become repeated groups, the short ones first."""
    keys = [key_of(p) for p in parts]
    for n in range(1, longest + 1):
        out, i = [], 0
        while i < len(parts):
            j, block = i + n, parts[i : i + n]
            while j < len(parts) and keys[j] == keys[i] and keys[j : j + n] == keys[i : i + n]:
                block = [merged(x, y) for x, y in zip(block, parts[j : j + n], strict=True)]
                j += n
            if j > i + n:
                out.append(block[0] if n == 1 and is_group(block[0]) and block[0][1] in "+*" else [block, "+"])
                i = j
            else:
                out.append(parts[i])
                i += 1
        if len(out) < len(parts):
            parts, keys = out, [key_of(p) for p in out]
    return parts


def grouped(parts: list, other: list) -> list:
    """parts with each run that is a repeated group of other as such a group, repeated once."""
    return regrouped(parts, repeated_blocks(other))


def repeated_blocks(parts: list) -> set[tuple[str, ...]]:
    return {tuple(map(key_of, p[0])) for p in parts if is_group(p) and p[1] in "+*"}


def regrouped(parts: list, blocks: set[tuple[str, ...]]) -> list:
    if not blocks:
        return parts
    keys, lengths, out, i = [key_of(p) for p in parts], sorted({len(b) for b in blocks}, reverse=True), [], 0
    while i < len(parts):
        n = next((n for n in lengths if tuple(keys[i : i + n]) in blocks), 0)
        out.append([parts[i : i + n], "+"] if n else parts[i])
        i += n or 1
    return out


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of places.

    A row of the table of lengths is one integer, its bit j clear where b's j-th part makes the row longer. Rows are kept in
    steps and worked out again on the way back, so memory is about the square root of len(a) rows of len(b) bits."""
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1

    def following(row: int, x: str) -> int:
        up = row & where.get(x, 0)
        return ((row + up) | (row - up)) & full

    step, kept, row = max(1, int(len(a) ** 0.5)), [full], full
    for i, x in enumerate(a, 1):
        row = following(row, x)
        if i % step == 0:
            kept.append(row)
    pairs, i, j, rows, start = [], len(a), len(b), [], len(a) + 1
    while i and j:
        if i < start:
            start = (i - 1) // step * step + 1
            rows = [kept[start // step]]
            for x in a[start - 1 : min(len(a), start - 1 + step)]:
                rows.append(following(rows[-1], x))
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif rows[i - start + 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    return pairs[::-1]


def align(a: list, b: list) -> list:
    """The wrapper of both: what one side lacks becomes optional, a group against its single block a repeated group."""
    a, b = grouped(a, b), grouped(b, a)
    out, i, j = [], 0, 0
    optional = lambda parts: [x if is_group(x) and x[1] in "?*" else [x[0], "*"] if is_group(x) else [[x], "?"] for x in parts]
    for x, y in [*common([key_of(p) for p in a], [key_of(p) for p in b]), (len(a), len(b))]:
        out += optional(a[i:x]) + optional(b[j:y])
        out += [merged(a[x], b[y])] if x < len(a) else []
        i, j = x + 1, y + 1
    return fold(out)


def page_parts(shapes: list[str], labels: list[bool], places: bool = False, pages: int = 1) -> list:
    return fold([[s, [pages, pages * x, [i] if places else []]] if s == SLOT else [s, 0] for i, (s, x) in enumerate(zip(shapes, labels, strict=True))])


def page_wrapper(page: str) -> list:
    shapes, _, labels = stream(page)
    return page_parts(shapes, labels)


def is_article(slot: list) -> bool:
    """A slot holds article text if it does so in most of the texts that it was made of."""
    return 2 * slot[1][1] > slot[1][0]


def alphabet(wrapper: list, letters: dict[str, str]) -> dict[str, str]:
    for part in wrapper:
        if is_group(part):
            alphabet(part[0], letters)
        else:
            letters.setdefault(part[0], chr(0xE000 + len(letters)))
    return letters


class Wrapper:
    """The wrapper as a pattern over one letter for each tag; article slots are captured as x. Groups don't give back."""

    def __init__(self, parts: list):
        self.parts, self.letters = parts, alphabet(parts, {SLOT: "\ue000"})

        def write(parts: list) -> str:
            one = lambda p: f"(?P<x>{self.letters[SLOT]})" if p[0] == SLOT and is_article(p) else self.letters[p[0]]
            return "".join(f"(?:{write(p[0])}){p[1]}+" if is_group(p) else one(p) for p in parts)

        self.pattern = regex.compile(write(parts))
        self.keys, self.blocks = [key_of(p) for p in parts], repeated_blocks(parts)

    def labels(self, shapes: list[str], own: list[bool]) -> list[bool]:
        """Which slots of a page are article text. A page that the pattern doesn't match is aligned with the wrapper; slots
        that have no counterpart there keep their own labels."""
        if found := self.pattern.fullmatch("".join(self.letters.get(s, "\uf8ff") for s in shapes)):
            chosen = {a for a, _ in found.spans("x")} if "x" in self.pattern.groupindex else set()
            return [i in chosen for i in range(len(shapes))]
        out = list(own)

        def give(part: list, slot: list) -> None:
            (part, _), (slot, _) = bare(part), bare(slot)
            if is_group(part):
                for x, y in zip(part[0], slot[0], strict=True):
                    give(x, y)
            elif part[0] == SLOT:
                for i in part[1][2]:
                    out[i] = is_article(slot)

        page = regrouped(page_parts(shapes, own, places=True), self.blocks)
        for x, y in common([key_of(p) for p in page], self.keys):
            give(page[x], self.parts[y])
        return out


def extract(page: str, wrapper: Wrapper | None = None, template: frozenset[int] = frozenset()) -> str:
    """The article's text; blocks are joined by one space. template: keys of blocks to leave out where no element is the article."""
    shapes, texts, labels = stream(page)
    if wrapper is not None:
        labels = wrapper.labels(shapes, labels)
    found = list(blocks(shapes, texts, labels)) if template and "article" not in shapes and "main" not in shapes else []
    repeated = {i for key, slots in found if key in template for i in slots} if any(key not in template for key, _ in found) else set()
    out = []
    for i, (shape, text, label) in enumerate(zip(shapes, texts, labels, strict=True)):
        if label and i not in repeated:
            out.append(entities.unescape(text))
        elif shape != SLOT and shape.strip("/!") not in INLINE:
            out.append(" ")
    return " ".join("".join(out).split())


def has_article(page: str) -> bool:
    return any(k == "open" and v in ("article", "main") and not n for k, v, n in tokens(page))


def blocks(shapes: list[str], texts: list[str], labels: list[bool]) -> Iterator[tuple[int, list[int]]]:
    """Key of place and text, and the slots, of each block of article text."""
    chain, slots = [], []

    def made() -> Iterator[tuple[int, list[int]]]:
        if text := " ".join(entities.unescape("".join(texts[i] for i in slots)).split()):
            yield xxhash.xxh64_intdigest("\x00".join([*chain, text]).encode("utf-8", "replace")) - (1 << 63), slots

    for i, shape in enumerate(shapes):
        if shape == SLOT:
            if labels[i]:
                slots.append(i)
            continue
        name = shape.strip("/!")
        if name in INLINE:
            continue
        yield from made()
        slots = []
        if shape[0] == "/":
            if name in chain:
                del chain[len(chain) - 1 - chain[::-1].index(name) :]
        elif name not in VOID:
            if name in UNCLOSED and chain and chain[-1] == name:
                chain.pop()
            chain.append(name)
    yield from made()


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def infer_wrappers(pages: DataFrame, url: str = "url", html: str = "html", fan_in: int = 32) -> DataFrame:
    """host, wrapper (JSON) and rows, the count of its rows, of every host. Every page counts."""

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for page in b.column("html"):
                shapes, _, labels = stream(page.as_py())
                parts.append(" ".join(f"{s}{'1' * x}" for s, x in zip(shapes, labels, strict=True)))
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("page"), pa.array(parts, pa.string())], ["host", "page", "stream"])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for parts, n in zip(b.column("stream").to_pylist(), b.column("pages").to_pylist(), strict=True):
                parts = parts.split(" ") if parts else []
                made.append(json.dumps(page_parts([SLOT if x[0] == SLOT else x for x in parts], [x == f"{SLOT}1" for x in parts], pages=n)))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("host", "at", "pages", "rows")), pa.array(made, pa.string())], ["host", "at", "pages", "rows", "wrapper"])

    def aligned(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (-r["pages"], r["at"], r["wrapper"]))
        alike: dict[tuple[str, ...], list] = {}
        for row in rows:
            parts = json.loads(row["wrapper"])
            k = tuple(map(key_of, parts))
            alike[k] = [merged(x, y) for x, y in zip(alike[k], parts, strict=True)] if k in alike else parts
        whole_one = None
        for parts in alike.values():
            whole_one = parts if whole_one is None else align(whole_one, parts)
        return pa.table({"host": [key[0].as_py()], "at": [key[1].as_py()], "pages": [sum(r["pages"] for r in rows)], "rows": [sum(r["rows"] for r in rows)], "wrapper": [json.dumps(whole_one)]})

    kind = "host string, at long, pages long, rows long, wrapper string"
    text = whole(F.col(html).cast("string"))
    seen = pages.select(host_of(F.col(url)).alias("host"), F.xxhash64(text).alias("page"), text.alias("html")).mapInArrow(streams, "host string, page long, stream string")
    counted = seen.groupBy("host", "page", "stream").agg(F.count(F.lit(1)).alias("rows")).groupBy("host", "stream").agg(F.count(F.lit(1)).alias("pages"), F.sum("rows").alias("rows"))
    made = cut(counted.withColumn("at", F.xxhash64("stream")).mapInArrow(folded, kind))
    most = made.groupBy("host").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    while most > 1:
        most = -(-most // fan_in)
        made = cut(made.withColumn("at", F.pmod("at", F.lit(most))).groupBy("host", "at").applyInArrow(aligned, kind))
    return made.select("host", "wrapper", "rows")


def infer_templates(pages: DataFrame, url: str = "url", html: str = "html", least_pages: int = 3, least_share: float = 0.5) -> DataFrame:
    """host and template, the keys of blocks that its pages without article or main element repeat. Every page counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, ids, keys = [], [], []
            for host, page in zip(*b.columns, strict=True):
                page = page.as_py()
                if not has_article(page) and (found := sorted({key for key, _ in blocks(*stream(page))})):
                    hosts.append(host.as_py())
                    ids.append(xxhash.xxh64_intdigest(repr(found)) - (1 << 63))
                    keys.append([None, *found])  # null counts the pages
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(ids, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["host", "page", "keys"])

    seen = pages.select(host_of(F.col(url)).alias("host"), whole(F.col(html).cast("string"))).mapInArrow(run, "host string, page long, keys array<long>")
    counts = cut(seen.select("host", "page", F.explode("keys").alias("key")).distinct().groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_pages))
    totals = counts.filter("key is null").select("host", F.col("n").alias("pages"))
    constant = counts.filter("key is not null").join(totals, "host").filter(F.col("n") > least_share * F.col("pages"))
    return constant.groupBy("host").agg(F.collect_list("key").alias("template"))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", broadcast_bytes: int = 64 << 20, **fit: int) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    wrappers = cut(infer_wrappers(pages, url, html, **fit).join(infer_templates(pages, url, html), "host", "left"))
    size = wrappers.agg(F.sum(F.length("wrapper") + F.length("host") + 100 + 40 * F.coalesce(F.size("template"), F.lit(0)))).first()[0] or 0
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), whole(F.col(html).cast("string")).alias("html"))
    known = None
    if size <= broadcast_bytes:
        known = pages.sparkSession.sparkContext.broadcast({r.host: (r.wrapper, r.template) for r in wrappers.toLocalIterator()})
        rows = rows.withColumns({"wrapper": F.lit(None).cast("string"), "template": F.lit(None).cast("array<long>")})
    else:
        rows = hot_join(rows, wrappers, "host", "rows", F.col("html")).select("page_id", "url", "host", "html", "wrapper", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, tuple] = {}
        for b in batches:
            texts = []
            for host, page, own, repeated in zip(*(b.column(n) for n in ("host", "html", "wrapper", "template")), strict=True):
                h = host.as_py()
                if h not in made:
                    if len(made) > 2000:
                        made.clear()
                    spec, template = known.value.get(h, (None, None)) if known is not None else (own.as_py(), repeated.as_py())
                    made[h] = (Wrapper(json.loads(spec)) if spec else None, frozenset(template or ()))
                texts.append(extract(page.as_py(), *made[h]))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
