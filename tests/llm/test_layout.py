"""WARC, HTML, mixing and sharding."""

import hashlib
import json
import random
import re
import zlib
from collections import defaultdict
from html.parser import HTMLParser
from itertools import pairwise

import pytest

from imgspark.llm import html_wrapper as H
from imgspark.llm import shard_sort as O
from imgspark.llm import source_mix as M
from imgspark.llm import warc as W

LONG = "<p>" + "é" * 60 + "</p>\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, file int")


def test_warc_revisits(spark, sf_dir):
    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    edge = [(4, "http://a/\r\nX: y", LONG), (2, None, LONG), (3, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (9, "u", LONG), (9, "u", LONG)]
    for rows in (table, edge, []):
        got = W.warc_revisits(pages(spark, rows)).collect()
        first = {}
        for i, _, h in sorted(rows, key=lambda r: r[0]):
            first.setdefault(h or "", i)
        assert sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == sorted((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in rows)
        by = {i: h or "" for i, _, h in rows}
        for r in got:
            again = r.payload_bytes >= 100 and first[by[r.page_id]] != r.page_id
            assert (r.record_type, r.refers_to) == (("revisit", first[by[r.page_id]]) if again else ("response", None))
    twice = W.warc_revisits(pages(spark, [(9, "u", LONG), (9, "u", LONG)])).collect()
    assert sorted((r.record_type, r.refers_to) for r in twice) == [("response", None), ("revisit", 9)]


def test_warc_payloads_survive(spark, tmp_path):
    W.page_archives(pages(spark, [(1, "u", LONG), (2, "v", LONG), (3, "w", "ü")]), str(tmp_path / "a"))
    W.deduplicate_archives(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    got = {r.page_id: (r.record_type, r.payload) for r in W.read_archives(spark, str(tmp_path / "b")).collect()}
    assert got == {1: ("response", LONG), 2: ("revisit", ""), 3: ("response", "ü")}


def test_warc_record_ids_and_odd_payloads(spark, tmp_path):
    odd = ["\r\n" * 60 + "x", "y" + "\r\n" * 60, "\r\n\r\n" * 40, "\r\n\r" * 50, "WARC/1.1\r\n" * 20, "z" * 5_000_000]
    rows = [(i, "u", p) for i, p in enumerate(odd)] + [(9, "u", LONG), (9, "u", LONG), (None, None, "q" * 200), (None, None, "q" * 200)]
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    W.page_archives(pages(spark, rows), a)
    W.deduplicate_archives(spark, a, b)
    before, after = (W.read_archives(spark, x).collect() for x in (a, b))
    assert sorted((str(r.page_id), r.payload) for r in before) == sorted((str(i), p) for i, _, p in rows)
    ids = [r.record_id for r in before + after]
    assert len(set(ids)) == len(ids) == 20 and all(len(x) == 36 for x in ids)
    kept = {r.record_id: r.payload_digest for r in after if r.record_type == "response"}
    text = "".join(r[0] for r in spark.read.text(b, wholetext=True).collect())
    refers = {m[1]: m[2] for m in re.finditer(r"WARC-Record-ID: <urn:uuid:([^>]*)>(?:(?!WARC/1)[\s\S])*?WARC-Refers-To: <urn:uuid:([^>]*)>", text)}
    again = [r for r in after if r.record_type == "revisit"]
    assert len(again) == len(refers) == 2 and all(kept[refers[r.record_id]] == r.payload_digest for r in again)


def test_warc_parses_pieces_and_refuses_what_is_no_record():
    record = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for n in (1, 2, 7, 1000):
        assert list(W.parse((2 * record)[i : i + n] for i in range(0, 2 * len(record), n))) == [(0, {"content-length": "3"}, b"abc"), (len(record), {"content-length": "3"}, b"abc")]
    for bad in (b"x" + record, record[:-5]):
        with pytest.raises(ValueError, match="record"):
            list(W.parse(iter([bad])))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>x</style></head><body><header><h1>Site</h1></header><nav><ul><li><a>m</a></li>{li}</ul></nav>
<div class="cookie-notice">we use</div><article><h1>Head&amp;line</h1><p>One  <b>bo</b>ld &lt;p&gt;<br>two{more}</p><div class="ad">buy</div><form><p>f</p></form><section class="comments"><article><p>c</p></article></section>{tail}</article>
<aside>side</aside><script>var t="</p>";</script><footer>&copy; f</footer></body></html>"""


def test_main_text(spark):
    texts = [PAGE.format(li="<li><a>x</a></li>" * i, more=f" w{i}", tail="<p>tail</p>" * (i % 3)) for i in range(9)]
    rows = [(i, f"https://Host.example/{i}", t) for i, t in enumerate(texts)] + [(20, None, None), (21, "odd", "no <b>mark</b> up &am"), (22, "http://h.example/x", ""), (3, "https://Host.example/3", texts[3])]
    want = {i: " ".join(["Head&line One bold <p> two", f"w{i}", *["tail"] * (i % 3)]) for i in range(9)} | {20: "", 21: "no mark up &am", 22: ""}
    for size in (64 << 20, 0):
        got = H.main_text(pages(spark, rows), broadcast_bytes=size).collect()
        assert len(got) == len(rows)
        assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    assert H.main_text(pages(spark, [])).count() == 0


def test_texts_that_the_pages_of_a_host_repeat_are_template(spark):
    make = lambda i: f"""<html><body><div class=a1><div class=b7>Home<div>All <i>news</i></div></div><div class=c3><p>Story {i} is <b>told</b> here<p>Again {i}</div>
<div class=b9>Buy now{' and then' * (i % 2)}</div><div class=b7>&copy; the owners</div></div></body></html>"""  # noqa: E731
    rows = [(i, "http://h.example/x", make(i)) for i in range(9)] + [(i, "http://h.example/y", make(0)) for i in range(20, 40)]
    rows += [(i, "http://two.example/", make(i)) for i in range(50, 52)] + [(i, "http://same.example/", make(7)) for i in range(60, 65)]
    story = lambda i: f"Story {i} is told here Again {i}"
    full = lambda i: f"Home All news {story(i)} Buy now{' and then' * (i % 2)} © the owners"
    # of nine different pages five say Buy now; copies count once; two pages and copies of one page tell nothing
    want = {i: story(i) + " Buy now and then" * (i % 2) for i in range(9)} | {i: story(0) for i in range(20, 40)} | {i: full(i) for i in (50, 51)} | {i: full(7) for i in range(60, 65)}
    for size in (64 << 20, 0):
        assert {r.page_id: r.text for r in H.main_text(pages(spark, rows).repartition(5), broadcast_bytes=size).collect()} == want


def test_wrapper_has_optional_and_repeated_groups_and_matches_unseen_pages():
    make = lambda i, j: PAGE.format(li="<li><a>x</a></li>" * i, more="", tail="<p>tail</p>" * j)
    w = H.Wrapper(H.align(H.page_wrapper(make(2, 0)), H.page_wrapper(make(5, 2))))
    shapes, _, labels = H.stream(make(11, 7))
    assert w.pattern.fullmatch("".join(w.letters[s] for s in shapes)) and w.labels(shapes, [not x for x in labels]) == labels
    assert "+" in str(w.parts) and "?" in str(w.parts) and "|" not in w.pattern.pattern
    one, none = H.page_wrapper("<div><p>a</p></div>"), H.page_wrapper("<div></div>")
    for x in (H.align(one, none), H.align(H.align(none, one), one)):
        pattern, letters = H.Wrapper(x).pattern, H.Wrapper(x).letters
        assert all(pattern.fullmatch("".join(letters[s] for s in H.stream(p)[0])) for p in ("<div><p>a</p></div>", "<div></div>"))


def test_alignment_is_a_longest_common_subsequence():
    def longest(a, b):
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        return rows[-1][-1]

    rng = random.Random(6)
    for _ in range(300):
        a, b = (rng.choices("abcde", k=rng.randint(0, 40)) for _ in range(2))
        pairs = H.common(a, b)
        assert len(pairs) == longest(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in pairwise(pairs))


def test_a_page_gets_its_text_through_the_wrapper_of_its_host(spark):
    """Odd pages whose own markup hides or adds text; their neighbours tell what the places are."""
    body = lambda i: f"<h2>Title {i}</h2><p>Story {i} is told here</p><p>And more of {i}</p>"
    page = lambda i, menu, box="<div>", tail="<div class=comments><p>reader {i}</p></div>": f"<html><body>{menu}{box}{body(i)}</div>{tail.format(i=i)}<footer>foot {i}</footer></body></html>"
    menu = lambda i: f"<nav><ul><li><a>Home</a></li><li><a>Item {i}</a></li></ul></nav>"
    rows = [(i, "http://h.example/", page(i, menu(i))) for i in range(20)]
    rows.append((30, "http://h.example/", page(30, menu(30).replace("</nav>", ""))))  # a menu that is never closed
    rows.append((31, "http://h.example/", page(31, menu(31), box="<div class=ad>")))  # a name that hides the story
    rows.append((32, "http://h.example/", page(32, menu(32), tail="<div class=voices><p>reader {i}</p></div>")))  # comments by another name
    story = lambda i: f"Title {i} Story {i} is told here And more of {i}"
    got = {r.page_id: r.text for r in H.main_text(pages(spark, rows).repartition(4)).collect()}
    assert {i: got[i] for i in range(20)} == {i: story(i) for i in range(20)}
    alone = {i: H.extract(h) for i, _, h in rows}
    assert alone[30] == alone[31].replace("reader 31", "").strip() == "" and got[30] == story(30) and got[31] == story(31)
    assert all(alone[i] == got[i] for i in range(20))
    again = {r.page_id: r.text for r in H.main_text(pages(spark, rows[::-1]).repartition(1), broadcast_bytes=0).collect()}
    assert again == got


@pytest.mark.parametrize("fan_in", [2, 32])
def test_every_page_of_a_host_counts_in_its_wrapper(spark, fan_in):
    """Each slot counts the texts of all pages, copies once, however the pages are grouped; most of all pages decide."""
    body = lambda i, box: f"<html><body><div{box}><p>Story {i} is told</p></div>{'<ul><li>x</li></ul>' * (i % 3)}{'<hr>' * (i % 5 // 2)}<table><tr><td>{i}</td></tr></table></body></html>"
    rows = [(i, f"http://{h}.example/", body(i, " class=ad" * (i < hidden))) for h, hidden in (("few", 18), ("most", 22)) for i in range(40)]
    rows += [(100 + i, "http://few.example/", body(0, " class=ad")) for i in range(50)]
    made = {r.host: r for r in H.infer_wrappers(pages(spark, rows).repartition(6), fan_in=fan_in).collect()}

    def slots(parts):
        return [x for p in parts for x in (slots(p[0]) if H.is_group(p) else [p] if p[0] == H.SLOT else [])]

    for h, r in made.items():
        counts = [tuple(s[1][:2]) for s in slots(json.loads(r.wrapper))]
        assert (40, 22 if h == "few.example" else 18) in counts and (40, 40) in counts
        assert sum(n for n, _ in counts) == 80 + sum(i % 3 for i in range(40))
    assert {h: r.rows for h, r in made.items()} == {"few.example": 90, "most.example": 40}
    again = {r.host: r.wrapper for r in H.infer_wrappers(pages(spark, rows[::-1]).repartition(3), fan_in=fan_in).collect()}
    assert again == {h: r.wrapper for h, r in made.items()}
    got = H.main_text(pages(spark, rows), fan_in=fan_in).collect()
    assert all(("Story" in r.text) == ("few" in r.url) for r in got) and len(got) == len(rows)


class PlainArticle(HTMLParser):
    """Text in the article element by nesting alone, a second way for pages that have one."""

    def __init__(self, page):
        super().__init__()
        self.depth = self.skip = 0
        self.out = []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag not in H.VOID:
            names = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
            if self.skip or self.depth and (tag in "nav footer aside form button script style".split() or re.search(r"(?i)\b(ad|comments|cookie-notice)\b", names)):
                self.skip += 1
            elif tag == "article" or self.depth:
                self.depth += tag == "article"
        if tag not in H.INLINE:
            self.out.append(" ")

    def handle_endtag(self, tag):
        if tag not in H.VOID:
            if self.skip:
                self.skip -= 1
            elif tag == "article":
                self.depth -= 1
        if tag not in H.INLINE:
            self.out.append(" ")

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.out.append(data)


def test_main_text_of_the_table_by_nesting(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    plain = {r.page_id: " ".join("".join(PlainArticle(r.html or "").out).split()) for r in table.collect()}
    got = H.main_text(table).collect()
    assert len(got) == len(plain) and sum(map(len, plain.values())) > 10_000
    assert {r.page_id: r.text for r in got} == plain


def test_long_pages(spark):
    """Tens of thousands of parts, in no order that folds; alignment stays exact and small."""
    rng = random.Random(2)
    make = lambda i: "<article>" + "".join(f"<{(t := rng.choice('p h2 div ul table'.split()))}>w{i}</{t}>" for _ in range(6000)) + "</article><div>" + "x" * 300_000 + "</div>"
    rows = [(i, "http://long.example/", make(i)) for i in range(3)]
    got = {r.page_id: r.text for r in H.main_text(pages(spark, rows)).collect()}
    assert got == {i: " ".join([f"w{i}"] * 6000) for i in range(3)}


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, text string, size string, h int")


def plain_targets(sizes):
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_source_mix(spark, sf_dir):
    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text").collect()]
    edge = [(i, "hot", f"w{i} " * (i % 50)) for i in range(300)] + [(400, None, "a b c"), (401, "b", None), (402, "b", ""), (403, "c", "x " * 5000), (403, "c", "x " * 5000), (404, "é", "one two")]
    for rows in (table, edge, [(1, "a", None)], []):
        options = {"shard_docs": 20}
        got = M.source_mix(docs(spark, rows), **options).collect()
        assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
        sizes, taken = defaultdict(int), defaultdict(int)
        for _, s, t in rows:
            sizes[s] += len((t or "").split())
        want = plain_targets(sizes)
        for r in got:
            assert r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r["size"] and r.target == pytest.approx(want[r.source])
            taken[r.source] += r.taken
        for s in taken:
            assert abs(taken[s] - want[s]) <= 8 + 0.01 * want[s], (s, taken[s], want[s])
        again = M.source_mix(docs(spark, rows[::-1]).repartition(3), **options).collect()
        assert sorted(map(str, again)) == sorted(map(str, got))


def test_apportion_is_sainte_lague(spark):
    votes = {"a": 1000, "b": 333, "c": 100, "d": 7, "e": 7, "f": 0, "g": 51, "h": 3}
    for seats in (0, 1, 5, 17, 100, 1501):
        df = spark.createDataFrame([(0, k, v, seats) for k, v in votes.items()], "g int, k string, v long, s long")
        got = {r.k: r.quota for r in M.apportion(df, ["g"], ["k"], "v", "s").collect()}
        plain = dict.fromkeys(votes, 0)
        for _ in range(seats):
            best = max(votes, key=lambda k: (votes[k] / (2 * plain[k] + 1), [-ord(k)]))
            plain[best] += 1
        assert got == plain, seats


def test_mixed_documents(spark):
    rows = [(i, "abc"[i % 3], "w " * 20) for i in range(300)]
    out = M.mixed(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns
    n = defaultdict(int)
    for r in out.collect():
        n[r.source] += 20
    want = plain_targets({"a": 2000, "b": 2000, "c": 2000})
    assert all(abs(n[s] - want[s]) <= 60 for s in "abc")


def test_shard_sort(spark, sf_dir):
    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text").collect()]
    hot = [(i, "s", "the same text") for i in range(900)] + [(i, "s", f"text {i}") for i in range(1000, 2000)] + [(None, "s", None), (5000, "s", None), (5, "s", "the same text")]
    for rows, shards, options in ((table, 4, {}), (hot, 8, {}), (hot, 8, {"slice_rows": 50}), ([], 8, {}), ([(1, "s", "x")], 8, {}), ([(i, "s", None) for i in range(64)], 8, {})):
        got = O.shard_sort(docs(spark, rows), shards=shards, **options).collect()
        want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, _, t in rows)
        assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
        by, total = defaultdict(list), sum(r["size"] for r in got)
        for r in got:
            assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
            by[r.shard].append(r)
        for s, own in by.items():
            assert sorted(r.slot for r in own) == list(range(len(own)))
        if len(rows) > 1:
            most = max(r["size"] for r in got)
            assert all(abs(sum(r["size"] for r in by[s]) - total / shards) <= 0.01 * total / shards + 2 * most for s in range(shards))


def test_slots_do_not_depend_on_slices(spark):
    """One order at every size, groups of equal texts in one piece but where bytes would be unequal."""
    rows = [(i, "s", "the same text") for i in range(400)] + [(i, "s", "another") for i in range(3000, 3300)] + [(i, "s", f"text {i // 2}") for i in range(1000, 2000)] + [(None, "s", "the same text"), (None, "s", None)]
    key = lambda t: int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16)
    text = {i: t for i, _, t in rows if i is not None}
    seen = []
    for n in (1_000_000, 100, 30, 7):
        got = O.shard_sort(docs(spark, rows), shards=8, slice_rows=n).collect()
        seen.append(sorted(map(str, got)))
        order = sorted((r.shard, r.slot, r.doc_id) for r in got)
        ids = [i for _, _, i in order if i is not None]
        assert ids == sorted(text, key=lambda i: (key(text[i]), i))
    assert all(x == seen[0] for x in seen)
    # pairs of equal texts: every one is far below a hundredth of a shard's bytes
    many = [(i, "s", f"text {i // 2}") for i in range(20_000)]
    shard = {r.doc_id: r.shard for r in O.shard_sort(docs(spark, many), shards=8).collect()}
    assert all(shard[i] == shard[i + 1] for i in range(0, 20_000, 2))
