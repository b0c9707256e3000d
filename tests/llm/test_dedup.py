"""Exact and SimHash dedup, line dedup: edge cases and brute force over a whole small table."""

import hashlib
import random
from collections import defaultdict

import pytest
import xxhash

from imgspark.llm import exact_dedup as X
from imgspark.llm import line_dedup as L
from imgspark.llm import simhash_dedup as S
from imgspark.llm.common import hot_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _t string, kept string, fp string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "x", "y", "z") for i, t in rows], SCHEMA)


def plain_fp(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join("\x20" if c in " \t\n\x0b\x0c\r" else c for c in w).split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps):
    ids = {}
    for i, f in fps:
        ids[f] = min(i, ids.get(f, i))
    keys = list(ids)
    up = {f: f for f in keys}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 3 and root(a) != root(b):
                up[root(a)] = root(b)
    low = defaultdict(lambda: 1 << 62)
    for f in keys:
        low[root(f)] = min(low[root(f)], ids[f])
    return {f: low[root(f)] for f in keys}


EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a b c d e"), (7, "a b c d e"), (8, "a b c d f"), (9, "x y ÉtÉ \x85 \x1f z"), (10, "w " * 20000)]


def test_simhash_edges_and_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    for rows in (EDGE, docs):
        got = S.simhash_dedup(frame(spark, rows)).collect()
        assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
        want = plain_components([(i, plain_fp(t)) for i, t in rows])
        by = {i: plain_fp(t) for i, t in rows}
        for r in got:
            assert r.fp % (1 << 64) == by[r.doc_id] and r.component_id == want[by[r.doc_id]]


def test_links_match_brute_force(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << x for x in rng.sample(range(64), k)) for b in base for k in (0, 1, 2, 3, 3, 4, 5) for _ in range(3)}
    fps = list(enumerate(sorted(fps)))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(i, signed(f)) for i, f in fps], "id long, fp long")
    got = [(r.a, r.b) for r in S.links(df).collect()]
    want = {(i, j) for i, a in fps for j, b in fps if i < j and (a ^ b).bit_count() <= 3}
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_a_chain_and_empty(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r.id: r.root for r in S.components(chain).collect()}
    assert got == {i: 0 for i in range(61)} | {90: 90, 95: 90, 100: 90}
    assert S.components(chain.limit(0)).count() == 0
    assert S.simhash_dedup(frame(spark, [])).count() == 0


def test_rows_without_id_link_their_neighbours(spark, monkeypatch):
    # fingerprints 0 - 7 - 63 in steps of three bits; only a row without doc_id has the one between
    monkeypatch.setattr(S, "fingerprints", lambda docs, *_: docs.selectExpr("doc_id", "cast(text as long) as fp"))
    got = S.simhash_dedup(frame(spark, [(4, "63"), (None, "7"), (9, "0"), (None, "4096000"), (2, "-1")])).collect()
    assert {(r.doc_id, r.fp, r.component_id) for r in got} == {(4, 63, 4), (None, 7, 4), (9, 0, 4), (None, 4096000, None), (2, -1, 2)}


def test_keep_one(spark):
    text = "the same words stand here again and again for all of them"
    kept = sorted(r.doc_id for r in S.keep_one(frame(spark, [(3, text), (2, text), (9, "quite another text with other words in it")])).collect())
    assert kept == [2, 9]


@pytest.mark.parametrize("keep,limit", [("largest", X.TRIE_BYTES), ("smallest", X.TRIE_BYTES), ("largest", 3000)])
def test_exact_dedup(spark, sf_dir, keep, limit):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    odd = [(None, "x"), (3, "x"), (None, "y"), (None, "y"), (5, "hot"), (5, "hot"), (5, "other")]
    for rows in (EDGE, docs, odd, [(i, "hot") for i in range(500)] + [(1000, "cold")], []):
        by = defaultdict(list)
        for i, t in rows:
            by[t or ""].append(i)
        pick = lambda ids: (max if keep == "largest" else min)((i for i in ids if i is not None), default=None)
        got = X.exact_dedup(frame(spark, rows), keep=keep, trie_bytes=limit).collect()
        want, seen = [], set()
        for i, t in rows:
            best = pick(by[t or ""])
            want.append((i, best, len(by[t or ""]), i == best and t not in seen, hashlib.sha256((t or "").encode()).hexdigest()))
            seen |= {t} if i == best else set()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
        kept = X.keep_owners(frame(spark, rows), keep=keep)
        assert kept.columns == frame(spark, rows).columns
        assert sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str) == sorted(((pick(ids), t) for t, ids in by.items()), key=str)


def test_rows_meet_hot_and_other_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 30}") for i in range(3000)] + [(9, "none")], "i long, k string")
    table = spark.createDataFrame([("hot", 2000, 1)] + [(f"k{i}", 100, i) for i in range(0, 30, 3)], "k string, n long, v long")
    for share in (1, 2, 40):
        got = hot_join(rows, table, "k", "n", rows.i, share=share).collect()
        assert sorted((r.i, r.k, r.v) for r in got if r.k != "none") == sorted((i, "hot" if i % 3 else f"k{i % 30}", 1 if i % 3 else i % 30) for i in range(3000))
        assert [(r.n, r.v) for r in got if r.k == "none"] == [(None, None)]


@pytest.mark.parametrize("ordered", [True, False])
def test_full_tries_are_spilled_whole(ordered):
    rng = random.Random(3)
    keys = [bytes(rng.choices(b"ab", k=rng.randint(0, 14))) for _ in range(4000)] + [b"a" * 9000] * 3
    rows = [(k, i, 1) for i, k in enumerate(keys)]
    want = {}
    for k, i, _ in rows:
        want[k] = (i, want.get(k, (0, 0))[1] + 1)
    for limit in (2000, 1 << 30):
        out = list(X._owners(iter(sorted(rows, key=lambda r: r[0]) if ordered else rows), "largest", limit, ordered))
        got = {}
        for k, best, n in out:
            got[k] = (max(best, got.get(k, (0, 0))[0]), n + got.get(k, (0, 0))[1])
        assert got == want and (len(out) == len(want) or not ordered and limit == 2000)


def test_line_dedup(spark):
    names = "Ada Bob Cleo Dan Eve Finn".split()
    rows = [(i, f"own line of {chr(97 + i)} document\nVisited 1{i} times by users\n\nPosted by {names[i]} in the news section\nshort") for i in range(6)]
    rows += [(6, None), (7, ""), (8, "Visited x times by users"), rows[5], (9, "Posted by Gus in the news section\n1 2 3 4")] + [(i, "5 6 7 8") for i in range(10, 16)]
    got = sorted(map(tuple, L.line_dedup(frame(spark, rows)).select("doc_id", "n_lines", "n_lines_dropped", "clean_text").collect()))
    assert got[0] == (0, 5, 0, rows[0][1])
    # names are variable fields as digits are; what is wildcards by more than half isn't dropped
    for i in range(1, 6):
        assert got[i] == (i, 5, 3, "\nshort")
    assert got[6] == got[5]
    assert got[7:] == [(6, 1, 0, ""), (7, 1, 0, ""), (8, 1, 0, rows[8][1]), (9, 2, 1, "1 2 3 4")] + [(i, 1, 0, "5 6 7 8") for i in range(10, 16)]
    assert L.line_dedup(frame(spark, [])).count() == 0


def plain_line_dedup(rows, min_docs=5):
    """The tree as dictionaries, line by line."""
    mask = lambda line: tuple("<*>" if any(c in "0123456789" for c in w) else w for w in line.split(" ") if w)
    docs = {(i, t or "") for i, t in rows}
    of, leaves = defaultdict(set), defaultdict(set)
    for d in docs:
        for line in d[1].split("\n"):
            if len(m := mask(line)) >= 3:
                of[m].add(d)
                leaves[len(m), m[:2]].add(m)
    template = {}
    for (n, lead), lines in leaves.items():
        seen = defaultdict(int)
        for m in lines:
            for x in enumerate(m):
                seen[x] += len(of[m])
        for m in lines:
            t = tuple(w if w != "<*>" and seen[k, w] >= min_docs else "<*>" for k, w in enumerate(m))
            if 2 * sum(w != "<*>" for w in t) >= n:
                template[m] = lead, t
    has = defaultdict(set)
    for m, t in template.items():
        has[t] |= of[m]
    first = {t: min(ds, key=lambda d: (d[0] is None, d[0])) for t, ds in has.items() if len(ds) >= min_docs}
    stays = lambda d, line: (t := template.get(mask(line))) not in first or first[t] == d
    return [(i, "\n".join(x for x in (t or "").split("\n") if stays((i, t or ""), x))) for i, t in rows]


def test_templates_by_count_and_leading_tokens(spark):
    """A field in any place but the leading ones is found: at the end, in the middle and in both."""
    names = "Anna Berta Clara Dora Emma Frida Greta Hanna Ida Johanna".split()
    shapes = ["Posted by {} in the news section", "Posted by the author {}", "Posted by {} in {}", "Seen in the {} of {}"]
    for shape in shapes:
        rows = [(i, f"Own words of document {chr(97 + i) * 3} stand here\n{shape.format(n, names[-i])}\nAnd {chr(97 + i) * 4} more ends it") for i, n in enumerate(names)]
        kept = {r.doc_id: r.clean_text for r in L.line_dedup(frame(spark, rows)).collect()}
        assert sum(shape.split(" {}")[0] in t for t in kept.values()) == 1, shape


@pytest.mark.parametrize("small", [L.SMALL, 0])
def test_line_dedup_by_brute_force(spark, monkeypatch, small):
    """Variants, a line of thousands of tokens, lines that most documents share, null and repeated ids."""
    monkeypatch.setattr(L, "SMALL", small)
    rng = random.Random(8)
    words = "red green blue old new fast slow big small odd".split()
    kinds = ["Read {} more about {} in our shop", "All {} rights reserved by {}", "{} {} {} {} {}", "See {} page {} of {}", "the same line everywhere here"]
    line = lambda: (k := rng.choice(kinds)).format(*(rng.choice([*words, str(rng.randint(0, 99))]) for _ in range(k.count("{}"))))
    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 6)))) for i in range(120)]
    long_line = "see " * 5000
    rows += [(200 + i, long_line + w) for i, w in enumerate(words[:6])] + [(None, "the same line everywhere here\nown text of nobody"), rows[3], rows[3], (300, None)]
    got = [(r.doc_id, r.clean_text) for r in L.line_dedup(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(plain_line_dedup(rows), key=str)


def test_lines_and_tokens_are_exchanged_once(spark, monkeypatch):
    """What goes into a join of lines or tokens has no exchange of its own behind it, and a token's row is its line and place."""
    given, join = [], L.hot_join

    def spied(rows, table, key, *rest, **kw):
        given.append((key, rows.columns, rows._jdf.queryExecution().executedPlan().toString().count("Exchange")))
        return join(rows, table, key, *rest, **kw)

    monkeypatch.setattr(L, "hot_join", spied)
    monkeypatch.setattr(L, "SMALL", 0)
    rows = [(i, f"Own words of {chr(97 + i)} document\nPosted by {chr(97 + i)} in the news section") for i in range(9)]
    got = [(r.doc_id, r.clean_text) for r in L.line_dedup(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(plain_line_dedup(rows))
    assert [(k, n) for k, _, n in given] == [("leaf", 0), ("place", 0), ("line", 0), ("template", 0)] and given[1][1] == ["line", "place"]
