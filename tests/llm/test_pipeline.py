"""The pipeline against a brute-force version of its stages."""

import hashlib
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from imgspark.llm.quality_rules import BOILERPLATE, MENU
from imgspark.llm.queries import tokenizer_path

from test_dedup import plain_components, plain_fp
from test_layout import plain_targets
from test_text import BLANK, base, split


def plain_clean(text):
    """The text without its failing lines, None if the document is rejected; the line rules written a second time."""
    if base(text)[-1]:
        return None
    good, all_chars, good_chars = [], 0, 0
    for line in text.split("\n"):
        b, w = line.strip(BLANK), split(line)
        bars, marks, n = sum(map(line.count, "|»•›")), sum(map(line.count, "#*$%&<>!")), len(w)
        menu = bars >= 3 and 3 * bars >= n - bars or re.search(MENU, b, re.A)
        phrases = len(re.findall(BOILERPLATE, b, re.A))
        odd = marks >= max(3, n) or n < 4 and b[-1:] not in ".!?…:;,\"')]”»。"
        fails = bool(w) and (menu or phrases and 60 * phrases >= n or odd)
        all_chars += sum(map(len, w))
        if not fails:
            good.append(line)
            good_chars += sum(map(len, w))
    return "\n".join(good) if 2 * good_chars >= all_chars else None


def test_stages_and_run(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = P.quality(spark, docs, sf_dir)
    by = {r.doc_id: r for r in kept.collect()}
    first = set(by)
    want = {r.doc_id: x for r in docs.collect() if (x := plain_clean(r.text)) is not None}
    assert kept.columns == docs.columns and 0 < len(first) < docs.count()
    assert {i: (r.text, r.n_chars) for i, r in by.items()} == {i: (x, len(x)) for i, x in want.items()}

    last = {}
    for i in sorted(first):
        last[by[i].text] = i
    assert {r.doc_id for r in P.exact(spark, kept, sf_dir).collect()} == set(last.values())

    classes = plain_components([(i, plain_fp(by[i].text)) for i in last.values()])
    third = {i for i in last.values() if classes[plain_fp(by[i].text)] == i}
    lean = kept.filter(F.col("doc_id").isin(sorted(last.values())))
    assert {r.doc_id for r in P.near(spark, lean, sf_dir).collect()} == third

    out = P.run(spark, sf_dir).collect()
    sizes, got = defaultdict(int), defaultdict(int)
    for i in third:
        sizes[by[i].source] += len(by[i].text.encode().split())
    library = Tokenizer.from_file(tokenizer_path())
    times = defaultdict(int)
    for r in out:
        assert r.doc_id in third and r.source == by[r.doc_id].source
        times[r.doc_id] += 1
        text = by[r.doc_id].text
        got[r.source] += len(text.encode().split())
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    longest = max(len(by[i].text.split()) for i in third)
    assert max(times.values()) <= 2 and all(abs(got[s] - t) <= 2 * longest for s, t in plain_targets(sizes).items())


LONG = " ".join(f"Line{k} speaks{k} of river{k * 7} that nobody{k} had counted{k}." for k in range(24))
OTHER = " ".join(f"Another{k} page tells{k} how roof{k * 5} was mended{k} in spring{k}." for k in range(24))
HUGE = " ".join(f"Word{k} follows word{k * 7 % 5000} in this very long text." for k in range(9000))
ODD = [(3, LONG), (7, LONG), (7, OTHER), (7, OTHER), (None, OTHER), (None, LONG), (None, None), (4, None), (5, ""), (5, " \n"), (8, HUGE), (8, LONG + " End."), (9, "short text."), (9, HUGE + "\nhome | menu | login | search")]
CLASHES = "kept n_lines carried row fp root component_id keep_id n size taken source_size target copies one first text_sha256 _key _id _sha _u words".split()


def odd_docs(spark, rows=ODD):
    docs = spark.createDataFrame([(i, t, None if k % 3 == 0 else "wiki", f"en{k}", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string, lang string, n_chars long")
    return docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("lang")) for c in CLASHES}).repartition(3)


def own(r):
    """A row by what no stage may touch."""
    return (r.doc_id, r.lang, r.source, *(r[c] for c in CLASHES))


def test_every_stage_hands_on_clashing_columns_and_odd_rows(spark, sf_dir):
    docs = odd_docs(spark)
    given = {own(r): r.text for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and {own(r) for r in got} <= set(given), name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        if name == "quality":
            want = {k: x for k, t in given.items() if (x := plain_clean(t or "")) is not None}
            assert {own(r): r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
        if name == "exact":
            best = {}
            for i, t in ODD:
                best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
            assert sorted((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in got) == sorted(best.items())
    encoded = P.encode(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id or -1, r.lang) for r in encoded) == sorted((k[0] or -1, k[1]) for k in given)


def test_near_keeps_one_row_of_each_class_whatever_the_ids(spark, sf_dir):
    rows = [*ODD, (1, OTHER.replace("Another", "another")), (2, LONG), (2, LONG), (2, HUGE.upper())]
    got = P.near(spark, odd_docs(spark, rows), sf_dir).collect()
    classes = plain_components([(k, plain_fp(t or "")) for k, (_, t) in enumerate(rows)])
    best = {}
    for i, t in rows:
        key = classes[plain_fp(t or "")]
        mine = (i is None, i or 0, 0)
        if key not in best or mine < best[key]:
            best[key] = mine
    assert sorted((classes[plain_fp(r.text or "")], (r.doc_id is None, r.doc_id or 0, 0)) for r in got) == sorted(best.items())
    assert {r.doc_id for r in P.near(spark, odd_docs(spark, [(3, LONG), (7, LONG), (7, OTHER)]), sf_dir).collect()} == {3, 7}
    assert P.near(spark, odd_docs(spark, [(7, LONG), (7, LONG + " x")]), sf_dir).count() == 1
