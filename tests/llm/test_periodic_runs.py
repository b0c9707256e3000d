"""Periodic runs against stretches found period by period, word by word."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from imgspark.llm import periodic_runs as R


def by_hand(words):
    """(start, length, period) of all runs, by start, then period."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        t = 0
        while t < n - p:
            if words[t] != words[t + p]:
                t += 1
                continue
            s = t
            while t < n - p and words[t] == words[t + p]:
                t += 1
            if t - s + p >= max(12, 2 * p):
                found.setdefault((s, t - s + p), p)  # the smallest period comes first
    return sorted((s, m, p) for (s, m), p in found.items())


def expected(doc_id, text, repeat):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if repeat and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = by_hand(words)
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return doc_id, n, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def random_words(r):
    k, n = r.choice([1, 2, 2, 3, 10]), r.randrange(r.choice([20, 60, 300]))
    words = [r.randrange(k) for _ in range(n)]
    for _ in range(r.randrange(3)):
        if words:
            a, p = r.randrange(len(words)), r.randrange(1, max(2, len(words) // 3))
            words = words[:a] + words[a : a + p] * r.randrange(2, 6) + words[a + p :]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_texts_side_by_side(seed):
    r = random.Random(seed)
    for _ in range(150):
        texts, flat, want = [random_words(r) for _ in range(r.randrange(1, 4))], [], []
        for k, w in enumerate(texts):
            want += [(s + len(flat), m, p) for s, m, p in by_hand(w)]
            flat += [*w, -1 - k]
        got = R.runs(np.array(flat, np.int64), max(map(len, texts)))
        assert [tuple(x) for x in got.tolist()] == sorted(want)


def test_hashes_that_collide_change_nothing(monkeypatch):
    """All letters hash alike: everything is reported, and the words decide."""
    monkeypatch.setattr(R.Text, "hashes", lambda self, length: np.zeros(self.n - length + 1, np.uint64))
    monkeypatch.setattr(R.Text, "equal", lambda self, a, b, length: (a >= 0) & (b + length <= self.n))
    r = random.Random(8)
    for _ in range(40):
        w = random_words(r)
        assert [tuple(x) for x in R.runs(np.array([*w, -1]), len(w)).tolist()] == by_hand(w)


def test_texts_as_rows(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, r.choice([" ", "\n", "\t\x0b "]).join("abé\x1fc"[w % 5] + str(w) for w in random_words(r))) for i in range(120)]
    rows += [(None, "x " * 40), (None, None), (500, ""), (501, " \n\t"), (3, rows[3][1]), (3, rows[3][1]), (-7, "one " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("period", R.F.lit("mine"))
    for repeat in (False, True):
        got = sorted((tuple(x) for x in R.periodic_runs(docs, repeat=repeat).collect()), key=str)
        assert got == sorted((expected(i, t, repeat) for i, t in rows), key=str)
    assert R.periodic_runs(docs.limit(0)).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").filter("length(text) < 8000")
    got = sorted((tuple(x) for x in R.periodic_runs(docs, repeat=True).collect()), key=str)
    assert got == sorted((expected(i, t, True) for i, t in docs.collect()), key=str)


def test_long_texts_are_cut_into_slices_between_words(monkeypatch):
    monkeypatch.setattr(R, "SLICE_BYTES", 7)
    text = "aa bbbbbbbbbbbbb cc\n" * 9
    assert list(R.answers(iter([(1, text)]), False)) == [expected(1, text, False)]


def test_a_very_long_text_of_one_word():
    (row,) = R.answers(iter([(1, "a " * 200_000)]), False)
    assert row[1:7] == (200_000, 1, 0, 200_000, 1, 200_000_000)
