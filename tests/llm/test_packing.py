"""Packing: tokens against the library, places without gaps, plans against bounds and against the best plan of small cases."""

import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from tokenizers import Tokenizer

from imgspark.llm import best_fit_packing as B
from imgspark.llm.queries import tokenizer_path

WORDS = tokenizer_path("word_bpe_49k.json")


def of_library(texts):
    t = Tokenizer.from_file(WORDS)
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(rows, docs, max_tokens):
    """rows: RESULT of pack(); docs: (doc_id, text) with different doc_ids."""
    ids = dict(zip((d for d, _ in docs), of_library([t for _, t in docs]), strict=True))
    seen, sequences = Counter(), defaultdict(list)
    for r in rows:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == r["piece"] * max_tokens and r["length"] == len(piece) <= max_tokens
        assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
        seen[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert seen == {d: len(x) for d, x in ids.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= max_tokens
    return len(sequences), -(-sum(map(len, ids.values())) // max_tokens)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    used, least = check(B.pack(docs, WORDS).collect(), [tuple(r) for r in docs.collect()], 4096)
    assert used <= least + 2


@pytest.mark.parametrize("max_tokens", [1, 7, 64])
def test_odd_texts(spark, max_tokens):
    odd = [None, "", " \n", "É" * 50, "été É", "<|endoftext|>", "a<|startoftext|>b <|endoftext|>.", "It's he'll 'S x'", "word...###", "naïve”. ß% ǅ* İ, Σας ς.", "\x1c\x1d a\x85b  c d", "1234.", "１２.", "x" * 4000, "à. ̀.", "日本語。テスト!", "😀😀 %%", "ﬁn! 'TIS", "\x0bq\x0cw", "\x01 a\x01b \x01\x01 x", "क़, x\u0958. ỳ\u0344!"]
    docs = [(i, t) for i, t in enumerate(odd)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("length", B.F.lit("mine")).repartition(3)
    check(B.pack(frame, WORDS, max_tokens=max_tokens).collect(), docs, max_tokens)


def test_repeated_rows_and_no_rows(spark):
    frame = spark.createDataFrame([(5, "same text here")] * 30 + [(None, "same text here")] * 4, "doc_id long, text string").repartition(4)
    rows = B.pack(frame, WORDS, max_tokens=10).collect()
    assert len(rows) == 34 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 34 and {r["offset"] for r in rows} == {0, 4}
    assert B.pack(frame.limit(0), WORDS).count() == 0


def test_words_and_marks_alone_are_tokenised_like_the_text():
    r = random.Random(7)
    every = "".join(map(chr, range(0xC0, 0x180)))
    assert [np.frombuffer(x, "<u4").tolist() for x in B.Encoder(WORDS).encode([*every, *(f"a{c}b, {c}{c}" for c in every)])] == [x[:-1] for x in of_library([*every, *(f"a{c}b, {c}{c}" for c in every)])]
    letters = "abcXYZéßİçΣ\u0958"
    texts = ["".join(r.choice([*letters, *letters, *" \n.,!?;:\"#%*)]'’“0123"]) for _ in range(300)) for _ in range(300)]
    encoder = B.Encoder(WORDS)
    for text, ids in zip(texts, of_library(texts), strict=True):
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == ids[:-1]


def kept(kinds, histogram, max_tokens):
    used = Counter()
    for kind, times in kinds:
        assert times > 0 and sum(k * n for k, n in kind.items()) <= max_tokens
        for k, n in kind.items():
            used[k] += n * times
    assert used == Counter(histogram)
    return sum(n for _, n in kinds)


@lru_cache(None)
def fewest(items, max_tokens):
    """By trying every set that holds the longest item."""
    if not items:
        return 0
    first, rest, best = items[0], items[1:], len(items)
    for mask in range(1 << len(rest)):
        taken = [x for i, x in enumerate(rest) if mask >> i & 1]
        if first + sum(taken) <= max_tokens:
            best = min(best, 1 + fewest(tuple(x for i, x in enumerate(rest) if not mask >> i & 1), max_tokens))
    return best


def test_small_plans_are_at_most_one_sequence_from_the_best():
    r = random.Random(2)
    for _ in range(25):
        items = tuple(sorted((r.randrange(3, 60) for _ in range(8)), reverse=True))
        n = kept(B.plan(Counter(items), 100, rounds=60), Counter(items), 100)
        assert fewest(items, 100) <= n <= fewest(items, 100) + 1


def test_plans_of_many_pieces():
    r = random.Random(1)
    hard = Counter(r.randrange(900, 2100) for _ in range(50_000))
    assert kept(B.plan(hard), hard, 4096) <= 1.025 * sum(k * n for k, n in hard.items()) / 4096  # best fit alone takes 1.078
    mixed = Counter(min(4096, max(1, int(r.lognormvariate(6.8, 0.8)))) for _ in range(50_000))
    assert kept(B.plan(mixed), mixed, 4096) <= 1.002 * sum(k * n for k, n in mixed.items()) / 4096
    third = Counter({1000: 10**12, 1096: 10**12, 2000: 10**12})  # counts of any size cost the same
    assert kept(B.plan(third), third, 4096) <= 1.01 * 10**12


def test_knapsack_against_all_choices():
    r = random.Random(4)
    for _ in range(50):
        sizes = np.array([r.randrange(1, 9) for _ in range(4)])
        weights = np.array([r.random() for _ in range(4)])
        got = B.knapsack(weights, sizes, 12)
        best = [0.0] * 13
        for c in range(1, 13):
            best[c] = max([best[c - 1]] + [best[c - s] + w for s, w in zip(sizes.tolist(), weights.tolist()) if s <= c])
        assert sum(sizes[k] * n for k, n in got.items()) <= 12 and abs(sum(weights[k] * n for k, n in got.items()) - best[12]) < 1e-9
