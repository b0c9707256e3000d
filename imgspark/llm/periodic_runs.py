"""Periodic runs of words, by catchers of squares over completed blocks of powers of two.

For each L = 4, 8, 16, ... the text is cut into blocks of L words. A completed block is a catcher for the squares of period
2L to 4L - 1: the first half of such a square holds a whole block, and so the block's words come again one period later. While
words are appended in the zone that lies 2L to 4L - 1 words behind it, the suffix of L words that each of them ends is compared
with the block. A hit says that words one period apart agree over a block; hits of neighbouring blocks at one distance are one
stretch, which is carried on word by word to both sides for less than a block (in halving steps). A stretch as long as its
period is a square, or several that overlap: they merge into one run. Periods below 8 need no blocks: each word is
compared with the one so far before it.

Comparisons go by a rolling 64-bit hash, for all words of a chunk of texts at once; what they report is held against the
words themselves, and where it does not stand, that period is scanned word by word. So no collision changes a result. A stretch with
a multiple of a run's period begins and ends where the run does and is dropped for it. There is no shuffle: a text is one row.

Defined cases: a null or blank text has no words, no runs and the digests of nothing; a null doc_id has no number, so that its
text stays as it is; repeated rows are each answered; texts may be of any length (memory follows the longest one); further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run's least length in words, words of texts that are looked through together, bytes cut into words at once.
LEAST_LENGTH = 12
CHUNK_WORDS = 1 << 18
SLICE_BYTES = 1 << 20
#: Blocks of this many words are the least; shorter periods than twice that are compared directly.
LEAST_BLOCK = 4
#: Comparisons of catchers with suffixes that are held at a time.
WATCHED = 1 << 22
#: An odd multiplier of the rolling hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
RESULT = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True that are so long at least."""
    edges = np.flatnonzero(same[1:] != same[:-1]) + 1
    if same.size and same[0]:
        edges = np.concatenate(([0], edges))
    if edges.size % 2:
        edges = np.concatenate((edges, [same.size]))
    a, b = edges[::2], edges[1::2]
    long = b - a >= least
    return a[long], b[long]


class Text:
    """The words of one or more texts as numbers, with hashes of all their substrings."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.n = words, words.size
        with np.errstate(over="ignore"):
            x = words.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0x2545F4914F6CDD1D)
            x ^= x >> np.uint64(32)
            self.power = np.full(self.n + 1, BASE, np.uint64)
            self.power[0] = 1
            np.cumprod(self.power, out=self.power)
            shrink = np.full(self.n, INVERSE, np.uint64)
            if self.n:
                shrink[0] = 1
            np.cumprod(shrink, out=shrink)
            self.sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(x * shrink, out=self.sums[1:])

    def hashes(self, length: int) -> np.ndarray:
        """Of the substrings of that length, by first word."""
        with np.errstate(over="ignore"):
            return (self.sums[length:] - self.sums[: self.n - length + 1]) * self.power[: self.n - length + 1]

    def equal(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Whether the substrings from a and from b (a < b) agree; False where one would leave the text."""
        inside = (a >= 0) & (b + length <= self.n)
        a, b = np.where(inside, a, 0), np.where(inside, b, 0)
        end_a, end_b = np.minimum(a + length, self.n), np.minimum(b + length, self.n)
        with np.errstate(over="ignore"):
            return inside & ((self.sums[end_a] - self.sums[a]) * self.power[a] == (self.sums[end_b] - self.sums[b]) * self.power[b])

    def stretches(self, period: int) -> tuple[np.ndarray, np.ndarray]:
        """Where words one period apart agree for long enough to be a run, word by word."""
        return _stretches(self.words[:-period] == self.words[period:], max(LEAST_LENGTH, 2 * period) - period)


def caught(text: Text, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, period) of stretches of squares with periods from 2 to 4 blocks that catchers of this size report."""
    n, width = text.n, 2 * block
    blocks = n // block
    padded = np.zeros((blocks + 4) * block + 1, np.uint64)
    hashes = text.hashes(block)
    padded[: hashes.size] = hashes
    zones = np.lib.stride_tricks.as_strided(padded[width:], (blocks, width), (8 * block, 8), writeable=False)
    keys = padded[: blocks * block : block]
    found = []
    for i in range(0, blocks, per := max(1, WATCHED // width)):
        hit = np.flatnonzero(zones[i : i + per] == keys[i : i + per, None])
        b, distance = i + hit // width, hit % width + width
        found.append((distance * (blocks + 1) + b)[b * block + distance + block <= n])
    at = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    if not at.size:
        return
    breaks = np.flatnonzero(np.diff(at) != 1) + 1  # neighbouring blocks at one distance are one stretch
    first, last = at[np.concatenate(([0], breaks))], at[np.concatenate((breaks - 1, [at.size - 1]))]
    period, b, e = first // (blocks + 1), first % (blocks + 1), last % (blocks + 1)
    able = (e - b + 3) * block - 2 >= period
    period, low, high = period[able], b[able] * block, (e[able] + 1) * block
    step = block // 2
    while step:
        low = np.where(text.equal(low - step, low - step + period, step), low - step, low)
        high = np.where(text.equal(high, high + period, step), high + step, high)
        step //= 2
    square = high - low >= period
    yield low[square], high[square], period[square]


def runs(words: np.ndarray, longest: int) -> np.ndarray:
    """All runs of the texts as rows (start, length, smallest period), by start, then period.

    words: a number for each word, with one of its own behind each text; longest: the words of the longest text."""
    text, found = Text(words), {}

    def add(starts: np.ndarray, ends: np.ndarray, period: int) -> None:
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            found.setdefault((s, e + period), period)

    for period in range(1, min(2 * LEAST_BLOCK, longest // 2 + 1)):
        add(*text.stretches(period), period)
    block = LEAST_BLOCK
    while 4 * block <= longest:
        for low, high, period in caught(text, block):
            order = np.argsort(period, kind="stable")
            for s, e, p in zip(low[order].tolist(), high[order].tolist(), period[order].tolist(), strict=True):
                known = found.get((s, e + p))
                if known is not None and p % known == 0:
                    continue
                if np.array_equal(words[s:e], words[s + p : e + p]):
                    found.setdefault((s, e + p), p)
                else:
                    add(*text.stretches(p), p)
        block *= 2
    return np.array(sorted((s, e - s, p) for (s, e), p in found.items()), np.int64).reshape(-1, 3)


def numbered(text: bytes, numbers: dict[bytes, int]) -> np.ndarray:
    """The words of a text by their numbers; new words get the next ones."""
    parts, at = [], 0
    while at < len(text):
        end = at + SLICE_BYTES
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = text[at:end].split()
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def repeating(words: np.ndarray, doc_id: int | None) -> np.ndarray:
    """One text in ten gets a tail that repeats some of its words, by a rule on its doc_id."""
    n = words.size
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return words[np.where(i >= a, a + (i - a) % p, i)]


def _answer(doc_id: int | None, words: np.ndarray, found: np.ndarray, of: list[bytes]) -> tuple:
    keep = words
    best = (None,) * 4
    if len(found):
        k = max(range(len(found)), key=lambda k: (found[k, 1], -found[k, 0], -found[k, 2]))
        start, length, period = found[k].tolist()
        best = (start, length, period, 1000 * length // period)
        edges = np.zeros(words.size + 1, np.int64)
        np.add.at(edges, found[:, 0] + found[:, 2], 1)
        np.add.at(edges, found[:, 0] + found[:, 1], -1)
        keep = words[np.cumsum(edges[:-1]) == 0]
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in found.tolist())
    sha = hashlib.sha256()
    for i in range(0, keep.size, CHUNK_WORDS):
        sha.update((b" " if i else b"") + b" ".join(map(of.__getitem__, keep[i : i + CHUNK_WORDS].tolist())))
    return doc_id, words.size, len(found), *best, hashlib.sha256(lines.encode()).hexdigest(), sha.hexdigest()


def answers(docs: Iterator[tuple[int | None, str | None]], repeat: bool) -> Iterator[tuple]:
    """Texts are looked through together until they have CHUNK_WORDS words; a longer one by itself."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    some: list[tuple[int | None, np.ndarray]] = []
    total = 0

    def done() -> Iterator[tuple]:
        parts, starts, at = [], [], 0
        for k, (_, w) in enumerate(some):
            starts.append(at)
            parts += [w, np.array([-1 - k])]
            at += w.size + 1
        found = runs(np.concatenate(parts), max(w.size for _, w in some))
        cuts = np.searchsorted(found[:, 0], [*starts, at])
        of = list(numbers)
        for k, (doc_id, w) in enumerate(some):
            yield _answer(doc_id, w, found[cuts[k] : cuts[k + 1]] - [starts[k], 0, 0], of)

    for doc_id, text in docs:
        words = numbered((text or "").encode(), numbers)
        some.append((doc_id, repeating(words, doc_id) if repeat else words))
        total += words.size
        if total >= CHUNK_WORDS:
            yield from done()
            numbers, some, total = defaultdict(count().__next__), [], 0
    if some:
        yield from done()


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repeat: bool = False) -> DataFrame:
    """One row for each of docs, as RESULT has it; repeat=True plants tails that repeat themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i.as_py(), t.as_py()) for b in batches for i, t in zip(b.column(0), b.column(1), strict=True))
        names = [f.split()[0] for f in RESULT.split(", ")]
        types = [pa.string() if f.endswith("string") else pa.int64() for f in RESULT.split(", ")]
        some: list[tuple] = []
        for r in answers(rows, repeat):
            some.append(r)
            if len(some) == 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names)
                some = []
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names)

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, RESULT)
