"""Best-fit packing of tokenised documents into sequences, planned by a configuration linear program over the length histogram.

1. Tasks tokenise whole texts, cut documents over `max_tokens` into pieces and keep what identifies a piece: its length, a
   checksum of its ids, its task and its number among that task's pieces of the length. Only these narrow rows move later.
2. The histogram of lengths (max_tokens counters, whatever the input) goes to the driver, which plans there. Lengths are grouped
   into classes of about equal tokens. The program "fewest patterns that cover all classes" is solved by multiplicative weights:
   in each round a knapsack by dynamic programming finds the pattern of greatest weight, and the classes that it serves more than
   their share lose weight. Rounded down, a pattern times its count becomes segments of equal sequences, each naming real lengths.
3. What rounding leaves, the shortest piece of each pattern, and pieces that are short altogether go best fit, longest first, into the
   room of those sequences and then into new ones; equal sequences and equal pieces are handled by counts, so the plan's size and
   time don't grow with the input. Four shares of max_tokens are tried as the limit of "short"; the plan of fewest sequences is used.
4. A piece's number among all of its length (its task's earlier counts plus its own) points to its place in the plan.

Defined cases: a null text is empty, an empty text is the end token alone; repeated rows and a null doc_id are documents like any
other; further columns are ignored; a text may be of any length, it is tokenised word by word; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

MAX_TOKENS = 4096
END_ID = 1
#: Words whose ids a worker remembers, and texts that are tokenised at a time.
CACHE_WORDS = 1_000_000
TEXTS = 256
#: The knapsack's steps, classes of lengths, rounds of the weights, and how fast these move.
STEPS = 512
CLASSES = 200
ROUNDS = 1000
RATE = 0.02
#: Pieces up to these shares of max_tokens are left to best fit.
SHORT = (1 / 64, 1 / 8, 1 / 4, 1 / 2)
#: A word between words that are tokenised together, and how many those are.
BETWEEN = b"\x01"
ASKED = 2048
#: Lower-case letters that no normalisation changes and that form one piece, whatever stands beside them.
LATIN = re.compile("[a-zß-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįıĳĵķĺļľłńņňŋōŏőœŕŗřśŝşšţťŧũūŭůűųŵŷźżž]+")
#: Marks that end many words. They are tokens of their own behind a letter.
MARKS = b'.,!?;:"#%*)]'
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
RESULT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


@lru_cache(2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _byte_letters() -> tuple[list[str], list[int]]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, others follow from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) for b in shown] + [chr(256 + k) for k in range(len(hidden))], shown + hidden


class Encoder:
    """Ids of whole texts as little-endian bytes. ASCII white space ends every token, so words are tokenised one by one, once."""

    def __init__(self, path: str) -> None:
        self.tokenizer, self.known = _tokenizer(path), {}
        self.letters = {b: c for c, b in zip(*_byte_letters(), strict=True)}
        (self.between,) = self.tokenizer.encode(BETWEEN.decode(), add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.encode().split() for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        found = [list(map(self.known.get, words)) for words in split]
        self.learn({w for words, got in zip(split, found, strict=True) if None in got for w, x in zip(words, got, strict=True) if x is None})
        known = self.known
        return [b"".join([known[w] if x is None else x for w, x in zip(words, got, strict=True)] if None in got else got) for words, got in zip(split, found, strict=True)]

    def learn(self, words: set[bytes]) -> None:
        known, joined, new = self.known, [], set()
        for w in words:
            parts = self.parts(w)
            new.update(parts)
            if parts[0] is not w:
                joined.append((w, parts))
        self.ask([w for w in new if w not in known])
        for w, parts in joined:
            known[w] = known[parts[0]] if len(parts) == 1 else known[parts[0]] + known[parts[1]]

    @staticmethod
    def parts(word: bytes) -> tuple[bytes, ...]:
        """The word, or letters in lower case and the marks behind them, which are tokenised alike alone and together."""
        bare = word.rstrip(MARKS)
        letters = bare.lower()  # of ASCII letters
        if letters == word:
            return (word,)
        if not (bare.isalpha() or normalize("NFC", bare.decode()).lower().isalpha()):  # a letter may normalise to one with a mark
            return (word,)
        return (letters,) if len(bare) == len(word) else (letters, word[len(bare) :])

    def ask(self, words: list[bytes]) -> None:
        """Words of Latin letters go to the merges as they are, without the library's own normalising and splitting."""
        other = []
        known, merge = self.known, self.tokenizer.model.tokenize
        for w in words:
            letters = w.decode()
            if w.islower() and w.isalpha():
                known[w] = array("I", [t.id for t in merge(letters)]).tobytes()
            elif LATIN.fullmatch(letters := letters.lower()):
                known[w] = array("I", [t.id for t in merge(letters.encode().decode("latin-1").translate(self.letters))]).tobytes()
            else:
                other.append(w)
        self.ask_whole(other)

    def ask_whole(self, words: list[bytes]) -> None:
        """Many words as one text, with a word of one token between them that none of them has."""
        plain = [w for w in words if BETWEEN not in w]
        for i in range(0, len(plain), ASKED):
            some = plain[i : i + ASKED]
            (e,) = self.tokenizer.encode_batch_fast([(b" " + BETWEEN + b" ").join(some).decode()], add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(ids == self.between).tolist()
            if len(ends) != len(some) - 1:
                raise ValueError("the tokenizer joins words")
            whole = ids.tobytes()
            for w, a, b in zip(some, [0, *(x + 1 for x in ends)], [*ends, ids.size], strict=True):
                self.known[w] = whole[4 * a : 4 * b]
        for w in words:
            if BETWEEN in w:
                self.known[w] = np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of PIECES for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = _encoder(tokenizer), TaskContext.get().partitionId(), Counter()
        names = [f.split()[0] for f in PIECES.split(", ")]
        for b in batches:
            for i in range(0, b.num_rows, TEXTS):
                some = b.slice(i, TEXTS)
                out: list[tuple] = []
                for d, ids in zip(some.column(0).to_pylist(), encoder.encode([t or "" for t in some.column(1).to_pylist()]), strict=True):
                    ids += END_ID.to_bytes(4, "little")
                    for k in range(0, len(ids) // 4, max_tokens):
                        one = ids[4 * k : 4 * (k + max_tokens)]
                        n = len(one) // 4
                        out.append((d, k // max_tokens, k, n, zlib.crc32(one), part, seen[n]))
                        seen[n] += 1
                types = [pa.int32() if f.endswith("int") else pa.int64() for f in PIECES.split(", ")]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, PIECES)


def knapsack(weights: np.ndarray, sizes: np.ndarray, room: int) -> Counter:
    """How often each item is taken for the greatest weight in a room of so many steps."""
    best, taken = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(sizes, kind="stable")
    w, s = weights[order], sizes[order]
    fits = np.searchsorted(s, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if n := fits[c]:
            value = best[c - s[:n]] + w[:n]
            k = int(value.argmax())
            if value[k] > best[c]:
                best[c], taken[c] = value[k], k
    out, c = Counter(), room
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            out[int(order[taken[c]])] += 1
            c -= int(s[taken[c]])
    return out


def classes(lengths: np.ndarray, counts: np.ndarray, most: int = CLASSES) -> list[np.ndarray]:
    """Neighbouring lengths, as indices, that hold about equally many tokens."""
    tokens = np.cumsum(lengths * counts)
    of = np.minimum((tokens - 1) * most // max(1, tokens[-1]), most - 1) if len(tokens) else tokens
    return [np.flatnonzero(of == k) for k in np.unique(of)]


def patterns(lengths: np.ndarray, counts: np.ndarray, max_tokens: int, rounds: int = ROUNDS) -> tuple[list[np.ndarray], dict[tuple, float]]:
    """The classes as indices of lengths, and how many sequences of each pattern ((class, times), ...) the fractional solution has."""
    groups = classes(lengths, counts)
    if not groups:
        return [], {}
    grain = -(-max_tokens // STEPS)
    room = max_tokens // grain
    sizes = np.array([min(room, -(-int(lengths[g].max()) // grain)) for g in groups])
    demand = np.array([counts[g].sum() for g in groups], float)
    sequences = max(1.0, (sizes * demand).sum() / room)
    share = demand / sequences  # of a class in the average sequence
    log_w, served, found = np.zeros(len(groups)), np.zeros(len(groups)), Counter()
    for t in range(1, rounds + 1):
        p = knapsack(sizes * np.exp(log_w - log_w.max()), sizes, room)
        found[tuple(sorted(p.items()))] += 1
        for k, n in p.items():
            served[k] += n
        log_w = -RATE * (served / share - t) / np.sqrt(1 + t * RATE)
        log_w = np.clip(log_w, -30, 30)
    return groups, {p: n * sequences / rounds for p, n in found.items()}


class Plan:
    """Sequences of a few kinds: a kind is its lengths and how many sequences are of it."""

    def __init__(self, max_tokens: int) -> None:
        self.max_tokens, self.full = max_tokens, []
        self.open: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)
        self.rooms: list[int] = []

    def add(self, kind: dict[int, int], times: int) -> None:
        if times <= 0:
            return
        room = self.max_tokens - sum(k * n for k, n in kind.items())
        if room not in self.open:
            insort(self.rooms, room)
        self.open[room].append((kind, times))

    def _pop(self, room: int) -> tuple[dict[int, int], int]:
        kinds = self.open[room]
        one = kinds.pop()
        if not kinds:
            del self.open[room]
            self.rooms.pop(bisect_left(self.rooms, room))
        return one

    def best_fit(self, length: int, count: int) -> None:
        """Place pieces where they leave the least room; in a sequence with room for several, that is for all of them."""
        while count:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = self.max_tokens // length
                self.add({length: each}, count // each)
                self.add({length: count % each}, int(count % each > 0))
                return
            room = self.rooms[at]
            kind, times = self._pop(room)
            each = room // length
            whole = min(times, count // each)
            self.add(kind | {length: kind.get(length, 0) + each}, whole)
            count -= whole * each
            times -= whole
            if times and count < each and count:
                self.add(kind | {length: kind.get(length, 0) + count}, 1)
                times, count = times - 1, 0
            self.add(kind, times)

    def kinds(self) -> Iterator[tuple[dict[int, int], int]]:
        for room in self.rooms:
            yield from self.open[room]


def plan(histogram: dict[int, int], max_tokens: int = MAX_TOKENS, short: tuple[float, ...] = SHORT, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Kinds of sequences and their numbers, which hold every piece of the histogram."""
    tried = [_plan(histogram, max_tokens, int(max_tokens * s), rounds) for s in short]
    return min(tried, key=lambda kinds: sum(n for _, n in kinds))


def _plan(histogram: dict[int, int], max_tokens: int, small: int, rounds: int) -> list[tuple[dict[int, int], int]]:
    left = {k: n for k, n in histogram.items() if n}
    out = Plan(max_tokens)
    large = np.array(sorted(k for k in left if k > small), np.int64)
    groups, solved = patterns(large, np.array([left[int(k)] for k in large], np.int64), max_tokens, rounds)
    queues = [[int(k) for k in large[g]] for g in groups]  # of each class, longest last
    for pattern, x in sorted(solved.items(), key=lambda p: -p[1]):
        _round_down(out, _open(pattern), int(x), queues, left)
    for length in sorted(left, reverse=True):
        out.best_fit(length, left[length])
    return list(out.kinds())


def _open(pattern: tuple) -> tuple:
    """The pattern without one piece of its shortest class: best fit fills that room by real lengths, closer than a class can."""
    (k, n), *rest = pattern
    return tuple(rest) if n == 1 else ((k, n - 1), *rest)


def _round_down(out: Plan, pattern: tuple, times: int, queues: list[list[int]], left: dict[int, int]) -> None:
    """Sequences of one pattern, with real lengths for its classes, as long as there are pieces."""
    while times > 0:
        pick: Counter = Counter()
        for k, n in pattern:
            queue = queues[k]
            at = len(queue) - 1
            while n and at >= 0:  # the longest lengths that are left; several where one runs out
                took = min(n, left.get(queue[at], 0))
                if took:
                    pick[queue[at]] += took
                n -= took
                at -= 1
        if not pick:
            return
        same = min(times, *(left[k] // n for k, n in pick.items()))
        out.add(dict(pick), same)
        times -= same
        for length, n in pick.items():
            left[length] -= n * same
            if not left[length]:
                del left[length]
        for k, _ in pattern:
            while queues[k] and queues[k][-1] not in left:
                queues[k].pop()


def places(kinds: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys of a length's first number, rows: first number, pieces in a sequence, first sequence, offset)."""
    used, rows, keys, sequence = Counter(), [], [], 0
    for kind, times in kinds:
        offset = 0
        for length, n in sorted(kind.items(), reverse=True):
            keys.append((length << 44) + used[length])
            rows.append((used[length], n, sequence, offset))
            used[length] += n * times
            offset += n * length
        sequence += times
    order = np.argsort(np.array(keys, np.int64))
    return np.array(keys, np.int64)[order], np.array(rows, np.int64).reshape(-1, 4)[order]


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece with its sequence and its place there, as RESULT has it."""
    found = cut(pieces(docs, tokenizer, max_tokens, doc_id, text))
    by_task = cut(found.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # max_tokens rows at most
    keys, rows = places(plan(histogram, max_tokens))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_task = by_task.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = found.join(by_task, ["length", "part"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = b.column(3).to_numpy(), b.column(5).to_numpy()
            first, each, sequence, offset = rows[np.searchsorted(keys, (length << 44) + number, side="right") - 1].T
            of = number - first
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence + of // each), pa.array(offset + of % each * length)], [f.split()[0] for f in RESULT.split(", ")])

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("number")).mapInArrow(place, RESULT)
