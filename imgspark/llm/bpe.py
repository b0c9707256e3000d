"""Byte-level BPE, by speculation and verification.

A word is first covered greedily by the longest tokens. The cover is the encoding exactly if no merge ever crosses one of
its inner borders. Whether one does is settled for each adjacent pair of tokens by itself: along a border only the right
edges of the left token's merge tree and the left edges of the right token's tree ever stand, each from the rank that forms
it until the rank that takes it into its parent, so a crossing merge needs two such nodes that stand at its rank. All pairs
of a block of words are tested at once with array look-ups; only words with a crossing pair are merged step by step.

Defined cases: a null text counts as empty and has no ids; the special token's own string in a text becomes its id, as the
library has it; texts may be of any length (they are worked through in chunks of words, the digests are running ones);
repeated rows and an empty table need no care, there is no shuffle; further columns are carried along, those named like a
result column are replaced.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import batched

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the splitting pattern of this kind of tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where two Unicode versions may class a character differently, the library's own splitter is asked.
UNSURE = regex.compile(r"[^\x00-՗ؠ-يऄ-हก-ฮḀ-ỿ‐-⁤₠-₹℀-⅏←-⏿─-➿ぁ-ゖァ-ヺ一-鿌가-힣！-ﾟ\U0001f300-\U0001f5ff]")
NEVER = np.int64(1) << 40
CHUNK_WORDS = 1 << 17
CACHE_WORDS = 500_000
BLOCK_CHARS = 1 << 20
WIDE = 48


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes: printable ones for themselves, the others for letters from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """Tables of one tokenizer file, and a cache of encoded words."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.by_bytes = {self.bytes[i]: i for i in vocab.values()}
        left, right, self.rank = (np.full(self.size, -1, np.int64) for _ in range(3))
        for r, (a, b) in enumerate(merges):
            whole = vocab[a + b]
            if self.rank[whole] >= 0 or max(self.rank[vocab[a]], self.rank[vocab[b]]) >= r:
                raise ValueError("a token with two merges, or merged before its parts")
            left[whole], right[whole], self.rank[whole] = vocab[a], vocab[b], r
        made = np.nonzero(self.rank >= 0)[0]
        keys = left[made] * self.size + right[made]
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], self.rank[made][order]
        self.made_at = np.zeros(len(merges), np.int64)
        self.made_at[self.rank[made]] = made
        self.merge = dict(zip(self.keys.tolist(), made[order].tolist(), strict=True))
        self.right_edge, self.left_edge = self.edge(right), self.edge(left)
        whole = np.ones(self.size, bool)  # tokens that their own bytes encode to; others are never proposed
        whole[made] = self.crossing(left[made], right[made], self.rank[made]) == self.rank[made]
        for i in made[np.argsort(self.rank[made])].tolist():
            whole[i] &= whole[left[i]] and whole[right[i]]
        self.propose = {b: i for b, i in self.by_bytes.items() if whole[i]}
        self.longest = max(map(len, self.propose))
        self.split, self.cache = regex.compile(PATTERN), {}
        self.at_special = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.path, self.library = path, None

    def edge(self, child: np.ndarray) -> np.ndarray:
        """Row i: token i, its child, that one's child, ...; -1 after the last."""
        columns, now = [], np.arange(self.size)
        while (now >= 0).any():
            columns.append(now)
            now = np.where(now >= 0, child[now], -1)
        return np.stack(columns, axis=1)

    def crossing(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """The first rank at which a merge crosses the border of a and b, NEVER if none does. until: both tokens stand so long."""
        end = np.full(len(a), NEVER) if until is None else until + 1
        first = np.full(len(a), NEVER)
        xs, ys = self.right_edge[a], self.left_edge[b]
        for i in range(xs.shape[1]):
            x = xs[:, i]
            if not (x >= 0).any():
                break
            gone_x = end if i == 0 else self.rank[xs[:, i - 1]]
            for j in range(ys.shape[1]):
                y = ys[:, j]
                k = np.nonzero((x >= 0) & (y >= 0))[0]
                if not len(k):
                    break
                key = x[k] * self.size + y[k]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                k, r = k[hit], self.key_rank[at[hit]]
                gone_y = end[k] if j == 0 else self.rank[ys[k, j - 1]]
                # of two merges of one rank the left one comes first
                stands = (r < gone_x[k]) & ((r < gone_y) if j == 0 else (r <= gone_y))
                first[k[stands]] = np.minimum(first[k[stands]], r[stands])
        return first

    def exact(self, word: bytes) -> list[int]:
        """Merging step by step: the lowest rank first, of equal ones the leftmost. A heap of pairs over a linked list, so
        a word of n bytes takes n log n steps."""
        ids = [self.by_bytes[word[i : i + 1]] for i in range(len(word))]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < n:
                made = self.merge.get(ids[i] * self.size + ids[j], -1)
                if made >= 0:
                    heappush(heap, (int(self.rank[made]), i, j, made))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, made = heappop(heap)
            # -1 stands for a token that was taken in; a pair whose tokens have changed merges into something else
            if ids[i] < 0 or after[i] != j or self.merge.get(ids[i] * self.size + ids[j], -1) != made:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return [x for x in ids if x >= 0]

    def exact_many(self, words: list[bytes]) -> list[list[int]]:
        """exact() for words of up to WIDE bytes at once: in each round every row makes its next merge."""
        n, width = len(words), max(map(len, words))
        lens = np.fromiter(map(len, words), np.int64, n)
        byte_ids = np.array([self.by_bytes[bytes([i])] for i in range(256)])
        ids = np.full((n, width), -1, np.int64)
        ids[np.arange(width) < lens[:, None]] = byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full((n, width), NEVER)  # of the pair that begins here
        rank[:, :-1] = self.pair_rank(ids[:, :-1], ids[:, 1:])
        rows, out, place = np.arange(n), [None] * n, np.arange(width)
        while True:
            at = rank.argmin(axis=1)  # the leftmost of the lowest
            k = np.arange(len(rows))
            go = rank[k, at] < NEVER
            for i in np.nonzero(~go)[0].tolist():
                out[rows[i]] = ids[i][ids[i] >= 0].tolist()
            if not go.any():
                return out
            rows, ids, rank, at = rows[go], ids[go], rank[go], at[go]
            k = np.arange(len(rows))
            ids[k, at] = self.made_at[rank[k, at]]
            after = np.minimum(place + (place > at[:, None]), width - 1)
            last = ids[:, -1].copy()
            ids, rank = np.take_along_axis(ids, after, 1), np.take_along_axis(rank, after, 1)
            ids[:, -1] = np.where(at == width - 1, last, -1)
            rank[:, -1] = NEVER
            following = ids[k, np.minimum(at + 1, width - 1)]
            rank[k, at] = np.where(at + 1 < width, self.pair_rank(ids[k, at], following), NEVER)
            before = np.maximum(at - 1, 0)
            rank[k, before] = np.where(at > 0, self.pair_rank(ids[k, before], ids[k, at]), rank[k, before])

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = np.where((a >= 0) & (b >= 0), a * self.size + b, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], NEVER)

    def greedy(self, word: bytes) -> list[int]:
        out, i, find, n = [], 0, self.propose.get, len(word)
        while i < n:
            j = min(n, i + self.longest)
            while (token := find(word[i:j])) is None:
                j -= 1
            out.append(token)
            i = j
        return out

    def learn(self, words: list[str]) -> int:
        """Put these words into the cache, as packed ids; the count of those that had to be merged exactly."""
        raw = [w.encode() for w in words]
        covers = [self.greedy(w) for w in raw]
        lens = np.fromiter(map(len, covers), np.int64, len(covers))
        flat = np.fromiter((t for c in covers for t in c), np.int64, int(lens.sum()))
        of = np.repeat(np.arange(len(covers)), lens)
        inner = np.nonzero(of[1:] == of[:-1])[0]
        pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        bad = (self.crossing(pairs // self.size, pairs % self.size) < NEVER)[back]
        failing = np.unique(of[inner[bad]]).tolist()
        short = [i for i in failing if len(raw[i]) <= WIDE]
        for some in (short[j : j + 2048] for j in range(0, len(short), 2048)):
            for i, c in zip(some, self.exact_many([raw[i] for i in some]), strict=True):
                covers[i] = c
        for i in failing:
            if len(raw[i]) > WIDE:
                covers[i] = self.exact(raw[i])
        packed = np.fromiter((t for c in covers for t in c), "<u4").tobytes()
        ends = (4 * np.cumsum([len(c) for c in covers])).tolist()
        self.cache.update((w, packed[a:b]) for w, a, b in zip(words, [0, *ends], ends, strict=False))
        return len(failing)

    def word_lists(self, text: str) -> Iterator[list[str]]:
        if UNSURE.search(text):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path).pre_tokenizer
            yield from map(list, batched((text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)), CHUNK_WORDS))
        elif len(text) <= 4 * CHUNK_WORDS:
            yield self.split.findall(text)
        else:
            yield from map(list, batched((m.group() for m in self.split.finditer(text)), CHUNK_WORDS))

    def pieces(self, text: str) -> Iterator[list[str] | int]:
        """Lists of words, and the ids of special tokens between them."""
        at = 0
        for m in self.at_special.finditer(text):
            yield from self.word_lists(text[at : m.start()])
            yield self.special[m.group()]
            at = m.end()
        yield from self.word_lists(text[at:] if at else text)

    def know(self, lists: list[list[str]]) -> None:
        """Have all words of these lists in the cache."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        if new := list(dict.fromkeys(w for words in lists for w in words if w not in self.cache)):
            self.learn(new)

    def pack(self, piece: list[str] | int) -> bytes:
        return np.array([piece], "<u4").tobytes() if isinstance(piece, int) else b"".join(map(self.cache.__getitem__, piece))

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids in pieces, packed as little-endian unsigned 32-bit integers."""
        for piece in self.pieces(text):
            if not isinstance(piece, int):
                self.know([piece])
            yield self.pack(piece)

    def encode_all(self, texts: list[str]) -> Iterator[Iterator[bytes]]:
        """encode() of each text; short texts are learned in blocks, so that the pairs of many words are tested at once."""
        block, chars = [], 0
        for text in texts:
            if chars + len(text) > BLOCK_CHARS and block:
                yield from self.block(block)
                block, chars = [], 0
            if len(text) > BLOCK_CHARS:
                yield self.encode(text)
            else:
                block.append(text)
                chars += len(text)
        yield from self.block(block)

    def block(self, texts: list[str]) -> Iterator[Iterator[bytes]]:
        split = [list(self.pieces(t)) for t in texts]
        self.know([p for pieces in split for p in pieces if not isinstance(p, int)])
        for pieces in split:
            yield map(self.pack, pieces)

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def _digests(b: Bpe, encoded: Iterator[bytes]) -> tuple[int, str, str]:
    ids, decoded, n = hashlib.sha256(), hashlib.sha256(), 0
    for piece in encoded:  # pieces end with words, so with whole characters
        n += len(piece) // 4
        ids.update(piece)
        decoded.update(b.decode(piece).encode())
    return n, ids.hexdigest(), decoded.hexdigest()


def bpe_digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Every row with n_tokens, ids_sha256 and decoded_sha256."""
    keep = [c for c in docs.columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256")]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bpe(path)
        for batch in batches:
            found = [_digests(b, e) for e in b.encode_all([t.as_py() or "" for t in batch.column(batch.num_columns - 1)])]
            n, ids, decoded = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], [*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("\x00text")).mapInArrow(run, schema)


def bpe_encode(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Every row with its token ids as an array."""
    keep = [c for c in docs.columns if c != into]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(into, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bpe(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [np.frombuffer(b"".join(b.encode(t.as_py() or "")), "<u4").astype(np.int32) for t in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.list_(pa.int32()))], [*keep, into])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("\x00text")).mapInArrow(run, schema)


def bpe_decode(coded: DataFrame, path: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """Every row with the text of its token ids; null ids give an empty text."""
    keep = [c for c in coded.columns if c != into]
    schema = T.StructType([*[coded.schema[c] for c in keep], T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bpe(path)
        for batch in batches:
            texts = [b.decode(np.array(x.as_py() or [], "<u4").tobytes()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*keep, into])

    return coded.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`").alias("\x00ids")).mapInArrow(run, schema)
