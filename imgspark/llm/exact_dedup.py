"""Exact duplicates by Patricia tries.

Each map task first puts its own texts into a trie, so a text leaves a task once however often it occurs there. The
distinct texts then go, by byte length and content hash, to partitions that insert the full byte strings into compressed
radix tries again. A terminal node keeps the identifier that stays (the largest by default, as the query's contract asks;
keep="smallest" for the smallest) and the count of rows. A trie that outgrows its memory is spilled by subtree: a map task
sends what it has; behind the exchange Spark sorts the texts of a partition, so all subtrees beside the path of the text at hand
are complete and are given out. No task writes files of its own.

Defined cases: a null text counts as empty; a row whose doc_id is null is counted but never stays while another of its
group has one, and one of them stays if none has; of repeated rows (equal doc_id and text) one stays; further columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join, whole

TRIE_BYTES = 48 << 20
OUT_ROWS = 512


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by bisection over slices."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Node:
    __slots__ = ("edge", "children", "best", "count")

    def __init__(self, edge: bytes):
        self.edge, self.children, self.best, self.count = edge, {}, None, 0


class Patricia:
    """A compressed radix trie of byte strings; a terminal node has a count above zero. held: about how many bytes it takes."""

    def __init__(self, better):
        self.root, self.better, self.held = Node(b""), better, 0

    def insert(self, key: bytes, ident: int | None, count: int = 1) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.held += len(child.edge) + 200
                node, at = child, len(key)
            elif key.startswith(child.edge, at):
                node, at = child, at + len(child.edge)
            else:
                n = common_prefix(child.edge, key[at : at + len(child.edge)])
                middle = Node(child.edge[:n])
                child.edge = child.edge[n:]
                middle.children[child.edge[0]] = child
                node.children[key[at]] = middle
                self.held += 200
                node, at = middle, at + n
        node.best = ident if node.count == 0 else self.better(node.best, ident)
        node.count += count

    def items(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Every distinct string with its identifier and count."""
        stack = [(self.root, b"")]
        while stack:
            node, prefix = stack.pop()
            if node.count:
                yield prefix, node.best, node.count
            stack += [(c, prefix + c.edge) for c in node.children.values()]

    def spill(self, key: bytes) -> Iterator[tuple[bytes, int | None, int]]:
        """Give out every subtree beside the path of key, and the strings on it, until key alone is left."""
        node, at, stay = self.root, 0, None
        while node is not None:
            if at == len(key):
                stay = node
            elif node.count:
                yield key[:at], node.best, node.count
            following = node.children.pop(key[at], None) if at < len(key) else None
            part = Patricia(self.better)
            part.root.children = node.children
            yield from ((key[:at] + k, best, n) for k, best, n in part.items())
            node, at = following, at + len(following.edge) if following else at
        self.root, self.held = Node(b""), 0
        if stay:
            self.insert(key, stay.best, stay.count)


def better(keep: str):
    pick = {"largest": max, "smallest": min}[keep]
    return lambda a, b: b if a is None else a if b is None else pick(a, b)


def _owners(rows: Iterator[tuple[bytes, int | None, int]], keep: str, limit: int, ordered: bool) -> Iterator[tuple[bytes, int | None, int]]:
    """Distinct texts of rows. Above limit bytes the trie is given out: if equal texts come together each text once, else
    once for each time that it fills."""
    trie = Patricia(better(keep))
    for key, ident, n in rows:
        trie.insert(key, ident, n)
        if trie.held > limit and (not ordered or trie.held > len(key) + 200):
            if ordered:
                yield from trie.spill(key)
            else:
                yield from trie.items()
                trie = Patricia(better(keep))
    yield from trie.items()


def _merge(keep: str, limit: int, local: bool):
    """A task: (doc_id, text bytes, count) in, one row for each distinct text out. local: rows in any order, texts go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = ((text.as_py(), ident.as_py(), n.as_py()) for b in batches for ident, text, n in zip(*b.columns[:3], strict=True))
        rows, held = [], 0
        for key, best, n in _owners(given, keep, limit, not local):
            rows.append((len(key), hashlib.sha256(key).hexdigest(), key if local else None, best, n))
            held += len(key) if local else 0
            if len(rows) == OUT_ROWS or held > 8 << 20:
                yield _batch(rows, local)
                rows, held = [], 0
        if rows:
            yield _batch(rows, local)

    return run


def _batch(rows: list[tuple], texts_out: bool) -> pa.RecordBatch:
    n, sha, text, best, count = zip(*rows, strict=True)
    columns = {"n_bytes": pa.array(n, pa.int64()), "sha": pa.array(sha, pa.string()), "keep_id": pa.array(best, pa.int64()), "size": pa.array(count, pa.int64())}
    return pa.RecordBatch.from_pydict(columns | ({"text": pa.array(text, pa.binary())} if texts_out else {}))


def text_owners(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "largest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row for each distinct text: n_bytes, sha, keep_id, size."""
    rows = docs.select(F.col(doc_id).cast("long"), whole(F.col(text).cast("string")).cast("binary"), F.lit(1).cast("long"))
    local = rows.mapInArrow(_merge(keep, trie_bytes, True), "n_bytes long, sha string, keep_id long, size long, text binary")
    # equal texts come together, so a full trie lets go of what it has; Spark's sorter holds the rest
    dealt = local.repartition("n_bytes", "sha").select("keep_id", "text", "size").sortWithinPartitions("text")
    return dealt.mapInArrow(_merge(keep, trie_bytes, False), "n_bytes long, sha string, keep_id long, size long")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "largest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of docs."""
    owners = cut(text_owners(docs, doc_id, text, keep, trie_bytes)).select(F.col("sha").alias("text_sha256"), "keep_id", F.col("size").alias("group_size"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _sha(F.col(text)).alias("text_sha256"))
    rows = rows.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    met = hot_join(rows, owners, "text_sha256", "group_size", F.col("doc_id"))
    met = met.select("doc_id", "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.lit(1), "_n")).alias("_copy"))
    return met.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"), "text_sha256")


def keep_owners(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of docs that stay, one for each text. A doc_id that repeats with another text is told apart by that text."""
    ident = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    owners = text_owners(docs, doc_id, text, keep).select(ident(F.col("keep_id")).alias("_id"), F.col("sha").alias("_sha"))
    rows = docs.select(F.struct("*").alias("row"), ident(F.col(doc_id).cast("long")).alias("_id"), _sha(F.col(text)).alias("_sha"))
    return rows.join(owners, ["_id", "_sha"], "left_semi").dropDuplicates(["_id", "_sha"]).select("row.*")


def _sha(text: Column) -> Column:
    return F.sha2(whole(text.cast("string")).cast("binary"), 256)
