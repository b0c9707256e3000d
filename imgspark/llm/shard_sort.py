"""Sharding by histogram sort.

Documents are ordered by a key made of a hash of the text and the doc_id, so equal texts stand together and a group of them
may still be cut anywhere. Splitters are sought that cut the order into shards of near equal bytes: candidate boundaries
are laid over the keys, the exact bytes below each of them are counted across all partitions, and for every splitter that
isn't within tolerance the two candidates around its aim become the ends of the next, finer set of candidates. Then each row
is compared with the splitters and the rows are exchanged once. Native: expressions, aggregates and a window only.

A group of equal texts is cut by doc_id only where neither of its ends is within group_tolerance of the aim: near equal bytes
come first, so of groups that weigh a good part of a shard some are cut.

The law is `bytes`. Slots count (hash, doc_id) in order, whatever the size. Where shards hold more than slice_rows rows on
average they are numbered in slices, from the counts of the slices before, so no task orders a whole shard: equal ranges of the
hash, in which each hash of more than slice_rows rows (there are rows / slice_rows of them at most) is cut into equal ranges of
the doc_id.

Defined cases: a null text has no bytes (size 16, checksum 0); a null doc_id stands before all others; rows that are equal
in text and doc_id have equal keys and share a shard; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, whole

#: Candidates between two ends, and the bits of the text hash in the key.
PROBES, HASH_BITS = 64, 60
OVERHEAD = 16


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = whole(F.col(text).cast("string"))
    size = F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long") + OVERHEAD
    return docs.select(F.col(doc_id).alias("doc_id"), size.alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.conv(F.substring(F.md5(t.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long").alias("h"))


def refine(rows: DataFrame, key: Column, aims: list[tuple[int, int]], low: int, high: int, tolerance: int, edge: int = 0) -> dict[int, tuple[int, int, int]]:
    """For each aim (number, bytes) a boundary: number -> (key, bytes below key, bytes below key + 1); keys lie in low..high.
    edge: how far from the aim the boundary may be if it would cut the rows of one key else.

    All aims with equal ends share one set of candidates. The histogram has PROBES rows for each set, so its size is fixed."""
    done: dict[int, tuple[int, int, int]] = {}
    ends = {n: (low, high + 1, 0, None) for n, _ in aims}
    aim = dict(aims)
    while ends:
        spans = sorted({(a, b) for a, b, _, _ in ends.values()})
        width = {a: max(1, -(-(b - a) // PROBES)) for a, b in spans}
        span = F.lit(None).cast("long")
        step = F.lit(None).cast("long")
        for a, b in reversed(spans):  # at most one set for each splitter
            inside = (key >= a) & (key < b)
            span, step = F.when(inside, F.lit(a)).otherwise(span), F.when(inside, F.lit(width[a])).otherwise(step)
        probed = rows.select(span.alias("a"), step.alias("w"), key.alias("k"), "size").filter(F.col("a").isNotNull())
        counts = {(r.a, r.i): (r.bytes, r.n) for r in probed.groupBy("a", F.expr("(k - a) div w").alias("i")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}
        following = {}
        for n, (a, b, below, _) in ends.items():
            at = a
            i = 0
            while True:
                here, n_rows = counts.get((a, i), (0, 0))
                if below + here >= aim[n] or at + width[a] >= b:
                    break
                below, at, i = below + here, at + width[a], i + 1
            top = min(b, at + width[a])
            if aim[n] - below <= tolerance:
                done[n] = (at, below, below)
            elif below + here - aim[n] <= tolerance and top < b:
                done[n] = (top, below + here, below + here)
            elif n_rows == 1 and top < b or top - at <= 1 and min(aim[n] - below, below + here - aim[n]) <= edge:
                done[n] = (at, below, below) if 2 * (aim[n] - below) <= here else (top, below + here, below + here)
            elif top - at <= 1:
                done[n] = (at, below, below + here)
            else:
                following[n] = (at, top, below, None)
        ends = following
    return done


def splitters(rows: DataFrame, parts: int, tolerance: float, group_tolerance: float) -> list[tuple[int, int | None]]:
    """parts - 1 boundaries (h, doc_id): a row is at or above one if its h is larger, or equal and its doc_id not smaller. doc_id null: any."""
    total, low, high = rows.agg(F.sum("size"), F.min("h"), F.max("h")).first()
    if not total:
        return []
    slack = int(total / parts * tolerance)
    aims = [(n, total * n // parts) for n in range(1, parts)]
    found = refine(rows, F.col("h"), aims, low, high, slack, int(total / parts * group_tolerance))
    out = {n: (h, None) for n, (h, below, above) in found.items()}
    within: dict[int, list[int]] = {}
    for n, (h, below, above) in found.items():
        if above > below:  # one hash holds more than the tolerance: cut it by doc_id
            within.setdefault(h, []).append(n)
    for h, numbers in within.items():
        group = rows.filter((F.col("h") == h) & F.col("doc_id").isNotNull())
        first, last = group.agg(F.min("doc_id"), F.max("doc_id")).first()
        if first is None:
            continue
        loose = rows.filter((F.col("h") == h) & F.col("doc_id").isNull()).agg(F.sum("size")).first()[0] or 0
        inner = refine(group, F.col("doc_id"), [(n, max(0, total * n // parts - found[n][1] - loose)) for n in numbers], first, last, slack)
        out |= {n: (h, k) for n, (k, _, _) in inner.items()}
    return [out[n] for n in sorted(out)]


def sliced(rows: DataFrame, shards: int, n_rows: int, slice_rows: int) -> DataFrame:
    """rows with `part`, slices of the order (h, doc_id)."""
    slices = -(-n_rows // (shards * slice_rows))
    tall = -(-(1 << HASH_BITS) // (shards * slices))
    rows = rows.withColumn("_a", F.expr(f"h div {tall}L"))
    hot = cut(rows.groupBy("h", "_a").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter(F.col("n") > slice_rows))
    wide = F.greatest(F.lit(1).cast("long"), F.ceil((F.col("last") - F.col("first") + 1) / F.ceil(F.col("n") / slice_rows)).cast("long"))
    hot = hot.groupBy("_a").agg(F.sort_array(F.collect_list(F.struct("h", "first", wide.alias("wide")))).alias("_hot"))
    rows = rows.join(F.broadcast(hot), "_a", "left")
    own = F.get(F.filter("_hot", lambda x: x["h"] == F.col("h")), F.lit(0))
    rows = rows.withColumns({"_own": own, "_below": F.coalesce(F.size(F.filter("_hot", lambda x: x["h"] < F.col("h"))), F.lit(0))})
    place = F.when(F.col("_own").isNotNull(), F.coalesce(F.expr("(doc_id - _own.first) div _own.wide"), F.lit(-1).cast("long"))).otherwise(0)
    part = F.struct(F.col("_a").alias("a"), F.col("_below").alias("below"), F.col("_own").isNotNull().alias("hot"), place.alias("place"))
    return rows.withColumn("part", part).drop("_a", "_hot", "_own", "_below")


def shard_sort(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 40, tolerance: float = 0.005, group_tolerance: float = 0.01, slice_rows: int = 1_000_000
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row of docs."""
    rows = cut(keyed(docs, doc_id, text))
    n_rows = rows.count()
    above = [(F.col("h") > h) | (F.col("h") == h) & (F.lit(True) if k is None else F.coalesce(F.col("doc_id") >= k, F.lit(False))) for h, k in splitters(rows, shards, tolerance, group_tolerance)]
    shard = F.lit(0)
    for x in above:
        shard = shard + x.cast("int")
    rows = rows.select("doc_id", "size", "text_crc32", "h", shard.alias("shard"))
    order = lambda *keys: F.row_number().over(Window.partitionBy("shard", *keys).orderBy("h", "doc_id")) - 1
    if n_rows <= shards * slice_rows:
        placed = rows.withColumn("slot", order())
    else:
        rows = sliced(rows, shards, n_rows, slice_rows)
        starts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        starts = starts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        placed = rows.withColumn("slot", order("part")).join(starts, ["shard", "part"]).withColumn("slot", F.col("slot") + F.col("start"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
