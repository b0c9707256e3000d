"""Near-duplicates by SimHash with deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. Of two fingerprints that differ in at most three bits, one half differs in at
most one, so each half is indexed as it is and once per bit position with that bit deleted. Equal signatures are joined,
and each pair is verified on all 64 bits. A pair is found by one signature only: the bit that differs stands as 0 on the
left and as 1 on the right, and the second half is used only where the first differs in two bits or more.

Equal fingerprints are merged before the index, so groups of copies cost one entry. Links go between fingerprints; the
classes come from alternating large-star and small-star steps, each a min-aggregate and a join on checkpointed tables.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and is linked like any other; a row
whose doc_id is null gets the class of its fingerprint, and links like any other; repeated rows each stay; further columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join, whole

BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1))
    stops = ends[min(shingle, len(words)) - 1 :]
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, BLOCK):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[i : i + BLOCK].tolist(), stops[i : i + BLOCK].tolist(), strict=True)], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, with_sha: bool = False) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; with_sha adds the text's SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            sha = [pa.array([hashlib.sha256((t.as_py() or "").encode()).hexdigest() for t in b.column(1)], pa.string())] if with_sha else []
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps.view(np.int64)), *sha], names)

    names = ["doc_id", "fp", "sha"] if with_sha else ["doc_id", "fp"]
    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, fp long" + ", sha string" * with_sha)


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """Pairs a < b of ids whose fingerprints differ in 1 to 3 bits, each once. fps: id and distinct fp."""
    if max_bits > 3:
        raise ValueError("two halves serve up to three bits")
    half = F.when(F.col("k") < 33, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(0xFFFFFFFF))
    rows = fps.select("id", "fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("k")).select("id", "fp", "k", (F.col("k") % 33).alias("at"), half.alias("half"))
    bit = F.when(F.col("at") < 32, F.expr("shiftleft(1L, at)")).otherwise(F.lit(0).cast("long"))
    rows = rows.select("id", "fp", "k", "at", bit.alias("bit"), "half").select(
        "id", "fp", "k", F.col("half").bitwiseAND(F.bitwise_not("bit")).alias("rest"), (F.col("at") == 32).alias("as_is"), (F.col("half").bitwiseAND(F.col("bit")) != 0).alias("one")
    )
    a = rows.filter("as_is or not one").select(F.col("id").alias("a"), F.col("fp").alias("fa"), "k", "rest")
    b = rows.filter("as_is or one").select(F.col("id").alias("b"), F.col("fp").alias("fb"), "k", "rest", "as_is")
    verified = (
        f"bit_count(fa ^ fb) <= {max_bits} and (not as_is or fa < fb)"
        " and (left.k < 33 or bit_count(shiftrightunsigned(fa ^ fb, 32)) > 1)"
    )
    return (
        a.alias("left").join(b.alias("right"), (F.col("left.k") == F.col("right.k")) & (F.col("left.rest") == F.col("right.rest")) & F.expr(verified))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )


def components(edges: DataFrame) -> DataFrame:
    """id and root, the smallest id reachable, for every id that stands in an edge (a, b)."""
    e = cut(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u < v").distinct())
    known = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("m").alias("u"), "v").filter("u < v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select("u", "v", "m")
        e = cut(small.select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).filter("u < v").distinct())
        seen = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v"))).first()
        if seen == known:
            return e.select(F.col("v").alias("id"), F.col("u").alias("root")).unionByName(e.select(F.col("u").alias("id"), F.col("u").alias("root")).distinct())
        known = seen


def classes(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """fp, n (rows that have it), id (their smallest doc_id) and component_id for every fingerprint of prints (doc_id, fp)."""
    fps = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")))
    # fingerprints are the nodes, so that one without any doc_id links its neighbours; min() passes over nulls
    roots = cut(components(links(fps.select(F.col("fp").alias("id"), "fp"), max_bits)).withColumnRenamed("id", "fp"))
    low = fps.join(roots, "fp").groupBy("root").agg(F.min("id").alias("component_id"))
    owner = fps.join(roots.join(low, "root"), "fp", "left")
    return cut(owner.select("fp", "n", "id", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "id").alias("component_id")))


def simhash_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """doc_id, fp and component_id for every row of docs."""
    prints = cut(fingerprints(docs, doc_id, text, shingle))
    return hot_join(prints, classes(prints, max_bits).select("fp", "n", "component_id"), "fp", "n", F.col("doc_id")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class stays: that of the smallest doc_id (none comes last), then fingerprint, then digest of the text.

    Rows are told apart by doc_id and text, so a doc_id that repeats with an unrelated text loses nothing, and near copies
    under one doc_id are one class like any others; of rows that repeat in both one stays. All columns are handed on."""
    sha = F.sha2(whole(F.col(text).cast("string")).cast("binary"), 256)
    key = F.struct(F.col(doc_id).isNull().alias("none"), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("id"), sha.alias("sha"))
    prints = fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), with_sha=True)
    rows = cut(prints.groupBy("doc_id", "fp", "sha").agg(F.count(F.lit(1)).alias("copies")))
    known = classes(rows.select("doc_id", "fp")).select("fp", "n", "root")
    one = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "fp", "sha")
    rows = cut(hot_join(rows, known, "fp", "n", F.col("sha")).drop("n").withColumn("one", one))
    first = cut(rows.groupBy("root").agg(F.min("one").alias("first"), F.count(F.lit(1)).alias("n")))
    met = hot_join(rows, first, "root", "n", F.col("sha"))
    odd = met.filter("one != first or copies > 1").select(F.struct("one.none", "one.id", "one.sha").alias("_key"), (F.col("one") == F.col("first")).alias("_stays"))
    odd = cut(odd)
    marked = docs.select(F.struct("*").alias("row"), key.alias("_key"))
    single = marked.join(odd.select("_key"), "_key", "left_anti").select("row.*")
    repeated = marked.join(odd.filter("_stays").select("_key"), "_key", "left_semi").groupBy("_key").agg(F.first("row").alias("row")).select("row.*")
    return single.unionByName(repeated)
