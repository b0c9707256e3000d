"""Line dedup by a log-template tree of fixed depth.

A line is parsed by its token count, then by its `depth` leading tokens, which lead to a leaf of the tree; tokens with a digit in
them are variable fields and become a wildcard at once. In a leaf, a token is constant at its position if min_docs pairs of document
and line have it there, and a variable field else; so lines that differ in names, words or URLs meet in one template. A line
belongs to its template if a share of `similarity` of its tokens is constant. Templates that occur in min_docs documents or more
are dropped everywhere but in the first document that has them. Native: expressions, aggregates and joins only.

All lines are shuffled once, as hashes, to count the leaves. What follows regards the lines of leaves that min_docs lines reach:
tokens are counted on different lines, each weighted by its documents, so a line that all documents share is taken apart once.
Such a line is a row with one hash for each token; counts of places are exchanged, and only the places that are constant come
back to the lines. What is exchanged for each token is its place and its line's hash, no more.
Texts move once, to meet their dropped line numbers. Joins on what may be hot go through hot_join.

Defined cases: a null text counts as empty; lines without a token are never dropped; lines shorter than min_tokens tokens
stay; documents are told apart by doc_id and a 64-bit hash of it and the text, so repeated rows count once and lose the same
lines; a null doc_id counts as the last one; texts and lines may be of any length; further columns are carried along, those named like a
result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, carried, cut, hot_join, unpacked, whole

WILDCARD = "<*>"
#: Tables of so many rows of a few hashes each are broadcast.
SMALL = 300_000


def template(line: Column) -> Column:
    """The masked line: tokens parted by one space, those with a digit as wildcards."""
    spaced = F.translate(F.btrim(line, F.lit(BLANKS)), BLANKS, " " * len(BLANKS))
    tokens = F.when(F.contains(spaced, F.lit("  ")), F.regexp_replace(spaced, " +", " ")).otherwise(spaced)
    digits = F.translate(tokens, "0123456789", "") != tokens
    return F.when(digits, F.regexp_replace(tokens, "[^ 0-9]*+[0-9][^ ]*+", WILDCARD)).otherwise(tokens)


def path_key(line: Column, depth: int = 2) -> Column:
    """The path through the tree as a struct: token count, hash of the leaf (count, leading tokens), hash of the masked line."""
    masked = template(line)
    n = F.length(masked) - F.length(F.translate(masked, " ", "")) + 1
    return F.struct(n.alias("n"), F.xxhash64(n, F.substring_index(masked, " ", depth)).alias("leaf"), F.xxhash64(masked, F.lit(depth)).alias("line"))


def _lines_of_full_leaves(lined: DataFrame, min_docs: int) -> DataFrame:
    leaves = cut(lined.groupBy("leaf").agg(F.count(F.lit(1)).alias("in_leaf")).filter(F.col("in_leaf") >= min_docs))
    return hot_join(lined, leaves, "leaf", "in_leaf", F.col("u")).filter("in_leaf is not null").drop("in_leaf")


def _each_once(given: DataFrame) -> DataFrame:
    """One row for each line: a repeated document gives its lines as often as it stands there, and those alone are brought together."""
    again = cut(given.groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("line"))
    if again.isEmpty():
        return given
    columns = [c for c in given.columns if c != "line"]
    repeated = given.join(again, "line", "left_semi").groupBy("line").agg(*[F.first(c).alias(c) for c in columns])
    return cut(given.join(again, "line", "left_anti").unionByName(repeated))


def _templates(rows: DataFrame, lined: DataFrame, min_docs: int, similarity: float) -> DataFrame:
    """line, template (both hashes) and docs of the different lines in lined that belong to a template."""
    once = lined.groupBy("leaf", "line", "u", "id").agg(F.min("at").alias("at"))
    apart = cut(once.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("u", "at")).alias("from")))
    # one document of each line gives its tokens
    wanted = apart.groupBy(F.col("from.u").alias("_u")).agg(F.collect_list(F.struct("from.at", "leaf", "line", "docs")).alias("wanted"))
    wanted = cut(wanted)
    given = rows.select("_u", "_text").join(F.broadcast(wanted) if apart.count() <= SMALL else wanted, "_u")
    given = given.select(F.split("_text", "\n").alias("_lines"), F.explode("wanted").alias("w")).select("w.leaf", "w.line", "w.docs", template(F.get("_lines", F.col("w.at"))).alias("masked"))
    token = F.split("masked", " ")
    places = F.filter(F.transform(token, lambda x, at: F.when(x != WILDCARD, F.xxhash64("leaf", at, x))), lambda x: x.isNotNull())
    given = _each_once(cut(given.select("leaf", "line", "docs", F.size(token).alias("n"), places.alias("places"))))
    constant = cut(given.select("docs", F.explode("places").alias("place")).groupBy("place").agg(F.sum("docs").alias("seen")).filter(F.col("seen") >= min_docs))
    tokens = given.select("line", F.explode("places").alias("place"))
    # the largest join has one form at every size, so what it exchanges grows evenly
    met = hot_join(tokens, constant, "place", "seen", F.col("line")).filter("seen is not null")
    # the template is known by its constant tokens and their places; two sums of hashes stand for them
    made = met.groupBy("line").agg(F.count(F.lit(1)).alias("constants"), F.bit_xor("place").alias("a"), F.bit_xor(F.xxhash64("place")).alias("b"))
    made = made.join(given.select("line", "leaf", "docs", "n"), "line")
    return made.filter(F.col("constants") >= similarity * F.col("n")).select("line", "docs", F.xxhash64("leaf", "n", "a", "b").alias("template"))


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 5, min_tokens: int = 3, depth: int = 2, similarity: float = 0.5) -> DataFrame:
    """Every row with clean_text, n_lines and n_lines_dropped."""
    out = ["clean_text", "n_lines", "n_lines_dropped"]
    ident, body = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    # a text is carried once, in the row that is handed on, and split where its lines are asked for
    kept = [c for c in out if c != text]
    rows = docs.select(carried(docs, kept), F.xxhash64(ident, body).alias("_u"), F.coalesce(ident.cast("long"), F.lit((1 << 63) - 1)).alias("_id"))
    text_of = whole(F.col(f"carried.`{text}`").cast("string"))
    lined = rows.select("_u", "_id", F.posexplode(F.split(text_of, "\n")).alias("at", "line")).select("_u", "_id", "at", path_key(F.col("line"), depth).alias("path"))
    # the filter comes after the cut: before it, the masking would be repeated for it
    lined = cut(lined.select(F.col("_u").alias("u"), F.col("_id").alias("id"), "at", "path.*")).filter(F.col("n") >= min_tokens).drop("n")
    # cut again, as both what follows and the last join read these lines, and each would exchange all lines for it
    lined = cut(_lines_of_full_leaves(lined, min_docs))
    templates = cut(_templates(rows.select("_u", text_of.alias("_text")), lined, min_docs, similarity))
    found = cut(hot_join(lined.drop("leaf"), templates, "line", "docs", F.col("u"), small=SMALL).filter("template is not null").select("u", "id", "at", "template"))
    once = found.groupBy("template", "u", "id").agg(F.count(F.lit(1)).alias("n"))
    common = cut(once.groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("id", "u")).alias("first")).filter(F.col("docs") >= min_docs))
    met = hot_join(found, common, "template", "docs", F.col("u"), small=SMALL).filter((F.col("first.u") != F.col("u")) | (F.col("first.id") != F.col("id")))
    dropped = met.groupBy(F.col("u").alias("_u"), F.col("id").alias("_id")).agg(F.collect_set("at").alias("_drop"))
    joined = rows.join(dropped, ["_u", "_id"], "left").withColumns({"_drop": F.coalesce("_drop", F.array().cast("array<int>")), "_lines": F.split(text_of, "\n")})
    joined = joined.withColumn("_stay", F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop")))
    return joined.select(
        *unpacked(docs, out),
        F.array_join(F.transform("_stay", lambda i: F.get("_lines", i)), "\n").alias("clean_text"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size("_drop").cast("long").alias("n_lines_dropped"),
    )
