"""Secrets: three fixed patterns, and character Markov models that tell random strings from ordinary identifiers.

Two first-order models over the letters of tokens are trained: one on random strings, one on ordinary ones. A token of
min_token letters or more with a digit and a letter in it is reported if the mean log-likelihood ratio of its transitions
exceeds a threshold and it doesn't overlap a span of the fixed patterns. Labelled samples: random are what the fixed
patterns find in sample_docs documents (those with the smallest hash) and digests of their ids written in base 16 and 64;
ordinary are those documents' words of letters, alone and in pairs joined as identifiers are, with a digit. The model is a table of
transitions of 66 letter classes, so its size is fixed. Native: expressions and aggregates only.

Positions are code points, end exclusive. Matches are found with regexp_extract_all, their places from the lengths of the
pieces that split() leaves between them.

Defined cases: a null text counts as empty and has no spans; repeated rows are scanned each for itself; an empty table
trains on nothing, and reports nothing; further columns are carried along, those named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, unpacked, whole, words

#: Kind, pattern, and least length of the match (assign: of its second group).
PATTERNS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
    ("access", r"AKIA[A-Z0-9]+", 16),
    ("hex", r"[0-9a-f]+", 32),
)
#: Found only where a match of full length is possible; spares most texts the exact pass.
POSSIBLE = {"assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CLASSES = len(ALPHABET) + 1
#: Scores are kept as integers in thousandths, so sums are exact in any order.
SCALE = 1000
#: Matches whose places are summed in one fold.
BLOCK = 256


def places(text: Column, pattern: str) -> Column:
    """Array of (s, e) of all leftmost matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern)
    steps = F.zip_with(between, found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    return let(F.filter(steps, lambda x: x["m"].isNotNull()), running)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(steps: Column) -> Column:
    """(s, e) of matches from the gaps before them and their lengths. Folds that append copy what they have, so they run
    over blocks of steps and then over the blocks, never over all steps of a long text."""
    empty = F.array().cast("array<struct<s:int,e:int>>")

    def inside(block: Column, at: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(at.alias("at"), empty.alias("out")),
            lambda a, x: F.struct((a["at"] + x["g"] + x["m"]).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["g"]).alias("s"), (a["at"] + x["g"] + x["m"]).alias("e")))).alias("out")),
            lambda a: a["out"],
        )

    def over(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x["g"] + x["m"]))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        return F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), inside))

    cuts = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int"))
    return F.when(F.size(steps) == 0, empty).otherwise(let(F.transform(cuts, lambda i: F.slice(steps, i * BLOCK + 1, F.lit(BLOCK))), over))


def base_spans(text: Column) -> Column:
    """Array of (s, k, e) of the fixed patterns, k being the place of the kind in PATTERNS."""
    def spans(k: int, pattern: str, least: int) -> Column:
        kind = F.lit(k).alias("k")
        if k == 0:
            value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
            sized = F.zip_with(places(text, pattern), value, lambda p, v: F.struct(p["s"].alias("s"), kind, p["e"].alias("e"), F.length(v).alias("n")))
            return F.transform(F.filter(sized, lambda x: x["n"] >= least), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
        # runs of one class: a run that is too short can't begin a longer one, so only long ones are looked for
        rest = least - len("AKIA") if pattern.startswith("AKIA") else least
        return F.transform(places(text, f"{pattern.removesuffix('+')}{{{rest},}}"), lambda p: F.struct(p["s"].alias("s"), kind, p["e"].alias("e")))

    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    parts = [F.when(text.rlike(POSSIBLE[name]), spans(k, pattern, least)).otherwise(none) for k, (name, pattern, least) in enumerate(PATTERNS)]
    return F.array_sort(F.concat(*parts))


def moves(token: Column) -> Column:
    """Array of transition numbers, first class * CLASSES + second class."""
    classes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return let(classes, lambda x: F.filter(F.zip_with(x, F.slice(x, F.lit(2), F.size(x)), lambda a, b: a * CLASSES + b), lambda m: m.isNotNull()))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_docs: int = 1000) -> list[int]:
    """Log-likelihood ratio of each transition in thousandths, random over ordinary, with one added to every count."""
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    chosen = docs.select(doc_id).orderBy(F.md5(ident), doc_id).limit(sample_docs).distinct()  # sample_docs ids at most
    some = docs.join(F.broadcast(chosen), doc_id, "left_semi").select(ident.alias("id"), whole(F.col(text)).alias("t"))
    some = some.withColumn("w", F.filter(words(F.col("t")), lambda w: w.rlike("^[A-Za-z]{3,}$"))).withColumn("b", base_spans(F.col("t")))
    after = F.slice(F.col("w"), 2, 1 << 30)
    snake = F.zip_with("w", after, lambda a, b: F.concat(a, F.lit("_"), b))
    camel = F.zip_with("w", after, lambda a, b: F.concat(a, F.initcap(b), (F.length(a) % 10).cast("string")))
    ordinary = F.filter(F.concat("w", snake, camel), lambda x: x.isNotNull())
    found = F.transform("b", lambda x: F.regexp_extract(F.substring("t", x["s"] + 1, x["e"] - x["s"]), "([A-Za-z0-9+/_=-]+)$", 1))
    digest = [F.sha2(F.concat(F.lit(f"{i}:"), "id"), 256) for i in range(8)]
    drawn = F.array(*digest, *[F.base64(F.unhex(d)) for d in digest])
    labelled = lambda tokens, label: F.transform(tokens, lambda x: F.struct(label.alias("label"), x.alias("token")))
    all_tokens = F.concat(labelled(ordinary, F.lit(0)), labelled(found, F.lit(1)), labelled(drawn, F.lit(1)))
    counts = some.select(F.inline(all_tokens)).select("label", F.explode(moves(F.col("token"))).alias("m")).groupBy("m").agg(
        F.count_if(F.col("label") == 1).alias("r"), F.count_if(F.col("label") == 0).alias("o")
    )
    counts = counts.withColumn("row", F.floor(F.col("m") / CLASSES).cast("int"))
    totals = counts.groupBy("row").agg(F.sum("r").alias("tr"), F.sum("o").alias("to"))
    ratio = F.log((F.col("r") + 1) / (F.col("tr") + CLASSES)) - F.log((F.col("o") + 1) / (F.col("to") + CLASSES))
    table = [0] * (CLASSES * CLASSES)
    for m, x in counts.join(totals, "row").select("m", F.floor(ratio * SCALE + 0.5).cast("int")).collect():  # CLASSES ** 2 rows at most
        table[m] = x
    return table


def secret_scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_token: int = 20, threshold: float = 0.5, sample_docs: int = 1000, model: list[int] | None = None
) -> DataFrame:
    """Every row with base (array of s, k, e) and added (array of s, e, score)."""
    model = train(docs, doc_id, text, sample_docs) if model is None else model
    weights = F.lit(model).cast("array<int>")
    likely = rf"[A-Za-z0-9+/_=-]{{{min_token}}}"
    d = docs.select(carried(docs, ["base", "added"]), whole(F.col(f"`{text}`")).alias("_t"))
    d = d.withColumn("base", base_spans(F.col("_t")))
    runs = F.when(F.col("_t").rlike(likely), places(F.col("_t"), rf"[A-Za-z0-9+/_=-]{{{min_token},}}")).otherwise(F.array().cast("array<struct<s:int,e:int>>"))
    d = d.withColumn("_r", runs)
    d = d.withColumn("_c", F.transform("_r", lambda p: F.struct(p["s"].alias("s"), p["e"].alias("e"), F.substring("_t", p["s"] + 1, p["e"] - p["s"]).alias("x"))))
    d = d.withColumn("_c", F.filter("_c", lambda c: c["x"].rlike("[0-9]") & c["x"].rlike("[A-Za-z]") & ~F.exists("base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))))
    d = d.withColumn("_m", F.transform("_c", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), moves(c["x"]).alias("m"))))
    score = lambda c: F.aggregate(c["m"], F.lit(0).cast("long"), lambda a, m: a + F.get(weights, m)) / F.size(c["m"]) / SCALE
    d = d.withColumn("added", F.filter(F.transform("_m", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), score(c).alias("score"))), lambda c: c["score"] > threshold))
    return d.select(*unpacked(docs, ["base", "added"]), "base", "added")


def secret_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, the counts of the three kinds, base_sha256, spans and n_random."""
    d = secret_scan(docs.select(doc_id, text), doc_id, text, **options)
    names = F.array(*[F.lit(k) for k, _, _ in PATTERNS], F.lit("random"))
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    d = d.withColumn("_all", F.array_sort(F.concat("base", F.transform("added", lambda x: F.struct(x["s"].alias("s"), F.lit(3).alias("k"), x["e"].alias("e"))))))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return d.select(
        F.col(doc_id).alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("_all")).alias("spans"), F.size("added").cast("long").alias("n_random"),
    )
