"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets: the sources share budget_percent of all words by weight; a target stops at cap times its source's size and the
excess is shared again until none is above. The mix is made of blocks of block_words words. First the blocks are apportioned
to the sources by highest quotients (votes: targets), then each source's blocks to its shards (votes: words in the shard).
A source has one shard for every shard_docs of its documents, so a source with a third of all rows is ordered in many small
windows. Within a shard the documents stand in a seeded order; its words, counted through in that order, form the blocks.
A quota of q blocks takes the whole shard as often as it fits and then the first of its blocks.

Apportionment is exact without dealing seat by seat: rounding votes / divisor at the mean divisor misses the wanted seats by
less than half the number of parties, and no party gains or loses more than votes * parties / (2 * seats * divisor) + 2 of
them, so only those seats are ranked by quotient.

Defined cases: a null text has no words and a document without words is taken 0 times; a null source is a source of its own
and the last; repeated rows count each; ties are broken by source and by shard; an empty table gives an empty result;
further columns are ignored. Native: expressions, aggregates, joins and windows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words

#: The weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)


def targets(sources: DataFrame, budget_percent: int = 150, cap: int = 2) -> DataFrame:
    """sources (source, source_size) with weight and target. One row a source; their order needs one window over them."""
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    s = sources.withColumn("weight", F.get(F.array(*[F.lit(w) for w in WEIGHTS]), (place - 1) % len(WEIGHTS)).cast("long"))
    s = s.withColumn("most", F.col("source_size") * cap)
    # the sources that stop are the first ones by most / weight
    up = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    everything = Window.partitionBy()
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns(
        {
            "total": F.sum("source_size").over(everything) * budget_percent / 100,
            "weights": F.sum("weight").over(everything),
            "full": F.coalesce(F.sum("most").over(before), F.lit(0)),
            "full_weights": F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    s = s.withColumn("level", (F.col("total") - F.col("full")) / (F.col("weights") - F.col("full_weights")))
    s = s.withColumn("stops", F.col("most") <= F.col("level") * F.col("weight"))
    s = s.withColumn("open", F.min(F.when(~F.col("stops"), F.struct(F.col("full_weights").alias("w"), F.col("level").alias("level")))).over(everything))
    target = F.when(F.coalesce(F.col("full_weights") < F.col("open.w"), F.lit(True)), F.col("most").cast("double")).otherwise(F.col("open.level") * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def apportion(parties: DataFrame, group: list[str], party: list[str], votes: str, seats: str) -> DataFrame:
    """parties with `quota`: `seats` (equal within a group) dealt among the parties of a group by highest quotients votes / (2 k + 1)."""
    of = Window.partitionBy(*group)
    p = parties.withColumns({"_v": F.col(votes).cast("double"), "_n": F.count(F.lit(1)).over(of), "_all": F.sum(F.col(votes).cast("double")).over(of)})
    p = p.withColumn("_q", F.when(F.col("_all") > 0, F.col("_v") * F.col(seats) / F.col("_all")).otherwise(0.0))
    p = p.withColumn("_a", F.floor(F.col("_q") + 0.5))
    p = p.withColumns({"_miss": F.when(F.col("_all") > 0, F.col(seats)).otherwise(0) - F.sum("_a").over(of), "_reach": (F.ceil(F.col("_q") * F.col("_n") / (2 * F.greatest(F.col(seats), F.lit(1)))) + 2).cast("long")})
    k = F.explode_outer(F.when((F.col("_miss") != 0) & (F.col("_v") > 0), F.sequence(F.lit(0).cast("long"), F.col("_reach") - 1)))
    c = p.select("*", k.alias("_k")).withColumn("_seat", F.when(F.col("_miss") > 0, F.col("_a") + F.col("_k")).otherwise(F.col("_a") - 1 - F.col("_k")))
    c = c.withColumn("_quotient", F.when(F.col("_seat") >= 0, F.col("_v") / (2 * F.col("_seat") + 1)))
    gains = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("_quotient").desc_nulls_last(), *party))
    loses = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("_quotient").asc_nulls_last(), *[F.col(x).desc() for x in party]))
    c = c.withColumns({"_up": gains, "_down": loses})
    step = F.when(F.col("_quotient").isNull(), 0).when((F.col("_miss") > 0) & (F.col("_up") <= F.col("_miss")), 1).when((F.col("_miss") < 0) & (F.col("_down") <= -F.col("_miss")), -1).otherwise(0)
    rest = [x for x in parties.columns if x not in group + party]
    return c.groupBy(*group, *party).agg(*[F.first(x).alias(x) for x in rest], (F.first("_a") + F.sum(step)).cast("long").alias("quota"))


def order_key(ident: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))))


def source_mix(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", budget_percent: int = 150, cap: int = 2, block_words: int = 8, shard_docs: int = 2000, seed: int = 7
) -> DataFrame:
    """doc_id, source, size, source_size, target and taken for every row of docs."""
    base = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size")).withColumn("at", order_key(F.col("doc_id"), seed)))
    sizes = cut(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")))
    aimed = targets(sizes.select("source", "source_size"), budget_percent, cap)
    blocks = F.floor(F.sum("target").over(Window.partitionBy()) / block_words + 0.5).cast("long")
    # nulls don't join: sources go by their place from here on
    aimed = aimed.withColumns({"_g": F.lit(0), "_seats": blocks, "_name": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))})
    dealt = apportion(aimed, ["_g"], ["_name"], "target", "_seats").drop("_g", "_seats").withColumnRenamed("quota", "source_quota")
    shards = sizes.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_name"), F.ceil(F.col("n_docs") / shard_docs).alias("n_shards"))
    per_source = cut(dealt.join(shards, "_name").select("_name", "source_size", "target", "source_quota", "n_shards"))
    rows = base.withColumn("_name", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).join(per_source, "_name")
    rows = cut(rows.withColumn("shard", F.conv(F.substring("at", 1, 8), 16, 10).cast("long") % F.col("n_shards")))
    sums = rows.groupBy("_name", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    quotas = apportion(sums, ["_name"], ["shard"], "shard_size", "source_quota").select("_name", "shard", "shard_size", "quota")
    rows = rows.join(quotas, ["_name", "shard"])
    line = Window.partitionBy("_name", "shard").orderBy("at", "doc_id", "size")
    rows = rows.withColumn("_end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    words = F.least(F.col("quota") * block_words, cap * F.col("shard_size"))
    turns = F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(0).cast("long")
    rest = F.col("_words") - F.col("_turns") * F.col("shard_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("_end") - F.col("size"))))
    rows = rows.withColumns({"_words": words, "_turns": turns})
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("_turns") * F.col("size") + part).cast("long").alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mix as documents: each row of docs as often as taken / size says, rounded."""
    mix = source_mix(docs, doc_id, source, text, **options).groupBy(F.col("doc_id").alias("_id"), F.col("size").alias("_size")).agg(F.sum("taken").alias("_taken"), F.count(F.lit(1)).alias("_rows"))
    d = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("own"), n_words(F.col(text)).alias("words"))
    d = d.join(mix, F.col("own").eqNullSafe(F.col("_id")) & (F.col("words") == F.col("_size")))
    times = F.when(F.col("words") > 0, F.floor(F.col("_taken") / F.col("_rows") / F.col("words") + 0.5)).otherwise(0).cast("int")
    copies = F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))
    return d.select("row", copies.alias("copy")).select("row.*")
