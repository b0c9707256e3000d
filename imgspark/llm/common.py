"""What the operators of this subpackage share: word rules, table access and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words, as a character list and as a Java / RE2 pattern.
BLANKS = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text; empty for a null or blank one. Bind it to a column before it is used in a lambda."""
    bare = F.btrim(whole(text), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def n_words(text: Column) -> Column:
    bare = F.btrim(whole(text), F.lit(BLANKS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, GAP))).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a temporary one is made in local mode
    (tests); on a cluster that is an error, as executors can't read the driver's disk."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    now = sc._jsc.sc().getCheckpointDir()
    if now.isEmpty():
        if not at and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="spark-checkpoint-"))
        now = sc._jsc.sc().getCheckpointDir()
    return at or now.get()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint, which a lost executor doesn't take along."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint()


def hot_join(rows: DataFrame, table: DataFrame, key: str, weight: str, *spread: Column, share: int = 10_000, small: int = 0) -> DataFrame:
    """rows left joined with table by its unique key, a string or long; weight: for how many rows an entry stands.

    Keys that stand for more than one row in `share` are share of them at most, whatever the input: these are broadcast, and
    rows that have met them are dealt by a hash of spread for the join with the others. A table of `small` rows or fewer is
    broadcast as a whole."""
    total, n = table.agg(F.sum(weight), F.count(F.lit(1))).first()
    values = [c for c in table.columns if c != key]
    if n <= small:
        return rows.join(F.broadcast(table), key, "left").select(*rows.columns, *values)
    hot = F.col(weight) * share > (total or 0)
    first = table.filter(hot).select(F.col(key), F.struct(*values).alias("_hot"))
    rest = table.filter(~hot).select(F.col(key).alias("_key"), F.struct(*values).alias("_rest"))
    met = rows.join(F.broadcast(first), key, "left")
    dealt = F.xxhash64(*spread, F.spark_partition_id()).cast(dict(rows.dtypes)[key])
    met = met.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(dealt))
    met = met.join(rest.hint("merge"), "_key", "left").withColumn("_met", F.coalesce("_hot", "_rest"))
    return met.select(*rows.columns, *[F.col(f"_met.{c}").alias(c) for c in values])


def carried(frame: DataFrame, replaced: list[str]) -> Column:
    """The columns that an operator passes on, as one struct, so that none clashes with a working column."""
    keep = [F.col(f"`{c}`").alias(c) for c in frame.columns if c not in replaced]
    return F.struct(*keep, F.lit(0).alias("")).alias("carried")


def unpacked(frame: DataFrame, replaced: list[str]) -> list[Column]:
    """Those columns again; frame is the one that carried() was given."""
    return [F.col(f"carried.`{c}`").alias(c) for c in frame.columns if c not in replaced]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
