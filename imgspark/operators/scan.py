"""Running sums over groups that no task has to hold: range partitions, their totals, and the totals' own running sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def prefix_sums(rows: DataFrame, group: str, order: list[str], sums: dict[str, str]) -> DataFrame:
    """rows with, for each entry new: column of sums, the sum of column over the rows of the group that stand before.

    Rows are dealt by ranges of (group, order), so that a group with most of the rows lies in many partitions; a window
    never sees more of a group than one partition has, and the totals of a group are a row for each of those. `order` has to
    tell the rows of a group apart."""
    shared_dir(rows.sparkSession)
    keys = [group, *order]
    # a reliable checkpoint: the partition of a row may not change when a task runs again
    laid = rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()).checkpoint()
    within = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = laid.groupBy(F.col(group).alias("_group"), "_part").agg(*[F.sum(c).alias(f"_{new}") for new, c in sums.items()])
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_group", F.col("_part").alias("_of"), *[F.coalesce(F.sum(f"_{new}").over(before), F.lit(0)).alias(f"_{new}") for new in sums])
    near = laid.withColumns({f"_near_{new}": F.coalesce(F.sum(c).over(within), F.lit(0)) for new, c in sums.items()})
    met = near.join(totals, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
    return met.select(*rows.columns, *[(F.col(f"_near_{new}") + F.col(f"_{new}")).alias(new) for new in sums])



def with_parts(rows: DataFrame, weight: str, order: list[str], parts: int) -> DataFrame:
    """rows with `part`, 0 to parts - 1: neighbours by order go together, and every part weighs about the same.

    A row belongs to the part in which the middle of its share of the running weight lies; so no part is heavier than the mean and
    one row more. Rows without a weight, or with less than 1, count as 1. `order` has to tell rows apart."""
    w = F.greatest(F.coalesce(F.col(weight).cast("long"), F.lit(1)), F.lit(1))
    summed = prefix_sums(rows.withColumns({"_all": F.lit(0), "_w": w}), "_all", order, {"_before": "_w"})
    total = rows.agg(F.sum(w)).first()[0] or 1
    middle = 2 * F.col("_before") + F.col("_w")
    part = F.least(F.floor(middle * parts / (2 * total)), F.lit(parts - 1)).cast("int")
    return summed.select(*rows.columns, part.alias("part"))


def balanced(rows: DataFrame, weight: str, order: list[str], parts: int) -> DataFrame:
    """rows in `parts` partitions of about the same weight: a manifest before its files are read, so that a task gets many
    small pictures or few large ones. Nothing but the manifest moves."""
    return with_parts(rows, weight, order, parts).repartitionById(parts, "part").drop("part")
