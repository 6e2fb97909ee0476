"""Positions in an order over all rows, without one task that sorts them all."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.storage import written

__all__ = ["global_rank", "running_sum", "written"]


def global_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Adds `name` (long, from 1): the place of each row in `order` (columns or names). Rows are sorted by range; a task's
    first place follows from the counts of the tasks before it, which are as few as there are tasks."""
    bits = 33  # monotonically_increasing_id() is the partition, then 33 bits of position
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    kept = written(ranged, "ranked", wide=True).withColumn("_part", F.shiftright("_id", bits))
    counts = {r["_part"]: r["n"] for r in kept.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    firsts = list(accumulate((counts.get(i, 0) for i in range(max(counts, default=0) + 1)), initial=0))
    first = F.split(F.lit(",".join(map(str, firsts))), ",")[F.col("_part").cast("int")].cast("long")  # one literal array
    return kept.withColumn(name, first + F.col("_id").bitwiseAND(F.lit((1 << bits) - 1)) + 1).drop("_id", "_part")


def running_sum(df: DataFrame, group: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds `name` (long): the sum of value over the rows of the group up to this one in `order`, which should tell rows
    apart. Rows are sorted by range over group and order, so that a group that holds most rows spreads over tasks; a task's
    share of a group starts from the sums of the tasks before it, which are as few as there are tasks and groups."""
    part, mine, base = "_part", "_mine", "_base"
    ranged = df.withColumn(mine, value.cast("long")).repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    kept = written(ranged.withColumn(part, F.spark_partition_id()), "running", wide=True)
    own = F.sum(mine).over(Window.partitionBy(part, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sums = kept.groupBy(part, *group).agg(F.sum(mine).alias(mine))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(part, *group, F.coalesce(F.sum(mine).over(before), F.lit(0)).alias(base))
    named = sums.select(F.col(part).alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], base)
    same = F.col(part) == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = kept.withColumn(name, own).join(named, same)
    return out.withColumn(name, F.col(name) + F.col(base)).select(*df.columns, name)
