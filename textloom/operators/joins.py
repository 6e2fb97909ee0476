"""Joins of a large table with one row per key, where one key may hold a third of the large table's rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENT = 200_000  #: rows of the smaller side that are sent to every task, at most; beyond, keys are dealt out
SHARE = 200  #: a key with more than this fraction of the rows is hot, so there are fewer than this many


def fresh(name: str, *frames: DataFrame) -> str:
    """`name`, with as many underscores as it takes to be no column of the frames."""
    used = {c.lower() for f in frames for c in f.columns}
    while name.lower() in used:
        name += "_"
    return name


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", least: int = 1_000) -> DataFrame:
    """big joined (inner, left, left_semi or left_anti) with small, rows of a hot key of big spread over parts and small's
    row repeated for each part. big is counted first, so it should be a written table."""
    total = big.count()
    many = big.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > max(total // SHARE, least)).collect()  # fewer than SHARE rows
    if not many:
        return big.join(small, on, how)
    parts, salt = fresh("_parts", big, small), fresh("_salt", big, small)
    schema = ", ".join([*[f"`{c}` {big.schema[c].dataType.simpleString()}" for c in on], f"{parts} int"])
    hot = big.sparkSession.createDataFrame([(*[r[c] for c in on], -(-r["n"] * SHARE // total)) for r in many], schema)
    n = F.coalesce(F.col(parts), F.lit(1))
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])  # meets nothing, so it may go anywhere
    spread = F.pmod(F.monotonically_increasing_id(), F.when(missing, SHARE).otherwise(n)).cast("int")
    left = big.join(F.broadcast(hot), on, "left").withColumn(salt, spread).drop(parts)
    right = small.join(F.broadcast(hot), on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), n - 1))).drop(parts)
    return left.join(right, [*on, salt], how).drop(salt)


def keyed_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", weight: Column | None = None) -> DataFrame:
    """salted_join(), or a broadcast of small where it has been counted (in rows, or the sum of `weight`) and has SENT or
    fewer. Both give the same rows; small should be a written table, and so should big where it is not cheap."""
    n = small.count() if weight is None else small.agg(F.sum(weight)).first()[0] or 0
    if n <= SENT:
        return big.join(F.broadcast(small), on, how)
    return salted_join(big, small, on, how)
