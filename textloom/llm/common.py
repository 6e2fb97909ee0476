"""What the operators of this subpackage share: inputs, written intermediate tables, ordered sums."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.joins import fresh, keyed_join, salted_join
from textloom.storage import drop, scratch, temporaries
from textloom.storage import written as keep

__all__ = ["WORD", "WORD_PY", "digest", "drop", "fresh", "keep", "keyed_join", "ordered_sums", "release", "salted_join", "scratch", "table", "temporaries", "text_batches"]

#: A word of the contracts: a run of anything but space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 1000
WORD_PY = r"[^\x20\x09-\x0d]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by the path that Spark's reader opens."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """From now on an Arrow batch has BATCH_ROWS rows at most: what a task holds at once of texts, pages or vectors is
    10,000 rows by default, several times in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def release() -> None:
    """Gives back what a task's Python has freed: workers are kept for the next tasks, and would hold it meanwhile."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def digest(text: Column) -> Column:
    """Content address of a text; null and empty differ."""
    return F.when(text.isNull(), F.lit("null")).otherwise(F.sha2(text, 256))


def ordered_sums(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds `before`: the sum of `value` (long, not null) over the rows of the same group that stand earlier in `order`.

    Rows are dealt by range over (group, order), so a group of any size spreads over tasks; each task runs a local sum,
    and the sums of (group, task) pairs, at most one per group and task, are what a window adds up. Ties in `order` get
    distinct places. The result is written, so places are stable. Adds before, row (long, unique), _g, _task and _local.
    """
    key = F.xxhash64(*[F.col(c) for c in group]) if group else F.lit(0).cast("long")
    by = [F.col(c) for c in [*group, *order]]
    # the tie lets a range end among rows that are equal in all of these columns
    ranged = df.withColumns({"_g": key, "_tie": F.monotonically_increasing_id()}).repartitionByRange(*by, "_tie").drop("_tie")
    ranged = ranged.sortWithinPartitions(*by).withColumn("_task", F.spark_partition_id().cast("long"))
    schema = T.StructType([*ranged.schema.fields, T.StructField("_local", T.LongType()), T.StructField("row", T.LongType())])

    def run(batches):
        import numpy as np

        last, total, seen = None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if seen is None:  # a task may go through several ranges
                seen = batch.column("_task")[0].as_py() << 40
            g = batch.column("_g").to_numpy(zero_copy_only=False)
            v = batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            cum = np.cumsum(v) - v
            starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            base = np.repeat(cum[starts], np.diff(np.append(starts, len(g))))
            out = cum - base
            if last is not None and g[0] == last:
                first_end = starts[1] if len(starts) > 1 else len(g)
                out[:first_end] += total
            last, total = g[-1], int(out[-1] + v[-1])
            row = np.arange(seen, seen + len(g))
            seen += len(g)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64()), pa.array(row, pa.int64())], names=[*batch.schema.names, "_local", "row"])

    kept = keep(ranged.mapInArrow(run, schema), name)
    per = kept.groupBy("_g", "_task").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy("_g").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_g", "_task", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    return kept.join(per, ["_g", "_task"]).withColumn("before", F.col("_local") + F.col("_base"))
