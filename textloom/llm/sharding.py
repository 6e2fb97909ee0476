"""Sharding by Hilbert-curve order: rows close in several metadata dimensions land in the same shard and file."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ordered_sums, table

SHARDS = 8
BITS = 8


def hilbert_index(cells, bits: int):
    """Hilbert index of integer cells (rows x dimensions) on a curve of `bits` per dimension, as int64.

    Skilling's transposition (AIP Conf. Proc. 707, 2004), done for all rows at once.
    """
    x = np.array(cells, dtype=np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def quantile_cuts(df: DataFrame, columns: Sequence[str], bits: int) -> list[list]:
    """The 2^bits - 1 quantiles of each column over all rows, from one aggregation of sketches."""
    n = 1 << bits
    found = df.agg(*[F.percentile_approx(c, [i / n for i in range(1, n)], 10 * n).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    return [sorted(set(q or [])) for q in found]


def label_cell(column: str, bits: int) -> Column:
    """The cell of a label: its hash, so that no list of labels is needed; null has a cell too."""
    return F.pmod(F.xxhash64(F.col(column)), F.lit(1 << bits))


def hilbert_order(df: DataFrame, numbers: Sequence[str], labels: Sequence[str], bits: int = BITS) -> DataFrame:
    """Adds `hilbert` (long): the curve index of the numbers, each quantised by how many of its quantiles lie below it
    (null: cell 0), and of the labels, by hash. At most 62 bits in all."""
    if bits * (len(numbers) + len(labels)) > 62:
        raise ValueError("the index has more than 62 bits")
    cuts = quantile_cuts(df, numbers, bits) if numbers else []

    @F.pandas_udf("long")
    def index(*columns: pd.Series) -> pd.Series:
        cells = [np.where(c.isna(), 0, np.searchsorted(q, c.fillna(0).to_numpy())) for q, c in zip(cuts, columns, strict=False)]
        cells += [c.to_numpy() for c in columns[len(cuts):]]
        return pd.Series(hilbert_index(np.stack(cells, axis=1), bits), dtype="int64")

    return df.withColumn("hilbert", index(*[F.col(c) for c in numbers], *[label_cell(c, bits) for c in labels]))


def cut_runs(df: DataFrame, order: Sequence[str], shards: int) -> DataFrame:
    """Adds `shard` and `slot`: the rows in order, cut into `shards` runs whose counts are at most one apart."""
    placed = ordered_sums(df.withColumn("_one", F.lit(1).cast("long")), [], order, "_one", "hilbert")
    n = placed.count()
    firsts = [s * n // shards for s in range(shards)]
    at = F.col("before")
    shard, first = F.lit(0), F.lit(0).cast("long")
    for s in range(1, shards):
        shard = F.when(at >= firsts[s], s).otherwise(shard)
        first = F.when(at >= firsts[s], F.lit(firsts[s])).otherwise(first)
    return placed.withColumn("shard", shard).withColumn("slot", at - first)


def write_shards(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Writes a frame that cut_runs() has cut: a folder per shard, rows in curve order, so that each file and row group
    covers a small box of every dimension and readers prune by its minima and maxima."""
    cut = df.withColumn("_file", F.floor(F.col("slot") / rows_per_file))
    cut.repartitionByRange("shard", "_file").sortWithinPartitions("shard", "slot").drop("_file", "_g", "_task", "_local", "_one", "before", "row").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law `rows`: counts at most one apart.

    Dimensions: size by quantile, lang and source by hash; ties of the curve go by text CRC, doc_id, so that equal texts
    stand together within a cell. A null text counts as empty (size 1, CRC 0); null doc_ids sort first; repeated rows
    keep a slot each; an empty table gives no rows. Extra columns are never read.
    """
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(docs["text"], F.lit(""))
    thin = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), docs["lang"], docs["source"])
    cut = cut_runs(hilbert_order(thin, ["size"], ["lang", "source"]), ["hilbert", "text_crc32", "doc_id"], SHARDS)
    return cut.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
