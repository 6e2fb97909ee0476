"""Delimited files of any size as cells and back, read and written in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as X


def cells(spark: SparkSession, path: str, sep: str = ",", multiline: bool = True) -> DataFrame:
    """(path, row, col, value) of the cells of CSV files that hold anything, all as text, line ends as marks. Rows number
    from 0 within a file's part: `row` is unique and in order, not gapless."""
    df = spark.read.csv(path, sep=sep, header=False, multiLine=multiline, quote='"', escape='"', inferSchema=False)
    named = df.select(F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("row"), F.array(*df.columns).alias("cells"))
    out = named.select("path", "row", F.posexplode("cells").alias("col", "value")).where(X.trim_u(F.coalesce("value", F.lit(""))) != "")
    return out.withColumn("value", F.replace(F.replace("value", F.lit("\r"), F.lit("␍")), F.lit("\n"), F.lit("␊")))


def write(cells_: DataFrame, path: str, columns: int, sep: str = ",") -> None:
    """Writes cells (row, col, value) as CSV files: rows regrouped, formulas made harmless, UTF-8 without a mark."""
    plain = F.replace(F.replace("value", F.lit("␊"), F.lit("\n")), F.lit("␍"), F.lit("\r"))
    rows = cells_.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", X.safe_cell(plain).alias("v")))).alias("m"))
    wide = rows.repartitionByRange("row").sortWithinPartitions("row").select(*[F.coalesce(F.try_element_at("m", F.lit(i)), F.lit("")).alias(f"c{i}") for i in range(columns)])
    wide.write.csv(path, sep=sep, quote='"', escape='"', header=False, emptyValue="", mode="overwrite", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
