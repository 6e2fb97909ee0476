"""Files as segments and back: a reader and a writer by extension, run where the bytes are."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import captions
from textloom.functions import text as X
from textloom.sources import formats


def scan(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, extension, ord, type, place, value, prose, error) of every text in the files under a path. A file that can't
    be read gives one row with its error; extensions without a reader give none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    files = files.withColumn("extension", X.file_type(F.col("path"))).where(F.col("extension").isin(*formats.READERS))

    readers = dict(formats.READERS)  # what is registered here goes to the tasks

    @F.pandas_udf("struct<slots:array<struct<type:string,place:string,value:string>>,error:string>")
    def read(content: pd.Series, extension: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, ext in zip(content, extension, strict=True):
            try:
                rows.append((readers[ext](raw), None))
            except Exception as e:  # a broken file is a row, not the end of the scan
                rows.append(([], f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["slots", "error"])

    got = files.select("path", "extension", read("content", "extension").alias("r"))
    texts = got.select("path", "extension", F.posexplode("r.slots").alias("ord", "s"), "r.error").select("path", "extension", "ord", "s.*", "error")
    bad = got.where("r.error is not null").select("path", "extension", F.col("r.error").alias("error"))
    return texts.withColumn("prose", X.should_translate(F.col("value"))).unionByName(bad, allowMissingColumns=True)


#: By extension the family of markup in which two languages stand side by side; others put one below the other.
FAMILIES = {"srt": "srt", "vtt": "vtt", "md": "md"}


def write_back(spark: SparkSession, path: str, translated: DataFrame, bilingual: bool = False) -> DataFrame:
    """(path, result) of the files under a path with the texts of (path, place, translated) put in: one file's new texts
    are gathered, files spread. bilingual: beside the old texts (`value`) instead of in their place."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    new = translated.where("translated is not null")
    if bilingual:
        extension = X.file_type(F.col("path"))
        two = captions.both(F.col("value"), F.col("translated"), "cell")
        for ext, family in FAMILIES.items():
            two = F.when(extension == ext, captions.both(F.col("value"), F.col("translated"), family)).otherwise(two)
        new = new.withColumn("translated", two)
    new = new.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("place", "translated"))).alias("new"))

    writers = dict(formats.WRITERS)

    @F.pandas_udf("binary")
    def write(content: pd.Series, extension: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([writers[e](raw, dict(n)) for raw, e, n in zip(content, extension, new, strict=True)])

    return files.join(new, "path").select("path", write("content", X.file_type(F.col("path")), "new").alias("result"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, mtime, size) of the files under a path, their content unread."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
