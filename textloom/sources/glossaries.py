"""Glossary files: CSV with a column per language, read by code or name of the language, written with guards."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import LANGUAGES
from textloom.sources import formats
from textloom.storage import _at


def column_of(header: list[str], lang: str) -> int | None:
    """The column of a language: headed by its code or its own name, in any case."""
    want = lang.strip().lower()
    names = {want, *[x.lower() for kv in LANGUAGES.items() if want in (kv[0].lower(), kv[1].lower()) for x in kv]}
    return next((i for i, h in enumerate(header) if h.strip().lstrip("﻿").lower() in names), None)


def pairs_of(raw: bytes, src: str, dst: str) -> list[tuple[str, str]]:
    """The terms of a file in both languages; from `auto` the first other column is the source. Without the columns, none."""
    rows, _ = formats.rows_of(raw)
    if not rows:
        return []
    to = column_of(rows[0], dst)
    of = column_of(rows[0], src)
    if of is None and src.strip().lower() == "auto" and to is not None:
        of = next((i for i in range(len(rows[0])) if i != to), None)
    if of is None or to is None:
        return []
    both = [(r[of].strip(), r[to].strip()) for r in rows[1:] if len(r) > max(of, to)]
    return [(a, b) for a, b in both if a and b]


def scan(spark: SparkSession, path: str, src: str, dst: str) -> DataFrame:
    """(path, ord, src, dst) of the glossary files at a path."""

    @F.pandas_udf("array<struct<src:string,dst:string>>")
    def read(content: pd.Series) -> pd.Series:
        return content.map(lambda raw: [{"src": a, "dst": b} for a, b in pairs_of(raw, src, dst)])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    return files.select("path", F.posexplode(read("content")).alias("ord", "t")).select("path", "ord", "t.*")


def write(spark: SparkSession, folder: str, name: str, header: list[str], rows: list[list[str]], new: bool = False) -> str:
    """Writes a glossary (a user's list of terms, a few thousand) as one file and gives its path. Refused are a name that is
    no file's, a new one that exists, and no rows in the place of some."""
    if not name.strip() or re.search(r'[\\/:*?"<>|]', name):
        raise ValueError(f"{name!r} is no name of a glossary")
    path = f"{folder.rstrip('/')}/{name.strip()}.csv"
    at, fs = _at(spark, path)
    if fs.exists(at):
        if new:
            raise FileExistsError(path)
        if not rows and spark.read.text(path).where("trim(value) <> ''").limit(2).count() > 1:
            raise ValueError("a glossary with terms is not replaced by an empty one")
    text = "".join(",".join('"' + str(c).replace('"', '""') + '"' for c in r) + "\n" for r in [header, *rows])
    out = fs.create(at, True)
    out.write(bytearray(b"\xef\xbb\xbf" + text.encode()))
    out.close()
    return path


def delete(spark: SparkSession, folder: str, name: str) -> None:
    """Removes a glossary; Default stays."""
    if name == "Default":
        raise ValueError("the Default glossary stays")
    at, fs = _at(spark, f"{folder.rstrip('/')}/{name}.csv")
    if not fs.delete(at, False):
        raise FileNotFoundError(name)
