"""Trees in columns: the texts of JSON values and HTML pages as rows."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.sources import formats


def json_leaves(df: DataFrame, key: str, column: str, skip_keys: frozenset = formats.SKIP_KEYS, skip_paths: frozenset = frozenset()) -> DataFrame:
    """(key, path, value) of every string in a JSON column that is not excluded; values that are no JSON have none."""

    @F.pandas_udf("array<struct<path:string,value:string>>")
    def found(values: pd.Series) -> pd.Series:
        def of(v):
            try:
                return [(".".join(map(str, p)), t) for p, t in formats.leaves(json.loads(v), skip_keys, skip_paths)]
            except (TypeError, ValueError):
                return []

        return values.map(of)

    return df.select(key, F.inline(found(F.col(column))))


def html_blocks(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, n, type, place, value) of the texts of an HTML column in document order."""

    @F.pandas_udf("array<struct<type:string,place:string,value:string>>")
    def found(values: pd.Series) -> pd.Series:
        return values.map(lambda v: formats.read_html((v or "").encode()))

    return df.select(key, F.posexplode(found(F.col(column))).alias("n", "b")).select(key, "n", "b.*")
