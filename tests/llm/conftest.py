"""Small tables of the operators' contracts, with nulls, empty and long texts, ties, repeats and clashing extra columns."""

import pytest

ODD = [
    (1, "the quick brown fox", "en", "a"),
    (2, None, None, None),
    (3, "", "fr", "b"),
    (4, "the quick brown fox", "en", "a"),
    (4, "the quick brown fox", "en", "a"),
    (5, " \t\n", "fr", "b"),
    (6, "word " * 30000, "en", "hot"),
    (None, "no id here", "en", "hot"),
    (7, "Größe ἀρχή İstanbul Σίσυφος été <|endoftext|> \x1c it's we'll 42 ²", "de", "c"),
    *[(100 + i, f"copy {i // 20} of a text that many rows share", "en", "hot") for i in range(60)],
]


@pytest.fixture(scope="session")
def odd_rows():
    return ODD


#: Names that the operators and stages use themselves.
CLASHES = ("row", "size", "before", "_g", "_task", "_tie", "length", "slot", "component_id", "score", "node", "_spans", "_blob", "_doc", "_content", "_n", "_row", "_parts", "_slot", "_whole", "_taken", "_toxicity", "_alone", "_salt", "blob", "taken", "id", "content", "bytes", "shard", "toxic", "n_words", "kept", "logs", "post")


def write(spark, path, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    if extra:  # names that the operators use themselves
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("x") for c in CLASHES})
    df.write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("odd"), ODD)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [])
