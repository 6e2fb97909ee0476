"""The corpus pipeline: STAGES over documents, each reading what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import mixing, packing, secrets, simhash, toxicity
from textloom.llm.common import WORD, fresh, keep, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score as toxic. The model learns from the labels of the rows that are not held out.

    A null or empty text scores like one without hits; repeated rows share their fate; without usable labels, and in an
    empty table, nothing goes."""
    return toxicity.without_toxic(docs, toxicity.train_model(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more.

    Repeated rows are copies; all texts without words are copies of one another; of a group whose doc_ids are all null one
    row of each text stays, else a null doc_id never does; an empty table stays empty."""
    return simhash.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, secrets in its text replaced by a mark. A null or empty text stays; repeated rows stay, their text
    scanned once; an empty table stays empty. `n_chars` follows the text."""
    return with_length(secrets.redact(docs, secrets.scan_texts(docs)), docs)


def with_length(out: DataFrame, docs: DataFrame) -> DataFrame:
    """out with docs' columns, n_chars (if there is one) the length of the text."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them, in the order of its slots: once or twice, cut where a source's quota ends, not
    at all where it has ended.

    A pass that takes all words of a document gives its text as it is; one that takes a part gives these words with
    spaces between. A row stands where its first slot of the pass does. A document without words has no share in a mix
    by words and stays as it is, after all others. `n_chars` follows. Repeated rows are documents of their own; a null
    source is a source; an empty table stays empty.
    """
    row, whole, parts, slot = (fresh(c, docs) for c in ("_row", "_whole", "_parts", "_slot"))
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    named = keep(docs.withColumn(row, F.monotonically_increasing_id()), "to-mix", wide=True)
    content = F.xxhash64("doc_id", "text").alias("content")  # another layout of the rows gives the same mix
    rows, plan, slots = mixing.mix(named.select(F.col(row).alias("id"), content, F.col("source"), size.alias("size")), names=("id",))
    per = plan.groupBy("row", "pass_no").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("parts"), F.sum(F.col("high") - F.col("low")).alias("taken"), F.min("slot").alias("slot"))
    some = rows.join(per, "row", "left").where("size = 0 or taken > 0")
    some = some.select(F.col("id").alias(row), (F.coalesce("taken", F.lit(0)) == F.col("size")).alias(whole), F.col("parts").alias(parts), F.coalesce("slot", F.lit((1 << 62) - 1)).alias(slot))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = lambda w: F.flatten(F.transform(parts, lambda p: F.slice(w, p["low"].cast("int") + 1, (p["high"] - p["low"]).cast("int"))))
    plain = F.array_join(F.element_at(F.transform(F.array(words), cut), 1), " ")
    out = named.join(some, row).withColumn("text", F.when(F.col(whole), F.col("text")).otherwise(plain))
    # a slot's partition follows from its number, and slots are of one size
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.least(F.floor(F.col(slot) * F.lit(n / max(slots, 1))), F.lit(n - 1)).cast("int")
    out = out.repartitionById(n, F.when(F.col(slot) < slots, at).otherwise(n - 1)).sortWithinPartitions(slot, row)
    return with_length(out, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 2048 tokens. A null text is empty and has one token, the end
    mark; repeated rows are packed each; an empty table gives no rows."""
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No stage but the secret scan can be written in SQL: the scores, hashes and tokens are no SQL functions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each stage's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}", wide=True)
    return STAGES[-1][1](spark, docs, sf_dir)
