"""The batch call to a model: packed requests with masked tokens, replies joined to them, outcomes, rounds, resuming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions.tokens import OPEN, SHUT, arrow, mask, retry_budget
from textloom.operators import segments, terms
from textloom.operators.ordering import written

Model = Callable[[Column], Column]  #: a request (JSON of ids and texts) to a reply


def stand_in(request: Column) -> Column:
    """A model that marks each text: deterministic, and all that the engine brings along itself."""
    return F.to_json(F.transform_values(F.from_json(request, "map<string,string>"), lambda _, v: segments.fake_translate(v)))


# --- requests ---------------------------------------------------------------------------------------------------------


def masked(c: Column) -> Column:
    """struct(text, tokens): machine tokens as numbered marks; texts without any stay in the JVM."""
    some = c.rlike(r"[%$\{]")
    done = arrow(_marked, "array<string>")(F.when(some, c))
    return F.when(some, F.struct(done[0].alias("text"), F.slice(done, F.lit(2), F.size(done)).alias("tokens"))).otherwise(F.struct(c.alias("text"), F.array().cast("array<string>").alias("tokens")))


def _marked(text: str) -> list[str]:
    """The masked text, then its tokens."""
    bare, kept = mask(text)
    return [bare, *kept.values()]


def unmasked(c: Column, tokens: Column) -> Column:
    """Marks back to tokens, however often they stand; unknown numbers stay."""
    numbered = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    mark = lambda i: F.concat(F.lit(OPEN), i.cast("string"), F.lit(SHUT))
    return F.aggregate(numbered, c, lambda text, x: F.replace(text, mark(x["i"]), x["t"]))


def requests(chunks: DataFrame, budget: int | None) -> DataFrame:
    """(doc_id, batch, request, items) of chunks (doc_id, count_split, value): batches by token budget (none: a chunk each),
    the request as JSON of ids and masked texts, items as structs (count_split, value, tokens)."""
    rows = chunks.where("count_split is not null").select("doc_id", F.col("count_split").cast("int").alias("ord"), "value")
    if budget is None:
        placed = rows.withColumn("batch", F.col("ord"))
    else:
        placed = rows.join(segments.pack(rows, budget).select("doc_id", "ord", "batch"), ["doc_id", "ord"])
    item = placed.withColumn("_m", masked(F.col("value"))).select("doc_id", "batch", F.struct(F.col("ord").cast("long").alias("count_split"), "value", F.col("_m.text").alias("text"), F.col("_m.tokens").alias("tokens")).alias("i"))
    got = item.groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list("i")).alias("items"))
    request = F.map_from_arrays(F.transform("items", lambda i: i["count_split"].cast("string")), F.transform("items", lambda i: i["text"]))
    return got.select("doc_id", "batch", F.to_json(request).alias("request"), "items")


# --- replies ----------------------------------------------------------------------------------------------------------


def reply_texts(c: Column) -> Column:
    """map of ids to texts of a reply, null where it is no JSON object; what is no string there is an empty text."""
    raw = F.from_json(X.clean_json(c), "map<string,variant>")
    return F.transform_values(raw, lambda _, v: F.coalesce(F.when(F.schema_of_variant(v) == "STRING", v.cast("string")), F.lit("")))


def replied(answered: DataFrame) -> DataFrame:
    """(doc_id, batch, count_split, original, translated, echo) of (doc_id, batch, request, items, reply): a request's items
    with their texts of the reply, unmasked; what the reply misses is empty. echo: the reply is the request."""
    got = answered.withColumn("_r", reply_texts(F.col("reply")))
    same = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.from_json("request", "map<string,string>"))))) == F.to_json(F.map_from_entries(F.array_sort(F.map_entries("_r"))))
    got = got.select("doc_id", "batch", F.coalesce(same, F.lit(False)).alias("echo"), "_r", F.explode("items").alias("i"))
    text = F.coalesce(F.try_element_at("_r", F.col("i.count_split").cast("string")), F.lit(""))
    return got.select("doc_id", "batch", F.col("i.count_split").alias("count_split"), F.col("i.value").alias("original"), X.trim_u(unmasked(text, F.col("i.tokens"))).alias("translated"), "echo")


def judged(rows: DataFrame, src: str, dst: str, last_try: bool = False) -> DataFrame:
    """replied() with outcome; a reply that repeats its request fails as a whole, but not on the last try."""
    out = segments.outcome(rows, src, dst, last_try)
    return out if last_try else out.withColumn("outcome", F.when(F.col("echo"), "failed").otherwise(F.col("outcome")))


def translate(chunks: DataFrame, src: str, dst: str, model: Model = stand_in, budget: int = 4096, retries: int = 3, done: DataFrame | None = None, memory: DataFrame | None = None, signature: str = "") -> DataFrame:
    """(doc_id, count_split, original, translated, outcome) of chunks (doc_id, count_split, value).

    What `done` has (doc_id, count_split) is left out, and so are blank chunks. A batch that the memory knows as a whole
    is served by it. What fails goes again in smaller batches, in the last round one by one, where what is structurally
    whole is kept for review and the rest falls back to its source. Each round is written, so a lost executor repeats no
    calls.
    """
    left = chunks.where(F.col("count_split").isNotNull() & (X.trim_u(F.col("value")) != "")).select("doc_id", "count_split", "value")
    if done is not None:
        left = left.join(done.select("doc_id", "count_split"), ["doc_id", "count_split"], "left_anti")
    parts = []
    for n in range(retries + 1):
        last = n == retries
        asked = requests(left, None if last and n else budget if n == 0 else retry_budget(budget, n - 1))
        if memory is not None and n == 0:
            flat = written(asked.select("doc_id", "batch", "request", "items", F.explode(F.col("items")["value"]).alias("value"), F.xxhash64("doc_id", "batch").alias("batch_id")), "asked", wide=True)
            known = terms.lookup(flat, memory, signature)
            served = known.where("served").select("doc_id", F.explode(F.col("items")).alias("i"), "value", "dst").where("i.value = value")
            served = served.select("doc_id", F.col("i.count_split").alias("count_split"), F.col("value").alias("original"), F.col("dst").alias("translated"), F.lit("translated").alias("outcome"))
            parts.append(served.distinct())
            asked = known.where("not served").select("doc_id", "batch", "request", "items").distinct()
        got = written(judged(replied(asked.withColumn("reply", model(F.col("request")))), src, dst, last), "round", wide=True)
        got = got.select("doc_id", "count_split", "original", "translated", "outcome")
        parts.append(got if last else got.where("outcome <> 'failed'"))
        left = got.where("outcome = 'failed'").select("doc_id", "count_split", F.col("original").alias("value"))
        if last or left.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("translated", F.when(F.col("outcome") == "failed", F.col("original")).otherwise(F.col("translated")))


def validated(results: DataFrame, signature: str, now: Column) -> DataFrame:
    """Rows for the memory (terms.upsert): what passed all checks and is no copy of its source."""
    return results.where("outcome = 'translated' and translated <> original").select(X.cache_key(F.lit(signature), F.col("original")).alias("key"), F.col("original").alias("src"), F.col("translated").alias("dst"), now.alias("used_at"))


def polished(first: Column, second: Column) -> Column:
    """The second pass's map of texts where it has the first's keys and, text by text, the first's placeholders; else the
    first's."""
    keys = F.array_sort(F.map_keys(first)) == F.array_sort(F.map_keys(second))
    kept = F.forall(F.map_entries(first), lambda e: X.tokens(e["value"], X.LOOSE) == X.tokens(F.try_element_at(second, e["key"]), X.LOOSE))
    return F.when(F.coalesce(keys & kept, F.lit(False)), second).otherwise(first)


# --- what a batch gets to know of those before ------------------------------------------------------------------------


class Recent(segments.Machine):
    """Rows (doc_id, batch, texts, costs) to (doc_id, batch, context): before a batch, the last texts of the last batch that
    had any, three at most and as many as the budget takes from the end; a single text over the budget changes nothing."""

    def __init__(self, budget: int, most: int = 3):
        self.budget, self.most, self.context = budget, most, []

    def add(self, doc_id, batch, texts, costs) -> list[tuple]:
        before = self.context
        fits, used = [], 0
        for text, cost in reversed([(t, c) for t, c in zip(texts, costs, strict=True) if t and len(t.strip()) > 1][-self.most :]):
            if used + cost > self.budget:
                break
            fits, used = [text, *fits], used + cost
        self.context = fits or before
        return [(doc_id, batch, before)]


def rolling_context(results: DataFrame, budget: int = 128) -> DataFrame:
    """(doc_id, batch, context) of (doc_id, batch, count_split, translated): see Recent. A batch's texts stand in the order of
    their ids as texts, as the keys of a reply do."""
    item = F.struct(F.col("count_split").cast("string").alias("k"), F.coalesce("translated", F.lit("")).alias("t"), X.token_count(F.col("translated")).alias("c"))
    rows = results.groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list(item)).alias("i"))
    rows = rows.select("doc_id", "batch", F.col("i.t").alias("texts"), F.col("i.c").alias("costs"))
    return segments.fold(rows, "doc_id", ["batch"], lambda: Recent(budget), "doc_id long, batch int, context array<string>")


# --- runs that survive a stop -----------------------------------------------------------------------------------------


def stage(spark: SparkSession, path: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of a stage under a run's path: read where an earlier run has finished it, else made and written. Spark's
    committer marks a finished table, so a stage that broke off is made again and never read half."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")):
        make().write.mode("overwrite").parquet(f"{path}/{name}")
    return spark.read.parquet(f"{path}/{name}")


def translate_documents(spark: SparkSession, docs: DataFrame, path: str, src: str, dst: str, model: Model = stand_in, budget: int = 4096, retries: int = 3, limit: int = 1200) -> DataFrame:
    """(doc_id, text) of docs (doc_id, text) translated: lines, distinct values, chunks, calls, and back. Each stage is a
    table under `path`; a second run goes on behind the last one that was finished."""
    rows = segments.lines(docs)
    prose = rows.where("not blank").where(X.should_translate(F.col("value")))
    spread = stage(spark, path, "map", lambda: segments.dedup(prose)[1])
    distinct = stage(spark, path, "distinct", lambda: spread.groupBy("count_deduped").agg(F.first("value").alias("value")))
    chunks = stage(spark, path, "chunks", lambda: segments.split_chunks(distinct.select(F.col("count_deduped").alias("doc_id"), F.lit(0).alias("ord"), "value"), limit))
    group = 256  # distinct values that may share a request
    asked = chunks.select(F.floor(F.col("doc_id") / group).alias("doc_id"), (F.pmod(F.col("doc_id"), F.lit(group)) * 65536 + F.col("chunk")).alias("count_split"), "value")
    results = stage(spark, path, "results", lambda: translate(asked, src, dst, model, budget, retries))
    told = results.select((F.col("doc_id") * group + F.floor(F.col("count_split") / 65536)).alias("count_deduped"), F.pmod(F.col("count_split"), F.lit(65536)).cast("int").alias("chunk"), "translated")
    whole = chunks.select(F.col("doc_id").alias("count_deduped"), "chunk", "chunks").join(told, ["count_deduped", "chunk"], "left")
    back = segments.restore(spread, whole)
    text = rows.join(back.select("doc_id", "ord", "translated"), ["doc_id", "ord"], "left")
    parts = text.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("translated", "value").alias("t")))).alias("p"))
    return parts.select("doc_id", F.array_join(F.transform("p", lambda p: p["t"]), "\n").alias("text"))
