"""The life of segments (doc_id, ord, type, value): distinct values, batches, replies, restoring, coverage and checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators.joins import keyed_join
from textloom.operators.ordering import global_rank, written

# Report category of each segment type; any other type is `other`.
CATEGORIES = {
    "text": "body", "paragraph": "body", "heading": "body", "list": "body", "block": "body", "table_cell": "table", "cell": "table",
    "header": "header_footer", "footer": "header_footer", "footnote": "notes", "endnote": "notes", "notes": "notes",
    "comment": "comments", "chart": "charts", "smartart": "smartart", "textbox": "textboxes", "shape": "textboxes",
    "alt_text": "alt_text", "image": "alt_text", "metadata": "metadata", "subtitle": "subtitles", "srt": "subtitles", "vtt": "subtitles", "ass": "subtitles",
}


def lines(docs: DataFrame, *keep: str) -> DataFrame:
    """A segment per line of (doc_id, text): ord from 0, the raw value, whether it is blank."""
    parts = docs.select("doc_id", *keep, F.posexplode(F.split("text", "\n", -1)).alias("ord", "value"))
    return parts.withColumn("blank", X.trim_u(F.col("value")) == "")


def dedup(segments: DataFrame, key: tuple[str, ...] = ("value",), order: tuple[str, ...] = ("doc_id", "ord")) -> tuple[DataFrame, DataFrame]:
    """(distinct, map): each distinct key once with count_deduped, numbered by first occurrence, and n; and the segments'
    order columns with the count_deduped of their key. Partial aggregation collapses copies before the shuffle."""
    first = segments.groupBy(*key).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n"))
    distinct = global_rank(first, ["first"], "count_deduped")
    # 128 bits stand for the key, so that no text is a key of the join; a line that many documents share is spread
    ends = lambda df, *more: df.select(*more, F.xxhash64(*key).alias("_a"), F.xxhash64(*key, F.lit(1)).alias("_b"))
    mapped = keyed_join(ends(segments, *order, *key), ends(distinct, "count_deduped"), ["_a", "_b"])
    return distinct, mapped.select(*order, *key, "count_deduped")


def fake_translate(c: Column) -> Column:
    """The stand-in for a model: a mark before the text."""
    return F.concat(F.lit("[T]"), c)


def restore(segment_map: DataFrame, chunks: DataFrame, order: tuple[str, ...] = ("doc_id", "ord")) -> DataFrame:
    """Segments with `translated`: the chunks (count_deduped, chunk, chunks, translated) of their distinct value joined in
    order, or the value itself where any chunk is missing or empty."""
    good = chunks.where(F.coalesce(F.col("translated"), F.lit("")) != "")
    whole = good.groupBy("count_deduped").agg(F.max("chunks").alias("want"), F.array_sort(F.collect_list(F.struct("chunk", "translated"))).alias("parts"))
    whole = whole.where(F.size("parts") == F.col("want")).select("count_deduped", X.join_chunks(F.transform("parts", lambda p: p["translated"])).alias("joined"))
    # a line that many documents share is a hot key
    back = keyed_join(segment_map, written(whole, "joined", wide=True), ["count_deduped"], "left")
    return back.select(*order, "value", F.coalesce("joined", "value").alias("translated"))


def fill_missing(chunks: DataFrame, results: DataFrame, key: str = "count_split") -> DataFrame:
    """Every chunk with its result, the last of several, or its own text where there is none."""
    last = results.groupBy(key).agg(F.max_by("translated", "seq").alias("translated"))
    out = chunks.join(last, key, "left")
    return out.select(key, F.col("value").alias("original"), F.coalesce("translated", "value").alias("translated"), F.col("translated").isNull().alias("missing"))


def category(c: Column) -> Column:
    named = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    return F.coalesce(F.try_element_at(named, F.lower(F.coalesce(c, F.lit("text")))), F.lit("other"))


def is_translated(original: Column, translated: Column) -> Column:
    return (X.trim_u(F.coalesce(translated, F.lit(""))) != "") & (translated != original)


def coverage(results: DataFrame, *by: str) -> DataFrame:
    """total, translated, fallback, needs_review of (original, translated, review)."""
    ok = is_translated(F.col("original"), F.col("translated"))
    aggs = [F.count("*").alias("total"), F.count_if(ok).alias("translated"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("fallback"), F.count_if("review").alias("needs_review")]
    return results.groupBy(*by).agg(*aggs) if by else results.agg(*aggs)


def qa_flags(pairs: DataFrame, lang: str | None = None) -> DataFrame:
    """Adds the checks of (original, translated[, start, end]): length ratio, placeholders, width, lines, reading speed."""
    base = (lang or "").split("-")[0]
    pick = lambda of, default: of.get(lang) or of.get(base) or default
    # Cells a line and characters a second by language.
    width = pick({"ja": 26, "zh": 32, "zh-Hant": 32, "zh-Hans": 32, "ko": 32}, 42)
    speed = pick({"ja": 7.0, "zh": 9.0, "zh-Hant": 9.0, "zh-Hans": 9.0, "ko": 12.0}, 20.0)
    o, t = F.coalesce("original", F.lit("")), F.coalesce("translated", F.lit(""))
    lo, lt = F.length(X.trim_u(o)), F.length(X.trim_u(t))
    rows = F.split(t, r"\r\n|\r|\n", -1)
    out = pairs.withColumns({
        "bad_ratio": (lo >= 8) & (lt > 0) & ((lt < 0.25 * lo) | (lt > 4.0 * lo)),
        "bad_tokens": (o != "") & (t != "") & (X.tokens(o, X.LOOSE) != X.tokens(t, X.LOOSE)),
        "too_wide": F.exists(rows, lambda r: X.cells(r) > width),
        "too_many_lines": F.size(rows) > 2,
    })
    if "start" in pairs.columns:
        span = F.col("end") - F.col("start")
        chars = F.length(X.trim_u(F.replace(t, F.lit("\n"), F.lit(""))))
        out = out.withColumn("too_fast", F.coalesce((span > 0) & (chars > 0) & (chars / span > speed), F.lit(False)))
    return out


def qa_report(flagged: DataFrame, key: str = "doc_id") -> DataFrame:
    """(check, n, first) by check: how many rows fail it, and the least key that does."""
    checks = [c for c in ("bad_ratio", "bad_tokens", "too_wide", "too_many_lines", "too_fast") if c in flagged.columns]
    long = flagged.select(key, F.explode(F.array(*[F.when(F.col(c), F.lit(c)) for c in checks])).alias("check")).where("check is not null")
    return long.groupBy("check").agg(F.count("*").alias("n"), F.min(key).alias("first"))


def outcome(replies: DataFrame, src: str, dst: str, last_try: bool = False) -> DataFrame:
    """Adds outcome to (original, translated): translated, failed, or on the last try needs_review, where only texts whose
    tokens are whole may be kept although they are not valid."""
    ok = X.translation_valid(F.col("original"), F.col("translated"), src, dst)
    whole = X.structure_kept(F.col("original"), F.col("translated")) & (X.trim_u(F.coalesce("translated", F.lit(""))) != "")
    rest = F.when(whole, "needs_review").otherwise("failed") if last_try else F.lit("failed")
    return replies.withColumn("outcome", F.when(ok, "translated").otherwise(rest))


class Machine:
    """A state that a key's rows pass through in order: add() and close() give rows that are ready."""

    def add(self, *row) -> list[tuple]:
        raise NotImplementedError

    def close(self) -> list[tuple]:
        return []


def fold(df: DataFrame, key: str, order: list[str], make: Callable[[], Machine], schema: str) -> DataFrame:
    """An order-dependent pass over the rows of each key, which is the first column: rows are dealt and sorted by key, and
    a task runs one machine a key over them as they stream by, so that a key of any length takes the memory of its
    machine. A key's rows are one document, conversation or stream and go to one task; keys spread."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[] for _ in kinds], kinds, strict=True)], schema=kinds)

    def run(batches):
        machine, now = None, None
        for part in batches:
            ready: list[tuple] = []
            for row in zip(*[c.to_pylist() for c in part.columns], strict=True):
                if machine is None or row[0] != now:
                    if machine is not None:
                        ready += machine.close()
                    machine, now = make(), row[0]
                ready += machine.add(*row)
            yield batch(ready)
        yield batch(machine.close() if machine is not None else [])

    columns = [key, *[c for c in df.columns if c != key]]
    return df.select(*columns).repartition(F.col(key)).sortWithinPartitions(key, *order).mapInArrow(run, schema)


class Greedy(Machine):
    """Rows with the number of their batch: a batch ends before the row whose cost would exceed the budget, and an
    over-large row has one of its own. `cost` is the row's place of the cost."""

    def __init__(self, budget: float, cost: int):
        self.budget, self.cost, self.batch, self.used = budget, cost, 0, 0.0

    def add(self, *row) -> list[tuple]:
        if self.used and self.used + row[self.cost] > self.budget:
            self.batch, self.used = self.batch + 1, 0.0
        self.used += row[self.cost]
        return [(*row, self.batch)]


def pack(segments: DataFrame, budget: int, cost: Callable[[Column], Column] = X.token_count) -> DataFrame:
    """(doc_id, ord, cost, batch): batches of ordered segments of a document by token budget: a row's cost is that of its
    JSON line; one that exceeds the budget stands alone."""
    line = F.to_json(F.map_from_arrays(F.array(F.col("ord").cast("string")), F.array("value")))
    thin = segments.select("doc_id", "ord", cost(line).cast("int").alias("cost"))
    return fold(thin, "doc_id", ["ord"], lambda: Greedy(budget, 2), "doc_id long, ord int, cost int, batch int")


def split_chunks(segments: DataFrame, limit: int = 1200) -> DataFrame:
    """(doc_id, ord, chunk, chunks, value): texts over the token limit cut at sentence ends, over-long sentences at inner
    punctuation and then by length; no character is lost but for doubled punctuation in texts that are cut."""

    def cut(text: str) -> list[str]:
        import re

        token = re.compile(r"[^\W\d_]+|\d|[^\s\w]+|_")
        count = lambda t: len(token.findall(t))
        if count(text) <= limit:
            return [text]
        for a, b in (("..", "."), ("。。", "。"), ("，，", "，"), ("!!", "!"), ("??", "?")):
            text = text.replace(a, b)

        def fine(part: str, patterns: tuple[str, ...]) -> Iterator[tuple[str, int]]:
            """(piece, tokens) of a part, cut by the first pattern, pieces that are still over the limit by the next ones,
            and at last by length."""
            n = count(part)
            if n <= limit:
                yield part, n
            elif patterns:
                for piece in re.findall(patterns[0], part):
                    yield from fine(piece, patterns[1:])
            else:
                step = max(1, int(0.9 * limit))
                ends = [0, *[m.end() for m in token.finditer(part)][step - 1 : -1 : step], len(part)]
                yield from ((part[a:b], step) for a, b in zip(ends, ends[1:], strict=False) if a < b)

        out, now, held = [], "", 0
        for piece, n in fine(text, (r"""[^.!?;。！？；\n]*[.!?;。！？；\n]["'”’」』）)]* *|[^.!?;。！？；\n]+$""", r"[^,，、:：]*[,，、:：] *|[^,，、:：]+$")):
            if now and held + n > limit:
                out.append(now)
                now, held = "", 0
            now, held = now + piece, held + n
        return [*out, now] if now else out

    @F.pandas_udf("array<string>")
    def chunks_of(values: pd.Series) -> pd.Series:
        return values.map(lambda v: cut(v) if v else [v or ""])

    cut_ = segments.select("doc_id", "ord", chunks_of(F.col("value")).alias("_c"))
    return cut_.select("doc_id", "ord", F.posexplode("_c").alias("chunk", "value"), F.size("_c").alias("chunks"))


def previous_context(batches: DataFrame, by: str, order: str, size: int = 200) -> DataFrame:
    """Adds previous: the last characters of the last batch before that has text."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tail = F.when(X.trim_u(F.col("text")) != "", F.right("text", F.lit(size)))
    return batches.withColumn("previous", F.coalesce(F.last(tail, ignorenulls=True).over(w), F.lit("")))


def translate_rounds(chunks: DataFrame, call: Callable[[DataFrame, int], DataFrame], src: str, dst: str, retries: int = 3) -> DataFrame:
    """Chunks (count_split, original) through call(rows, round), which adds translated: failed rows go again, the last
    round keeps what is structurally whole. Each round is written, so that a lost executor repeats no calls."""
    done, left = None, chunks
    for n in range(retries + 1):
        got = written(outcome(call(left, n), src, dst, last_try=n == retries), "round", wide=True)
        ok = got if n == retries else got.where("outcome <> 'failed'")
        done = ok if done is None else done.unionByName(ok)
        left = got.where("outcome = 'failed'").select(*chunks.columns)
        if left.isEmpty():
            break
    return done.withColumn("translated", F.when(F.col("outcome") == "failed", F.col("original")).otherwise(F.col("translated")))


# --- sets of rows -----------------------------------------------------------------------------------------------------


def unfinished(chunks: DataFrame) -> DataFrame:
    """What a run that goes on still has to do: rows with an id and a text that are not marked as translated."""
    return chunks.where(F.col("count_split").isNotNull() & (X.trim_u(F.coalesce("value", F.lit(""))) != "") & ~F.coalesce("translated_status", F.lit(False)))


def marked(chunks: DataFrame, results: DataFrame, key: str = "count_split") -> DataFrame:
    """chunks with translated_status where results have their id."""
    done = results.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_done", F.lit(True))
    return chunks.drop("translated_status").join(done, key, "left").withColumn("translated_status", F.coalesce("_done", F.lit(False))).drop("_done")


def first_reports(known: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """known, and of more what has a key that known has not, the first of each by its other columns."""
    fresh = more.where(F.col(key).isNotNull()).join(known.select(key), key, "left_anti")
    one = fresh.groupBy(key).agg(F.min(F.struct(*[c for c in more.columns if c != key])).alias("_r")).select(key, "_r.*")
    return known.unionByName(one)


def missing_ids(chunks: DataFrame, results: DataFrame, key: str = "count_split") -> DataFrame:
    """Ids that have no result."""
    return chunks.select(key).distinct().join(results.select(key), key, "left_anti")


def all_failed_before(batches: DataFrame, failed: DataFrame) -> DataFrame:
    """(batch, retried) of (batch, count_split): whether all ids of a batch are among the failed, so it is no first try."""
    seen = batches.join(failed.select("count_split").distinct().withColumn("_f", F.lit(True)), "count_split", "left")
    return seen.groupBy("batch").agg(F.bool_and(F.coalesce("_f", F.lit(False))).alias("retried"))


def routed(rows: DataFrame, types: tuple[str, ...]) -> dict[str, DataFrame]:
    """rows by their type, for the writer of each part; types have no rows in common."""
    return {t: rows.where(F.col("type") == t) for t in types}


def without(rows: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """rows but for those that gone names: lines that have been merged into others."""
    return rows.join(gone.select(*on), on, "left_anti")


def default_first(name: Column, first: str = "Default") -> list[Column]:
    """An order of names: one of them, then the others in any case."""
    return [name != first, F.lower(name), name]
