"""Records of runs, tables for proofreading, lists of documents, admission, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as X


def run_records(runs: DataFrame) -> DataFrame:
    """A record of each run (id, start_time, end_time, input_file, ..): its duration, its file type, texts without nulls, an
    error of 500 characters at most, a batch of one where it has none. Other columns stay."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    made = {
        "duration_seconds": F.floor((F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))) / 1_000_000),
        "file_type": X.file_type(F.col("input_file")), "error_reason": F.substring(text("error_reason"), 1, 500), "error_category": text("error_category"),
        "batch_id": text("batch_id"), "batch_size": F.coalesce(F.nullif(F.col("batch_size"), F.lit(0)), F.lit(1)),
    }
    return runs.withColumns(made)


def edited(table: DataFrame, rows: DataFrame) -> tuple[DataFrame, int]:
    """(table with rows' translations, how many changed) for two tables of (ord, count_src, translated).

    Refused are a different number of rows, another order of them, and an all-empty table in the place of one that is not."""
    named = rows.select("ord", F.col("count_src").alias("_id"), F.coalesce("translated", F.lit("")).alias("_new"))
    both = table.join(named, "ord", "full")
    has = lambda c: F.coalesce(F.bool_or(X.trim_u(F.coalesce(F.col(c), F.lit(""))) != ""), F.lit(False))
    seen = both.agg(F.count_if(F.col("_new").isNull() | F.col("count_src").isNull()).alias("lost"), F.count_if(~F.col("_id").eqNullSafe(F.col("count_src"))).alias("moved"), has("translated").alias("had"), has("_new").alias("has"), F.count_if(F.coalesce("translated", F.lit("")) != F.col("_new")).alias("changed")).first()
    if seen["lost"] or seen["moved"]:
        raise ValueError(f"the rows don't match the table: {seen['lost']} are missing, {seen['moved']} stand elsewhere")
    if seen["had"] and not seen["has"]:
        raise ValueError("the table would lose all its translations")
    return both.withColumn("translated", F.col("_new")).select(*table.columns), seen["changed"]


def overridden(texts: DataFrame, edits: DataFrame) -> DataFrame:
    """texts (value, ..) with `value` replaced by what edits (original, edited) say of it, sought without white space around
    it; a blank or missing edit keeps the text. Of several edits of a text the last (ord) counts."""
    last = edits.groupBy(X.trim_u(F.col("original")).alias("_k")).agg(F.max_by("edited", "ord").alias("_e"))
    got = texts.withColumn("_k", X.trim_u(F.col("value"))).join(last, "_k", "left")
    return got.withColumn("value", F.coalesce(F.when(X.trim_u(F.col("_e")) != "", F.col("_e")), F.col("value"))).drop("_k", "_e")


def finished(files: DataFrame, depth: int = 4) -> DataFrame:
    """(folder, mtime) of the folders of a listing (path, mtime) that hold a result and its manifest, no deeper than `depth`
    below the root (paths are relative to it), and within no folder that is one itself."""
    at = files.select(F.regexp_replace("path", "/?[^/]*$", "").alias("folder"), F.regexp_extract("path", "[^/]*$", 0).alias("name"), "mtime").where("folder <> ''")
    found = at.groupBy("folder").agg(F.max(F.when(F.col("name") == "dst_translated.json", F.col("mtime"))).alias("mtime"), F.bool_or(F.col("name") == "manifest.json").alias("m")).where("mtime is not null and m").drop("m")
    found = found.where(F.size(F.split("folder", "/")) <= depth + 1)
    steps = F.transform(F.sequence(F.lit(1), F.size(F.split("folder", "/"))), lambda n: F.array_join(F.slice(F.split("folder", "/"), 1, n), "/"))
    above = found.select("folder", F.explode(steps).alias("up")).where("up <> folder")
    inside = above.join(found.select(F.col("folder").alias("up")), "up", "left_semi").select("folder")
    return found.join(inside, "folder", "left_anti")


def documents_in_order(docs: DataFrame, by: str = "time", descending: bool = True) -> DataFrame:
    """docs (folder, mtime) by time, or by the folder's own name in any case."""
    key = F.col("mtime") if by == "time" else X.fold_case(F.regexp_extract("folder", "[^/]*$", 0))
    return docs.orderBy(key.desc() if descending else key.asc(), "folder")


def admitted(tasks: DataFrame, requests: DataFrame, most: int, most_each: int) -> DataFrame:
    """requests (session_id, ..) with `verdict`: busy where all sessions together run `most` tasks (session_id, status), else
    full where the session runs `most_each`, else go."""
    running = tasks.where("status = 'running'").groupBy("session_id").agg(F.count("*").alias("n"))
    total = running.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    got = requests.join(running, "session_id", "left").crossJoin(F.broadcast(total))  # one row
    verdict = F.when(F.col("all") >= most, "busy").when(F.coalesce("n", F.lit(0)) >= most_each, "full").otherwise("go")
    return got.withColumn("verdict", verdict).drop("n", "all")


def kept_tasks(tasks: DataFrame, now: Column, ttl: float = 1800) -> DataFrame:
    """Tasks but for those that have ended longer than `ttl` seconds ago."""
    over = F.col("status").isin("done", "error", "stopped") & (now - F.coalesce(F.col("ended_at"), now) > ttl)
    return tasks.where(~over)


def report_lines(results: DataFrame) -> DataFrame:
    """Adds line to (name, status, detail): what a package says about each of its files."""
    return results.withColumn("line", F.concat(F.col("name"), F.lit(": "), F.col("status"), F.when(F.coalesce("detail", F.lit("")) != "", F.concat(F.lit(" - "), F.col("detail"))).otherwise("")))


def loudest(tracks: DataFrame, wanted: str = "auto") -> DataFrame:
    """(file, track) of tracks (file, track, lang, volume): the one of that number (else the first), the first of that
    language, or the loudest, the first of equals; a file of one track or none has no choice to make."""
    w = Window.partitionBy("file")
    many = tracks.withColumn("_n", F.count("*").over(w)).where("_n > 1")
    first = F.min("track")
    loud = F.coalesce(F.max_by("track", F.struct("volume", -F.col("track"))), first)
    if wanted.isdigit():
        pick = F.coalesce(F.max(F.when(F.col("track") == int(wanted), F.col("track"))), F.lit(0))
    elif wanted not in ("", "auto"):
        pick = F.coalesce(F.min(F.when(F.lower("lang").startswith(wanted.lower()), F.col("track"))), loud)
    else:
        pick = loud
    return many.groupBy("file").agg(pick.alias("track"))


def backfilled(labels: DataFrame, base: str = "en") -> DataFrame:
    """labels (lang, key, text) with the keys that a language lacks taken from the base language."""
    grid = labels.select("lang").distinct().join(F.broadcast(labels.where(F.col("lang") == base).select("key", F.col("text").alias("_base"))))  # languages by labels
    own = labels.alias("o").join(grid, ["lang", "key"], "full")
    return own.select("lang", "key", F.coalesce("text", "_base").alias("text"))


def numbered(paragraphs: DataFrame, nums: DataFrame, levels: DataFrame) -> DataFrame:
    """paragraphs (num_id, level, ..) with format and template of their numbering: num_id names a list of nums (num_id,
    abstract_id), which names levels (abstract_id, level, format, template)."""
    return paragraphs.join(nums, "num_id", "left").join(levels, ["abstract_id", "level"], "left")


def remaining(segments: DataFrame, known: DataFrame) -> DataFrame:
    """Segments (file, start_ms, end_ms) that no checkpoint has recognised yet."""
    return segments.join(known.select("file", "start_ms", "end_ms"), ["file", "start_ms", "end_ms"], "left_anti")
