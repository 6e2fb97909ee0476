"""Runs and their records: filters, batches, retention, names, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.ordering import running_sum

SORTS = ("start_time", "end_time", "total_tokens", "file_type", "status", "file_name")
LIVE = ("running", "paused", "queued")


def select_runs(runs: DataFrame, file_type: str | None = None, status: str | None = None, sort_by: str = "start_time", descending: bool = True, limit: int | None = None) -> DataFrame:
    """Runs by filter, in an allowed order (any other falls back to start_time), ties by id."""
    if file_type:
        runs = runs.where(F.col("file_type") == file_type.lower().lstrip("."))
    if status:
        runs = runs.where(F.col("status") == status)
    by = F.col(sort_by if sort_by in SORTS else "start_time")
    runs = runs.orderBy(by.desc() if descending else by.asc(), "id")
    return runs.limit(limit) if limit else runs


def batch_status(runs: DataFrame) -> DataFrame:
    """(batch, n, first, status) of runs: a run without a batch is its own; the worst news decides."""
    batch = F.coalesce(F.col("batch_id"), F.concat(F.lit("__solo__"), F.col("id").cast("string")))
    any_ = lambda *s: F.bool_or(F.col("status").isin(*s))
    state = (
        F.when(any_("running", "queued"), "running").when(any_("paused"), "paused")
        .when(F.bool_and(F.col("status") == "success"), "success").when(any_("failed"), "failed").when(any_("interrupted"), "interrupted").otherwise("stopped")
    )
    return runs.groupBy(batch.alias("batch")).agg(F.count("*").alias("n"), F.min("start_time").alias("first"), state.alias("status"))


def recover(runs: DataFrame) -> DataFrame:
    """After a restart what was live has been interrupted."""
    return runs.withColumn("status", F.when(F.col("status").isin(*LIVE), "interrupted").otherwise(F.col("status")))


def newest(runs: DataFrame, most: int, max_age_days: int, now: Column) -> DataFrame:
    """Runs young enough, of these the `most` newest: a top-k, not a sort of all."""
    young = runs.where(F.col("start_time") >= now - F.expr(f"INTERVAL {max_age_days} DAYS"))
    return young.orderBy(F.desc("start_time"), F.desc("id")).limit(most)


def over_size(files: DataFrame, cap: int, by: str) -> DataFrame:
    """Adds delete: whether a file and all newer ones of its folder exceed the cap, so the oldest go first. A folder that
    holds most files spreads over tasks."""
    total = running_sum(files, [by], [F.col("mtime").desc(), F.col("path").desc()], F.col("size"), "_total")
    return total.withColumn("delete", F.col("_total") > cap).drop("_total")


def unique_names(files: DataFrame) -> DataFrame:
    """Adds unique: the k-th file of a name gets ` (k)` before its extension. A name that most files have spreads."""
    numbered = running_sum(files, ["name"], [F.col("ord")], F.lit(1), "_k")
    stem, ext = F.regexp_replace("name", r"\.[^.]*$", ""), F.regexp_extract("name", r"\.[^.]*$", 0)
    k = F.col("_k")
    return numbered.withColumn("unique", F.when(k == 1, F.col("name")).otherwise(F.concat(stem, F.lit(" ("), k.cast("string"), F.lit(")"), ext))).drop("_k")


def pair_transcript(source: DataFrame, target: DataFrame, by: str, ts: str) -> DataFrame:
    """Lines of both sides paired by stamp and place within it; what has no partner stays alone."""
    place = lambda df: df.withColumn("k", F.row_number().over(Window.partitionBy(by, ts).orderBy("ord")))
    a, b = place(source).select(by, ts, "k", F.col("text").alias("source")), place(target).select(by, ts, "k", F.col("text").alias("target"))
    return a.join(b, [by, ts, "k"], "full")


def latest_queries(history: DataFrame, key: list[str], n: int) -> DataFrame:
    """The last entry of each key, the n newest of these."""
    last = history.groupBy(*key).agg(F.max_by(F.struct(*[c for c in history.columns if c not in key]), "ts").alias("l"))
    return last.select(*key, "l.*").orderBy(F.desc("ts"), *key).limit(n)
