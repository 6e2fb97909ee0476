"""Runs as a user sees them: groups of jobs that can be watched and stopped, states of files, settings, logs, reports."""

from __future__ import annotations

import io
import itertools
import json
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions.tokens import arrow
from textloom.operators.records import report_lines


@contextmanager
def job_group(spark: SparkSession, name: str, about: str = "") -> Iterator[None]:
    """Jobs that are started within belong to the run `name`, so that progress() sees and stop() ends them."""
    spark.sparkContext.setJobGroup(name, about or name, interruptOnCancel=True)
    try:
        yield
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def stop(spark: SparkSession, name: str) -> None:
    spark.sparkContext.cancelJobGroup(name)


def progress(spark: SparkSession, name: str) -> float:
    """The share of the tasks of a run's live stages that have ended; 1 where none is live."""
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup(name) if (job := tracker.getJobInfo(j)) and job.status == "RUNNING" for s in map(tracker.getStageInfo, job.stageIds) if s]
    tasks = sum(s.numTasks for s in stages)
    return sum(s.numCompletedTasks for s in stages) / tasks if tasks else 1.0


def file_states(results: DataFrame) -> DataFrame:
    """Adds state to a run's files (run, ord, status, error): what has been done, but behind the first error that no retry
    mends, or behind a stop, the rest of the run's files are stopped."""
    ends = (F.col("status") == "stopped") | ((F.col("status") == "failed") & (X.error_class(F.col("error")) == "hard"))
    at = Window.partitionBy("run").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    over = F.coalesce(F.max(ends).over(at), F.lit(False))
    return results.withColumn("state", F.when(over, "stopped").otherwise(F.col("status")))


def rates(runs: DataFrame) -> DataFrame:
    """Adds progress (at most 1), rate (items a second) and left (seconds) to (done, total, seconds); null where unknown."""
    share = F.when(F.col("total") > 0, F.least(F.lit(1.0), F.col("done") / F.col("total")))
    rate = F.when((F.col("seconds") > 0) & (F.col("done") > 0), F.col("done") / F.col("seconds"))
    return runs.withColumns({"progress": share, "rate": rate, "left": F.when(rate > 0, F.greatest(F.lit(0.0), F.col("total") - F.col("done")) / rate)})


def route_logs(logs: DataFrame, path: str, fallback: str = "system") -> None:
    """Writes log lines (task_id, ..) to a folder for each task; lines of no task go to the fallback."""
    named = logs.withColumn("task_id", F.coalesce(F.nullif(F.col("task_id"), F.lit("")), F.lit(fallback)))
    named.repartition("task_id").write.partitionBy("task_id").mode("append").json(path)


def report(coverage: DataFrame, checks: DataFrame) -> Column:
    """One row's JSON of a run's coverage (a row) and of its checks (check, ids)."""
    ids = checks.agg(F.array_sort(F.collect_list(F.struct("check", "ids"))).alias("checks"))
    both = coverage.crossJoin(ids)  # one row each
    return both.select(F.to_json(F.struct(F.struct(*coverage.columns).alias("coverage"), F.map_from_entries("checks").alias("qa"))).alias("report"))


def transcript(source: DataFrame, target: DataFrame, title: str) -> DataFrame:
    """(session, n, line) of live sessions' transcripts: a title, each line of source (session, ord, text) with the k-th
    translation of its time stamp below, a blank line, and at the end translations that have no line."""
    stamp = F.regexp_extract("text", r"^\[(\d{2}:\d{2}:\d{2})\]", 1)

    def placed(df: DataFrame) -> DataFrame:
        named = df.withColumn("ts", stamp)
        return named.withColumn("k", F.row_number().over(Window.partitionBy("session", "ts").orderBy("ord")))

    a = placed(source)
    b = placed(target).where("ts <> ''").select("session", "ts", "k", F.col("text").alias("translated"), F.col("ord").alias("later"))
    both = a.join(b, ["session", "ts", "k"], "full")
    line = lambda group, place, order, text: F.struct(F.lit(group).alias("g"), place.cast("long").alias("p"), F.lit(order).alias("o"), text.alias("line"))
    own = F.array(line(1, F.col("ord"), 0, F.col("text")), line(1, F.col("ord"), 1, F.col("translated")), line(1, F.col("ord"), 2, F.lit("")))
    rest = F.array(line(2, F.col("later"), 0, F.col("translated")))
    rows = both.select("session", F.explode(F.when(F.col("text").isNotNull(), own).otherwise(rest)).alias("l")).where("l.line is not null")
    heads = rows.select("session").distinct().select("session", F.explode(F.array(line(0, F.lit(0), 0, F.lit(title)), line(0, F.lit(0), 1, F.lit("")))).alias("l"))
    n = F.row_number().over(Window.partitionBy("session").orderBy("l.g", "l.p", "l.o"))
    return heads.unionByName(rows).select("session", n.alias("n"), F.col("l.line").alias("line"))


def quick(texts: DataFrame, translated: Column) -> DataFrame:
    """Adds translated and ok to (text): a blank text, or one without a reply, gives an empty one."""
    ok = (X.trim_u(F.coalesce("text", F.lit(""))) != "") & (F.coalesce(translated, F.lit("")) != "")
    return texts.withColumn("ok", ok).withColumn("translated", F.when(ok, X.trim_u(translated)).otherwise(""))


def settings(spark: SparkSession, path: str) -> DataFrame:
    """(name, key, value) of the JSON files of settings at a path: a file's name without its ending, and its leaves by their
    keys with dots between; a file that is no JSON object has none."""

    def leaves(node, at: str) -> Iterator[tuple[str, str]]:
        for k, x in node.items():
            if isinstance(x, dict):
                yield from leaves(x, f"{at}{k}.")
            else:
                yield f"{at}{k}", x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)

    def found(text: str) -> list[dict[str, str]]:
        try:
            tree = json.loads(text)
        except ValueError:
            return []
        return [{"key": k, "value": x} for k, x in leaves(tree, "")] if isinstance(tree, dict) else []

    read = arrow(found, "array<struct<key:string,value:string>>")
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]*)\.[^./]*$", 1).alias("name"), F.inline(read(F.col("value"))))
    return files


def resolved(options: DataFrame, base: str, over: str) -> DataFrame:
    """(key, value) of settings (name, key, value): what `over` says goes before `base`."""
    rank = F.when(F.col("name") == over, 0).otherwise(1)
    return options.where(F.col("name").isin(base, over)).groupBy("key").agg(F.min_by("value", rank).alias("value"))


def packages(files: DataFrame) -> DataFrame:
    """(run, package) of the files of runs (run, ord, name, content, status, detail): a zip of what has content, in order,
    a name that is taken numbered from 2 until it is free, and results.txt with a line for each file. A run's files are one
    user's upload."""
    lines = report_lines(files)
    entry = F.struct("ord", F.coalesce("name", F.lit("")).alias("name"), "content", "line")
    runs = lines.groupBy("run").agg(F.array_sort(F.collect_list(entry)).alias("entries"))

    @F.pandas_udf("binary")
    def pack(entries: pd.Series) -> pd.Series:
        return entries.map(lambda e: package([(x["name"], x["content"], x["line"]) for x in e]))

    return runs.select("run", pack("entries").alias("package"))


def package(entries: list[tuple[str, bytes | None, str]]) -> bytes:
    """A zip of (name, content, line of the report); the same entries give the same bytes."""
    out, used = io.BytesIO(), set()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content, _ in entries:
            if content is not None:
                stem, dot, ending = name.rpartition(".")
                numbered = (f"{stem} ({i}){dot}{ending}" if dot else f"{name} ({i})" for i in itertools.count(2))
                free = next(n for n in itertools.chain([name], numbered) if n not in used)
                used.add(free)
                z.writestr(zipfile.ZipInfo(free, (1980, 1, 1, 0, 0, 0)), bytes(content), zipfile.ZIP_DEFLATED)
        z.writestr(zipfile.ZipInfo("results.txt", (1980, 1, 1, 0, 0, 0)), "".join(f"{line}\n" for _, _, line in entries))
    return out.getvalue()
