"""Registered queries of runs: states, logs, reports, transcripts, settings, requests of a live stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import control, segments, timeline
from textloom.plans.catalogue import boxes, cues, query, read, texts
from textloom.storage import scratch
from textloom.streaming import speech


@query("SELECT o_custkey AS run, o_orderkey AS ord, CASE WHEN coalesce(max(CASE WHEN o_orderkey % 9 = 4 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'stopped' WHEN o_orderkey % 9 IN (2, 4) THEN 'failed' ELSE 'success' END AS state FROM orders")
def run_states(spark, sf):
    """Orders as files of their customer's run: every ninth fails for good, every other ninth for a time."""
    kind = F.col("o_orderkey") % 9
    rows = read(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("ord"), F.when(kind.isin(2, 4), "failed").otherwise("success").alias("status"), F.when(kind == 4, "401 Unauthorized").when(kind == 2, "timed out").alias("error"))
    return control.file_states(rows).select("run", "ord", "state")


@query("SELECT o_custkey, count(*) AS done, least(1.0, count(*) / 12.0) AS progress, count(*) / 60.0 AS rate, greatest(0, 12 - count(*)) / (count(*) / 60.0) AS \"left\" FROM orders GROUP BY o_custkey")
def progress_rates(spark, sf):
    done = read(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("done"))
    return control.rates(done.withColumn("total", F.lit(12)).withColumn("seconds", F.lit(60.0))).select("o_custkey", "done", "progress", "rate", "left")


@query("SELECT CASE WHEN event_type = 'view' THEN 'system' ELSE event_type END AS task_id, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1")
def log_routing(spark, sf):
    """Events as log lines; views belong to no task."""
    path = scratch(spark, "logs")
    e = read(spark, sf, "events")
    control.route_logs(e.select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("task_id"), "event_id"), path)
    return spark.read.schema("event_id long, task_id string").json(path).groupBy("task_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("SELECT '{\"coverage\":{\"total\":' || count(*) || ',\"translated\":' || count_if(doc_id % 7 <> 0) || ',\"fallback\":' || count_if(doc_id % 7 = 0) || ',\"needs_review\":' || count_if(doc_id % 13 = 0) || '},\"qa\":{\"length\":[' || (SELECT string_agg(doc_id, ',' ORDER BY doc_id) FROM documents WHERE doc_id % 50 = 0) || '],\"width\":[' || (SELECT string_agg(doc_id, ',' ORDER BY doc_id) FROM documents WHERE doc_id % 90 = 0) || ']}}' AS report FROM documents")
def report_json(spark, sf):
    d = texts(spark, sf).where("text <> ''").unionByName(texts(spark, sf).where("text = ''")).select("doc_id", F.lit("a").alias("original"), F.when(F.col("doc_id") % 7 != 0, "b").otherwise("a").alias("translated"), (F.col("doc_id") % 13 == 0).alias("review"))
    flags = d.select("doc_id", F.explode(F.array(F.when(F.col("doc_id") % 50 == 0, "length"), F.when(F.col("doc_id") % 90 == 0, "width"))).alias("check")).where("check is not null")
    ids = flags.groupBy("check").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return control.report(segments.coverage(d), ids)


@query("""WITH c AS (SELECT conv_id AS session, turn AS ord, CASE WHEN role = 'assistant' THEN 'b' ELSE 'a' END AS side, printf('%02d:%02d:%02d', 0, turn // 4 // 60, turn // 4 % 60) AS ts, md5(text) AS t FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY session, side, ts ORDER BY ord) AS k FROM c),
p AS (SELECT coalesce(a.session, b.session) AS session, a.ord, b.ord AS later, '[' || a.ts || '] ' || a.t AS t, '[' || b.ts || '] ' || b.t AS u FROM (SELECT * FROM k WHERE side = 'a') a FULL JOIN (SELECT * FROM k WHERE side = 'b') b ON a.session = b.session AND a.ts = b.ts AND a.k = b.k),
l AS (SELECT session, 1 AS g, ord AS p, 0 AS o, t AS line FROM p WHERE t IS NOT NULL UNION ALL SELECT session, 1, ord, 1, u FROM p WHERE t IS NOT NULL AND u IS NOT NULL UNION ALL SELECT session, 1, ord, 2, '' FROM p WHERE t IS NOT NULL UNION ALL SELECT session, 2, later, 0, u FROM p WHERE t IS NULL UNION ALL SELECT DISTINCT session, 0, 0, 0, '# Live' FROM p UNION ALL SELECT DISTINCT session, 0, 0, 1, '' FROM p)
SELECT session, CAST(row_number() OVER (PARTITION BY session ORDER BY g, p, o) AS INTEGER) AS n, line FROM l""")
def live_transcripts(spark, sf):
    """Turns as lines of a session, an assistant's as translations; several have one time stamp."""
    c = read(spark, sf, "conversations")
    stamp = F.format_string("[00:%02d:%02d] ", F.floor(F.col("turn") / 240), F.floor(F.col("turn") / 4) % 60)
    lines = c.select(F.col("conv_id").alias("session"), F.col("turn").alias("ord"), F.concat(stamp, F.md5(F.col("text").cast("binary"))).alias("text"), "role")
    return control.transcript(lines.where("role <> 'assistant'").drop("role"), lines.where("role = 'assistant'").drop("role"), "# Live")


@query("SELECT doc_id, doc_id % 5 <> 0 AND trim(text) <> '' AS ok, md5(CASE WHEN doc_id % 5 <> 0 AND trim(text) <> '' THEN '[T]' || trim(text, ' ' || chr(9) || chr(10) || chr(13)) ELSE '' END) AS translated FROM documents")
def quick_translations(spark, sf):
    d = texts(spark, sf)
    reply = F.when(F.col("doc_id") % 5 != 0, segments.fake_translate(X.trim_u(F.col("text"))))
    return control.quick(d, reply).select("doc_id", "ok", F.md5(F.col("translated").cast("binary")).alias("translated"))


@query("SELECT n_name AS key, CASE WHEN n_nationkey % 3 = 0 THEN 'mode ' || n_nationkey ELSE 'base ' || n_nationkey END AS value FROM nation UNION ALL SELECT 'deep.x', '1'")
def mode_settings(spark, sf):
    """Two files of settings, the second of which speaks of a third of the keys."""
    from textloom.storage import _at

    n = [(r.n_name, r.n_nationkey) for r in read(spark, sf, "nation").collect()]  # a file of settings
    folder = scratch(spark, "settings")
    import json

    for name, tree in (("base", {k: f"base {i}" for k, i in n} | {"deep": {"x": 1}}), ("mode", {k: f"mode {i}" for k, i in n if i % 3 == 0}), ("broken", None)):
        at, fs = _at(spark, f"{folder}/{name}.json")
        out = fs.create(at, True)
        out.write(bytearray(json.dumps(tree).encode() if tree else b"{"))
        out.close()
    return control.resolved(control.settings(spark, folder), "base", "mode")


@query("SELECT DISTINCT CASE n_nationkey % 4 WHEN 0 THEN 'English' WHEN 1 THEN '日本語' WHEN 2 THEN 'Deutsch' ELSE 'xx' END AS name FROM nation")
def language_listing(spark, sf):
    """Names of the languages of files by their codes, once each; a code without a name stands for itself."""
    code = F.element_at(F.array(*map(F.lit, ["en", "ja", "de", "xx"])), (F.col("n_nationkey") % 4 + 1).cast("int"))
    named = F.create_map(*[F.lit(x) for name, c in X.LANGUAGES.items() for x in (c, name)])
    return read(spark, sf, "nation").select(F.coalesce(F.try_element_at(named, code), code).alias("name")).distinct()


@query("SELECT p_partkey % 20 AS files, array_to_string(list_distinct(list_filter(list(k ORDER BY p_partkey), lambda x: x IS NOT NULL)), '') IS NOT NULL AS some, len(list_distinct(list_filter(list(k ORDER BY p_partkey), lambda x: x IS NOT NULL))) AS keys, min(k ORDER BY p_partkey) IS NOT NULL AS any FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'excel_bilingual_mode' WHEN p_size % 3 = 1 THEN 'subtitle_bilingual_mode' END AS k FROM part) GROUP BY files")
def bilingual_keys(spark, sf):
    """The settings that a set of files asks for, in the order of the files, once each."""
    name = F.when(F.col("p_size") % 3 == 0, "a.xlsx").when(F.col("p_size") % 3 == 1, "b.MP4").otherwise("c.bin")
    p = read(spark, sf, "part").select((F.col("p_partkey") % 20).alias("files"), "p_partkey", X.bilingual_key(name).alias("k"))
    got = p.groupBy("files").agg(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("p_partkey", "k")))).alias("l"))
    keys = F.array_distinct(F.transform("l", lambda x: x["k"]))
    return got.select("files", F.lit(True).alias("some"), F.size(keys).cast("long").alias("keys"), (F.size(keys) > 0).alias("any"))


@query("SELECT doc_id AS count_split, doc_id % 3 = 0 AS translated_status FROM documents")
def status_marks(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("count_split"), F.col("source").alias("value"))
    return segments.marked(d, d.where("count_split % 3 = 0")).select("count_split", "translated_status")


@query("SELECT DISTINCT p_brand AS model FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 1)")
def uncovered_models(spark, sf):
    """Models that a service lists and no written settings cover."""
    p = read(spark, sf, "part").select(F.col("p_brand").alias("model"), "p_size")
    return segments.without(p.select("model").distinct(), p.where("p_size = 1").select("model").distinct(), ["model"])


@query("SELECT id, CAST(row_number() OVER (ORDER BY k, id) AS BIGINT) AS rank FROM (SELECT 'n' || n_nationkey AS id, n_nationkey AS k FROM nation UNION ALL SELECT * FROM (VALUES ('③', 3), ('xii', 12), ('九', 9), ('none', 0)))")
def sorted_results(spark, sf):
    """Results by the number in their id, whatever its form."""
    n = read(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"))
    rows = n.unionByName(spark.createDataFrame([("③",), ("xii",), ("九",), ("none",)], "id string"))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(X.to_int_tolerant(F.col("id")), "id")).cast("long"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, max(0) OVER () AS z, row_number() OVER (PARTITION BY user_id ORDER BY event_id) = count(*) OVER (PARTITION BY user_id) AS final FROM events),
r AS (SELECT key, k, final, CASE WHEN final THEN 0 ELSE 16 END AS since, CASE WHEN final AND 16 >= 280 THEN 'final' END AS kind FROM e WHERE k = 1 UNION ALL
 SELECT key, k, final, CASE WHEN final OR (now >= 360 AND k * 16 >= 280) THEN 0 ELSE now END, CASE WHEN final AND k * 16 >= 280 THEN 'final' WHEN NOT final AND now >= 360 AND k * 16 >= 280 THEN 'partial' END FROM (SELECT e.key, e.k, e.final, r.since + 16 AS now FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1))
SELECT key, CAST((k - 1) * 16 AS BIGINT) AS ms, kind FROM r WHERE kind IS NOT NULL""")
def recognition_requests(spark, sf):
    """A user's events as the frames of an utterance that has been going since the first."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    final = n == F.count("*").over(Window.partitionBy("user_id"))
    e = read(spark, sf, "events").select(F.col("user_id").alias("key"), ((n - 1) * 16).cast("long").alias("ms"), (n * 16).cast("long").alias("age"), final.alias("final"))
    return segments.fold(e, "key", ["ms"], speech.Requests, "key long, ms long, kind string")


@query("SELECT event_id FROM events WHERE user_id % 2 = 1 OR event_id < user_id * 20")
def late_results(spark, sf):
    """Events as results; sessions of even users were stopped at a time of their own."""
    e = read(spark, sf, "events")
    ended = e.where("user_id % 2 = 0").select(F.col("user_id").alias("session"), (F.col("user_id") * 20).alias("stopped")).distinct()
    return speech.on_time(e.select(F.col("user_id").alias("session"), F.col("event_id").alias("at")), ended).select(F.col("at").alias("event_id"))


@query("WITH b AS (SELECT l_orderkey % 97 AS image, l_orderkey * 8 + l_linenumber AS id, CAST(min(l_partkey) % 400 AS DOUBLE) AS x0, l_linenumber AS y FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT image, id, CAST(row_number() OVER (PARTITION BY image ORDER BY y, x0 DESC, id) - 1 AS INTEGER) AS rank FROM b")
def bubble_order(spark, sf):
    """Rows from the top down, each from right to left."""
    return timeline.reading_order(boxes(spark, sf), right_to_left=True)


@query("""WITH c AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, CAST(round(turn * 4.0 * 1000) AS BIGINT) AS a, CAST(round((turn * 4.0 + 1 + length(text) / 20) * 1000) AS BIGINT) AS b, text FROM conversations)
SELECT doc_id, md5(string_agg(n || chr(10) || printf('%02d:%02d:%02d,%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) || chr(10) || text || chr(10) || chr(10), '' ORDER BY n)) AS file FROM c GROUP BY doc_id""")
def srt_files(spark, sf):
    made = timeline.srt_files(cues(spark, sf).select("doc_id", "start", "end", F.col("original").alias("text")))
    return made.select("doc_id", F.md5(F.col("file").cast("binary")).alias("file"))


_LINES_OF = """b AS (SELECT l_orderkey % 97 AS image, l_orderkey * 8 + l_linenumber AS id, l_linenumber % 2 = 0 AS up, l_linenumber AS line, CAST(min(l_partkey) % 400 AS DOUBLE) AS x0, l_linenumber * 60.0 AS y0, max(l_discount) AS score FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


@query(f"""WITH {_LINES_OF}, g AS (SELECT *, CASE WHEN x0 - lag(x0) OVER w < CASE WHEN up THEN 19.2 ELSE 42.0000001 END THEN 0 ELSE 1 END AS new FROM b WHERE id % 7 <> 0 WINDOW w AS (PARTITION BY image, line ORDER BY x0, id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY image, line ORDER BY x0, id ROWS UNBOUNDED PRECEDING) AS island FROM g),
m AS (SELECT image, up, id, x0, y0, score, min(id) OVER (PARTITION BY image, line, island) AS region FROM s UNION ALL SELECT image, up, id, x0, y0, score, id FROM b WHERE id % 7 = 0),
r AS (SELECT image, region, string_agg(id % 100, '' ORDER BY CASE WHEN up THEN -x0 ELSE x0 END, id) AS value, min(x0) AS x0, min(y0) AS y0, max(x0 + CASE WHEN up THEN 12 ELSE 30 END) AS x1, max(y0 + CASE WHEN up THEN 30 ELSE 12 END) AS y1, min(score) AS score, count(*) AS n FROM m GROUP BY image, region)
SELECT *, CAST(row_number() OVER (PARTITION BY image ORDER BY y0, x1 DESC, region) AS INTEGER) AS rank FROM r""")
def bubble_regions(spark, sf):
    """Lines of writing, those of even number upright, made of orders' lines; every seventh is no prose and stays alone."""
    line = read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.max("l_discount").alias("score"))
    up = F.col("l_linenumber") % 2 == 0
    x, y, id_ = (F.col("p") % 400).cast("double"), F.col("l_linenumber") * 60.0, F.col("l_orderkey") * 8 + F.col("l_linenumber")
    quad = F.array(F.array(x, y), F.array(x + F.when(up, 12.0).otherwise(30.0), y), F.array(x, y + F.when(up, 30.0).otherwise(12.0)), F.array(x + F.when(up, 12.0).otherwise(30.0), y + F.when(up, 30.0).otherwise(12.0)))
    lines = line.select((F.col("l_orderkey") % 97).alias("image"), id_.alias("id"), timeline.bounds(quad).alias("q"), (id_ % 100).cast("string").alias("value"), "score", (id_ % 7 != 0).alias("prose"))
    return timeline.bubbles(lines.select("image", "id", "q.*", "value", "score", "prose"))


@query("""WITH f AS (SELECT source, doc_id, (doc_id // 20 % 7) || '.txt' AS name, doc_id // 20 % 5 <> 0 AS ok, text FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY source, ok, name ORDER BY doc_id) AS k FROM f)
SELECT source AS run, string_agg(CASE WHEN ok THEN CASE WHEN k = 1 THEN name ELSE replace(name, '.txt', ' (' || k || ').txt') END END, '|' ORDER BY doc_id) || '|results.txt' AS names, md5(string_agg(name || CASE WHEN ok THEN ': success' ELSE ': failed - no text' END || chr(10), '' ORDER BY doc_id)) AS report, CAST(sum(CASE WHEN ok THEN octet_length(encode(text)) END) AS BIGINT) AS bytes FROM k GROUP BY source""")
def packages(spark, sf):
    """Documents as the files of their source's run, every fifth without a result: zipped, and what the zips hold."""
    import hashlib
    import io
    import zipfile

    def held(raw: bytes) -> list[str]:
        with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
            names = z.namelist()
            return ["|".join(names), hashlib.md5(z.read("results.txt")).hexdigest(), str(sum(len(z.read(n)) for n in names if n != "results.txt"))]

    from textloom.functions.tokens import arrow

    turn = F.floor(F.col("doc_id") / 20)
    ok = turn % 5 != 0
    d = texts(spark, sf).select(F.col("source").alias("run"), F.col("doc_id").alias("ord"), F.concat((turn % 7).cast("string"), F.lit(".txt")).alias("name"), F.when(ok, F.col("text").cast("binary")).alias("content"), F.when(ok, "success").otherwise("failed").alias("status"), F.when(~ok, "no text").alias("detail"))
    got = control.packages(d).select("run", arrow(held, "array<string>")(F.col("package")).alias("h"))
    return got.select("run", F.col("h")[0].alias("names"), F.col("h")[1].alias("report"), F.col("h")[2].cast("long").alias("bytes"))
