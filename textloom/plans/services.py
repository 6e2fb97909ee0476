"""Registered queries of calls, captions, limits, records and formats, and their SQL twins. Small tables of traps carry
expected values that were written by hand."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import captions, limits
from textloom.functions import text as X
from textloom.operators import calls, records, segments, terms, timeline
from textloom.plans.catalogue import QUERIES, pairs, q, query, read, texts

__all__ = ["QUERIES"]


def sql_value(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    return f"'{q(x)}'" if isinstance(x, str) else str(x)


def traps(schema: str, rows: list[tuple], outs: list[str]) -> tuple[str, callable]:
    """(SQL, rows) of a table whose last columns are expected values: SQL gives them, Spark gets only the others."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    kept = [n for n in names if n not in outs]
    sql = f"SELECT {', '.join(['id', *outs])} FROM (VALUES {', '.join('(' + ', '.join(map(sql_value, r)) + ')' for r in rows)}) t({', '.join(names)})"

    def make(spark: SparkSession) -> DataFrame:
        part = ", ".join(c.strip() for c in schema.split(",") if c.strip().split(" ")[0] in kept)
        return spark.createDataFrame([tuple(v for n, v in zip(names, r, strict=True) if n in kept) for r in rows], part)

    return sql, make


# --- captions ---------------------------------------------------------------------------------------------------------

_SPEECH, _speech = traps(
    "id int, value string, clean string",
    [
        (1, "<|en|><|HAPPY|>Hello  there 😊", "Hello there"), (2, "♪ la ♫  la", "la la"), (3, "no " * 12, "no no no no no"), (4, "No, no! NO no. no no no no no no", "No, no! NO no. no no no no"),
        (5, "ha" * 12, "hahahaha"), (6, "だめだめだめだめだめ", "だめだめだめだめだめ"), (7, "I love you I love you", "I love you I love you"), (8, "", ""), (9, "one two three four five six seven eight nine", "one two three four five six seven eight nine"),
    ],
    ["clean"],
)


@query(f"{_SPEECH} UNION ALL SELECT CAST(turn + 1000 * conv_id + 1000000 AS INTEGER), trim(regexp_replace(text, '\\s{{2,}}', ' ', 'g')) FROM conversations WHERE NOT regexp_matches(text, '[^\\x00-\\x7f]') AND len(string_split(text, ' ')) <= 8")
def speech_cleanup(spark, sf):
    """Turns of up to eight words have no loops to cut; the traps have all kinds of them."""
    turns = read(spark, sf, "conversations").where(~F.col("text").rlike(r"[^\x00-\x7f]") & (F.size(F.split("text", " ")) <= 8))
    rows = _speech(spark).unionByName(turns.select((F.col("turn") + 1000 * F.col("conv_id") + 1000000).cast("int").alias("id"), F.col("text").alias("value")))
    return rows.select("id", captions.clean_speech(F.col("value")).alias("clean"))


_SILENCE, _silence = traps(
    "id int, value string, lang string, silence boolean, shown boolean",
    [
        (1, "Thank you for watching!", "en", True, True), (2, " THANKS  for watching ", "en-US", True, True), (3, "Thank you for watching my film", "en", False, True), (4, "♪♪", "de", True, False), (5, "[Music]", "fr", True, True),
        (6, "ご視聴ありがとうございました。", "ja", True, True), (7, "ご視聴ありがとうございました", "en", False, True), (8, "。", "zh", False, False), (9, "", "en", False, False), (10, None, "en", False, False), (11, "thank you", None, False, True), (12, "ไทย", "th", False, True),
    ],
    ["silence", "shown"],
)


@query(_SILENCE)
def heard_silence(spark, sf):
    return _silence(spark).select("id", captions.is_heard_silence(F.col("value"), F.col("lang")).alias("silence"), captions.worth_showing(F.col("value")).alias("shown"))


@query("SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN text ELSE '<b>[T]' || text || '</b>' || chr(10) || text END) AS srt, md5(CASE WHEN doc_id % 7 = 0 THEN text ELSE text || ' (' || '[T]' || text || ')' END) AS sheet, md5(CASE WHEN doc_id % 7 = 0 THEN text ELSE text || chr(10) || '**<span style=\"color:#ff0000\">[T]' || text || '</span>**' END) AS md, left(replace(replace(lang || '/' || source || ':[x]' || doc_id, '/', '-'), ':[x]', '--x-'), 31) AS tab FROM documents")
def bilingual_texts(spark, sf):
    d = texts(spark, sf).withColumn("t", F.when(F.col("doc_id") % 7 == 0, F.col("text")).otherwise(segments.fake_translate(F.col("text"))))
    md = lambda c: F.md5(c.cast("binary"))
    o, t = F.col("text"), F.col("t")
    tab = F.concat("lang", F.lit("/"), "source", F.lit(":[x]"), F.col("doc_id").cast("string"))
    return d.select("doc_id", md(captions.both(o, t, "srt")).alias("srt"), md(captions.both(o, t, "sheet_name")).alias("sheet"), md(captions.both(o, t, "md", True, "ff0000")).alias("md"), captions.sheet_name(tab).alias("tab"))


# --- limits -----------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_custkey = 0 THEN 4096 WHEN o_custkey % 5 = 0 THEN greatest(128, o_custkey) WHEN o_custkey % 5 = 1 THEN CASE WHEN o_custkey % 2 = 0 THEN 1024 ELSE greatest(256, least(4096, CAST(floor(o_custkey * 100 * 0.4) AS INTEGER))) END WHEN o_custkey % 5 = 2 THEN 1024 ELSE 4096 END AS budget, greatest(256, least(2048, coalesce(CASE WHEN o_custkey % 2 = 1 THEN o_custkey * 100 END, 4096) - o_orderkey % 5000 - 128)) AS cap, greatest(256, 4096 // CAST(power(2, o_orderkey % 6 + 1) AS BIGINT)) AS shrunk, CASE WHEN o_custkey % 3 = 0 THEN 4 ELSE o_custkey % 3 END AS retries FROM orders")
def token_limits(spark, sf):
    o = read(spark, sf, "orders").withColumn("c", F.col("o_custkey").cast("int"))
    window = F.when(F.col("c") % 2 == 1, F.col("c") * 100)
    url = F.when(F.col("c") % 5 == 2, "http://LOCALHOST:1234/v1").otherwise("https://a.b/v1")
    budget = limits.batch_budget(F.when(F.col("c") % 5 == 0, F.col("c")), window, url, F.col("c") % 5 == 1)
    cap = limits.reply_cap(window, F.col("o_orderkey") % 5000)
    shrunk = limits.shrunk_budget(F.lit(4096), F.col("o_orderkey") % 6)
    return o.select("o_orderkey", budget.alias("budget"), cap.alias("cap"), shrunk.cast("long").alias("shrunk"), limits.own_or(F.col("c") % 3, 4).alias("retries"))


_SAMPLING, _sampling = traps(
    "id int, own double, mode double, url string, model string, sent double",
    [(1, 0.5, 1.3, "https://a.b", "m", 1.3), (2, 0.7, 1.3, "http://localhost:11434", "m", 0.7), (3, 0.5, 1.3, "https://x/anthropic", "m", None), (4, 0.5, 1.3, "https://a.b", "Claude-x", None), (5, 0.5, None, "https://a.b", None, 0.5), (6, None, None, None, None, None)],
    ["sent"],
)


@query(_SAMPLING.replace("sent FROM", "CAST(sent AS DOUBLE) AS sent FROM"))
def sampling_settings(spark, sf):
    return _sampling(spark).select("id", limits.sampling(F.col("own"), F.col("mode"), F.col("url"), F.col("model")).alias("sent"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1.0 WHEN w = 0 OR 2 * w + 8 <= 1.15 * w THEN 1.0 ELSE greatest(0.7, w / (2.0 * w + 8)) END AS scale, CASE WHEN doc_id % 7 = 0 OR w = 0 THEN 1800 ELSE 1260 END AS size FROM (SELECT doc_id, length(text) AS w FROM documents)")
def font_scales(spark, sf):
    """Translations that are twice as wide and four wide characters more: the scale is at its least."""
    d = read(spark, sf, "documents")
    t = F.when(F.col("doc_id") % 7 == 0, F.col("text")).otherwise(F.concat("text", "text", F.lit("四个字宽")))
    scale = limits.font_scale(F.col("text"), t)
    return d.select("doc_id", scale.alias("scale"), limits.font_size(F.lit(1800), scale).alias("size"))


@query("SELECT doc_id, 'From ' || CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'the source language' END || ' to de, {name} stays.' || CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) || 'Be brief.' ELSE '' END AS prompt, md5(chr(10) || '###' || CASE WHEN doc_id % 2 = 0 THEN 'ctx' ELSE '' END || '###' || chr(10) || 'Go###' || chr(10) || text || '###' || chr(10)) AS message FROM documents")
def prompts(spark, sf):
    d = read(spark, sf, "documents")
    source = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    hint = F.when(F.col("doc_id") % 3 == 0, "Be brief.").otherwise("")
    message = limits.user_message(F.lit(None).cast("string"), F.when(F.col("doc_id") % 2 == 0, "ctx"), F.lit("Go"), F.col("text"), F.lit(""))
    return d.select("doc_id", limits.prompt(F.lit("From {Text_Source_Language} to {Text_Target_Language}, {name} stays."), source, F.lit("de"), hint).alias("prompt"), F.md5(message.cast("binary")).alias("message"))


@query("SELECT o_custkey, left(sha1('m|en|de|' || 'doc' || '|' || printf('%.3f', (o_custkey % 7) / 4.0) || '|' || g || '|m1|v1'), 16) AS signature, g AS glossary FROM (SELECT o_custkey, left(sha1(string_agg(p, chr(10) ORDER BY p)), 12) AS g FROM (SELECT DISTINCT o_custkey, o_orderstatus || chr(9) || o_orderpriority AS p FROM orders) GROUP BY o_custkey)")
def signatures(spark, sf):
    """A customer's glossary: the pairs of states and priorities of their orders, in whatever order they come."""
    o = read(spark, sf, "orders").select("o_custkey", F.struct(F.col("o_orderstatus").alias("src"), F.col("o_orderpriority").alias("dst")).alias("p"))
    g = o.groupBy("o_custkey").agg(limits.glossary_signature(F.collect_set("p")).alias("glossary"))
    signature = limits.parameter_signature(F.lit("m"), F.lit("en"), F.lit("de"), F.lit("doc"), (F.col("o_custkey") % 7) / 4.0, F.col("glossary"))
    return g.select("o_custkey", signature.alias("signature"), "glossary")


# --- calls ------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Wert %s {name} ${HOME}!' ELSE 'Wert' END AS value, CASE WHEN doc_id % 5 = 0 THEN 'Wert ' || chr(57344) || '0' || chr(57345) || ' ' || chr(57344) || '1' || chr(57345) || ' ' || chr(57344) || '2' || chr(57345) || '!' ELSE 'Wert' END AS masked, CASE WHEN doc_id % 5 = 0 THEN '%s %s ${HOME}' || chr(57344) || '9' || chr(57345) ELSE 'x' END AS unmasked FROM documents")
def mask_roundtrip(spark, sf):
    """A reply that repeats one mark, leaves one out and invents one."""
    value = F.when(F.col("doc_id") % 5 == 0, "Wert %s {name} ${HOME}!").otherwise("Wert")
    d = read(spark, sf, "documents").select("doc_id", value.alias("value")).withColumn("m", calls.masked(F.col("value")))
    o, s = calls.OPEN, calls.SHUT
    reply = F.when(F.col("doc_id") % 5 == 0, f"{o}0{s} {o}0{s} {o}2{s}{o}9{s}").otherwise("x")
    return d.select("doc_id", "value", F.col("m.text").alias("masked"), calls.unmasked(reply, F.col("m.tokens")).alias("unmasked"))


_CALLS, _calls = traps(
    "id int, request string, reply string, last boolean, outcome string, translated string",
    [
        (1, "Hello world", "```json\n{\"1\": \"Hallo Welt\",}\n```", False, "translated", "Hallo Welt"), (2, "Hello world", '{"1": null}', False, "failed", ""), (3, "Hello world", '{"1": 5}', False, "failed", ""), (4, "Hello world", "no json", False, "failed", ""),
        (5, "Hello world", '{"2": "Hallo"}', False, "failed", ""), (6, "Hello world", '{"1": "Hello world"}', False, "failed", "Hello world"), (7, "Hello world", '{"1": " hello  WORLD "}', True, "needs_review", "hello  WORLD"), (8, "Hi %s", '{"1": "Hallo"}', True, "failed", "Hallo"),
        (9, "100%", '{"1": "100%"}', False, "failed", "100%"), (10, "100%", '{"1": "100%"}', True, "translated", "100%"), (11, "Hello world", 'Sure: {"1": "Hallo Welt"} bye', False, "translated", "Hallo Welt"), (12, "Hello world", '{"1": {"a": 1}}', True, "failed", ""),
    ],
    ["outcome", "translated"],
)


@query(_CALLS)
def reply_outcomes(spark, sf):
    """Replies of all kinds to one request each; a reply that repeats its request fails as a whole but on the last try."""
    rows = _calls(spark)
    item = F.struct(F.lit(1).cast("long").alias("count_split"), F.col("request").alias("value"), F.col("request").alias("text"), F.array().cast("array<string>").alias("tokens"))
    asked = rows.select(F.col("id").cast("long").alias("doc_id"), F.lit(0).alias("batch"), F.to_json(F.create_map(F.lit("1"), "request")).alias("request"), F.array(item).alias("items"), "reply", "last")
    out = calls.judged(calls.replied(asked.where("not last")), "en", "de", False).unionByName(calls.judged(calls.replied(asked.where("last")), "en", "de", True))
    return out.select(F.col("doc_id").cast("int").alias("id"), "outcome", "translated")


_TRANSLATED = "SELECT p.doc_id, i AS count_split, CASE WHEN parity = 1 THEN 'failed' WHEN NOT regexp_matches(v, '[A-Za-zÀ-ÿ]') THEN 'translated' ELSE 'translated' END AS outcome, md5(CASE WHEN parity = 1 THEN v ELSE '[T]' || v END) AS translated FROM (SELECT doc_id, doc_id % 2 AS parity, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS v FROM documents) p WHERE trim(v) <> '' AND NOT (p.doc_id % 3 = 0 AND i = 1)"


@query("WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, trim(unnest(string_split(text, chr(10)))) AS v FROM documents) SELECT doc_id, i AS count_split, CASE WHEN doc_id % 4 = 3 THEN 'failed' ELSE 'translated' END AS outcome, md5(CASE WHEN doc_id % 4 = 3 THEN v ELSE '[T]' || v END) AS translated FROM l WHERE v <> '' AND NOT (doc_id % 5 = 0 AND i = 0)")
def batch_calls(spark, sf):
    """Lines through packed calls in rounds. Lines of every fourth document get no reply in any of them, first lines of
    every fifth have been done by an earlier run."""
    lines = segments.lines(texts(spark, sf)).select("doc_id", F.col("ord").cast("long").alias("count_split"), X.trim_u(F.col("value")).alias("value"))
    # what must get no reply has a mark in front that the model drops, so all of its requests come back empty
    named = lines.withColumn("value", F.when(F.col("doc_id") % 4 == 3, F.concat(F.lit("\u0007"), "value")).otherwise(F.col("value")))
    model = lambda request: F.to_json(F.transform_values(F.from_json(request, "map<string,string>"), lambda _, v: F.when(v.startswith("\u0007"), "").otherwise(segments.fake_translate(v))))
    done = lines.where("doc_id % 5 = 0 and count_split = 0")
    got = calls.translate(named.where("value <> '\u0007'"), "en", "de", model, 512, 2, done)
    return got.select("doc_id", "count_split", "outcome", F.md5(F.replace("translated", F.lit("\u0007"), F.lit("")).cast("binary")).alias("translated"))


@query("SELECT doc_id, md5(array_to_string(list_transform(v, lambda x: '[T]' || x), chr(10))) AS text FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[A-Za-z][a-z]+ [a-z]+ [A-Za-z ,]+[.]$')) AS v FROM documents) WHERE len(v) > 0")
def documents_translated(spark, sf):
    """Whole documents of plain lines through every stage, each a table of a run, and back."""
    from textloom.storage import scratch

    d = texts(spark, sf)
    plain = F.array_join(F.filter(F.split("text", "\n", -1), lambda x: x.rlike("^[A-Za-z][a-z]+ [a-z]+ [A-Za-z ,]+[.]$")), "\n")
    docs = d.select("doc_id", plain.alias("text")).where("text <> ''")
    out = calls.translate_documents(spark, docs, scratch(spark, "run"), "en", "de", limit=100_000)
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"))


_POLISH, _polish = traps(
    "id int, first string, second string, text string",
    [
        (1, '{"1":"a %s","2":"b"}', '{"1":"better %s","2":"good"}', "better %s|good"), (2, '{"1":"a %s","2":"b"}', '{"1":"better","2":"good"}', "a %s|b"), (3, '{"1":"a","2":"b"}', '{"1":"x"}', "a|b"), (4, '{"1":"a"}', '{"1":"x","2":"y"}', "a"),
        (5, '{"1":"a {n}"}', '{"1":"x {m}"}', "a {n}"), (6, '{"1":"a"}', "broken", "a"), (7, '{"1":"{{X}} a"}', '{"1":"b {{X}}"}', "b {{X}}"),
    ],
    ["text"],
)


@query(_POLISH)
def second_pass(spark, sf):
    m = lambda c: F.from_json(c, "map<string,string>")
    best = calls.polished(m("first"), calls.reply_texts(F.col("second")))
    return _polish(spark).select("id", F.array_join(F.map_values(best), "|").alias("text"))


@query("WITH c AS (SELECT conv_id AS doc_id, turn, text, len(regexp_extract_all(text, '\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+')) AS n FROM conversations), w AS (SELECT a.doc_id, a.turn, max(CASE WHEN length(trim(b.text)) > 1 AND b.n <= 128 THEN b.turn END) AS last FROM c a LEFT JOIN c b ON b.doc_id = a.doc_id AND b.turn < a.turn GROUP BY a.doc_id, a.turn) SELECT w.doc_id, CAST(w.turn AS INTEGER) AS batch, coalesce(c.text, '') AS context FROM w LEFT JOIN c ON c.doc_id = w.doc_id AND c.turn = w.last")
def rolling_context(spark, sf):
    """One turn a batch: the context is the last turn that fits."""
    c = read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("batch"), F.lit(0).alias("count_split"), F.col("text").alias("translated"))
    return calls.rolling_context(c).select("doc_id", "batch", F.array_join("context", "\n").alias("context"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(octet_length(encode(t)) + octet_length(encode('[T]' || t))) AS BIGINT) AS bytes FROM (SELECT DISTINCT text AS t FROM documents WHERE text <> '')")
def memory_stats(spark, sf):
    """What the memory holds after the validated results of all documents have been stored."""
    d = texts(spark, sf).select(F.col("text").alias("original"), segments.fake_translate(F.col("text")).alias("translated"), F.when(F.col("text") == "", "failed").otherwise("translated").alias("outcome"))
    rows = calls.validated(d, "s1", F.lit(1))
    held = terms.upsert(rows.limit(0), rows)
    return held.agg(F.count("*").alias("n"), F.sum(F.octet_length("src") + F.octet_length("dst")).cast("long").alias("bytes"))


# --- records ----------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) % 90000 AS duration_seconds, 'txt' AS file_type, CASE WHEN o_orderstatus = 'F' THEN left(repeat('boom ', 200), 500) ELSE '' END AS error_reason, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'b' || o_custkey END AS batch_id, CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE o_custkey % 3 END AS batch_size FROM orders")
def run_records(spark, sf):
    o = read(spark, sf, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    lasted = F.floor("o_totalprice").cast("long") % 90000
    runs = o.select(F.col("o_orderkey").alias("id"), at.alias("start_time"), F.timestamp_micros(F.unix_micros(at) + lasted * 1_000_000 + 400_000).alias("end_time"), F.concat(F.lit("dir.x/file."), F.lit("TXT")).alias("input_file"), F.when(F.col("o_orderstatus") == "F", F.repeat(F.lit("boom "), F.lit(200))).alias("error_reason"), F.lit(None).cast("string").alias("error_category"), F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("b"), F.col("o_custkey").cast("string"))).alias("batch_id"), (F.col("o_custkey") % 3).cast("int").alias("batch_size"))
    return records.run_records(runs).select("id", "duration_seconds", "file_type", "error_reason", "batch_id", "batch_size")


@query("SELECT doc_id, md5(CASE WHEN doc_id % 4 = 0 THEN 'new ' || doc_id ELSE '[T]' || text END) AS translated, (SELECT count(*) FROM documents WHERE doc_id % 4 = 0) AS changed FROM documents")
def edited_table(spark, sf):
    table = texts(spark, sf).select(F.col("doc_id").alias("ord"), F.col("doc_id").alias("count_src"), segments.fake_translate(F.col("text")).alias("translated"))
    rows = table.withColumn("translated", F.when(F.col("ord") % 4 == 0, F.concat(F.lit("new "), F.col("ord").cast("string"))).otherwise(F.col("translated")))
    out, changed = records.edited(table, rows)
    return out.select(F.col("ord").alias("doc_id"), F.md5(F.col("translated").cast("binary")).alias("translated"), F.lit(changed).cast("long").alias("changed"))


@query("WITH e AS (SELECT text, max(doc_id) AS last FROM documents GROUP BY text) SELECT doc_id, md5(CASE WHEN last % 3 = 0 THEN 'edit ' || last ELSE '  ' || d.text END) AS value FROM documents d JOIN e ON e.text = d.text")
def overridden_texts(spark, sf):
    """Edits of every text by its last document; two of three are blank. Texts and edits differ in white space around."""
    d = texts(spark, sf)
    edits = d.select(F.concat("text", F.lit(" 　")).alias("original"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("edit "), F.col("doc_id").cast("string"))).otherwise(" ").alias("edited"), F.col("doc_id").alias("ord"))
    rows = d.select("doc_id", F.concat(F.lit("  "), "text").alias("value"))
    return records.overridden(rows, edits).select("doc_id", F.md5(F.col("value").cast("binary")).alias("value"))


_TREE, _tree = traps(
    "id int, path string, mtime int, folder string, rank int",
    [(1, "run/a/dst_translated.json", 5, "run/a", 3), (2, "run/a/manifest.json", 9, None, 0), (3, "b/dst_translated.json", 7, None, 0), (4, "S/t/Doc/dst_translated.json", 8, "S/t/Doc", 1), (5, "S/t/Doc/manifest.json", 1, None, 0), (6, "S/t/Doc/x/dst_translated.json", 9, None, 0), (7, "S/t/Doc/x/manifest.json", 9, None, 0), (8, "1/2/3/4/5/6/dst_translated.json", 2, None, 0), (9, "1/2/3/4/5/6/manifest.json", 2, None, 0), (10, "c/dst_translated.json", 6, "c", 2), (11, "c/manifest.json", 6, None, 0)],
    ["folder", "rank"],
)


@query(f"SELECT folder, CAST(rank AS BIGINT) AS rank FROM ({_TREE}) WHERE folder IS NOT NULL")
def finished_documents(spark, sf):
    got = records.documents_in_order(records.finished(_tree(spark).select("path", "mtime")))
    return got.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mtime"), "folder")).cast("long")).select("folder", "rank")


@query("WITH t AS (SELECT o_custkey AS s, count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 50 = 1 GROUP BY o_custkey) SELECT c_custkey AS session_id, CASE WHEN coalesce(n, 0) >= 4 THEN 'full' ELSE 'go' END AS verdict FROM customer LEFT JOIN t ON s = c_custkey")
def admission(spark, sf):
    tasks = read(spark, sf, "orders").where("o_custkey % 50 = 1").select(F.col("o_custkey").alias("session_id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"))
    asked = read(spark, sf, "customer").select(F.col("c_custkey").alias("session_id"))
    return records.admitted(tasks, asked, 1_000_000, 4)


@query("SELECT event_id FROM events WHERE NOT (event_type IN ('click', 'view') AND value > 50)")
def live_tasks(spark, sf):
    """Events as tasks: clicks and views have ended, their age is their value."""
    e = read(spark, sf, "events").select("event_id", F.when(F.col("event_type").isin("click", "view"), "done").otherwise("running").alias("status"), (F.lit(1000.0) - F.col("value")).alias("ended_at"))
    return records.kept_tasks(e, F.lit(1000.0), 50).select("event_id")


@query("SELECT o_custkey AS file, CASE WHEN count(*) FILTER (WHERE v IS NOT NULL) = 0 THEN min(t) ELSE arg_max(t, (coalesce(v, -1000), -t)) END AS track FROM (SELECT o_custkey, CAST(o_orderkey AS BIGINT) AS t, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE -(o_orderkey % 30) END AS v FROM orders) GROUP BY o_custkey HAVING count(*) > 1")
def loudest_tracks(spark, sf):
    t = read(spark, sf, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("track"), F.lit("en").alias("lang"), F.when(F.col("o_orderkey") % 4 != 0, -(F.col("o_orderkey") % 30).cast("double")).alias("volume"))
    return records.loudest(t)


@query("WITH l AS (SELECT CASE n_nationkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'fr' END AS lang, 'k' || (n_nationkey // 3) AS key, n_name AS text FROM nation WHERE n_nationkey % 7 <> 4), g AS (SELECT DISTINCT a.lang, b.key, b.text AS base FROM l a, l b WHERE b.lang = 'en') SELECT coalesce(l.lang, g.lang) AS lang, coalesce(l.key, g.key) AS key, coalesce(l.text, g.base) AS text FROM l FULL JOIN g ON l.lang = g.lang AND l.key = g.key")
def label_backfill(spark, sf):
    n = read(spark, sf, "nation").where("n_nationkey % 7 <> 4")
    lang = F.element_at(F.array(F.lit("en"), F.lit("de"), F.lit("fr")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return records.backfilled(n.select(lang.alias("lang"), F.concat(F.lit("k"), F.floor(F.col("n_nationkey") / 3).cast("string")).alias("key"), F.col("n_name").alias("text")))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE 'fmt' || ((l_suppkey % 4 + 10) * 10 + l_linenumber) END AS format FROM lineitem")
def list_numbering(spark, sf):
    """Paragraphs of four lists, one of which is not defined."""
    p = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 4).alias("num_id"), F.col("l_linenumber").cast("long").alias("level"))
    nums = spark.range(1, 4).select(F.col("id").alias("num_id"), (F.col("id") + 10).alias("abstract_id"))
    levels = spark.range(11, 14).select(F.col("id").alias("abstract_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(9).cast("long"))).alias("level")).withColumn("format", F.concat(F.lit("fmt"), (F.col("abstract_id") * 10 + F.col("level")).cast("string")))
    return records.numbered(p, F.broadcast(nums), F.broadcast(levels)).select("l_orderkey", "l_linenumber", "format")


@query("SELECT user_id AS file, event_id * 10 AS start_ms FROM events WHERE event_id % 3 <> 0")
def resumed_segments(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("file"), (F.col("event_id") * 10).alias("start_ms"), (F.col("event_id") * 10 + 5).alias("end_ms"))
    return records.remaining(e, e.where("start_ms % 30 = 0")).select("file", "start_ms")


@query("SELECT doc_id, source || '.txt: ' || CASE WHEN doc_id % 4 = 0 THEN 'failed - no text' ELSE 'success' END AS line FROM documents")
def package_report(spark, sf):
    d = read(spark, sf, "documents")
    failed = F.col("doc_id") % 4 == 0
    rows = d.select("doc_id", F.concat("source", F.lit(".txt")).alias("name"), F.when(failed, "failed").otherwise("success").alias("status"), F.when(failed, "no text").alias("detail"))
    return records.report_lines(rows).select("doc_id", "line")


# --- filters, sets and orders -----------------------------------------------------------------------------------------

_WORD, _word = traps(
    "id int, value string, prose boolean",
    [(1, "{{FIELD}} ", False), (2, "[formula_1] x", True), (3, "12", False), (4, "...", False), (5, "2024-01-02", True), (6, "v1.2", True), (7, "字", True), (8, "", False), (9, "a", True), (10, "1-2", True), (11, "한", True), (12, "→", False), (13, None, False)],
    ["prose"],
)


@query(_WORD)
def word_filter(spark, sf):
    return _word(spark).select("id", X.word_prose(F.col("value")).alias("prose"))


_B64 = "QUJD" * 30
_IMAGE, _image = traps(
    "id int, value string, image boolean, prose boolean",
    [(1, "data:image/png;base64,xx", True, False), (2, "![x](DATA:image/gif;x)", True, False), (3, _B64, True, False), (4, _B64[:-1], False, True), (5, "Some words of text", False, True), (6, _B64[:60] + " \n" + _B64[60:], True, False), (7, '<img alt="a" src="data:image/x">', True, False)],
    ["image", "prose"],
)


@query(_IMAGE)
def image_guard(spark, sf):
    c = F.col("value")
    return _image(spark).select("id", X.is_image_data(c).alias("image"), X.markdown_prose(c).alias("prose"))


_PAGE, _page = traps(
    "id int, value string, page boolean, leader boolean, section boolean, date boolean, toc boolean",
    [
        (1, "12", True, False, False, False, False), (2, "xiv", True, False, False, False, False), (3, "- 5 -", True, False, False, False, False), (4, "(7)", True, False, False, False, False), (5, "....57", True, False, False, False, False), (6, "......", False, True, False, False, False),
        (7, "1.1 Intro", False, False, True, False, False), (8, "2024.12.31", False, False, True, True, True), (9, "Introduction.......25", False, False, False, False, True), (10, "Scope\t\t3", False, False, False, False, True), (11, "3. Some text", False, False, False, False, False), (12, "31/12/2022", False, False, False, True, False), (13, "A title", False, False, False, False, False),
    ],
    ["page", "leader", "section", "date", "toc"],
)


@query(_PAGE)
def page_marks(spark, sf):
    c = F.col("value")
    return _page(spark).select("id", X.is_page_number(c).alias("page"), X.is_dot_leader(c).alias("leader"), X.is_section_number(c).alias("section"), X.is_date(c).alias("date"), X.is_contents_line(c).alias("toc"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 11 <> 0")
def continue_filter(spark, sf):
    """What a second run still has to do: not done yet, an id, no blank."""
    from textloom.operators.ordering import global_rank

    d = texts(spark, sf).select(F.when(F.col("doc_id") % 11 != 0, F.col("doc_id")).alias("count_split"), "doc_id", F.col("text").alias("value"), (F.col("doc_id") % 3 == 0).alias("translated_status"))
    left = segments.unfinished(d)
    return global_rank(left.select("doc_id"), ["doc_id"], "n")


@query("SELECT l_orderkey, l_linenumber, coalesce(score, 1.0) AS score, coalesce(score, 1.0) >= 0.6 AS kept FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount * 10 END AS score FROM lineitem)")
def confident_regions(spark, sf):
    r = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 3, F.col("l_discount") * 10).alias("score"))
    return timeline.confident(r).select("l_orderkey", "l_linenumber", "score", "kept")


_NAMES, _names = traps(
    "id int, value string, name boolean, session boolean, inside boolean",
    [(1, "Default", True, False, True), (2, "a/b", False, False, True), (3, "  ", False, False, False), (4, "0123456789abcdef0123456789abcdef", True, True, True), (5, "a/../b", False, False, False), (6, 'q"', False, False, True), (7, "0123ABCD", True, False, True), (8, "..", True, False, False), (9, None, False, False, False), (10, "x\\..\\y", False, False, False)],
    ["name", "session", "inside"],
)


@query(_NAMES)
def safe_names(spark, sf):
    c = F.col("value")
    return _names(spark).select("id", X.is_file_name(c).alias("name"), X.is_session(c).alias("session"), X.is_inside(c).alias("inside"))


@query("SELECT doc_id, e AS extension, c AS category, c NOT IN ('fmt-pdf', 'fmt-video') AS allowed, md5(left(text, 200)) AS capped FROM (SELECT doc_id, text, ['docx','csv','pdf','lrc','json','png','mp4'][doc_id % 7 + 1] AS e, ['fmt-word','fmt-excel','fmt-pdf','fmt-subtitle','fmt-text','fmt-image','fmt-video'][doc_id % 7 + 1] AS c FROM documents)")
def format_gate(spark, sf):
    d = texts(spark, sf)
    ext = F.element_at(F.array(*map(F.lit, ["docx", "csv", "pdf", "lrc", "json", "png", "mp4"])), (F.col("doc_id") % 7 + 1).cast("int"))
    kind = X.format_category(F.upper(ext))
    return d.select("doc_id", ext.alias("extension"), kind.alias("category"), (~kind.isin("fmt-pdf", "fmt-video")).alias("allowed"), F.md5(F.substring("text", 1, 200).cast("binary")).alias("capped"))


_LANGS, _langs = traps("id int, value string, code string", [(1, "English", "en"), (2, "日本語", "ja"), (3, "繁體中文", "zh-Hant"), (4, "Klingon", "klingon"), (5, "Tiếng Việt", "vi"), (6, "de", "de")], ["code"])


@query(_LANGS)
def language_codes(spark, sf):
    return _langs(spark).select("id", X.language_code(F.col("value")).alias("code"))


@query("SELECT doc_id, src, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY length(src) DESC, ord) AS INTEGER) AS rank FROM (SELECT d.doc_id, g.src, g.ord FROM documents d, (SELECT src, max(item_id) AS ord FROM (SELECT item_id, regexp_extract(text, '^[A-Za-z]+') AS src FROM benchmark) WHERE length(src) >= 2 GROUP BY src) g WHERE list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lower(src)))")
def longest_terms(spark, sf):
    from textloom.plans.catalogue import glossary

    return terms.longest_first(terms.match(texts(spark, sf).select("doc_id", "text"), glossary(spark, sf))).select("doc_id", "src", "rank")


_REPLY = json.dumps([["Alpha Beta", "A B"], ["https://x.y", "no"], {"source": "ALPHA beta", "target": "later"}, ["gamma", "g"], ["missing", "m"], ["12.5", "n"], ["A whole sentence!", "s"], ["delta", "delta"]])


@query("SELECT * FROM (VALUES ('Alpha Beta', 'A B', 0), ('gamma', 'g', 3)) t(src, dst, ord)")
def extracted_terms(spark, sf):
    """A reply's terms: noise, repeats, what equals its source and what no text has are left out."""
    from textloom.functions.tokens import arrow, term_list

    reply = spark.createDataFrame([(_REPLY,)], "reply string")
    pairs_of = arrow(lambda t: [{"src": a, "dst": b} for a, b in term_list("Here: " + t)], "array<struct<src:string,dst:string>>")
    found = reply.select(F.posexplode(pairs_of(F.col("reply"))).alias("ord", "p")).select("ord", "p.*")
    docs = spark.createDataFrame([("All of ａｌｐｈａ Beta here",), ("Gamma rays",)], "text string")
    return terms.cleaned(found, docs)


@query("SELECT doc_id, source, min(doc_id) OVER (PARTITION BY source) = doc_id AS first FROM documents WHERE doc_id % 2 = 0")
def failed_list(spark, sf):
    """Failed rows of two rounds: the first report of each stands."""
    d = read(spark, sf, "documents").where("doc_id % 2 = 0").select("doc_id", "source")
    again = d.withColumn("source", F.lit("again"))
    kept = segments.first_reports(d, again, "doc_id")
    first = F.min("doc_id").over(Window.partitionBy("source")) == F.col("doc_id")
    return kept.withColumn("first", first)


@query("SELECT doc_id AS count_split FROM documents WHERE doc_id % 3 = 0")
def missing_ids(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("count_split"))
    return segments.missing_ids(d, d.where("count_split % 3 <> 0"))


@query("SELECT source, bool_and(doc_id % 50 < 45) AS retried FROM documents GROUP BY source")
def first_tries(spark, sf):
    """Batches whose ids have all failed before are no first tries."""
    d = read(spark, sf, "documents").select(F.col("source").alias("batch"), F.col("doc_id").alias("count_split"))
    return segments.all_failed_before(d, d.where("count_split % 50 < 45")).select(F.col("batch").alias("source"), "retried")


@query("SELECT unnest(['id', 'url', 'href', 'extra', 'note']) AS key, unnest([true, true, true, true, false]) AS skipped")
def skip_keys(spark, sf):
    from textloom.sources import formats

    keys = formats.skip_keys(["Extra", "ID"])
    return spark.createDataFrame([(k,) for k in ("id", "url", "href", "extra", "note")], "key string").withColumn("skipped", F.col("key").isin(*keys))


@query("SELECT conv_id, turn, part, CAST(row_number() OVER (PARTITION BY part ORDER BY conv_id, turn) AS BIGINT) AS n FROM (SELECT conv_id, turn, CASE role WHEN 'system' THEN 'header' WHEN 'user' THEN 'cell' ELSE 'comment' END AS part FROM conversations)")
def routed_parts(spark, sf):
    """Rows of all kinds in one numbered stream, and by kind to the writers of their parts."""
    c = read(spark, sf, "conversations")
    kind = F.when(F.col("role") == "system", "header").when(F.col("role") == "user", "cell").otherwise("comment")
    routes = segments.routed(c.select("conv_id", "turn", kind.alias("type")), ("cell", "comment", "header"))
    out = None
    for name, part in routes.items():
        part = part.withColumn("part", F.lit(name)).withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("conv_id", "turn")).cast("long")).drop("type")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT doc_id, length(text) AS size, i AS line FROM (SELECT doc_id, text, unnest(range(1, 3)) AS i FROM documents) WHERE NOT (doc_id % 2 = 0 AND i = 2)")
def merged_tails(spark, sf):
    """Lines 1 and 2 of every text; in every second text line 2 has been merged into line 1 and goes."""
    d = read(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("size"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("line"))
    gone = d.where("doc_id % 2 = 0 and line = 2").select("doc_id", "line")
    return segments.without(d, gone, ["doc_id", "line"])


@query("SELECT name, CAST(row_number() OVER (ORDER BY k, n) AS BIGINT) AS rank FROM (SELECT r_name AS name, r_name <> 'Region3' AS k, lower(r_name) AS n FROM region) ORDER BY rank")
def default_first(spark, sf):
    """Names in any case, one of them before all others."""
    r = read(spark, sf, "region").select(F.col("r_name").alias("name"))
    key = segments.default_first(F.col("name"), "Region3")
    return r.withColumn("rank", F.row_number().over(Window.orderBy(*key)).cast("long"))


@query("SELECT doc_id, CASE WHEN length(t) <= 900 THEN md5(t) ELSE md5(left(t, 300) || chr(10) || '…' || chr(10) || substr(t, length(t) // 2 - 150 + 1, 300) || chr(10) || '…' || chr(10) || right(t, 300)) END AS sample FROM (SELECT doc_id, text AS t FROM documents)")
def stratified_sample(spark, sf):
    from textloom.functions.tokens import arrow, sample

    pick = arrow(lambda t: sample([t], 900), "string")
    return texts(spark, sf).select("doc_id", F.md5(pick(F.col("text")).cast("binary")).alias("sample"))


# --- voice ------------------------------------------------------------------------------------------------------------


@query("WITH e AS (SELECT user_id AS key, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) AS BIGINT) AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) // 20 % 3 <> 2 AS v, count(*) OVER (PARTITION BY user_id) AS n FROM events), s AS (SELECT *, lag(f) OVER (PARTITION BY key ORDER BY f) AS p FROM e WHERE v), g AS (SELECT *, sum(CASE WHEN p IS NULL OR f - p - 1 >= 19 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY f ROWS UNBOUNDED PRECEDING) AS k FROM s), x AS (SELECT key, min(f) AS a, max(f) + 1 AS b, max(n) AS n FROM g GROUP BY key, k), y AS (SELECT key, n, a, CASE WHEN n - b < 19 THEN n ELSE b END AS b FROM x) SELECT key, greatest(0, a * 16.0 - 100) AS start, least(n * 16.0, b * 16.0 + 100) AS \"end\" FROM y WHERE (b - a) * 16 >= 160")
def speech_regions(spark, sf):
    """Frames of 16 ms, voiced by turns; a silence of 300 ms ends a region, which is widened by 100 ms."""
    from textloom.streaming import speech

    w = Window.partitionBy("user_id").orderBy("event_id")
    n = F.row_number().over(w)
    e = read(spark, sf, "events").select(F.col("user_id").alias("key"), ((n - 1) * 16).cast("long").alias("ms"), (F.floor(n / 20) % 3 != 2).alias("voiced"))
    return speech.speech_regions(e)


@query("SELECT user_id AS key, CAST(f AS BIGINT) AS frame, CAST(256 AS BIGINT) AS samples FROM (SELECT user_id, unnest(range(sum(100 + event_id % 300)::BIGINT // 256)) AS f FROM events GROUP BY user_id)")
def audio_frames(spark, sf):
    """Packets of 100 to 399 samples in frames of 256; what is no whole frame waits."""
    from textloom.streaming import speech

    e = read(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("n"), F.repeat(F.lit("ab"), (F.lit(100) + F.col("event_id") % 300).cast("int")).cast("binary").alias("pcm"))
    return speech.reblocked(e).select("key", "frame", (F.octet_length("pcm") / 2).cast("long").alias("samples"))


@query("SELECT conv_id AS key, CAST(turn AS BIGINT) AS n, coalesce((SELECT right(string_agg(t, ' ' ORDER BY u), 200) FROM (SELECT p.text AS t, p.turn AS u FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn < c.turn AND regexp_matches(p.text, '[0-9A-Za-z]') ORDER BY p.turn DESC LIMIT 3)), '') AS context FROM conversations c")
def live_context(spark, sf):
    from textloom.streaming import speech

    c = read(spark, sf, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("n"), "text")
    return speech.live_context(c)


@query("SELECT user_id AS key, event_id AS n, CASE WHEN event_type = 'purchase' THEN 'final' ELSE 'partial' END AS kind, event_id % 3 = 0 OR event_type = 'purchase' AS served FROM events")
def recogniser_admission(spark, sf):
    """A recogniser that is busy two times of three drops partial requests; final ones wait."""
    from textloom.streaming import speech

    e = read(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("n"), F.when(F.col("event_type") == "purchase", "final").otherwise("partial").alias("kind"), (F.col("event_id") % 3 != 0).alias("busy"))
    return speech.served(e).select("key", "n", "kind", "served")


@query("SELECT conv_id, turn, n, md5(array_to_string(w[1:n], ' ')) AS text FROM (SELECT conv_id, turn, string_split(text, ' ') AS w, unnest(range(1, len(string_split(text, ' ')) + 1)) AS n FROM conversations)")
def token_deltas(spark, sf):
    """Replies that grow word by word: after each delta the text so far."""
    from textloom.streaming import speech

    c = read(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "w"))
    deltas = c.select("conv_id", "turn", (F.col("i") + 1).cast("long").alias("n"), F.when(F.col("i") == 0, F.col("w")).otherwise(F.concat(F.lit(" "), "w")).alias("delta"))
    return speech.cumulative(deltas, ["conv_id", "turn"], "n").select("conv_id", "turn", "n", F.md5(F.col("text").cast("binary")).alias("text"))
