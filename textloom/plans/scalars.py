"""Registered queries of scalar functions and state machines. Expected values of the traps were written by hand from the
survey's wording; the others are computed by SQL over derived rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions import tokens as K
from textloom.operators import segments
from textloom.plans.catalogue import query, read, texts
from textloom.plans.services import traps
from textloom.streaming import speech


def trap(schema: str, outs: list[str], rows: list[tuple]):
    """Registers a query over hand-written rows: the function gets the frame without its expected columns."""
    sql, make = traps(schema, rows, outs)

    def register(f):
        def run(spark, sf):
            return f(make(spark)).select("id", *outs)

        run.__name__, run.__doc__, run.__module__ = f.__name__, f.__doc__, f.__module__
        return query(sql)(run)

    return register


def v():
    """The column that the functions read."""
    return F.col("value")


_PROSE = [
    (1, '', False), (2, '  \u3000 ', False), (3, '12', False), (4, '1.5-2.5', False), (5, '+82-32-726-2000', False), (6, '12:30 PM', True), (7, '2024-01-02', False),
    (8, 'well-known', False), (9, 'mix', False), (10, 'civic', False), (11, 'mild', False), (12, 'Hello.It is fine', False), (13, '/x', False), (14, '100ms', False),
    (15, '3.5 kg', False), (16, '5 apples', True), (17, 'v1.2.3-beta', False), (18, 'build 12', False), (19, 'ABC-123', False),
    (20, '550e8400-e29b-41d4-a716-446655440000', False), (21, '192.168.0.1', False), (22, '00:1B:44:11:3A:B7', False), (23, 'https://a.b/c', False),
    (24, 'www.a.b', False), (25, 'a@b.co', False), (26, 'C:\\x', False), (27, 'file.txt', False), (28, '{name}', False), (29, '${x}', False), (30, '%PATH%', False),
    (31, '{{x}}', False), (32, '<%x%>', False), (33, '第一', True), (34, 'ｆ', True), (35, 'API', False), (36, 'TOTAL', True), (37, 'MAX_SIZE', False), (38, 'A1', False),
    (39, 'Hello world', True), (40, 'naïve café', True), (41, '한국어 문장', True), (42, 'it', True), (43, '0x1F', False), (44, '#FFF', False), (45, '2F-3F', False),
    (46, 'x', False), (47, '40°26\'46"N 79°58\'56"W', False), (48, 'Tel. 12 34 56 78', True), (49, '!?', False),
]


@trap("id int, value string, prose boolean", ["prose"], _PROSE)
def prose_traps(df):
    """Texts of all kinds and whether they are prose, by the survey's wording."""
    return df.withColumn("prose", X.should_translate(v()))


@trap(
    "id int, value string, zh boolean, ja boolean, ko boolean, ru boolean, th boolean, vi boolean", ["zh", "ja", "ko", "ru", "th", "vi"],
    [(1, "日本語テキスト", True, True, False, False, False, False), (2, "漢字", True, True, False, False, False, False), (3, "한국어", False, False, True, False, False, False), (4, "русский", False, False, False, True, False, True), (5, "ไทย", False, False, False, False, True, True), (6, "Việt", False, False, False, False, False, True), (7, "plain", False, False, False, False, False, False), (8, "ひらがな", False, True, False, False, False, False), (9, "été", False, False, False, False, False, True)],
)
def script_traps(df):
    return df.withColumns({k: X.has_script(v(), k) for k in ("zh", "ja", "ko", "ru", "th", "vi")})


@trap("id int, value string, marks string", ["marks"], [(1, "a %s {x} ${y} {{z}}", "${y}|%s|{x}|{{z}}"), (2, "%1$d and %5", "%1$d"), (3, "100% sure", ""), (4, "{a} {a}", "{a}|{a}"), (5, "", "")])
def loose_marks(df):
    return df.withColumn("marks", F.array_join(X.tokens(v(), X.LOOSE), "|"))


@trap("id int, value string, plain string", ["plain"], [(1, "{{HLINK_1}}a b{{/HLINK_1}} {{INLINE_2}}c", "a b c"), (2, "no marks", "no marks"), (3, "{{HLINK_1}}x{{/HLINK_1}}{{HLINK_2}}y{{/HLINK_2}}", "xy"), (4, "{{INLINE_12}}", ""), (5, "{{OTHER}}", "{{OTHER}}")])
def plain_marks(df):
    return df.withColumn("plain", X.plain_text(v()))


@trap("id int, value string, out string", ["out"], [(1, "2024年3月5日 was", "March 05, 2024 was"), (2, "in 2023-12 and", "in December 2023 and"), (3, "9999-01-01", "9999-01-01"), (4, "2024/13/01", "2024/13/01"), (5, "2024.1.2", "January 02, 2024"), (6, "2024年3月", "March 2024"), (7, "none", "none")])
def english_dates(df):
    return df.withColumn("out", K.arrow(K.english_dates, "string")(v()))


@trap("id int, value string, out string", ["out"], [(1, "• a", "a"), (2, "1. b", "1. b"), (3, "- words", "words"), (4, "- ab", "- ab"), (5, "* star here", "star here"), (6, "1.1 x", "1.1 x"), (7, "2022.12.31", "2022.12.31"), (8, "‣ c", "c"), (9, "-x", "-x"), (10, "•", "•")])
def list_marks(df):
    return df.withColumn("out", X.without_numbering(v()))


@trap("id int, value string, parts string", ["parts"], [(1, '&L&"Arial"Title &P', '&L|&"Arial"|Title |&P'), (2, "plain", "plain"), (3, "&CPage &P of &N", "&C|Page |&P| of |&N"), (4, "&12Big", "&12|Big"), (5, "", "")])
def header_codes(df):
    return df.withColumn("parts", F.array_join(K.arrow(lambda t: [p for _, p in K.header_parts(t)], "array<string>")(v()), "|"))


@trap(
    "id int, value string, status int, kind string, fatal string", ["kind", "fatal"],
    [(1, "x", 429, "rate_limit", "api_error"), (2, "x", 402, "hard", "api_error"), (3, "x", 503, "server", "api_error"), (4, "x", 400, "invalid_request", "api_error"), (5, "x", 422, "invalid_request", "api_error"), (6, "x", 413, "too_large", "api_error"), (7, "Request timed out", None, "timeout", "api_error"), (8, "Insufficient Balance", None, "hard", "insufficient_balance"), (9, "Incorrect API key", 200, "hard", "invalid_key"), (10, "Connection refused", None, "connection", "api_error"), (11, None, None, "unknown", "api_error"), (12, "Error 502 bad gateway", None, "server", "api_error")],
)
def error_kinds(df):
    return df.withColumn("kind", X.error_class(v(), F.col("status"))).withColumn("fatal", X.fatal_class(v()))


@trap("id int, value string, out string", ["out"], [(1, "<think>a\nb</think>ok", "ok"), (2, "x<think>1</think>y<think>2</think>", "xy"), (3, "<think>open", "<think>open"), (4, "", "")])
def without_reasoning(df):
    return df.withColumn("out", X.without_reasoning(v()))


@trap("id int, value string, out string", ["out"], [(1, '{"translation": "b"}', "b"), (2, "plain", "plain"), (3, '```json\n{"text": "c",}\n```', "c"), (4, '{"x": "first"}', "first"), (5, '{"text": "t", "translated_text": "u"}', "u"), (6, '{"1": "one"}', "one")])
def single_replies(df):
    return df.withColumn("out", X.plain_reply(v()))


@trap(
    "id int, value string, out string", ["out"],
    [(1, '{"1": "a"} {"2": "b"}', "1=a,2=b"), (2, 'x {"1": "a}", "2": "b",} y {"2": "c"} {bad}', "1=a},2=c"), (3, "none", ""), (4, '{"1": {"n": 1}}', '1={"n": 1}'), (5, '{"a": "q\\"{"}{"a": "z"}', "a=z")],
)
def merged_replies(df):
    return df.withColumn("out", K.arrow(lambda t: ",".join(f"{k}={x}" for k, x in K.merged_json(t).items()), "string")(v()))


@trap("id int, value string, out string", ["out"], [(1, 'so: [["a", "b"], ["c", "c"]]', "a>b"), (2, '[{"src": "x", "dst": "y"}, {"source": "s", "target": "t"}, 3]', "x>y,s>t"), (3, "junk", ""), (4, '[["a"]]', ""), (5, '[["a", 5]]', "a>5")])
def term_lists(df):
    return df.withColumn("out", K.arrow(lambda t: ",".join(f"{a}>{b}" for a, b in K.term_list(t)), "string")(v()))


@trap("id int, value string, out string", ["out"], [(1, "a|b", "a b"), (2, "第一句。|第二句。", "第一句。第二句。"), (3, "end |next", "end next"), (4, "one", "one"), (5, "字|word", "字word"), (7, "x.|第", "x.第")])
def joined_chunks(df):
    return df.withColumn("out", X.join_chunks(F.split(v(), r"\|")))


@trap("id int, value string, sizes string, out string", ["out"], [(1, "hello brave world", "5,12", "hello |brave world"), (2, "eine ganze Zeile", "9,6", "eine ganze |Zeile"), (3, "x", "5", "x"), (4, "abcdef", "1,1,1", "ab|cd|ef"), (5, "", "3,3", "|")])
def run_texts(df):
    from textloom.sources.formats import distribute

    return df.withColumn("out", K.arrow(lambda t, s: "|".join(distribute(t, [int(x) for x in s.split(",")])), "string")(v(), F.col("sizes")))


@trap("id int, value string, kept string", ["kept"], [(1, "a:x,y;b:y", "x"), (2, "a:x;b:y", "x"), (3, "a:x;b:x", ""), (4, "b:x", "")])
def removable_modules(df):
    """What only module a needs."""
    wanted = lambda t: {k: set(m.split(",")) for k, _, m in (p.partition(":") for p in t.split(";"))}
    return df.withColumn("kept", K.arrow(lambda t: ",".join(sorted(K.removable(wanted(t), "a"))), "string")(v()))


_PROSE_LONG = "In the beginning was a sentence which goes on for longer than its source, but says other things with new words."


@trap("id int, value string, source string, loop boolean", ["loop"], [(1, "na " * 60, "Hi", True), (2, "a line\nof text\n" * 12, "Hi", True), (3, _PROSE_LONG, "Hi", False), (4, "na " * 60, "x" * 80, False), (5, "na " * 12, "Hi", False), (6, "", "Hi", False), (7, None, "Hi", False), (8, "abcdefghijklmnopqrstuvwxyz012345" * 6, "Hi", True)])
def repetition_loops(df):
    """Texts far longer than their source that zlib shrinks to under a quarter, units of any length and over lines."""
    return df.withColumn("loop", X.repeated(F.col("source"), v()))


@trap("id int, value string, out string", ["out"], [(1, "ＡＢＣ ", "abc"), (2, "Straße", "strasse"), (3, "ﬁne", "fine"), (4, "Ⅳ", "iv"), (5, "ｶﾞ", "ガ"), (6, "Ａ①", "a1")])
def term_forms(df):
    return df.withColumn("out", K.arrow(K.compatible, "string")(v()))


@trap("id int, value string, structural string, sentinels string", ["structural", "sentinels"], [(1, "a {{F_1}} [formula_2] ␊", "[formula_2]|{{F_1}}|␊", ""), (2, "x 7 y 7", "", "7|7"), (3, "{a} [formula_x]", "", ""), (4, None, "", "")])
def structure_marks(df):
    return df.withColumn("structural", F.array_join(X.tokens(v(), X.STRUCTURAL), "|")).withColumn("sentinels", F.array_join(X.tokens(v(), X.SENTINEL), "|"))


@trap("id int, value string, out string", ["out"], [(1, "slide10,slide2,slide1", "slide1,slide2,slide10"), (2, "b,a", "a,b"), (3, "p1x2,p1x10,p01x3", "p1x2,p01x3,p1x10")])
def natural_orders(df):
    from textloom.sources.formats import natural

    return df.withColumn("out", K.arrow(lambda t: ",".join(sorted(t.split(","), key=natural)), "string")(v()))


@trap(
    "id int, value string, final boolean, units string, used int", ["units", "used"],
    [
        (1, "Short. And more", False, "Short.", 6), (2, "Short. And more", True, "Short.|And more", 15), (3, "这句话很长很长很长很长很长但是没有标点符号的时候也要断开来看看行不行呢", False, "这句话很长很长很长很长很长", 13), (4, "x" * 100, False, "x" * 88, 88), (5, "x" * 50, False, "", 0),
        (6, "And this one goes on for a while, then it does not stop but goes on", False, "And this one goes on for a while,", 33), (7, "Is it? Yes! 好。", False, "Is it?|Yes!|好。", 14), (8, "", True, "", 0),
    ],
)
def live_units(df):
    cut = K.arrow(lambda t, f: [*K.units(t, f)[0], str(K.units(t, f)[1])], "array<string>")(v(), F.col("final"))
    got = df.withColumn("_u", cut)
    return got.withColumn("units", F.array_join(F.slice("_u", F.lit(1), F.size("_u") - 1), "|")).withColumn("used", F.element_at("_u", -1).cast("int"))


@trap("id int, value string, tail string", ["tail"], [(1, "so we went on", " on"), (2, "Oh, so we went, home", "home"), (3, "entirely other words", "ther words"), (4, "so we", ""), (5, "so we went", "")])
def uncommitted_tails(df):
    """What is behind `so we went` in hypotheses that change the words before it."""
    return df.withColumn("tail", K.arrow(lambda t: speech.Agreement("so we went").tail(t), "string")(v()))


@trap(
    "id int, value string, seconds double, cues string", ["cues"],
    [(1, "One sentence here. Another one there now.", 9.0, "One sentence here.|Another one there now."), (2, "short", 3.0, "short"), (3, "A short fine line.", 3.0, "A short fine line."), (4, "nowheretocut", 30.0, "nowheretocut"), (5, "tiny it", 30.0, "tiny it"), (6, "first clause, second clause", 8.0, "first clause,|second clause"), (7, "", 1.0, "")],
)
def split_cues(df):
    return df.withColumn("cues", K.arrow(lambda t, s: "|".join(x for _, _, x in K.split_cue(0.0, s, t)), "string")(v(), F.col("seconds")))


@query("SELECT doc_id, CAST(round(1000 * sqrt(avg(s * s))) AS BIGINT) AS loudness, CAST(count(*) // 2 AS BIGINT) AS resampled FROM (SELECT doc_id, ((i * 97 + doc_id) % 2000 - 1000) / 32768.0 AS s FROM (SELECT doc_id, unnest(range(400)) AS i FROM documents)) GROUP BY doc_id")
def pcm_energy(spark, sf):
    """400 samples made of each document's number: decoded, their energy, and how many a rate of half gives."""
    import numpy as np

    def of(doc_id: int) -> list[float]:
        raw = ((np.arange(400) * 97 + doc_id) % 2000 - 1000).astype("<i2").tobytes()
        x = K.mono(raw)
        return [float(round(1000 * K.energy(x.astype(np.float64)))), float(len(K.resampled(x, 16000, 8000)))]

    got = read(spark, sf, "documents").select("doc_id", K.arrow(of, "array<double>")(F.col("doc_id")).alias("r"))
    return got.select("doc_id", F.col("r")[0].cast("long").alias("loudness"), F.col("r")[1].cast("long").alias("resampled"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS n, value < 480 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
r AS (SELECT key, n, k, CASE WHEN ok THEN 8 ELSE 4 END AS lim, CASE WHEN ok THEN 1 ELSE 0 END AS run FROM e WHERE k = 1
 UNION ALL SELECT e.key, e.n, e.k, CASE WHEN NOT e.ok THEN greatest(2, r.lim // 2) WHEN r.run + 1 >= 12 THEN least(16, r.lim + 1) ELSE r.lim END, CASE WHEN NOT e.ok OR r.run + 1 >= 12 THEN 0 ELSE r.run + 1 END FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1)
SELECT key, n, CAST(lim AS INTEGER) AS "limit" FROM r""")
def call_limits(spark, sf):
    """Events as calls: a large value is an overload."""
    e = read(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("n"), (F.col("value") < 480).alias("ok"))
    return segments.fold(e, "key", ["n"], lambda: speech.Told(speech.Limit()), "key long, n long, limit int")


@query("""WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS n, (event_id * 37 % 100) / 1000.0 AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
r AS (SELECT key, n, k, CAST(x AS DOUBLE) > 0.01::DOUBLE * 3.0::DOUBLE AS voiced, CASE WHEN CAST(x AS DOUBLE) > 0.01::DOUBLE * 3.0::DOUBLE THEN 0.01::DOUBLE ELSE 0.99::DOUBLE * 0.01::DOUBLE + 0.01::DOUBLE * CAST(x AS DOUBLE) END AS lvl FROM e WHERE k = 1
 UNION ALL SELECT key, n, k, up, CASE WHEN up THEN lvl ELSE 0.99::DOUBLE * lvl + 0.01::DOUBLE * x END FROM (SELECT e.key, e.n, e.k, CAST(e.x AS DOUBLE) AS x, r.lvl, CAST(e.x AS DOUBLE) > r.lvl * CASE WHEN r.voiced THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS up FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1))
SELECT key, n, voiced FROM r""")
def noise_floors(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("n"), ((F.col("event_id") * 37 % 100) / F.lit(1000.0)).alias("energy"))
    return segments.fold(e, "key", ["n"], lambda: speech.Told(speech.NoiseFloor()), "key long, n long, voiced boolean")


@query("SELECT event_type AS model, CAST(max(epoch_us(ts) // 1000000 + greatest(1, value)) AS BIGINT) AS until FROM events GROUP BY event_type")
def cool_downs(spark, sf):
    """A model rests until the latest of all times that its failures have named, to the nearest second."""
    e = read(spark, sf, "events")
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return speech.resting(e.select(F.col("event_type").alias("model"), at.alias("now"), F.col("value").alias("seconds"))).select("model", F.rint("until").cast("long").alias("until"))


@query()
def vocabulary_counts(spark, sf):
    """Tokens of whole texts by a public vocabulary."""
    from public_tokenizers import path

    return texts(spark, sf).select("doc_id", K.vocabulary_count(path("word_bpe_49k.json"))(F.col("text")).alias("tokens"))
