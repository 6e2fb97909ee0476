import re

import pytest
from pyspark.sql import functions as F
from textloom.functions import text as X
from textloom.operators import history, ordering, segments, terms, timeline
from textloom.streaming import speech


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


PROSE = {
    "": False, "  \u3000 ": False, "12": False, "1.5-2.5": False, "+82-32-726-2000": False, "12:30 PM": True, "2024-01-02": False, "well-known": False, "mix": False, "civic": False,
    "mild": False, "Hello.It is fine": False, "/x": False, "100ms": False, "3.5 kg": False, "5 apples": True, "v1.2.3-beta": False, "build 12": False, "ABC-123": False,
    "550e8400-e29b-41d4-a716-446655440000": False, "192.168.0.1": False, "00:1B:44:11:3A:B7": False, "https://a.b/c": False, "www.a.b": False, "a@b.co": False, "C:\\x": False,
    "file.txt": False, "{name}": False, "${x}": False, "%PATH%": False, "{{x}}": False, "<%x%>": False, "第一": True, "ｆ": True, "API": False, "TOTAL": True, "MAX_SIZE": False, "A1": False,
    "Hello world": True, "naïve café": True, "한국어 문장": True, "it": True, "0x1F": False, "#FFF": False, "2F-3F": False, "x": False, "40°26'46\"N 79°58'56\"W": False, "Tel. 12 34 56 78": True, "!?": False,
}


def test_should_translate(spark):
    assert dict(zip(PROSE, column(spark, list(PROSE), X.should_translate), strict=True)) == PROSE
    assert column(spark, ["Acme Corp", None], lambda c: X.should_translate(c, ("Acme Corp",))) == [False, False]


def test_scalars(spark):
    assert column(spark, ["12", "③", "㊿", "xiv", "贰", "item 42b", "none", None], X.to_int_tolerant) == [12, 3, 50, 14, 2, 42, 0, 0]
    assert column(spark, ["ab", "字a"], X.cells) == [2, 3]
    assert column(spark, ["00:01:02,500", "x", None], X.cue_seconds) == [62.5, None, None]
    assert column(spark, [59.9999, 3661.5], X.srt_time, "double") == ["00:01:00,000", "01:01:01,500"]
    assert column(spark, ["{{HLINK_1}}a{{/HLINK_1}} {{INLINE_2}}b"], X.plain_text) == ["a b"]
    assert column(spark, ["ha" * 20 + "!"], X.collapse_repeats) == ["hahahaha!"]
    assert column(spark, ["<think>x\ny</think>ok"], X.without_reasoning) == ["ok"]
    assert column(spark, ['```json\n{"1": "a",}\n```', 'say {"translation": "b"} now', "plain", '{"text": "c"}'], X.plain_reply) == ["a", "b", "plain", "c"]
    assert column(spark, ["=1", "-x", "ok", "a\x01b"], X.safe_cell) == [" =1", " -x", "ok", "ab"]
    assert column(spark, ["1.10", "1.9"], X.version_parts) == [[1, 10], [1, 9]]
    assert column(spark, ["Too Many Requests", "Request timed out", "Insufficient Balance", "boom", None], X.error_class) == ["rate_limit", "timeout", "hard", "unknown", "unknown"]
    assert column(spark, [429, 402, 503, 400, 422, 413, 200], lambda c: X.error_class(F.lit("x"), c), "int") == ["rate_limit", "hard", "server", "invalid_request", "invalid_request", "too_large", "unknown"]
    assert column(spark, ["insufficient_quota", "Invalid API key", "x"], X.fatal_class) == ["insufficient_balance", "invalid_key", "api_error"]
    assert column(spark, ["• a", "1. b", "- words", "- ab", "-x", "3.5 d", "2022.12", "•"], X.without_numbering) == ["a", "1. b", "words", "- ab", "-x", "3.5 d", "2022.12", "•"]
    assert column(spark, ["• a"], lambda c: X.without_numbering(c, False)) == ["• a"]
    assert column(spark, [45, 60, 125, 3600, 5400, 3661], X.duration, "long") == ["45s", "1m", "2m 5s", "1h", "1h 30m", "1h 1m 1s"]
    assert column(spark, [500, 12_500, None], X.short_count, "long") == ["500", "12.5K", "0"]


VALID = [
    ("100%", "100%", "en", "de", True), ("https://x.y", "https://x.y", "en", "de", True), ("a@b.co", "a@b.co", "en", "de", True), ("Hello", " hello ", "en", "de", False),
    ("Hello", "Hallo", "en", "de", True), ("Hello", "", "en", "de", False), ("Hello", "Hallo", "en", "zh", False), ("Hello", "你好", "en", "zh", True), ("你好", "你好", "zh", "en", False),
    ("abc", "abc", "zh", "en", True), ("Hi %s", "Hallo", "en", "de", False), ("Hi %s {n}", "{n} Hallo %s", "en", "de", True), ("Hi {{X}}", "Hallo", "en", "de", False), ("Hi", "na " * 60, "en", "de", False),
    ("Hi", "Chào", "en", "vi", True), ("Straße", "STRASSE", "de", "fr", False), ("Hi", "a line\nof text\n" * 12, "en", "de", False), ("Hi {!x}", "Hallo", "en", "de", False), ("95% of it", "95 % davon", "en", "de", True),
    ("Hi", "In the beginning was a sentence which goes on for longer than its source but says other things.", "de", "en", True),
]


@pytest.mark.parametrize("case", VALID)
def test_translation_valid(spark, case):
    o, t, src, dst, want = case
    row = spark.createDataFrame([(o, t)], "original string, translated string")
    assert row.select(X.translation_valid(F.col("original"), F.col("translated"), src, dst)).first()[0] is want


def test_last_round_keeps_only_whole_texts(spark):
    rows = spark.createDataFrame([(1, "Hi %s", "Hallo"), (2, "Hello", "Hello"), (3, "Hello", "Hallo"), (4, "x y", None)], "id int, original string, translated string")
    got = lambda last: {r.id: r.outcome for r in segments.outcome(rows, "en", "de", last).collect()}
    assert got(False) == {1: "failed", 2: "failed", 3: "translated", 4: "failed"}
    assert got(True) == {1: "failed", 2: "needs_review", 3: "translated", 4: "failed"}


def test_rounds_retry_what_failed(spark):
    rows = spark.createDataFrame([(i, f"text number {i}") for i in range(8)], "count_split long, original string")

    def call(left, n):
        ok = F.col("count_split") % 4 <= n
        return left.withColumn("translated", F.when(ok, F.concat(F.lit("[T]"), "original")).otherwise(""))

    got = {r.count_split: (r.outcome, r.translated) for r in segments.translate_rounds(rows, call, "en", "de", retries=2).collect()}
    assert got[0] == ("translated", "[T]text number 0") and got[2] == ("translated", "[T]text number 2")
    assert got[3] == ("failed", "text number 3") and len(got) == 8


def test_global_rank_is_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    ranked = ordering.global_rank(df.repartition(7), ["v"]).collect()
    assert sorted((r.rank, r.v) for r in ranked) == [(i + 1, i) for i in range(1000)]
    assert ordering.global_rank(df.limit(0), ["v"]).collect() == []


def test_running_sums_of_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 40}", (i * 7919) % 3001, i % 13) for i in range(3000)] + [(None, i, 2) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, o int, v long")
    got = {(r.g, r.o): r.t for r in ordering.running_sum(df.repartition(6), ["g"], [F.col("o").desc()], F.col("v"), "t").collect()}
    for g in {r[0] for r in rows}:
        total = 0
        for _, o, v in sorted((r for r in rows if r[0] == g), key=lambda r: -r[1]):
            total += v
            assert got[g, o] == total
    assert ordering.running_sum(df.limit(0), ["g"], [F.col("o")], F.col("v"), "t").collect() == []


def test_sessions_over_the_cuts_of_time(spark):
    import random

    random.seed(4)
    rows, at = [], {k: 1_700_000_000.0 for k in (1, 2)}
    for _ in range(400):
        k = random.choice((1, 1, 1, 2))
        at[k] += random.choice((5, 50, 59.5, 60, 61, 500))
        rows.append((k, at[k]))
    want = []
    for k in (1, 2):
        times, n = sorted(t for j, t in rows if j == k), 0
        runs = [[times[0]]]
        for a, b in zip(times, times[1:], strict=False):
            if b - a >= 60:
                runs.append([])
            runs[-1].append(b)
        want += [(k, n, len(r)) for n, r in enumerate(runs)]
    df = spark.createDataFrame(rows, "k long, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")))
    got = timeline.sessions(df, "k", "ts", 60, bucket=300).collect()
    assert sorted((r.k, r.session, r.n) for r in got) == sorted(want)


def test_chunks_and_restore(spark):
    latin = " ".join(f"Sentence number {i} has some words." for i in range(60))
    cjk = "".join(f"第{i}句话有一些字。" for i in range(120))
    df = spark.createDataFrame([(1, 0, latin), (2, 0, cjk), (3, 0, "short"), (4, 0, "x" * 3000), (5, 0, "")], "doc_id long, ord int, value string")
    chunks = segments.split_chunks(df, 100).collect()
    by = {}
    for c in sorted(chunks, key=lambda r: (r.doc_id, r.chunk)):
        by.setdefault(c.doc_id, []).append(c.value)
        assert c.chunks == sum(1 for d in chunks if d.doc_id == c.doc_id)
    assert "".join(by[1]) == latin and "".join(by[2]) == cjk and by[3] == ["short"] and "".join(by[4]) == "x" * 3000 and by[5] == [""]
    assert len(by[1]) > 2 and len(by[2]) > 2


def test_a_missing_chunk_gives_the_source(spark):
    mapped = spark.createDataFrame([(1, 0, "v1", 1), (2, 0, "v2", 2)], "doc_id long, ord int, value string, count_deduped long")
    chunks = spark.createDataFrame([(1, 0, 2, "a"), (1, 1, 2, "b"), (2, 0, 2, "a"), (2, 1, 2, "")], "count_deduped long, chunk int, chunks int, translated string")
    assert {r.doc_id: r.translated for r in segments.restore(mapped, chunks).collect()} == {1: "a b", 2: "v2"}


def test_greedy_batches():
    machine = segments.Greedy(6, 0)
    assert [row for c in [3, 3, 5, 20, 1] for row in machine.add(c)] == [(3, 0), (3, 0), (5, 1), (20, 2), (1, 3)]


def test_fold_runs_a_machine_a_key(spark):
    rows = spark.createDataFrame([(i % 7, i, float(i)) for i in range(5000)], "k long, o int, v double")
    got = segments.fold(rows.repartition(9), "k", ["o"], lambda: segments.Greedy(1e4, 2), "k long, o int, v double, b int").collect()
    for k in range(7):
        machine = segments.Greedy(1e4, 2)
        assert sorted(tuple(r) for r in got if r.k == k) == [r for i in range(k, 5000, 7) for r in machine.add(k, i, float(i))]
    assert segments.fold(rows.limit(0), "k", ["o"], lambda: segments.Greedy(1, 2), "k long, o int, v double, b int").collect() == []


def test_glossary_rules(spark):
    texts = spark.createDataFrame([(1, "The cat sat. Catalog"), (2, "concatenate"), (3, "我喜欢猫咪"), (4, "CAT-5 and C++"), (5, None)], "doc_id long, text string")
    g = spark.createDataFrame([(0, "cat", "Katze"), (1, "猫", "cat"), (2, "C++", "C++"), (3, "cat sat", "x")], "ord int, src string, dst string")
    assert sorted((r.doc_id, r.src) for r in terms.match(texts, g).collect()) == [(1, "cat"), (1, "cat sat"), (3, "猫"), (4, "C++"), (4, "cat")]
    wide = spark.createDataFrame([(0, "a", "1"), (1, "a", "2"), (2, "", "3")], "ord int, en string, de string")
    assert [(r.src, r.dst) for r in terms.unpivot(wide, "en", "de").collect()] == [("a", "2")]


@pytest.mark.parametrize("sent", [100, 1])
def test_live_terms_stand_anywhere(spark, monkeypatch, sent):
    monkeypatch.setattr(terms, "BROADCAST_TERMS", sent)
    texts = spark.createDataFrame([(1, "say ALICE and concat"), (2, "猫が好き Über"), (3, ""), (4, None), (5, "x")], "doc_id long, text string")
    g = spark.createDataFrame([(0, "alice", "A"), (1, "cat", "K"), (2, "猫", "cat"), (3, "über", "u"), (4, "Über", "U"), (5, "x", "X"), (6, "", "no")], "ord int, src string, dst string")
    assert sorted((r.doc_id, r["rank"], r.src) for r in terms.live_terms(texts, g).collect()) == [(1, 1, "alice"), (1, 2, "cat"), (2, 1, "猫"), (2, 2, "Über"), (5, 1, "x")]
    assert {r["rank"] for r in terms.live_terms(texts, g, 1).collect()} == {1}


def test_retention_and_names(spark):
    f = spark.createDataFrame([("d", f"p{i}", i, 10) for i in range(5)], "dir string, path string, mtime long, size long")
    assert sorted(r.path for r in history.over_size(f, 25, "dir").where("delete").collect()) == ["p0", "p1", "p2"]
    n = spark.createDataFrame([(1, "a.txt"), (2, "a.txt"), (3, "b")], "ord int, name string")
    assert [r.unique for r in history.unique_names(n).orderBy("ord").collect()] == ["a.txt", "a (2).txt", "b"]


def test_cues_and_boxes(spark):
    rows = [(1, 0.0, 0.5, "Hi."), (1, 0.6, 1.0, "there"), (1, 3.0, 6.0, "A short fine line."), (2, 0.0, 1.0, "好。"), (2, 1.1, 3.0, "是的"), (3, 0.0, 1.3, "a"), (3, 1.4, 2.7, "b"), (4, 0.0, 1.0, "w" * 60), (4, 1.0, 2.0, "w" * 60)]
    c = spark.createDataFrame(rows, "doc_id long, start double, end double, text string")
    got = sorted((r.doc_id, r.start, r.end, r.text) for r in timeline.merge_cues(c, 42).collect())
    assert got == [(1, 0.0, 1.0, "Hi. there"), (1, 3.0, 6.0, "A short fine line."), (2, 0.0, 3.0, "好。是的"), (3, 0.0, 1.3, "a"), (3, 1.4, 2.7, "b"), (4, 0.0, 1.0, "w" * 60), (4, 1.0, 2.0, "w" * 60)]
    b = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 12.0, 1.0, 22.0, 11.0), (1, 3, 0.0, 100.0, 10.0, 110.0)], "image long, id long, x0 double, y0 double, x1 double, y1 double")
    assert {r.id: r.grp for r in timeline.box_groups(b, timeline.boxes_linked(b, 5.0)).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.id: r["rank"] for r in timeline.reading_order(b, right_to_left=True).collect()} == {2: 0, 1: 1, 3: 2}
    quad = spark.range(1).select(timeline.bounds(F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((3, 9), (1, 2), (8, 4), (5, 5))])).alias("b")).first().b
    assert tuple(quad) == (1, 2, 8, 9)


def test_boxes_of_all_sizes_meet_once(spark):
    """Against brute force: page-wide, tiny and overlapping boxes, several images."""
    import random

    random.seed(8)
    boxes = []
    for i in range(240):
        x, y, h = random.uniform(0, 300), random.uniform(0, 300), random.choice((3, 8, 12, 20, 45))
        boxes.append((i % 3, i, x, y, x + random.choice((5, 30, 600)), y + h * random.uniform(0.9, 1.1)))
    df = spark.createDataFrame(boxes, "image long, id long, x0 double, y0 double, x1 double, y1 double")
    want = set()
    for a in boxes:
        for b in boxes:
            ha, hb = a[5] - a[3], b[5] - b[3]
            if a[0] == b[0] and a[1] < b[1] and max(a[2], b[2]) - min(a[4], b[4]) <= 12 and max(a[3], b[3]) - min(a[5], b[5]) <= 12 and max(ha, hb) <= 1.8 * min(ha, hb):
                want.add((a[0], a[1], b[1]))
    links = timeline.boxes_linked(df)
    got = [tuple(r) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    up = {(b[0], b[1]): b[1] for b in boxes}
    for _ in range(len(boxes)):
        for m, a, b in want:
            up[m, a] = up[m, b] = min(up[m, a], up[m, b])
    assert {(r.image, r.id): r.grp for r in timeline.box_groups(df, links).collect()} == up


def test_lists_of_equal_boxes_link_as_boxes_do(spark, monkeypatch):
    import random

    random.seed(4)
    boxes = []
    for i in range(500):
        x, y, w, h = random.randrange(0, 400, 25), random.randrange(0, 200, 25), random.choice((5, 30, 600)), random.choice((8, 12, 20))
        boxes.append((i % 2, i, float(x), float(y), float(x + w), float(y + h)))
    for i, odd in enumerate(((None, 0.0, 5.0, 14.0), (50.0, 0.0, 40.0, 14.0), (float("nan"), 0.0, 5.0, 14.0), (-0.0, 0.0, 5.0, 12.0), (0.0, 0.0, 5.0, 12.0), (9.0, 9.0, 20.0, 9.0), (9.0, 14.0, 20.0, 9.0), (80.0, 0.0, 40.0, 14.0))):
        boxes += [(m, 900 + 3 * i + k, *odd) for m in (0, 1, None) for k in range(3)]
    boxes += [(0, None, 0.0, 0.0, 5.0, 12.0), boxes[0], boxes[0]]  # an id that is missing, and one that comes three times
    df = spark.createDataFrame(boxes, "image long, id long, x0 double, y0 double, x1 double, y1 double")
    key = lambda r: (r.image, r.a, r.b)
    for gap in (12.0, 4.0):
        want = sorted(timeline.boxes_linked(df, gap).collect(), key=key)
        for most in (1_000, 2):
            monkeypatch.setattr(timeline, "LISTED", most)
            assert timeline.listed(df).agg({"ids": "count"}).first()[0] < len(boxes)
            assert sorted(timeline.equal_boxes_linked(df, gap).collect(), key=key) == want
    assert len(want) > 300


def test_box_lists_leave_no_shuffle_files(spark):
    def kept() -> set[str]:
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = kept(), spark.conf.get(key)
    lists = timeline.listed(spark.range(3000).selectExpr("id % 3 AS image", "id", "0D AS x0", "0D AS y0", "30D AS x1", "12D AS y1").repartition(4))
    assert not kept() - before
    assert spark.conf.get(key) == was
    assert sorted(len(r.ids) for r in lists.collect()) == [1000, 1000, 1000]


def test_bubbles_against_brute_force(spark):
    import random

    random.seed(2)
    boxes = []
    for i in range(260):
        w, h = random.choice(((40, 10), (10, 40), (15, 12), (200, 11), (10, 150)))
        x, y = random.uniform(0, 260), random.uniform(0, 260)
        boxes.append((i % 2, i, x, y, x + w * random.uniform(0.8, 1.2), y + h * random.uniform(0.8, 1.2)))

    def linked(a, b):
        dim = lambda t: (t[4] - t[2], t[5] - t[3])
        up = lambda t: dim(t)[1] > 1.3 * max(dim(t)[0], 1)
        ca, cb = min(dim(a)), min(dim(b))
        cs = max(min(ca, cb), 1)
        dx, dy = max(a[2], b[2]) - min(a[4], b[4]), max(a[3], b[3]) - min(a[5], b[5])
        return up(a) == up(b) and max(ca, cb) / cs <= 1.6 and (max(dx, 0) ** 2 + max(dy, 0) ** 2) ** 0.5 <= cs and -(dx if up(a) else dy) > -0.6 * cs

    df = spark.createDataFrame(boxes, "image long, id long, x0 double, y0 double, x1 double, y1 double")
    want = {(a[0], a[1], b[1]) for a in boxes for b in boxes if a[0] == b[0] and a[1] < b[1] and linked(a, b)}
    got = [tuple(r) for r in timeline.bubble_links(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30


def groups_of(boxes: list[tuple], links) -> dict:
    up = {(b[0], b[1]): b[1] for b in boxes}
    links, moved = list(links), True
    while moved:
        moved = False
        for m, a, b in links:
            if up[m, a] != up[m, b]:
                up[m, a] = up[m, b] = min(up[m, a], up[m, b])
                moved = True
    return up


def page(seed: int, n: int, kinds: tuple, tops: int) -> list[tuple]:
    """Boxes that share tops and feet, and some of any height."""
    import random

    r = random.Random(seed)
    out = []
    for i in range(n):
        w, h = r.choice(kinds)
        x, y = r.uniform(0, 900), r.randrange(tops) * 9.0 + r.choice((0, 0, 0, 2.5, 7.25))
        out.append((i % 3, i, x, y, x + w * r.uniform(0.7, 1.3), y + h * (1 if i % 5 else r.uniform(0.8, 1.2))))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_groups_by_runs_are_those_of_all_links(spark, seed):
    schema = "image long, id long, x0 double, y0 double, x1 double, y1 double"
    boxes = page(seed, 260, ((5, 3), (9, 14), (30, 8), (90, 14)), 30)
    odd = [(0, 900, None, 0.0, 5.0, 14.0), (0, 901, 50.0, 0.0, 40.0, 14.0), (0, 902, float("nan"), 0.0, 5.0, 14.0)]
    df = spark.createDataFrame([*boxes, *odd], schema)
    want = groups_of([*boxes, *odd], [tuple(x) for x in timeline.boxes_linked(df).collect()])
    assert {(x.image, x.id): x.grp for x in timeline.linked_groups(df).collect()} == want
    assert 10 < len(set(want.values())) < 200
    lines = page(seed, 360, ((40, 10), (24, 12), (9, 30), (12, 40), (60, 10), (1, 1), (0.5, 3)), 24)
    rows = [(*b, str(b[1]), 0.5, None if b[1] % 50 == 0 else b[1] % 11 != 0) for b in lines]
    df = spark.createDataFrame(rows, f"{schema}, value string, score double, prose boolean")
    want = groups_of(lines, [tuple(x) for x in timeline.bubble_links(df.where("prose")).collect()])
    assert {(x.image, x.id): x.grp for x in timeline.bubble_groups(df).collect()} == want
    assert 10 < len(set(want.values())) < 300


def test_boxes_over_one_another_make_no_pairs(spark, monkeypatch):
    """Groups of 3,000 boxes in a line come without their 4.5 million links."""
    made = []
    real = timeline.box_groups
    monkeypatch.setattr(timeline, "box_groups", lambda boxes, links: made.append(links.count()) or real(boxes, links))
    b = spark.range(3000).selectExpr("0L AS image", "id", "CAST(id % 30 AS DOUBLE) AS x0", "0.0D AS y0", "CAST(id % 30 + 40 AS DOUBLE) AS x1", "12.0D AS y1", "'' AS value", "0.5D AS score", "true AS prose")
    assert {r.grp for r in timeline.linked_groups(b).collect()} == {0}
    assert [(r.region, r.n) for r in timeline.bubbles(b).collect()] == [(0, 3000)]
    assert len(made) == 2 and sum(made) <= 6000

def test_rows_by_their_middles(spark):
    b = [(1, 0, 50.0, 0.0, 60.0, 10.0), (1, 1, 0.0, 3.0, 10.0, 13.0), (1, 2, 20.0, 8.0, 30.0, 18.0), (1, 3, 0.0, 30.0, 5.0, 40.0)]
    df = spark.createDataFrame(b, "image long, id long, x0 double, y0 double, x1 double, y1 double")
    # box 2 is 6.5 below the grown row's middle, more than 0.6 of its height
    assert [r.id for r in timeline.reading_order(df).orderBy("rank").collect()] == [1, 0, 2, 3]
    assert [r.id for r in timeline.reading_order(df, True).orderBy("rank").collect()] == [0, 1, 2, 3]


def test_voice_segments_and_limits():
    v, out = speech.VoiceSegments(), []
    for i in range(400):
        out += v.add(i * 16, 50 <= i < 150 or 250 <= i < 253)
    onset = 56 * 16  # six frames are 96 ms of voice
    assert out == [(onset - 500, (150 + 57) * 16)]  # 57 frames are 912 ms of silence
    v = speech.VoiceSegments()
    assert [x for i in range(4000) for x in v.add(i * 16, True)][0] == (0, 30000)
    limit = speech.Limit()
    assert limit.add(False) == 4
    assert [limit.add(True) for _ in range(12)][-1] == 5
    c = speech.Cooldown()
    c.add("a", 0)
    assert c.pick(["a", "b"], 1) == "b" and c.pick(["a"], 1) is None and c.pick(["a"], 601) == "a"
    f = speech.NoiseFloor()
    assert [f.add(e) for e in (0.01, 0.05, 0.025, 0.01)] == [False, True, True, False]


def test_agreement_commits_everything_once():
    a = speech.Agreement()
    grown = ("The cat sat.", "The cat sat. It", "Well, the cat sat. It was glad", "Well, the cat sat, it was glad.", "Well, the cat sat, it was glad. And")
    out = [a.add(t, f) for t, f in zip(grown, (False, False, False, False, True), strict=True)]
    assert out == [[], ["The cat sat."], [], [], ["it was glad.", "And"]]
    a = speech.Agreement("so we went", "")
    assert a.tail("so we went on") == " on" and a.tail("Oh, so we went, home") == "home" and a.tail("entirely other words") == "ther words"


def test_stream_equals_batch(spark, tmp_path):
    """Each file holds both keys' next hypotheses; the stream takes a file a time and gives what the batch gives."""
    schema = "key long, n long, text string, final boolean"
    grown = ("So we go. And", "So we go. And on", "So we go. And on we go. For", "So we go. And on we go. For ever.")
    for i, t in enumerate(grown):
        spark.createDataFrame([(k, i, t, i == 3) for k in (1, 2)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = speech.stateful(stream, "key", "n", speech.Agreement, speech.commit_step, speech.COMMIT)
    q = got.writeStream.format("memory").queryName("committed").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(100)
    finally:
        q.stop()
    want = speech.commits(spark.read.schema(schema).parquet(str(tmp_path / "in")))
    joined = lambda df: {k: [r.text for r in sorted(df, key=lambda r: r.n) if r.key == k] for k in (1, 2)}
    assert joined(want.collect()) == {k: ["So we go.", "And on we go.", "For ever."] for k in (1, 2)}
    assert joined(spark.table("committed").collect()).keys() == {1, 2}
