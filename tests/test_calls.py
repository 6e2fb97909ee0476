"""The batch call: rounds, memory, resuming, and what a stopped run finds again."""

import pytest
from pyspark.sql import functions as F
from textloom.functions import text as X
from textloom.operators import calls, records, segments, terms

SCHEMA = "doc_id long, count_split long, value string"


def chunks(spark, n=12):
    return spark.createDataFrame([(i % 3, i, f"text number {i} of %s") for i in range(n)] + [(0, 100, "  "), (1, None, "no id")], SCHEMA)


def test_rounds_shrink_and_end_one_by_one(spark):
    """A model that answers only requests of a single item: batches fail until the last round."""
    alone = lambda request: F.when(F.size(F.from_json(request, "map<string,string>")) == 1, calls.stand_in(request)).otherwise(F.lit("busy"))
    got = {r.count_split: r for r in calls.translate(chunks(spark), "en", "de", alone, 4096, 2).collect()}
    assert set(got) == set(range(12)) and all(r.outcome == "translated" and r.translated == f"[T]text number {i} of %s" for i, r in got.items())


def test_tokens_are_masked_before_the_call_and_back_after(spark):
    seen = calls.requests(chunks(spark), 4096).select("request").collect()
    assert seen and all("%s" not in r.request and calls.OPEN in r.request for r in seen)
    upper = lambda request: F.to_json(F.transform_values(F.from_json(request, "map<string,string>"), lambda _, v: F.upper(v)))
    got = calls.translate(chunks(spark).where("count_split < 100").withColumn("value", F.concat(F.lit("Ä "), "value")), "zh", "de", upper, 4096, 1).collect()
    assert all(r.translated.endswith("OF %s") for r in got)


def test_memory_serves_whole_batches_only(spark):
    known = spark.createDataFrame([(f"text number {i} of %s", f"memory {i} of %s") for i in range(12) if i % 3 != 1], "src string, dst string")
    memory = known.select(X.cache_key(F.lit("s"), F.col("src")).alias("key"), "dst")
    got = {r.count_split: r.translated for r in calls.translate(chunks(spark), "en", "de", budget=4096, retries=1, memory=memory, signature="s").collect()}
    assert all(got[i] == (f"[T]text number {i} of %s" if i % 3 == 1 else f"memory {i} of %s") for i in range(12)) and len(got) == 12


def test_only_valid_results_enter_the_memory(spark):
    rows = spark.createDataFrame([("a", "b", "translated"), ("c", "c", "translated"), ("d", "x", "needs_review"), ("e", "e", "failed")], "original string, translated string, outcome string")
    kept = calls.validated(rows, "s", F.lit(1))
    assert [r.src for r in terms.upsert(kept.limit(0), kept).collect()] == ["a"]


def test_a_run_goes_on_where_it_stopped(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Some words here.\n\n12345\nMore words there."), (2, "Some words here."), (3, "")], "doc_id long, text string")
    path, made = f"file://{tmp_path}/run", []

    def broken(request):
        made.append(1)
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError, match="stopped"):
        calls.translate_documents(spark, docs, path, "en", "de", broken)
    assert sorted(p.name for p in (tmp_path / "run").iterdir()) == ["chunks", "distinct", "map"]
    got = {r.doc_id: r.text for r in calls.translate_documents(spark, docs, path, "en", "de").collect()}
    assert got == {1: "[T]Some words here.\n\n12345\n[T]More words there.", 2: "[T]Some words here.", 3: ""}
    # a finished run calls no model again
    assert {r.doc_id: r.text for r in calls.translate_documents(spark, docs, path, "en", "de", broken).collect()} == got and len(made) == 1


def test_a_stage_that_broke_off_is_made_again(spark, tmp_path):
    path = f"file://{tmp_path}"
    calls.stage(spark, path, "s", lambda: spark.range(3))
    (tmp_path / "s" / "_SUCCESS").unlink()
    assert calls.stage(spark, path, "s", lambda: spark.range(5)).count() == 5
    assert calls.stage(spark, path, "s", lambda: spark.range(9)).count() == 5


def test_recent_context_keeps_what_fits():
    machine = calls.Recent(10)
    rows = [(["a a", "b b", "x", "c c", "d d"], [4, 4, 1, 4, 4]), ([], []), (["far too long"], [99]), (["one", "two"], [9, 5]), (["e"], [1])]
    assert [machine.add(1, i, t, c)[0][2] for i, (t, c) in enumerate(rows)] == [[], ["c c", "d d"], ["c c", "d d"], ["c c", "d d"], ["two"]]


def test_guards_of_edited_tables(spark):
    table = spark.createDataFrame([(0, 7, "a"), (1, 8, "b")], "ord int, count_src int, translated string")
    change = lambda rows: records.edited(table, spark.createDataFrame(rows, "ord int, count_src int, translated string"))
    out, n = change([(0, 7, "x"), (1, 8, None)])
    assert n == 2 and sorted(r.translated for r in out.collect()) == ["", "x"]
    for bad in ([(0, 7, "x")], [(0, 8, "x"), (1, 7, "y")], [(0, 7, "x"), (1, 8, "y"), (2, 9, "z")], [(0, 7, " "), (1, 8, None)]):
        with pytest.raises(ValueError, match=r"match|lose"):
            change(bad)


def test_tracks_by_number_language_and_volume(spark):
    rows = [("f", 0, "en", -30.0), ("f", 1, "ja", -20.0), ("f", 2, "jpn", -20.0), ("g", 0, None, None), ("g", 1, "en", None), ("one", 0, "en", -1.0)]
    t = spark.createDataFrame(rows, "file string, track int, lang string, volume double")
    pick = lambda w: {r.file: r.track for r in records.loudest(t, w).collect()}
    assert pick("auto") == {"f": 1, "g": 0} and pick("2") == {"f": 2, "g": 0} and pick("en") == {"f": 0, "g": 1} and pick("fr") == {"f": 1, "g": 0}


def test_marks_and_reports(spark):
    c = spark.createDataFrame([(i, str(i)) for i in range(4)], "count_split long, value string")
    assert {r.count_split for r in segments.unfinished(segments.marked(c, c.where("count_split < 2"))).collect()} == {2, 3}
    assert sorted((r.count_split, r.value) for r in segments.first_reports(c.limit(1), spark.createDataFrame([(0, "z"), (9, "b"), (9, "a"), (None, "n")], c.schema), "count_split").collect()) == [(0, "0"), (9, "a")]


def test_a_run_can_be_watched_and_stopped(spark):
    import threading
    import time

    from textloom.operators import control

    ended: list = []

    def work():
        with control.job_group(spark, "slow", "a run"):
            try:
                slow = F.udf(lambda i: time.sleep(0.2) or i, "long")
                spark.range(0, 4000, 1, 16).select(slow("id")).write.format("noop").mode("overwrite").save()
                ended.append("done")
            except Exception:
                ended.append("stopped")

    t = threading.Thread(target=work)
    t.start()
    time.sleep(4)
    assert 0 <= control.progress(spark, "slow") < 1
    control.stop(spark, "slow")
    t.join(30)
    assert ended == ["stopped"] and control.progress(spark, "slow") == 1.0


def test_glossary_files_have_guards(spark, tmp_path):
    from textloom.sources import glossaries

    folder = f"file://{tmp_path}"
    glossaries.write(spark, folder, "Default", ["en", "日本語", "de"], [["a", "あ", "A"], ["b", "", "B"], ["q\"x", "く", "Q,\n"]])
    terms_ = lambda s, d: sorted((r.src, r.dst) for r in glossaries.scan(spark, folder, s, d).collect())
    assert terms_("en", "ja") == [("a", "あ"), ('q"x', "く")] and terms_("auto", "English") == [("A", "a"), ("B", "b"), ("Q,", 'q"x')] or terms_("auto", "English")[0] == ("あ", "a")
    assert terms_("en", "fr") == []
    with pytest.raises(FileExistsError):
        glossaries.write(spark, folder, "Default", ["en"], [], new=True)
    with pytest.raises(ValueError, match="empty"):
        glossaries.write(spark, folder, "Default", ["en", "de"], [])
    for bad in ("a/b", " ", 'x"'):
        with pytest.raises(ValueError, match="name"):
            glossaries.write(spark, folder, bad, ["en"], [])
    with pytest.raises(ValueError, match="stays"):
        glossaries.delete(spark, folder, "Default")
    glossaries.write(spark, folder, "Mine", ["en"], [], new=True)
    glossaries.delete(spark, folder, "Mine")
    with pytest.raises(FileNotFoundError):
        glossaries.delete(spark, folder, "Mine")
