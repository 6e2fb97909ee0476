import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from textloom.functions import tokens as K


@pytest.mark.parametrize("text, want", [("Hi %s and %1$d of 100%", ["%s", "%1$d"]), ("${HOME}/$USER", ["${HOME}", "$USER"]), ("{n, plural, one {# item} other {# items}} x", ["{n, plural, one {# item} other {# items}}"]), ("{{HLINK_1}} stays {0}", ["{0}"]), ("{ } {", ["{ }"]), ("100%% {!x} 50% off $2", ["%%", "{!x}"]), ("{a}} {{b} {c", [])])
def test_tokens_and_masks(text, want):
    assert [text[a:b] for a, b in K.token_spans(text)] == want
    masked, kept = K.mask(text)
    assert list(kept.values()) == want and not any(w in masked for w in want)
    assert K.unmask(masked, kept) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab%s$d{}n 1#", max_size=40))
def test_masking_is_undone(text):
    masked, kept = K.mask(text)
    assert K.unmask(masked, kept) == text


def test_unknown_and_repeated_marks():
    assert K.unmask(f"{K.OPEN}0{K.SHUT} {K.OPEN}0{K.SHUT} {K.OPEN}9{K.SHUT}", {0: "%s"}) == f"%s %s {K.OPEN}9{K.SHUT}"


def test_replies():
    assert K.merged_json('x {"1": "a}", "2": "b",} y {"2": "c"} {bad}') == {"1": "a}", "2": "c"}
    assert K.term_list('so: [["a", "b"], {"src": "c", "dst": "d"}, {"source": "e", "target": "f"}, ["same", "same"], ["x"], 3] end') == [("a", "b"), ("c", "d"), ("e", "f")]
    assert K.term_list("junk") == []


def test_forms_and_ratios():
    assert K.compatible(" ＡＢＣ ") == "abc" and K.compatible("Straße") == "strasse"
    assert K.repetition_ratio("na " * 200) > 4 > K.repetition_ratio("Some ordinary prose with words that differ from each other.")


def test_cues_are_cut_at_sense_and_keep_their_text():
    got = K.split_cue(0.0, 9.0, "One sentence here. Another sentence there, and a clause.")
    assert [t for _, _, t in got] == ["One sentence here.", "Another sentence there, and a clause."]
    assert got[0][0] == 0.0 and got[-1][1] == 9.0 and got[0][1] == got[1][0]
    assert K.split_cue(0.0, 3.0, "short") == [(0.0, 3.0, "short")]
    assert len(K.split_cue(0.0, 2.0, "Too many words to read. In so little time as this.", fastest=10.0)) > 1
    words = [(0.5 * i, 0.5 * i + 0.5, w + " ") for i, w in enumerate("Hello there friend. This is a long sentence that should be split now.".split())]
    got = K.split_cue(0.0, 12.0, "".join(w for _, _, w in words), words=words)
    assert got[0] == (0.0, 1.5, "Hello there friend.") and all(a < b for a, b, _ in got)
    assert K.split_cue(0.0, 90.0, "nowheretocutthis") == [(0.0, 90.0, "nowheretocutthis")]


def test_units_wait_for_more():
    text = "Short. This is a second sentence. And this one goes on for a while, then it does not stop but goes on"
    some, used = K.units(text, False)
    assert some == ["Short.", "This is a second sentence.", "And this one goes on for a while,"] and text[used:] == " then it does not stop but goes on"
    assert K.units(text[used:], True)[0] == ["then it does not stop but goes on"]
    assert K.units("x" * 100, False) == (["x" * 88], 88) and K.units("x" * 50, False) == ([], 0)
    assert K.units("这句话很长很长很长很长很长但是没有标点符号的时候也要断开来看看行不行呢", False)[0] == ["这句话很长很长很长很长很长"]


def test_dates_headers_and_samples():
    assert K.english_dates("2024年3月5日 and 2023-12 and 9999-01-01") == "March 05, 2024 and December 2023 and 9999-01-01"
    assert K.header_parts('&L&"Arial"Title &P') == [("code", "&L"), ("code", '&"Arial"'), ("text", "Title "), ("code", "&P")]
    assert K.sample(["a" * 9000, "b" * 9000, "c" * 9000]).count("…") == 2 and len(K.sample(["x" * 20000])) == 9006 and K.sample(["a", "", "b"]) == "a\nb"


def test_audio_and_budgets():
    pcm = (np.sin(np.arange(1600) / 10) * 20000).astype("<i2").tobytes()
    x = K.mono(pcm)
    assert len(K.resampled(x, 16000, 8000)) == 800 and 0.3 < K.energy(x) < 0.6
    assert K.removable({"a": {"x", "y"}, "b": {"y"}}, "a") == {"x"}
    assert [K.retry_budget(4096, i) for i in range(5)] == [2048, 1024, 512, 256, 256]


def test_as_columns(spark):
    df = spark.createDataFrame([(1, "a %s"), (2, None)], "i int, t string").orderBy("i")
    names = K.arrow(lambda t: [t[a:b] for a, b in K.token_spans(t)], "array<string>")
    assert [r[0] for r in df.select(names(F.col("t"))).collect()] == [["%s"], None]
