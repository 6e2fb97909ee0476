"""Recognised speech and captions: clean-up, loops, phrases that silence is heard as, bilingual markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import text as X

# Signs that recognisers write for sounds; whole segments that they write for silence or music, by language
# (`*`: any); characters that make a caption worth showing.
SOUNDS = "😊😔😡😐🤢😱🎼👏😀😄😭🤧😷🤔🥱🎤🎶❓♪♫♬♩🎵🎧🎙🥁"
PHRASES = {
    "ja": ("ご視聴ありがとうございました", "ご視聴ありがとうございます", "最後までご視聴いただきありがとうございました", "チャンネル登録お願いします", "チャンネル登録をお願いします", "次の動画でお会いしましょう"),
    "en": ("thank you for watching", "thanks for watching", "please subscribe", "please subscribe to my channel", "subscribe to my channel", "subtitles by the amara.org community", "thank you"),
    "ko": ("시청해주셔서 감사합니다", "구독과 좋아요 부탁드립니다"),
    "zh": ("感谢观看", "感谢收看", "请订阅", "谢谢观看"),
    "*": ("♪", "♪♪", "♪♪♪", "[音楽]", "[music]", "(music)"),
}
WORDLIKE = r"[0-9A-Za-z\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}\x{0400}-\x{04ff}\x{0e00}-\x{0e7f}]"


def without_loops(c: Column, most: int = 8) -> Column:
    """A text whose repeated words are cut to `most` in a row, words being the same without the marks behind them and in any
    case; texts of no more words than that, and those without such a run, stay as they are."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    bare = lambda w: F.lower(F.regexp_replace(w, r"[,，、.。!！?？…\-]+$", ""))
    # run[i]: how many equal words end at i
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, w: Column) -> Column:
        n = F.when((bare(w) != "") & (bare(w) == s["last"]), s["n"] + 1).otherwise(F.lit(1))
        return F.struct(bare(w).alias("last"), n.alias("n"), F.when(n > most, s["out"]).otherwise(F.concat(s["out"], F.array(w))).alias("out"))

    cut = lambda w: F.aggregate(w, start, step)["out"]
    whole = lambda w, out: F.when(F.size(out) == F.size(w), c).otherwise(F.array_join(out, " "))
    return F.when(F.size(words) <= most, c).otherwise(F.element_at(F.transform(F.array(cut(words)), lambda out: whole(words, out)), 1))


def clean_speech(c: Column) -> Column:
    """Recognised text without tags, signs for sounds and loops."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"<\|[^|]*\|>", "")
    t = X.trim_u(F.regexp_replace(F.regexp_replace(t, f"[{SOUNDS}]", ""), f"{X.WHITE}{{2,}}", " "))
    return without_loops(X.collapse_repeats(t))


def phrase_form(c: Column) -> Column:
    return F.rtrim(F.regexp_replace(F.lower(X.trim_u(F.coalesce(c, F.lit("")))), f"{X.WHITE}+", " "), F.lit("。.!！?？ "))


def is_heard_silence(c: Column, lang: Column) -> Column:
    """Whether a whole segment is one of the phrases of its language, of the language without its region, or of any."""
    base = F.split(F.coalesce(lang, F.lit("")), "-")[0]
    form = phrase_form(c)
    marks = [F.when((F.lit(k == "*") | (lang == k) | (base == k)) & form.isin(*sorted(v)), True) for k, v in PHRASES.items()]
    return F.coalesce(*marks, F.lit(False))


def worth_showing(c: Column) -> Column:
    """Whether a caption has a character of a word."""
    return F.coalesce(X.trim_u(c).rlike(WORDLIKE), F.lit(False))


def styled(c: Column, family: str, bold: bool = True, color: str = "") -> Column:
    """A text in the markup of a family of formats, color as six hexadecimal digits; VTT takes bold only."""
    wrap = lambda a, x, b: F.concat(F.lit(a), x, F.lit(b))
    t = c
    if color and family != "vtt":
        t = wrap(f'<font color="#{color}">', t, "</font>") if family == "srt" else wrap(f'<span style="color:#{color}">', t, "</span>")
    if bold:
        t = wrap("**", t, "**") if family == "md" else wrap("<b>", t, "</b>")
    return F.when(c == "", c).otherwise(t)


def both(original: Column, translated: Column, family: str, bold: bool = True, color: str = "") -> Column:
    """Two texts in the place of one, or one where they are the same: subtitles show the translation first, sheet names put
    it in brackets, all others below the original."""
    o, t = (F.replace(F.replace(c, F.lit("␊"), F.lit("\n")), F.lit("␍"), F.lit("\r")) for c in (original, translated))
    same = X.trim_u(o) == X.trim_u(t)
    if family == "sheet_name":
        two = F.concat(o, F.lit(" ("), t, F.lit(")"))
    elif family in ("srt", "vtt"):
        two = F.concat(styled(t, family, bold, color), F.lit("\n"), o)
    elif family in ("html", "epub", "md"):
        two = F.concat(o, F.lit("\n"), styled(t, family, bold, color))
    else:
        two = F.concat(o, F.lit("\n"), t)
    return F.when(same, o).otherwise(two)


def sheet_name(c: Column) -> Column:
    """A name that a workbook takes: no reserved characters, 31 at most, never blank."""
    t = F.substring(F.regexp_replace(c, r"[/\\?*\[\]:]", "-"), 1, 31)
    return F.when(X.trim_u(t) == "", "Sheet").otherwise(t)
