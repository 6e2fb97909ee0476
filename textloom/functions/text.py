"""Column expressions over segment texts. They are native but for two that fall back to Arrow batches where a cheap test
asks for it: balanced braces (machine_tokens) and compression ratios (repeated)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space that str.strip() removes, as characters and as a class; the scripts' character ranges.
WHITE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WHITE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WIDE = r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{ff00}-\x{ffef}]"
SCRIPTS = {
    "zh": r"[\x{4e00}-\x{9fff}]",
    "zh-Hant": r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]",
    "ja": r"[\x{3040}-\x{30ff}\x{4e00}-\x{9faf}]",
    "ko": r"[\x{ac00}-\x{d7af}\x{1100}-\x{11ff}]",
    "ru": r"[\x{0400}-\x{04ff}]",
    "th": r"[\x{0e00}-\x{0e7f}]",
    "vi": r"[\x{00c0}-\x{1ef9}]",
}
CHECKED = ("zh", "zh-Hant", "ja", "ko", "ru", "th")  #: target languages whose script a translation must show

# What the filter takes for no prose: times, units, top-level domains, and patterns of codes and addresses.
TIME = r"^\d{1,2}:\d{2}(:\d{2})?\s*(AM|PM|am|pm)$"
_UNITS = (
    "mm|cm|dm|m|km|in|ft|yd|mi|mil|mg|g|kg|t|oz|lb|ton|lbs|ml|cl|dl|l|kl|fl\\s?oz|gal|pt|qt|cup|(mm|cm|m|km|in|ft|yd|mi)[²³]|ha|"
    "b|kb|mb|gb|tb|pb|hz|khz|mhz|ghz|thz|v|mv|kv|volt|volts|w|kw|mw|gw|watt|watts|°[cfk]|celsius|fahrenheit|kelvin|"
    "px|em|rem|ex|ch|vh|vw|vmin|vmax|rpm|bpm|ppm|dpi|fps|pa|kpa|mpa|gpa|psi|bar|atm|torr"
)
_TLD = "com|org|net|edu|gov|mil|int|co|io|me|tv|info|biz|name|pro|museum|aero|coop|[a-z]{2}"
_HEX = "[0-9a-f]"
#: What is no prose although it has two letters or more; texts with fewer letters are none anyway. Any letter case.
NO_PROSE = (
    rf"0x{_HEX}+",
    rf"#{_HEX}{{3,8}}",
    rf"\d+(\.\d+)?\s*({_UNITS})",
    r"\d+(\.\d+)?[a-z]{1,4}",
    r"v?\d+(\.\d+){1,3}(-[\p{L}\p{N}_]+)?(\+[\p{L}\p{N}_]+)?",
    r"(build|rev|revision)\s*\d+",
    r"[a-z]{1,4}\d{2,}[a-z]?\d*",
    r"\d{2,}[a-z]{1,4}\d*",
    r"[a-z0-9]{2,}(-[a-z0-9]{2,})+",
    r"[a-z]{2,}-\d{2,}(-[a-z0-9]+)*",
    r"SKU[:\-\s]*[a-z0-9]+",
    r"P/N[:\-\s]*[a-z0-9\-]+",
    rf"\{{?{_HEX}{{8}}-({_HEX}{{4}}-){{3}}{_HEX}{{12}}\}}?",
    rf"{_HEX}{{32}}|{_HEX}{{12}}",
    r"[0-9a-f:]{9,39}",
    rf"{_HEX}{{2}}([:-]{_HEX}{{2}}){{5}}",
    r"(https?|ftp|ftps|file|sftp)://\S+",
    rf"\S+\.({_TLD})([^\p{{L}}\p{{N}}_].*)?",
    r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}",
    r"[a-z0-9_\-.]+\.[a-z0-9]{1,5}",
    r"-?\d+(\.\d+)?°\s*\d+(\.\d+)?'(\s*\d+(\.\d+)?\")?\s*[NS]\s*,?\s*-?\d+(\.\d+)?°\s*\d+(\.\d+)?'(\s*\d+(\.\d+)?\")?\s*[EW]",
    r"-?\d+(\.\d+)?°\s*[NS],?\s*-?\d+(\.\d+)?°\s*[EW]",
    r"[{\[<][^{}\[\]<>]*[}\]>]",
    r"\$\{[^}]*\}",
    r"%[a-z_][a-z0-9_]*%",
    r"\{\{[^}]*\}\}",
    r"<%[^%]*%>",
    r"@[a-z_][a-z0-9_]*@",
    r"[ivxlcdm]{1,10}",
)
#: The same, where upper case matters; the last two look at the beginning only.
NO_PROSE_CASED = (r"\d+[A-Z]-\d+[A-Z]?", r"[A-Z0-9]*\d[A-Z0-9]*", r"[A-Z]{2,3}", r"[A-Z]+(_[A-Z]+)+")
NO_PROSE_START = (r"www\.\S+\.\S+", r"[A-Za-z]:\\", r"/[^/\s]")


def any_of(patterns: tuple[str, ...], flags: str = "") -> str:
    return f"{flags}^(?:{'|'.join(f'(?:{p})' for p in patterns)})$"


#: (pattern, starts only) of everything that is no prose; the same strings serve Java and RE2.
REJECT = (any_of(NO_PROSE, "(?i)"), any_of(NO_PROSE_CASED), f"^(?:{'|'.join(NO_PROSE_START)})", r"(?i)^www\.\S+\.\S+")


def trim_u(c: Column) -> Column:
    """c without white space of any kind at both ends."""
    return F.btrim(c, F.lit(WHITE_CHARS))


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value), with value computed once however often fn uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def count_of(c: Column, cls: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, cls, ""))


def should_translate(c: Column, keep_out: tuple[str, ...] = ()) -> Column:
    """Whether a text holds prose. Blank and listed texts don't, wide characters always do; then times with AM or PM do,
    codes of all kinds don't, and the share of letters decides about the rest. Null is no prose."""

    def judged(t: Column) -> Column:
        letters, others = count_of(t, r"\p{L}"), count_of(t, r"\p{N}")
        no = t == ""
        if keep_out:
            no = no | t.isin(*keep_out)
        codes = t.rlike(REJECT[0]) | t.rlike(REJECT[1]) | t.rlike(REJECT[2]) | t.rlike(REJECT[3])
        # most texts are words: two of them next to each other are settled without counting all letters
        words = t.rlike(r"^\p{L}{2,} \p{L}{2,}") & ~t.rlike(r"\p{N}")
        return (
            F.when(no, False)
            .when(t.rlike(WIDE), True)
            .when(t.rlike(TIME), True)
            .when(~words & (letters < 2), False)
            .when(codes, False)
            .when(words, True)
            .when(letters >= 0.6 * (letters + others), True)
            .otherwise((F.length(t) > 8) & (letters >= 3))
        )

    return let(trim_u(F.coalesce(c, F.lit(""))), judged)


def has_script(c: Column, lang: str) -> Column:
    """Whether a text shows the script of a language; false for languages in Latin letters."""
    return c.rlike(SCRIPTS[lang]) if lang in SCRIPTS else F.lit(False)


def cells(c: Column) -> Column:
    """Display width: wide characters take two cells."""
    return F.length(c) + count_of(c, r"[\x{3000}-\x{9fff}\x{ff00}-\x{ffef}]")


def cue_seconds(c: Column) -> Column:
    """Seconds of HH:MM:SS,mmm (or a dot), null if it doesn't begin like that."""
    t = trim_u(c)
    p = r"^(\d{1,2}):(\d{2}):(\d{2})[,.](\d{1,3})"
    g = lambda i: F.regexp_extract(t, p, i).cast("double")
    return F.when(t.rlike(p), g(1) * 3600 + g(2) * 60 + g(3) + g(4) / 1000)


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm, rounded to milliseconds first."""
    ms = F.round(seconds * 1000).cast("long")
    part = lambda x, n: F.lpad(F.floor(x).cast("string"), n, "0")
    return F.concat(part(ms / 3600000, 2), F.lit(":"), part((ms / 60000) % 60, 2), F.lit(":"), part((ms / 1000) % 60, 2), F.lit(","), part(ms % 1000, 3))


STRUCTURAL = r"\{\{[^}]+\}\}|\[formula_\d+\]|[␊␍]"
SENTINEL = r"\x{e002}\d+\x{e003}"
LOOSE = r"\{\{.*?\}\}|\$\{[^}]*\}|%\d+\$[a-zA-Z]|%[sdfgSDFG]|\{[^{}]*\}"
# Printf and shell tokens; single braces, which may nest, are functions.tokens.brace_spans'.
PRINTF = r"%(?:%|(?:\d+\$)?[-+0#]*\d*(?:\.\d+)?[diouxXeEfFgGaAcspn])"
SHELL = r"\$\{[A-Za-z_][\p{L}\p{N}_]*\}|\$[A-Za-z_][\p{L}\p{N}_]*"


def tokens(c: Column, pattern: str) -> Column:
    """The multiset of a pattern's matches: a sorted array, empty for null."""
    return F.array_sort(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0)))


def machine_tokens(c: Column) -> Column:
    """The multiset of printf, shell and single-brace tokens, leftmost and longest first: a sorted array, empty for null.
    Only texts with a brace leave the JVM."""
    from textloom.functions.tokens import arrow, machine_parts

    t = F.coalesce(c, F.lit(""))
    braced = t.contains("{")
    with_braces = arrow(machine_parts, "array<string>")(F.when(braced, t))
    return F.array_sort(F.when(braced, with_braces).otherwise(F.regexp_extract_all(t, F.lit(f"{PRINTF}|{SHELL}"), F.lit(0))))


def same_tokens(a: Column, b: Column, *patterns: str) -> Column:
    out = F.lit(True)
    for p in patterns:
        out = out & (tokens(a, p) == tokens(b, p))
    return out


def same_machine_tokens(a: Column, b: Column) -> Column:
    """Whether two texts have the same machine tokens; texts without a percent, dollar or brace have none."""
    marks = r"[%$\{]"
    some = F.coalesce(a, F.lit("")).rlike(marks) | F.coalesce(b, F.lit("")).rlike(marks)
    return ~some | (machine_tokens(F.when(some, a)) == machine_tokens(F.when(some, b)))


def fold_case(c: Column) -> Column:
    """Lower case, and one form for the letters that have two of them: long and sharp s, sigma at the end of a word."""
    return F.replace(F.translate(F.lower(c), "ſς", "sσ"), F.lit("ß"), F.lit("ss"))


def normalized(c: Column) -> Column:
    return fold_case(F.regexp_replace(trim_u(c), f"{WHITE}+", " "))


def repeated(original: Column, translated: Column) -> Column:
    """A run-away repetition: 40 characters or more, far longer than the source, and over four bytes for each that zlib
    needs. Only texts of such a length leave the JVM."""
    from textloom.functions.tokens import arrow, repetition_ratio

    t = trim_u(F.coalesce(translated, F.lit("")))
    long = (F.length(t) >= 40) & (F.length(t) > 2 * F.length(F.coalesce(original, F.lit(""))) + 40)
    return long & F.coalesce(arrow(repetition_ratio, "double")(F.when(long, t)) > 4.0, F.lit(False))


def structure_kept(original: Column, translated: Column) -> Column:
    """Placeholders, machine tokens and inline marks are the same: what breaks this must never be written."""
    return same_tokens(original, translated, STRUCTURAL, SENTINEL) & same_machine_tokens(original, translated)


def translation_valid(original: Column, translated: Column, src: str, dst: str) -> Column:
    """The checks of a translated text in their order: blank, tokens, repetition, nothing to translate, echo, script."""
    o, t = F.coalesce(original, F.lit("")), F.coalesce(translated, F.lit(""))
    echo = F.lit(src in CHECKED) & ~has_script(t, src)
    whole = trim_u(o)
    return (
        F.when(trim_u(t) == "", False)
        .when(~(same_tokens(o, t, STRUCTURAL) & same_machine_tokens(o, t)), False)
        .when(repeated(o, t), False)
        .when(~o.rlike(r"\p{L}"), True)
        .when(whole.rlike(r"(?i)^(?:https?://|ftp://|mailto:|www\.)\S+$") | whole.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), True)
        .when(normalized(o) == normalized(t), echo)
        .otherwise(has_script(t, dst) if dst in CHECKED else F.lit(True))
    )


def to_int_tolerant(c: Column) -> Column:
    """An integer out of digits, circled digits to 50, Roman numerals to XX, Chinese digits in both forms, else the first
    digits, else 0."""
    t = trim_u(c.cast("string"))
    roman = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV", "XVI", "XVII", "XVIII", "XIX", "XX"]
    circled = [*range(0x2460, 0x2474), *range(0x3251, 0x3260), *range(0x32B1, 0x32C0)]
    fixed = {**{chr(c): i + 1 for i, c in enumerate(circled)}, **{z: i + 1 for i, z in enumerate("壹贰叁肆伍陆柒捌玖拾")}, **{r: i + 1 for i, r in enumerate(roman)}, **{z: i for i, z in enumerate("零一二三四五六七八九十")}}
    named = F.create_map(*[F.lit(x) for kv in fixed.items() for x in kv])
    return F.coalesce(t.try_cast("int"), F.try_element_at(named, F.upper(t)), F.regexp_extract(t, r"\d+", 0).try_cast("int"), F.lit(0))


def replace_all(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Literal replacements, each on what the one before has left."""
    for a, b in rules:
        if a:
            c = F.replace(c, F.lit(a), F.lit(b))
    return c


def safe_cell(c: Column) -> Column:
    """A spreadsheet cell: no control characters, and a space before what a program would take as a formula."""
    t = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    return F.when(F.substring(t, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit(" "), t)).otherwise(t)


def plain_text(c: Column) -> Column:
    """Text without link and inline markers; what links enclose stays."""
    return F.regexp_replace(F.regexp_replace(c, r"\{\{HLINK_(\d+)\}\}(.*?)\{\{/HLINK_\d+\}\}", "$2"), r"\{\{INLINE_\d+\}\}", "")


def token_count(c: Column) -> Column:
    """Words, single digits and runs of symbols: a stand-in for a vocabulary's count."""
    return F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"), F.lit(0)))


def sentences(c: Column) -> Column:
    """Sentences with the quotes and spaces that follow their end marks."""
    return F.regexp_extract_all(c, F.lit(r"""[^.!?;。！？；\n]*[.!?;。！？；\n]["'”’」』）)]* *|[^.!?;。！？；\n]+$"""), F.lit(0))


def collapse_repeats(c: Column) -> Column:
    """Units of up to 12 characters that stand ten times or more in a row, cut to four."""
    return F.regexp_replace(c, r"(.{1,12}?)\1{9,}", "$1$1$1$1")


def join_chunks(parts: Column) -> Column:
    """Texts in order, a space between where neither side has white space or East Asian characters."""
    tight = rf"(?:{WHITE}|[\x{{3000}}-\x{{303f}}\x{{3040}}-\x{{30ff}}\x{{3400}}-\x{{9fff}}\x{{ff00}}-\x{{ffef}}])"
    return F.aggregate(parts, F.lit(""), lambda a, p: F.when((a == "") | (p == "") | a.rlike(f"{tight}$") | p.rlike(f"^{tight}"), F.concat(a, p)).otherwise(F.concat(a, F.lit(" "), p)))


def clean_json(c: Column) -> Column:
    """A model's reply as JSON: no fence, no mark at the start, no trailing commas, from the first { to the last }."""
    t = F.regexp_replace(trim_u(c), r"(?s)^\x{feff}?```(?:json)?\s*|\s*```$", "")
    t = F.coalesce(F.nullif(F.regexp_extract(t, r"(?s)\{.*\}", 0), F.lit("")), t)
    return F.regexp_replace(t, r",\s*([}\]])", "$1")


def reply_items(c: Column) -> Column:
    """map<string,string> of a reply, null where it is no JSON object."""
    return F.from_json(clean_json(c), "map<string,string>")


def plain_reply(c: Column) -> Column:
    """One text out of a reply: by the usual keys, else the first value, else the reply as it stands."""
    m = reply_items(c)
    keys = [F.try_element_at(m, F.lit(k)) for k in ("translated_text", "translation", "text", "1")]
    return F.coalesce(*keys, F.try_element_at(F.map_values(m), F.lit(1)), c)


def without_reasoning(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<think>.*?</think>", "")


def cache_key(signature: Column, text: Column) -> Column:
    return F.sha1(F.concat(signature, F.lit("\x00"), text).cast("binary"))


def duration(seconds: Column) -> Column:
    """1h 2m 3s, 2m 3s or 3s; parts that are nought are left out but the only one."""
    s = seconds.cast("long")
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit)))
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat_ws(" ", part(h, "h"), part(m, "m"), part(r, "s")))


def short_count(n: Column) -> Column:
    """A number of tokens, from a thousand on in K with one decimal; null is 0. Halves go the way that the double nearest to
    the thousands does, as printf has it, exact ones to the even side."""
    # the double as a whole number of 2^-52, or 2^-42 from two thousand on, beside the decimal
    wide = lambda c: c.cast("long").cast("decimal(20,0)")
    scale = F.when(n < 2_000_000, float(1 << 52)).otherwise(float(1 << 42))
    lean = wide(n / F.lit(1000.0) * scale) * 1000 - wide(n) * wide(scale)
    tenths, rest = F.floor(n / 100), n % 100
    up = (rest > 50) | ((rest == 50) & ((lean > 0) | ((lean == 0) & (tenths % 2 == 1))))
    shown = tenths + up.cast("int")
    return F.when(n >= 1000, F.concat(F.floor(shown / 10).cast("string"), F.lit("."), (shown % 10).cast("string"), F.lit("K"))).otherwise(F.coalesce(n, F.lit(0)).cast("string"))


def version_parts(c: Column) -> Column:
    """Numbers of a version, compared like arrays; what is no number counts as 0."""
    return F.transform(F.split(F.regexp_replace(c, "^[vV]", ""), r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def file_type(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"\.([^./]+)$", 1))


def result_name(name: Column, src: str, dst: str) -> Column:
    return F.concat(F.regexp_replace(name, r"\.[^./]*$", ""), F.lit(f"_{src}2{dst}"), F.regexp_extract(name, r"\.[^./]*$", 0))


# Kinds of failure by HTTP status; then by what the message says, the first that fits.
STATUS_KINDS = {429: "rate_limit", 413: "too_large", 400: "invalid_request", 404: "invalid_request", 422: "invalid_request", 401: "hard", 402: "hard", 403: "hard", 500: "server", 502: "server", 503: "server", 504: "server"}
MESSAGE_KINDS = (
    ("timeout", "timed out|timeout"),
    ("rate_limit", "rate limit|429|too many requests"),
    ("too_large", "413|request entity too large|payload too large"),
    ("server", "500|502|503|internal server error|service unavailable|overloaded|bad gateway"),
    ("hard", "unauthorized|401|invalid api key|invalid_api_key|incorrect api key|authentication fails|403|forbidden|insufficient|quota|402"),
    ("invalid_request", "400|422|invalid_request|unprocessable|bad request"),
    ("connection", "connection|network"),
)
FATAL_KINDS = (("insufficient_balance", "402|insufficient|quota"), ("invalid_key", "401|403|unauthorized|forbidden|api key|invalid_api_key|authentication"))


def _by_message(c: Column, kinds: tuple, other: str) -> Column:
    m = F.lower(F.coalesce(c, F.lit("")))
    return F.coalesce(*[F.when(m.rlike(p), F.lit(k)) for k, p in kinds], F.lit(other))


def error_class(message: Column, status: Column | None = None) -> Column:
    """Kind of a service's failure: by its status where it has one that says so, else by its message."""
    said = _by_message(message, MESSAGE_KINDS, "unknown")
    if status is None:
        return said
    named = F.create_map(*[F.lit(x) for kv in STATUS_KINDS.items() for x in kv])
    return F.coalesce(F.try_element_at(named, status.cast("int")), said)


def fatal_class(message: Column) -> Column:
    """What a failure that no retry mends is called."""
    return _by_message(message, FATAL_KINDS, "api_error")


#: What looks like a date as a whole; a text that begins like a section number.
DATE_FORM = r"^(?:\d{4}([./-])\d{1,2}\1\d{1,2}|\d{1,2}([./-])\d{1,2}\2\d{4}|\d{1,2}\.\d{1,2}\.\d{2}|\d{4}\.\d{1,2}|\d{1,2}\.\d{4})$"
SECTION_FORM = r"^\d+(?:\.\d+)+(?:\s|$|[\p{L}\p{N}_])"


def without_numbering(c: Column, numbered: Column | bool = True) -> Column:
    """A paragraph that is numbered automatically without a leading bullet, dash or star, if something is left; dates,
    section numbers and typed numbers stay."""
    bullet, dash = F.regexp_replace(c, r"^[•◦‣]\s*", ""), F.regexp_replace(c, r"^[-*]\s+(?=[\p{L}\p{N}_])", "")
    numbered = F.lit(numbered) if isinstance(numbered, bool) else numbered
    stays = ~numbered | trim_u(c).rlike(DATE_FORM) | trim_u(c).rlike(SECTION_FORM)
    return F.when(stays, c).when((bullet != c) & (trim_u(bullet) != ""), bullet).when((dash != c) & (F.length(trim_u(dash)) > 2), dash).otherwise(c)


def is_date(c: Column) -> Column:
    return F.coalesce(trim_u(c).rlike(DATE_FORM), F.lit(False))


def is_section_number(c: Column) -> Column:
    """Whether a text begins like 1.1 or 3.2.1."""
    return F.coalesce(c.rlike(SECTION_FORM), F.lit(False))


def is_page_number(c: Column) -> Column:
    """Whether a text is a page number: digits or a Roman numeral, alone, in brackets, or among dashes and dots."""
    t = trim_u(c)
    number = t.rlike(r"^\d+$") & F.coalesce(t.try_cast("int").between(1, 9999), F.lit(False))
    return F.coalesce(number | t.rlike("(?i)^[ivxlcdm]+$") | t.rlike(r"^(?!\d+$)[-\s.]*\d+[-\s.]*$") | t.rlike(r"^[\(\[{]\s*\d+\s*[\)\]}]$"), F.lit(False))


def is_dot_leader(c: Column) -> Column:
    """Whether over 0.7 of a text's characters, blanks left out, are dots."""
    solid = F.translate(trim_u(c), " \t", "")
    dots = F.length(solid) - F.length(F.translate(solid, ".", ""))
    return F.coalesce((F.length(solid) > 0) & (dots > 0.7 * F.length(solid)), F.lit(False))


#: A line of contents: dots, tabs or many spaces before a page number, or a number right behind a dot.
CONTENTS = (r"\.{3,}\s*\d+$", r".\t{2,}\d+$", r".\t+\s+\d+$", r".\s{5,}\d+$", r".\.\s*\.+\s*\d+$", r"^\d+\.?\d*\s+.+\.{2,}\s*\d+$", r"(?i)^[A-Z][A-ZÁÉÍÓÚÜÑ\s]+\t+\d+$", r".\s*\.\d+$", r".\t+\.{2,}\s*\d+$")


def is_contents_line(c: Column) -> Column:
    """Whether a text is a line of contents; something has to be left without the number and the dots."""
    t = trim_u(c)
    title = trim_u(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\s*\.\d+\s*$", ""), r"\s*\d+\s*$", ""), r"\.{3,}\s*$", ""))
    return F.coalesce((F.length(title) >= 2) & t.rlike("|".join(f"(?:{p})" for p in CONTENTS)), F.lit(False))


def word_prose(c: Column) -> Column:
    """The filter of paragraphs: with letters, or three characters with a digit, without the placeholders in them; no bare
    numbers, no marks only."""
    t = trim_u(F.regexp_replace(F.coalesce(c, F.lit("")), r"\{\{[^}]+\}\}|\[formula_\d+\]", ""))
    marks = r"^[.,;:!?()\[\]{}\"'\-_=+*&^%$#@~`|\\/<>]*$"
    return F.when(t.rlike(marks) | t.rlike(r"^\p{N}+$"), False).when(t.rlike(DATE_FORM) | t.rlike(r"\p{L}"), True).when((F.length(t) >= 3) & t.rlike(r"\p{N}"), True).otherwise(should_translate(c))


def is_image_data(c: Column) -> Column:
    """Whether a text is or shows an image in base64: by its address, or over 100 letters of that alphabet, four by four."""
    bare = F.regexp_replace(c, f"{WHITE}+", "")
    alone = (F.length(c) > 100) & (F.length(bare) > 100) & (F.length(bare) % 4 == 0) & bare.rlike("^[A-Za-z0-9+/=]+$")
    return F.coalesce(c.rlike(r'(?i)data:image/[^;]+;base64,|!\[.*?\]\(data:image/|<img[^>]*src="data:image/') | alone, F.lit(False))


def markdown_prose(c: Column) -> Column:
    return ~is_image_data(c) & should_translate(c)


def is_file_name(c: Column) -> Column:
    """Whether a name may become a file's: not blank, no reserved characters."""
    return F.coalesce((trim_u(c) != "") & ~c.rlike(r'[\\/:*?"<>|]'), F.lit(False))


def is_session(c: Column) -> Column:
    """Whether a session's name is safe in a path: 12 to 32 lower-case hexadecimal digits."""
    return F.coalesce(c.rlike("^[0-9a-f]{12,32}$"), F.lit(False))


def is_inside(c: Column) -> Column:
    """Whether a relative path leads nowhere above its root."""
    return F.coalesce((trim_u(c) != "") & ~F.array_contains(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), ".."), F.lit(False))


# Kinds of formats by extension, and codes of languages by their own names.
FORMATS = {
    "fmt-word": "docx", "fmt-ppt": "pptx", "fmt-excel": "xlsx csv tsv", "fmt-pdf": "pdf", "fmt-subtitle": "srt vtt ass ssa lrc", "fmt-text": "txt md epub html htm odt json",
    "fmt-image": "png jpg jpeg webp bmp", "fmt-video": "mp4 mkv mov avi webm mp3 wav m4a flac",
}
LANGUAGES = {"日本語": "ja", "中文": "zh", "繁體中文": "zh-Hant", "English": "en", "Español": "es", "Français": "fr", "Deutsch": "de", "Italiano": "it", "Português": "pt", "Русский": "ru", "한국어": "ko", "ภาษาไทย": "th", "Tiếng Việt": "vi"}


def format_category(extension: Column) -> Column:
    """The kind of a format by its extension, with or without a dot; null for any other."""
    named = F.create_map(*[F.lit(x) for kind, exts in FORMATS.items() for e in exts.split() for x in (e, kind)])
    return F.try_element_at(named, F.lower(F.ltrim(F.coalesce(extension, F.lit("")), F.lit("."))))


def language_code(name: Column) -> Column:
    """The code of a language by its own name; any other name is a code, in lower case."""
    named = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(named, name), F.lower(name))

# The setting that says whether files of a kind show both languages.
BILINGUAL = {
    "excel_bilingual_mode": "xlsx", "word_bilingual_mode": "docx", "pdf_bilingual_mode": "pdf", "subtitle_bilingual_mode": "srt vtt " + FORMATS["fmt-video"],
    "txt_bilingual_mode": "txt", "md_bilingual_mode": "md", "epub_bilingual_mode": "epub", "html_bilingual_mode": "html htm",
}


def bilingual_key(name: Column) -> Column:
    """That setting by a file's name, null for other kinds."""
    named = F.create_map(*[F.lit(x) for key, exts in BILINGUAL.items() for e in exts.split() for x in (e, key)])
    return F.try_element_at(named, file_type(name))
