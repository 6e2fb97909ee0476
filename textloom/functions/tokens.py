"""Functions that no column expression can hold: balanced braces, compression ratios, compatibility forms, repairs and
recursive cuts. Each is a plain function of one value; arrow() makes a vectorised column function of it."""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import PRINTF, SHELL


def arrow(fn: Callable, kind: str) -> Callable[..., Column]:
    """fn over columns, in Arrow batches; a null in the first column gives null."""

    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if row[0] is None else fn(*row) for row in zip(*columns, strict=True)], dtype="object")

    return run


OPEN, SHUT = "", ""  # Fixed values: the marks around a masked token's number
_SIMPLE = re.compile(f"{PRINTF}|{SHELL}".replace(r"\p{L}\p{N}_", r"\w"))
_BRACE = re.compile(r"[{}]")


def closing(text: str, start: int) -> int | None:
    """Where the brace that opens at `start` is closed, just behind it."""
    depth = 0
    for m in _BRACE.finditer(text, start):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return None


def brace_spans(text: str) -> list[tuple[int, int]]:
    """Outermost balanced single braces. What touches another brace is part of a {{ }} marker; after a brace that is never
    closed there are none."""
    found, at = [], text.find("{")
    while at >= 0:
        if text.startswith("{{", at):
            behind: int | None = at + 2
        elif text[at - 1 : at] in ("{", "}"):
            behind = at + 1
        else:
            behind = closing(text, at)
            if behind is None:
                break
            if not text.startswith("}", behind):
                found.append((at, behind))
        at = text.find("{", behind)
    return found


def token_spans(text: str) -> list[tuple[int, int]]:
    """Spans of machine tokens, leftmost first, of those that begin together the longest, none within another."""
    spans = sorted([m.span() for m in _SIMPLE.finditer(text)] + brace_spans(text), key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int]] = []
    for s in spans:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def machine_parts(text: str) -> list[str]:
    """The machine tokens of a text, in order."""
    return [text[a:b] for a, b in token_spans(text)]


def mask(text: str) -> tuple[str, dict[int, str]]:
    """The text with numbered marks for its machine tokens, and the tokens by number."""
    parts, kept, at = [], {}, 0
    for n, (a, b) in enumerate(token_spans(text)):
        parts += [text[at:a], f"{OPEN}{n}{SHUT}"]
        kept[n] = text[a:b]
        at = b
    return "".join([*parts, text[at:]]), kept


def unmask(text: str, kept: dict[int, str]) -> str:
    """Marks back to tokens, however often they stand; unknown numbers stay."""
    return re.sub(f"{OPEN}(\\d+){SHUT}", lambda m: kept.get(int(m[1]), m[0]), text)


def repetition_ratio(text: str) -> float:
    """Bytes per compressed byte: prose has 2 to 3, a loop over 4."""
    raw = (text or "").strip().encode()
    return len(raw) / max(len(zlib.compress(raw, 6)), 1)


def compatible(text: str) -> str:
    """NFKC, case-folded, trimmed: the form in which terms are the same."""
    return unicodedata.normalize("NFKC", text).casefold().strip()


def one_upper(text: str) -> str:
    """Upper case as SQL has it: a character becomes one character, ß becomes ẞ."""
    return "".join("ẞ" if c == "ß" else next((u for u in (c.upper(), c.title()) if len(u) == 1), c) for c in text)


def one_lower(text: str) -> str:
    """Lower case as SQL has it: a character becomes one character, wherever it stands."""
    return "".join(c.lower()[0] for c in text)


def json_objects(text: str) -> list[str]:
    """Top-level {...} of a text, braces within strings not counted."""
    found, depth, start, quoted, i = [], 0, 0, False, 0
    while i < len(text):
        c = text[i]
        if quoted:
            i += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = depth > 0
        elif c == "{":
            start = i if not depth else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                found.append(text[start : i + 1])
        i += 1
    return found


def merged_json(text: str) -> dict[str, str]:
    """One map of all objects that a reply holds, the last of equal keys; trailing commas are forgiven."""
    out: dict[str, str] = {}
    for part in json_objects(text):
        try:
            got = json.loads(re.sub(r",\s*([}\]])", r"\1", part), strict=False)
        except ValueError:
            continue
        out |= {str(k): v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in got.items()}
    return out


def term_list(text: str) -> list[tuple[str, str]]:
    """Pairs out of a reply's JSON array of pairs, or of objects with src or source, dst or target; what is no such pair, or
    two times the same, is left out."""
    inner = re.search(r"\[.*\]", text or "", re.S)
    try:
        rows = json.loads(inner[0]) if inner else []
    except ValueError:
        return []

    def pair(row) -> tuple[str, str]:
        if isinstance(row, dict):
            row = [row.get("src") or row.get("source"), row.get("dst") or row.get("target")]
        a, b = (row[:2]) if isinstance(row, list) and len(row) > 1 else (None, None)
        return tuple("" if x is None else str(x).strip() for x in (a, b))  # type: ignore[return-value]

    return [(a, b) for a, b in map(pair, rows) if a and b and a != b]


_WIDE = re.compile("[\u3000-\u9fff\uff00-\uffef]")  # the ranges of functions.text.cells


def cells(text: str) -> int:
    return len(text) + len(_WIDE.findall(text))


def split_index(text: str) -> int | None:
    """Where to cut a cue: behind the sentence mark nearest to the middle, else a clause mark, else a space; the first and
    the last character are no place for a cut."""
    for marks in (r"[。！？!?.]", r"[、，,；;:]", " "):
        ends = [m.end() for m in re.finditer(marks, text) if 1 < m.end() < len(text)]
        if ends:
            return min(ends, key=lambda e: abs(e - len(text) / 2))
    return None


Word = tuple[float, float, str]


def when_spoken(at: int, start: float, end: float, text: str, words: list[Word]) -> float:
    """The time of a place in a cue: the end of the word that reaches it, else by the share of characters."""
    word = bisect_left(list(accumulate(len(w) for _, _, w in words)), at)
    if word < len(words):
        return min(max(words[word][1], start), end)
    return start + (end - start) * at / max(len(text), 1)


def split_cue(start: float, end: float, text: str, most_cells: int = 84, longest: float = 7.0, fastest: float = 20.0, words: list[Word] | None = None) -> list[tuple[float, float, str]]:
    """A cue cut until each part is narrow, short and slow enough to read (`fastest`: characters a second), as far as there
    are places to cut; a text under eight characters stays whole."""
    text, words = (text or "").strip(), words or []
    if not text:
        return []
    lasts = max(end - start, 0.001)
    fits = cells(text) <= most_cells and len(text) <= fastest * lasts and lasts <= longest
    at = None if fits or len(text) < 8 else split_index(text)
    when = start if at is None else when_spoken(at, start, end, text, words)
    if at is None or not start < when < end:
        return [(start, end, text)]
    more = (most_cells, longest, fastest)
    return split_cue(start, when, text[:at], *more, [w for w in words if w[1] <= when]) + split_cue(when, end, text[at:], *more, [w for w in words if w[1] > when])


# Marks that end a sentence or a clause, words before which a running text may be cut.
SENTENCE_MARKS, CLAUSE_MARKS = "。！？!?.", "，、,；;"
CONNECTIVES = tuple("然后 然後 但是 所以 因为 因為 如果 不过 不過 而且 还有 還有 其实 其實 因此 于是 於是 可是 虽然 雖然 这样 這樣".split())


_SENTENCE = re.compile(f"[{re.escape(SENTENCE_MARKS)}]")
#: Places to cut a running text where no sentence ends, the best first.
_CUTS = (re.compile(f"(?<=[{re.escape(CLAUSE_MARKS)}])"), re.compile("(?<= )"), re.compile(f"(?={'|'.join(CONNECTIVES)})"))


def unit_end(text: str, start: int, final: bool, least: int, target: int, hard: int) -> int | None:
    """Where a unit of running text ends: behind a full stop, wherever it stands. Else, once the text is wide enough, behind
    the last clause mark of those that leave `least` cells, else the last space, else before the last connective."""
    widths = list(accumulate(map(cells, text[start:])))
    full = bisect_left(widths, hard)  # the character that fills the unit
    stop = _SENTENCE.search(text, start, start + full + 1)
    if stop:
        return stop.end()
    over = full < len(widths)
    if not over and (final or not widths or widths[-1] < target):
        return None
    first, last = start + bisect_left(widths, least), start + full + (1 if over else 0)
    for n, pattern in enumerate(_CUTS):
        # a cut behind a character belongs to it, one before a word to the word's first
        low, high = (first + 1, last) if n < 2 else (max(first, start + 1), last - 1)
        places = [m.start() for m in pattern.finditer(text, max(low - 1, start)) if low <= m.start() <= high]
        if places:
            return places[-1]
    return last if over else None


def units(text: str, final: bool, least: int = 24, target: int = 60, hard: int = 88) -> tuple[list[str], int]:
    """(units, characters consumed) of running text; what has no end yet waits, unless the text is final."""
    out, start = [], 0
    while start < len(text):
        end = unit_end(text, start, final, least, target, hard)
        if end is None and not final:
            break
        end = len(text) if end is None else end
        out.append(text[start:end].strip())
        start = end
    return [u for u in out if u], start


MONTHS = "January February March April May June July August September October November December".split()
_DATES = re.compile(r"(?P<y>\d{4})\s*[年./-]\s*(?P<m>\d{1,2})(?:\s*[月./-]\s*(?P<d>\d{1,2})\s*日?|\s*月)?")


def english_dates(text: str) -> str:
    """Year-first dates of 1900 to 2100 as `Month DD, YYYY` or `Month YYYY`; longer matches win."""

    def put(m: re.Match) -> str:
        y, mo, d = int(m["y"]), int(m["m"]), int(m["d"] or 0)
        if not (1900 <= y <= 2100 and 1 <= mo <= 12 and d <= 31):
            return m[0]
        return f"{MONTHS[mo - 1]} {d:02d}, {y}" if d else f"{MONTHS[mo - 1]} {y}"

    return _DATES.sub(put, text)


def header_parts(text: str) -> list[tuple[str, str]]:
    """(code or text, part) of a spreadsheet header: &L, &"font", &12 and other codes stand between texts."""
    parts = re.split(r'(&"[^"]*"|&\d+|&[A-Za-z&])', text)
    return [("code" if i % 2 else "text", p) for i, p in enumerate(parts) if p]


def sample(values: list[str], size: int = 9000) -> str:
    """A third each from the head, the middle and the tail of the joined values, an ellipsis between."""
    text, third = "\n".join(filter(None, values)), size // 3
    if len(text) <= size:
        return text
    middle = max(0, len(text) // 2 - third // 2)
    return "\n…\n".join((text[:third], text[middle : middle + third], text[-third:]))


def mono(pcm: bytes, channels: int = 1) -> np.ndarray:
    """16-bit little-endian samples as numbers from -1 to 1, channels averaged."""
    x = np.frombuffer(pcm[: len(pcm) // (2 * channels) * 2 * channels], "<i2").astype(np.float32) / 32768
    return x.reshape(-1, channels).mean(axis=1)


def resampled(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation to another rate."""
    n = round(len(x) * to / rate)
    return np.interp(np.arange(n) * rate / to, np.arange(len(x)), x).astype(np.float32) if len(x) else x


def energy(x: np.ndarray) -> float:
    return float(np.sqrt(np.mean(x * x))) if len(x) else 0.0


def removable(wanted: dict[str, set[str]], name: str) -> set[str]:
    """What only `name` needs among modules and their packages: its own, less all others'."""
    return set(wanted.get(name, set())) - set().union(*[v for k, v in wanted.items() if k != name])


def retry_budget(budget: int, round_: int, least: int = 256) -> int:
    """A batch's token budget in a retry round: halved each time."""
    return max(least, int(budget * 0.5 ** (round_ + 1)))


def vocabulary_count(path: str) -> Callable[[Column], Column]:
    """A column function that counts tokens by the vocabulary file at `path`, which every executor has to have; null and
    empty texts have none."""

    @F.pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        of = Tokenizer.from_file(path)
        for part in parts:
            yield pd.Series([len(of.encode(t or "", add_special_tokens=False).ids) for t in part], dtype="int64")

    return run
