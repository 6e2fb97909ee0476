"""Packing token sequences by minimum bin slack.

Lengths are at most the capacity, so the lengths of any number of pieces fit in a histogram of `capacity` counts. Bins
are made on that histogram: each by a bitset subset-sum over the lengths still there, and repeated while the counts last.
Pieces are then ranked within their length and find their bin by that rank.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, ordered_sums, release, table, text_batches

CAPACITY = 2048
END = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAIN = 0x180  #: below this code point lower case and NFC are the same for a letter alone and in its word


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level BPE writes each byte: itself if printable, else the next free one from U+0100."""
    keep_ = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(keep_)]
    return {**{b: chr(b) for b in keep_}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class WordIds(dict):
    """Ids of each lower-case run between white space, as little-endian bytes, made once; emptied at `most` of them."""

    def __init__(self, model, split: re.Pattern, most: int = 300_000):
        self.model, self.split, self.most, self.letters = model, split, most, byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = [t.id for w in self.split.findall(word) for t in self.model.tokenize(w.encode().decode("latin-1").translate(self.letters))]
        self[word] = found = struct.pack(f"<{len(ids)}I", *ids)
        return found


class FastIds:
    """The ids that tokenizer.encode(text, add_special_tokens=False) gives, as little-endian 32-bit bytes.

    No pre-token holds white space. So a text whose characters all lie below U+0180, without odd controls or special
    tokens, is split at white space, and each run is cut by the tokenizer's own pre-token pattern, encoded by its model
    and remembered. All other texts go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(open(path, encoding="utf-8").read())
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        lower = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.ids = None
        if lower and [s["type"] for s in steps] == ["Split", "ByteLevel"] and spec["model"]["type"] == "BPE":
            of = {k: "".join(re.escape(chr(c)) for c in range(PLAIN) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
            split = steps[0]["pattern"]["Regex"].replace(r"\p{L}", of["L"]).replace(r"\p{N}", of["N"])
            self.ids = WordIds(self.tokenizer.model, re.compile(split))
        self.marks = [t["content"].encode() for t in spec.get("added_tokens", [])]
        # the bytes of U+0009 to U+000D, U+0020 to U+007E and U+0080 to U+017F in UTF-8
        self.plain = bytes([*range(9, 14), *range(32, 127), *range(0x80, 0xC0), *range(0xC2, 0xC6)])

    def encode(self, text: str) -> bytes:
        raw = text.encode("utf-8", "surrogatepass")
        if self.ids is None or raw.translate(None, self.plain) or any(m in raw for m in self.marks):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        ids = self.ids
        return b"".join([ids[w] for w in text.lower().split()])


@lru_cache(maxsize=2)
def fast_ids(path: str) -> FastIds:
    return FastIds(path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece of each document of (doc_id, text): its ids, an end id after them, cut at `capacity`."""
    schema = T._parse_datatype_string(PIECES)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        coder = fast_ids(tokenizer)
        end = np.array([END], "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            out = [[] for _ in arrow]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = coder.encode(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for c, v in zip(out, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)
        release()

    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, schema)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, with repeats within counts, whose sum is the largest that fits in `room`; large lengths are tried first."""
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left > 0:
            n = min(take, left)
            after = (reach | reach << (n * length)) & full
            if after != reach:
                steps.append((length, n, reach))
                reach = after
                if reach >> room & 1:
                    left = 0
                    break
            left -= n
            take *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    out: list[int] = []
    for length, n, before in reversed(steps):
        if not before >> at & 1:
            out += [length] * n
            at -= n * length
    return out


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a bin, how many such bins) until no piece is left. Each bin takes the largest length there and the
    fullest combination beside it, and is repeated as often as the counts allow."""
    left, out = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        top = max(left)
        left[top] -= 1
        if not left[top]:
            del left[top]
        lengths = [top, *fullest(left, capacity - top)]
        left[top] = left.get(top, 0) + 1
        need = {x: lengths.count(x) for x in set(lengths)}
        times = min(left[x] // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((lengths, times))
    return out


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset (long) to pieces with `length` (1 to capacity): bins by minimum bin slack."""
    counts = {int(r["length"]): r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
    ranked = ordered_sums(pieces.withColumn("_one", F.lit(1).cast("long")), ["length"], order, "_one", "packing")
    plans: dict[int, list[tuple[int, int, int, int]]] = {}  # per length: first rank, bins, first sequence, offset
    used: dict[int, int] = {}
    sequence = 0
    for lengths, times in minimum_bin_slack(counts, capacity):
        offset = 0
        for x in lengths:
            plans.setdefault(x, []).append((used.get(x, 0), times, sequence, offset))
            used[x] = used.get(x, 0) + times
            offset += x
        sequence += times
    tables = {x: np.array(rows, np.int64) for x, rows in plans.items()}
    fields = [*ranked.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]

    def place(batches):
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            ranks = batch.column("before").to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for x in np.unique(lengths):
                at = np.flatnonzero(lengths == x)
                rows = tables[int(x)]
                k = np.searchsorted(rows[:, 0], ranks[at], side="right") - 1
                seq[at] = rows[k, 2] + ranks[at] - rows[k, 0]
                off[at] = rows[k, 3]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seq), pa.array(off)], names=[*batch.schema.names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, T.StructType(fields))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of (doc_id, text) with their places in sequences. The histogram and the ranks read written pieces."""
    pieces = keep(cut_documents(docs, tokenizer or tokenizer_path(), capacity), "pieces", wide=True)
    return pack(pieces, ["doc_id", "piece", "ids_crc32"], capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of at most 2048 tokens, packed into sequences of at most 2048.

    A null or empty text is one piece of one id, the end id 0; a null doc_id stays null; repeated rows are packed as
    documents of their own; an empty table gives no rows; extra columns are not read.
    """
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
