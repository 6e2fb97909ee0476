"""Language identification by Bayesian evidence fusion.

Evidence for each row: the likelihood of its text under letter-trigram models, the language that its markup declares, the
suffix of its address with a language code in its path, and the host's prior. Priors are smoothed down a hierarchy (all
rows, domain, host) and, like the likelihoods of declarations and addresses, are grouped sums of text posteriors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, keyed_join, table, text_batches
from .toxicity import held_out

TRAIN_DOCS = 10_000  #: the text model's labelled rows: at most so many, those of least hash
LETTERS = 64
TEMPER = 0.3  #: weight of a trigram: neighbours overlap and are no independent evidence
SMOOTH_HOST, SMOOTH_CODE = 10.0, 0.5
TRUST = 0.9  #: how far a declaration or address is believed


def letter_table() -> np.ndarray:
    """A letter class for each code point below U+10000: 0 no letter, 1 to 26 a to z, 27 to 58 U+00DF to U+00FF, then other
    Latin, Greek, Cyrillic, East Asian and other letters."""
    out = np.full(0x10000, 63, np.int32)
    out[:0x250] = 59
    for c in range(0x250):
        if not chr(c).isalpha():
            out[c] = 0
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    out[0xDF:0x100] = np.where(out[0xDF:0x100] == 0, 0, np.minimum(np.arange(27, 60), 58))
    out[0x370:0x400], out[0x400:0x530] = 60, 61
    out[0x3040:0xD7B0] = 62
    for a, b in ((0x2000, 0x2C00), (0x3000, 0x3040), (0xD800, 0xF900), (0x2B0, 0x370)):
        out[a:b] = 0
    return out


TABLE = letter_table()


def trigrams(text: str) -> np.ndarray:
    """Codes of the letter trigrams of a text, lower-cased; what is no letter separates words."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    x = np.concatenate(([0], np.where(codes < 0x10000, TABLE[np.minimum(codes, 0xFFFF)], 63), [0]))
    t = (x[:-2] * LETTERS + x[1:-1]) * LETTERS + x[2:]
    return t[x[1:-1] > 0]


@dataclass
class TextModel:
    langs: list[str]
    logs: np.ndarray  #: LETTERS^3 x languages, log likelihood of the middle and last letter after the first

    def score(self, text: str) -> np.ndarray:
        t = trigrams(text)
        return np.bincount(t, minlength=1)[: len(self.logs)] @ self.logs[: max(t.max(initial=0) + 1, 1)] if len(t) > 50_000 else self.logs[t].sum(axis=0)


def count_trigrams(train: DataFrame) -> DataFrame:
    """(lang, code, n): how often a trigram stands in the texts of a language."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                sums.setdefault(lang, np.zeros(LETTERS**3, np.int64))
                np.add.at(sums[lang], trigrams(text), 1)
        for lang, s in sums.items():
            code = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code, pa.int32()), pa.array(s[code], pa.int64())], names=["lang", "code", "n"])

    return train.mapInArrow(run, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def train_text(docs: DataFrame) -> TextModel:
    """A model of the languages of (doc_id, text, lang), held-out rows left out. Without any, one unknown language."""
    text_batches(docs.sparkSession)
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("text is not null and lang is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    ids = mine.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    rows = count_trigrams(mine.join(ids, "doc_id")).collect()  # 64^3 rows for each language at most
    langs = sorted({r["lang"] for r in rows}) or ["und"]
    n = np.zeros((len(langs), LETTERS, LETTERS, LETTERS))
    at = {lang: i for i, lang in enumerate(langs)}
    for r in rows:
        n[at[r["lang"]]].reshape(-1)[r["code"]] = r["n"]
    one = n.sum(axis=(1, 2)) + 0.5
    one = one / one.sum(axis=1, keepdims=True)
    two = n.sum(axis=1) + 5 * one[:, None, :]
    two = two / two.sum(axis=2, keepdims=True)
    three = n + 5 * two[:, None, :, :]
    three = three / three.sum(axis=3, keepdims=True)
    return TextModel(langs, np.log(three).reshape(len(langs), -1).T.astype(np.float32))


def with_text_logs(rows: DataFrame, model: TextModel) -> DataFrame:
    """Replaces `text` by `logs` (array<double>): its log likelihood by language."""
    from pyspark.sql import types as T

    fields = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches):
        for batch in batches:
            logs = [model.score(t.as_py() or "").astype(float).tolist() for t in batch.column("text")]
            kept = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(logs, pa.list_(pa.float64()))], names=[*[f.name for f in fields], "logs"])

    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("logs", T.ArrayType(T.DoubleType()))]))


def softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def sums(posterior: str, n: int) -> list[Column]:
    return [F.sum(F.col(posterior)[i]).alias(f"s{i}") for i in range(n)]


def packed(n: int) -> Column:
    return F.array(*[F.col(f"s{i}") for i in range(n)])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def counts_of(rows: DataFrame, code: str, n: int) -> DataFrame:
    """(code, its soft counts by language) of all rows that have one."""
    return keep(rows.where(F.col(code).isNotNull()).groupBy(code).agg(*sums("post", n)).select(code, packed(n).alias(f"{code}_c")), code)


def everywhere(rows: DataFrame, n: int) -> list[float]:
    """The soft counts by language of all rows."""
    got = rows.agg(*[F.coalesce(F.sum(F.col("post")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(n)]).first()
    return [got[i] for i in range(n)]


def without_own(counts: Column, own: Column) -> Column:
    """Soft counts less the row's own posterior: its text is no evidence for what else speaks about it."""
    return F.zip_with(counts, own, lambda c, p: F.greatest(c - p, F.lit(0.0)))


def code_logs(code: str, all_: list[float], n: int) -> Column:
    """The log likelihood by language of a row's code, out of the soft counts of the other rows, TRUST of it; null without
    a code."""
    others = without_own(F.col(f"{code}_c"), F.col("post"))
    whole = without_own(F.array(*map(F.lit, all_)), F.col("post"))
    return F.zip_with(others, whole, lambda c, a: F.log((c + SMOOTH_CODE) / (a + SMOOTH_CODE * n)) * TRUST)


def fuse(scored: DataFrame, langs: list[str]) -> DataFrame:
    """Adds lang, probability and text_lang to rows with logs, declared, address, domain and host (any of these null). A
    host, code or domain that a third of all rows have spreads over tasks."""
    n = len(langs)
    rows = scored.withColumn("tempered", F.transform("logs", lambda x: x * TEMPER))
    rows = keep(rows.withColumn("post", softmax(F.col("tempered"))), "posteriors")
    all_ = everywhere(rows, n)
    root = F.array(*[F.lit((c + 1) / (sum(all_) + n)) for c in all_])
    domain = counts_of(rows, "domain", n)
    domain = domain.select("domain", F.zip_with("domain_c", root, lambda c, r: (c + SMOOTH_HOST * r) / (total(F.col("domain_c")) + SMOOTH_HOST)).alias("domain_p"))
    host = rows.where("host is not null").groupBy("host", "domain").agg(*sums("post", n)).select("host", "domain", packed(n).alias("host_c"))
    host = keep(host.join(domain, "domain", "left").select("host", "host_c", F.coalesce("domain_p", root).alias("domain_p")), "hosts")
    out = keyed_join(rows, host, ["host"], "left")
    with_code = {code: counts_of(rows.where(F.col(code).isNotNull()), code, n) for code in ("declared", "address")}
    for code, counts in with_code.items():
        out = keyed_join(out, counts, [code], "left")
    prior = F.when(F.col("host_c").isNull(), root).otherwise(F.zip_with(without_own(F.col("host_c"), F.col("post")), "domain_p", lambda c, p: (c + SMOOTH_HOST * p) / (total(F.col("host_c")) - 1 + SMOOTH_HOST)))
    add = lambda a, b: F.when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: x + y))
    logs = F.zip_with("tempered", prior, lambda x, p: x + F.log(F.greatest(p, F.lit(1e-12))))
    for code in with_code:
        logs = add(logs, code_logs(code, all_, n))
    out = out.withColumn("fused", logs)
    name = lambda a: F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position(a, F.array_max(a)).cast("int"))
    return out.select(*scored.columns, name(F.col("fused")).alias("lang"), F.array_max(softmax(F.col("fused"))).alias("probability"), name(F.col("tempered")).alias("text_lang"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Evidence of (page_id, url, html): the text without markup, the declared language, the address."""
    html, url = F.coalesce(pages["html"], F.lit("")), pages["url"]
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>|&[a-z]+;", " ")
    declared = F.lower(F.regexp_extract(html, r"""(?i)<html[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    path = F.lower(F.regexp_extract(url, r"^[^/]*//[^/]*/([A-Za-z]{2})(?=[/?#-]|$)", 1))
    some = lambda c: F.nullif(c, F.lit(""))
    return pages.select(
        F.lit("page").alias("kind"), F.lit(None).cast("long").alias("doc_id"), pages["page_id"].cast("long").alias("page_id"), bare.alias("text"),
        some(declared).alias("declared"), some(F.concat(F.regexp_extract(host, r"([^.]*)$", 1), F.lit("/"), path)).alias("address"),
        some(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"), some(host).alias("host"),
    )


def document_rows(docs: DataFrame) -> DataFrame:
    """Evidence of (doc_id, text, source): the source takes the place of host; nothing is declared."""
    none = F.lit(None).cast("string")
    return docs.select(F.lit("document").alias("kind"), docs["doc_id"].cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), docs["text"].alias("text"), none.alias("declared"), none.alias("address"), none.alias("domain"), F.concat(F.lit("source:"), docs["source"]).alias("host"))


def op7_evidence_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page and document.

    A null or empty text has no likelihood, so the other evidence or the prior decides; null url, source, declaration are
    no evidence; repeated rows are judged each; empty tables give no rows. `lang` of documents only trains the text model.
    """
    docs = table(spark, sf_dir, "documents")
    model = train_text(docs)
    rows = document_rows(docs).unionByName(page_rows(table(spark, sf_dir, "pages")))
    scored = keep(with_text_logs(rows, model), "languages", wide=True)
    return fuse(scored, model.langs).select("kind", "doc_id", "page_id", "lang", "probability", "text_lang", "declared", "host")
