"""Glossaries and the translation memory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions.tokens import arrow, compatible

#: A glossary up to this many terms is broadcast; a larger one is joined by its terms' first words.
BROADCAST_TERMS = 20_000


def occurs(term: Column, text: Column) -> Column:
    """Document rule: a term with East Asian characters occurs as a substring, one in Latin letters as whole words in any
    case, any other as a substring."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    word = F.concat(F.lit(r"(?iU)(?<![\w])"), quoted, F.lit(r"(?![\w])"))
    return F.when(term.rlike(X.WIDE), text.contains(term)).when(term.rlike("^[A-Za-z]"), F.rlike(text, word)).otherwise(text.contains(term))


def unpivot(glossary: DataFrame, src: str, dst: str) -> DataFrame:
    """(ord, src, dst) of a wide glossary with a column per language; of equal sources the last row wins."""
    rows = glossary.select("ord", X.trim_u(F.col(src)).alias("src"), X.trim_u(F.col(dst)).alias("dst")).where("src <> '' and dst <> ''")
    return rows.groupBy("src").agg(F.max("ord").alias("ord"), F.max_by("dst", "ord").alias("dst"))


def words_of(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def match(texts: DataFrame, glossary: DataFrame) -> DataFrame:
    """(doc_id, src, dst) of every term of (ord, src, dst) that occurs in a text of (doc_id, text).

    Terms that begin with a word of Latin letters meet texts by that word, an equi-join whatever the glossary's size; the
    others (few: East Asian or symbols) are broadcast up to BROADCAST_TERMS, and beyond that joined by first character.
    """
    latin = glossary.where(F.col("src").rlike("^[A-Za-z]") & ~F.col("src").rlike(X.WIDE))
    other = glossary.where(~(F.col("src").rlike("^[A-Za-z]") & ~F.col("src").rlike(X.WIDE)))
    keyed = latin.withColumn("_w", F.regexp_extract(F.lower("src"), r"^[\p{L}\p{N}_]+", 0))
    words = texts.select("doc_id", F.explode(words_of(F.col("text"))).alias("_w"))
    if latin.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        keyed = F.broadcast(keyed)
    near = words.join(keyed, "_w").select("doc_id", "src", "dst", "ord")
    # one word in Latin letters has been found as it stands; texts are looked up for the other terms only
    single = F.col("src").rlike(r"^[A-Za-z][\p{L}\p{N}_]*$")
    longer = near.where(~single).join(texts.select("doc_id", "text"), "doc_id").where(occurs(F.col("src"), F.col("text")))
    found = near.where(single).unionByName(longer.select("doc_id", "src", "dst", "ord"))
    if other.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        rest = texts.join(F.broadcast(other), texts["text"].contains(other["src"]))
    else:
        chars = texts.select("doc_id", "text", F.explode(F.array_distinct(F.split("text", ""))).alias("_c"))
        rest = chars.join(other.withColumn("_c", F.substring("src", 1, 1)), "_c").where(F.col("text").contains(F.col("src")))
    return found.unionByName(rest.select("doc_id", "src", "dst", "ord"))


def first_terms(matches: DataFrame, n: int = 8) -> DataFrame:
    """The first n terms of each text in glossary order."""
    return matches.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).where(F.col("rank") <= n)


def live_terms(texts: DataFrame, glossary: DataFrame, n: int = 8) -> DataFrame:
    """(doc_id, src, dst, rank): the first n terms of (ord, src, dst) in glossary order that stand anywhere in a text of
    (doc_id, text): ASCII terms in any case, others as they are. Up to BROADCAST_TERMS terms go to every task; more of them
    meet texts by the two characters that they begin with."""
    form = lambda c: F.lower(c)
    named = glossary.where(F.length("src") > 0).withColumn("_any", F.col("src").rlike(r"^[\x00-\x7f]+$"))
    held = F.when(F.col("_any"), form(F.col("text")).contains(form(F.col("src")))).otherwise(F.col("text").contains(F.col("src")))
    if named.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        found = texts.join(F.broadcast(named), held)
    else:
        low = F.lower("text")
        starts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda i: F.substring(low, i, F.lit(2)))
        # a term of one character meets the texts by that character
        keys = F.array_distinct(F.concat(starts, F.transform(starts, lambda x: F.substring(x, 1, 1))))
        near = texts.select("doc_id", F.explode(keys).alias("_k")).join(named.withColumn("_k", F.substring(form(F.col("src")), 1, 2)), "_k").drop("_k")
        found = near.join(texts.select("doc_id", "text"), "doc_id").where(held)
    return first_terms(found.select("doc_id", "src", "dst", "ord"), n)


def normal(c: Column) -> Column:
    """The form in which terms are the same: NFKC, any case, trimmed."""
    return arrow(compatible, "string")(c)


def merge(extracted: DataFrame, user: DataFrame, form: Callable[[Column], Column] = normal) -> DataFrame:
    """(src, dst): the user's terms, then extracted ones whose form, the normal one by default, the user doesn't have; first
    of equals wins."""
    both = user.withColumn("_p", F.lit(0)).unionByName(extracted.withColumn("_p", F.lit(1)))
    best = both.groupBy(form(F.col("src")).alias("_k")).agg(F.min_by(F.struct("src", "dst"), F.struct("_p", "ord")).alias("b"))
    return best.select("b.src", "b.dst")


def longest_first(matches: DataFrame) -> DataFrame:
    """Adds rank: a text's terms, the longest first, equals in glossary order."""
    return matches.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.length("src").desc(), "ord")))


LEAST, MOST, KEPT = 2, 80, 60  # Fixed values: characters of a term; terms that are kept


def noise(c: Column) -> Column:
    """No term: too short or long, over several lines, an address, a number or version, code, a sentence."""
    t = X.trim_u(c)
    n = F.length(t)
    address = t.rlike(r"(?i)https?://|www\.") | t.rlike(r"[^@\s]+@[^@\s]+\.[^@\s]+")
    sentence = t.rlike("[。！？!?…]$") | (t.rlike(r"^[\x00-\x7f]+$") & (F.size(F.split(t, r"\s+")) > 6)) | ((n > 24) & t.rlike("[，、,;；]"))
    return (n < LEAST) | (n > MOST) | t.rlike(r"[\n\t]") | address | t.rlike(r"(?i)^[\d\s.,:%/v#x+\-—–()]+$") | t.rlike(r"[{}$%<>]") | sentence


def cleaned(found: DataFrame, texts: DataFrame, most: int = KEPT) -> DataFrame:
    """(src, dst, ord) of the first `most` of found terms (ord, src, dst) that are no noise, whose normal form some text of
    (text) holds, the first of equal forms."""
    good = found.where(~noise(F.col("src"))).withColumn("_n", normal(F.col("src")))
    first = good.groupBy("_n").agg(F.min_by(F.struct("src", "dst", "ord"), "ord").alias("t")).select("_n", "t.*")
    # candidates of one reply: a few, so they go to the texts, and not the texts to one place
    held = texts.select(normal(F.col("text")).alias("_t")).join(F.broadcast(first.select("_n")), F.col("_t").contains(F.col("_n"))).select("_n").distinct()
    return first.join(held, "_n", "left_semi").orderBy("ord").limit(most).select("src", "dst", "ord")


def lookup(items: DataFrame, memory: DataFrame, signature: str) -> DataFrame:
    """Adds hit and dst to (batch_id, value): the memory's text, served only where a whole batch is known."""
    key = X.cache_key(F.lit(signature), F.col("value"))
    out = items.withColumn("key", key).join(memory.select("key", F.col("dst")), "key", "left")
    whole = out.groupBy("batch_id").agg(F.bool_and(F.col("dst").isNotNull()).alias("served"))
    return out.join(whole, "batch_id").withColumn("dst", F.when(F.col("served"), F.col("dst")))


def upsert(memory: DataFrame, fresh: DataFrame) -> DataFrame:
    """The latest dst of each key; texts that equal their source are never stored."""
    both = memory.unionByName(fresh.where("src <> dst"))
    return both.groupBy("key").agg(F.max_by(F.struct("src", "dst", "used_at"), F.struct("used_at", "dst")).alias("m")).select("key", "m.*")


def prune(memory: DataFrame, most: int) -> DataFrame:
    """The `most` rows used last: those above the cut, found by a top-k, and of those at the cut the least keys."""
    return memory.orderBy(F.desc("used_at"), "key").limit(most)
