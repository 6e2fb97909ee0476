"""Sizes, budgets and settings as column expressions, each resolved from the most special value to a constant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import text as X

LOCAL = "localhost|127\\.0\\.0\\.1|0\\.0\\.0\\.0"


def batch_budget(own: Column, context: Column, url: Column, local: Column, default: int = 4096) -> Column:
    """Tokens of a batch: the model's own setting (128 at least), 0.4 of a local model's window (256 to 4096, 1024 where
    the window is unknown), 1024 for a server on this machine, else the default."""
    window = F.when(context > 0, F.greatest(F.lit(256), F.least(F.lit(4096), (context * 0.4).cast("int")))).otherwise(1024)
    return F.coalesce(F.when(own != 0, F.greatest(F.lit(128), own)), F.when(local, window), F.when(F.lower(url).rlike(LOCAL), 1024), F.lit(default))


def shrunk_budget(budget: Column, round_: Column, least: int = 256) -> Column:
    """A batch's budget in retry rounds from 0: halved each time."""
    return F.greatest(F.lit(least), F.floor(budget * F.pow(F.lit(0.5), round_ + 1)).cast("int"))


def reply_cap(context: Column, asked: Column) -> Column:
    """Tokens that a reply may have: what the window leaves, 256 to 2048; an unknown window counts 4096."""
    return F.greatest(F.lit(256), F.least(F.lit(2048), F.coalesce(context, F.lit(4096)) - asked - 128))


def own_or(own: Column, default: Column | int, least: int = 1) -> Column:
    """A setting of a model, if it has one that is not nought, else the default."""
    other = F.lit(default) if isinstance(default, int) else default
    return F.when(F.coalesce(own, F.lit(0)) != 0, F.greatest(F.lit(least), own)).otherwise(other)


def sampling(configured: Column, mode: Column, url: Column, model: Column) -> Column:
    """The value to send: none where a provider takes none, the model's own on this machine, else the mode's before it."""
    refuses = F.lower(F.coalesce(url, F.lit(""))).contains("anthropic") | F.lower(F.coalesce(model, F.lit(""))).contains("claude")
    return F.when(refuses, None).when(F.lower(F.coalesce(url, F.lit(""))).rlike(LOCAL), configured).otherwise(F.coalesce(mode, configured))


def font_scale(source: Column, translated: Column) -> Column:
    """By how much a font shrinks for a translation that is over 1.15 times as wide: 0.7 at least; else 1."""
    wide = lambda c: F.length(c) + X.count_of(c, r"[\x{4e00}-\x{9fff}]")
    s, t = wide(source), wide(translated)
    return F.when((s == 0) | (t <= 1.15 * s), 1.0).otherwise(F.greatest(F.lit(0.7), s / t))


def font_size(size: Column, scale: Column) -> Column:
    """A size in hundredths of a point, 7 points at least."""
    return F.when(scale < 1, F.greatest(F.lit(700), F.floor(size * scale).cast("int"))).otherwise(size)


def prompt(template: Column, source: Column, target: Column, *hints: Column) -> Column:
    """A template with the names of the languages put in, and the hints that there are below it."""
    text = F.replace(F.replace(template, F.lit("{Text_Target_Language}"), target), F.lit("{Text_Source_Language}"), F.coalesce(source, F.lit("the source language")))
    return F.concat_ws("\n\n", text, *[F.nullif(h, F.lit("")) for h in hints])


def user_message(previous: Column, context: Column, ask: Column, request: Column, glossary: Column) -> Column:
    """The message of a batch: what came before, the request between marks, the terms to use."""
    z = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(z(previous), F.lit("\n###"), z(context), F.lit("###\n"), z(ask), F.lit("###\n"), request, F.lit("###\n"), z(glossary))


def parameter_signature(model: Column, src: Column, dst: Column, mode: Column, temperature: Column, glossary: Column, masked: bool = True, version: str = "v1") -> Column:
    """16 hexadecimal digits that stand for all that a translation depends on."""
    z = lambda c: F.coalesce(c, F.lit(""))
    heat = F.when(temperature.isNull(), "").otherwise(F.format_string("%.3f", temperature))
    parts = F.concat_ws("|", z(model), z(src), z(dst), z(mode), heat, z(glossary), F.lit("m1" if masked else "m0"), F.lit(version))
    return F.substring(F.sha1(parts.cast("binary")), 1, 16)


def glossary_signature(pairs: Column) -> Column:
    """12 hexadecimal digits of an array of (src, dst), whatever its order; empty for no terms."""
    rows = F.array_sort(F.transform(pairs, lambda p: F.concat_ws("\t", p["src"], p["dst"])))
    return F.when(F.coalesce(F.size(pairs), F.lit(0)) < 1, "").otherwise(F.substring(F.sha1(F.array_join(rows, "\n").cast("binary")), 1, 12))
