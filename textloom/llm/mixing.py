"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the mix has the van der Corput point of i (its bits reversed). The points go through the cumulative weights of
the sources, the slots of a source are ranked, and the k-th of them takes the k-th block of that source's shuffled words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, keep, keyed_join, ordered_sums, table

BLOCK = 1024
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
GRID, CELL = 40, 16
LEVELS = 64
SEED = 7


def van_der_corput(i: Column, bits: int = GRID) -> Column:
    """The base-2 van der Corput point of i >= 0, as an integer below 2^bits: the low `bits` bits of i, reversed."""
    for shift, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        m = F.lit(mask)
        i = F.shiftrightunsigned(i, shift).bitwiseAND(m).bitwiseOR(F.shiftleft(i.bitwiseAND(m), shift))
    i = F.shiftrightunsigned(i, 32).bitwiseOR(F.shiftleft(i, 32))
    return F.shiftrightunsigned(i, 64 - bits)


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds rank, weight and target to (source, source_size, source_key): see mix(). Sources may be as many as hosts: they
    are ranked by ordered sums, and no task has to hold them all.

    Resharing what exceeds a cap by weight until nothing does is water filling: the target is min(cap, level * weight)
    for the one level at which the targets add up. Aggregations, each trying LEVELS levels, narrow it down until it lies
    between two neighbouring doubles or no source's cap lies between; then the uncapped sources give it exactly.
    """
    last = sizes.withColumns({"_null": F.col("source").isNull().cast("int"), "_one": F.lit(1).cast("long")})
    s = ordered_sums(last, [], ["_null", "source"], "_one", "sources").withColumnRenamed("before", "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    s = keep(s.select("source", "source_key", "source_size", "rank", weight.alias("weight"), (most * F.col("source_size")).alias("cap")), "sources")
    whole, widest = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)) * share, F.max(F.col("cap") / F.col("weight"))).first()
    low, high = 0.0, float(widest or 0.0)  # at `high` every source has its cap
    while True:
        levels = [low + (high - low) * (i + 1) / LEVELS for i in range(LEVELS - 1)]
        sums = [F.sum(F.least(F.col("cap"), F.lit(x) * F.col("weight"))).alias(f"f{i}") for i, x in enumerate(levels)]
        between = F.count_if((F.col("cap") > low * F.col("weight")) & (F.col("cap") < high * F.col("weight"))).alias("between")
        full, free = F.coalesce(F.sum(F.when(F.col("cap") <= low * F.col("weight"), F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("cap") > low * F.col("weight"), F.col("weight"))), F.lit(0.0))
        row = s.agg(*sums, between, full.alias("full"), free.alias("free")).first()
        if not row["between"] or not low < levels[0] < high:
            level = (whole - row["full"]) / row["free"] if row["free"] else high
            break
        under = sum(row[f"f{i}"] <= whole for i in range(len(levels)))
        low, high = levels[under - 1] if under else low, levels[under] if under < len(levels) else high
    return s.withColumn("target", F.least(F.col("cap"), F.lit(float(level)) * F.col("weight"))).drop("cap", "rank")


def slot_count(goals: DataFrame, block: int = BLOCK) -> int:
    """Slots of the schedule; the few that top up a source that it left short come after these."""
    return -(-(goals.agg(F.sum("quota")).first()[0] or 0) // block)


def schedule(goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source_key, block_no, slot) for every block that the targets need; goals: source_key, quota (words, long).

    Sources are laid end to end on a grid of 2^40 in proportion to their quotas. A slot finds its source by the grid cell
    of its point, an equi-join on 2^16 cells, each with the sources that touch it. The k-th slot of a source serves its
    block k; blocks for which the low-discrepancy count falls short (by a few) get slots after all others.
    """
    spark = goals.sparkSession
    total = goals.agg(F.sum("quota")).first()[0] or 0
    n = -(-total // block)
    scale = float(1 << GRID) / max(total, 1)
    g = ordered_sums(goals.select("source_key", "quota"), [], ["source_key"], "quota", "quotas")
    g = g.withColumn("_low", F.floor(F.col("before") * scale)).withColumn("_high", F.floor((F.col("before") + F.col("quota")) * scale)).withColumn("blocks", F.ceil(F.col("quota") / block)).where("_high > _low")
    shift = GRID - CELL
    cells = g.select("source_key", "blocks", "_low", "_high", F.explode(F.sequence(F.shiftrightunsigned("_low", shift), F.shiftrightunsigned(F.col("_high") - 1, shift))).alias("_cell"))
    slots = spark.range(n).withColumnRenamed("id", "slot").withColumn("_point", van_der_corput(F.col("slot"))).withColumn("_cell", F.shiftrightunsigned("_point", shift))
    found = slots.join(cells, "_cell").where("_point >= _low and _point < _high").select("source_key", "blocks", "slot", F.lit(1).cast("long").alias("_one"))
    ranked = ordered_sums(found, ["source_key"], ["slot"], "_one", "schedule").where("before < blocks").select("source_key", F.col("before").alias("block_no"), "slot")
    have = ranked.groupBy("source_key").agg(F.count("*").alias("_have"))
    short = goals.withColumn("blocks", F.ceil(F.col("quota") / block)).join(have, "source_key", "left").withColumn("_have", F.coalesce("_have", F.lit(0))).where("_have < blocks")
    topped = short.select("source_key", F.explode(F.sequence(F.col("_have"), F.col("blocks") - 1)).alias("block_no")).withColumn("slot", n + F.pmod(F.xxhash64("source_key", "block_no"), F.lit(1 << 40)))
    return ranked.unionByName(topped)


def mix(docs: DataFrame, block: int = BLOCK, names: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, int]:
    """(rows, plan, slots) for docs with `source` and `size`, and what else tells rows apart or (`names`) only names them.

    rows: docs with row (long), source_size, target; plan: (row, slot, block_no, pass_no, low, high), the words low to
    high of a row that a slot takes; slots: how many there are. A source is a stream: its documents in hashed order (first
    pass; names have no part in the hash), then the same rotated by half (second), cut into blocks of `block` words; the
    quota, its rounded target, ends the stream.
    """
    by = [F.col(c) for c in docs.columns if c not in names]
    # written first: the sort by range looks at its rows twice, and their sizes come from whole texts
    docs = keep(docs.withColumn("source_key", F.xxhash64("source", F.lit(SEED))).withColumn("_shuffle", F.xxhash64(*by, F.lit(SEED))), "sized", wide=True)
    placed = ordered_sums(docs, ["source_key"], ["_shuffle"], "size", "mix")
    per = keep(targets(docs.groupBy("source", "source_key").agg(F.sum("size").alias("source_size"))).withColumn("quota", F.round("target").cast("long")), "targets")
    rows = keyed_join(placed, per.drop("source"), ["source_key"])
    size, s = F.col("size"), F.col("source_size")
    turned = F.pmod(F.col("before") + F.floor(s / 2), s)  # the place in the second pass
    wraps = turned + size - s
    span = lambda p, at, low, high: F.struct(F.lit(p).alias("pass_no"), at.cast("long").alias("at"), low.cast("long").alias("low"), high.cast("long").alias("high"))
    zero = F.lit(0)
    spans = F.array(span(1, F.col("before"), zero, size), span(2, s + turned, zero, F.least(size, s - turned)), span(2, s, s - turned, F.greatest(size, s - turned)))
    cut = rows.where("size > 0").select("row", "source_key", "quota", F.explode(spans).alias("p"), wraps.alias("_wraps"))
    cut = cut.select("row", "source_key", "p.pass_no", "p.at", "p.low", F.least(F.col("p.high"), F.col("p.low") + F.col("quota") - F.col("p.at")).alias("high")).where("high > low")
    first = F.floor(F.col("at") / block)
    cut = cut.withColumn("block_no", F.explode(F.sequence(first, F.floor((F.col("at") + F.col("high") - F.col("low") - 1) / block))))
    low = F.greatest(F.col("low"), F.col("low") + F.col("block_no") * block - F.col("at"))
    high = F.least(F.col("high"), F.col("low") + (F.col("block_no") + 1) * block - F.col("at"))
    cut = cut.select("row", "source_key", "pass_no", "block_no", low.alias("low"), high.alias("high"))
    goals = per.select("source_key", "quota")
    slots = schedule(goals, block)
    plan = cut.join(slots, ["source_key", "block_no"]).select("row", "slot", "block_no", "pass_no", "low", "high")
    return rows, plan, slot_count(goals, block)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text, null 0) of documents."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].alias("source"), F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def op4_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 150% of all words takes of each document, under the weights 5, 2, 1 by source: how many words, and
    which slots of the schedule take how many of them (slot:words, comma-joined, null: none).

    A null or wordless text has size 0 and is never taken; a null source is a source, the last; repeated rows are
    taken as documents of their own; an empty table gives no rows. Reruns agree: hashes of the row decide the order.
    """
    rows, plan, _ = mix(sized(table(spark, sf_dir, "documents")))
    words = F.col("high") - F.col("low")
    taken = plan.groupBy("row").agg(F.sum(words).alias("taken"), F.array_sort(F.collect_list(F.struct("slot", words.alias("words")))).alias("slots"))
    return rows.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", F.col("slots")[0]["slot"].alias("first_slot"), F.array_join(F.transform("slots", lambda s: F.concat_ws(":", s["slot"], s["words"])), ",").alias("slots"))
