"""Connected components of a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.joins import SENT

from .common import keep, salted_join


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b: long): root is the least node of its component.

    Alternates large-star and small-star steps (Kiveris et al., SoCC 2014); each round is written to the shared folder
    and rounds grow with the logarithm of the longest path. A hub's links spread over tasks. Self-links and repeated
    links are fine, nulls are not.
    """

    def met(rows: DataFrame, least: DataFrame, n: int) -> DataFrame:
        """rows with the least neighbour of their u, of n links at most."""
        return rows.join(F.broadcast(least), "u") if n <= SENT else salted_join(keep(rows, "star"), least, ["u"])

    high, low = F.greatest("a", "b"), F.least("a", "b")
    now = keep(links.select(high.alias("u"), low.alias("v")).where("u > v").distinct(), "links")
    mark = None
    while True:
        n = 2 * now.count()
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = met(both.where("v > u"), least, n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        if n > SENT:
            large = keep(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = met(large, least, n)
        small = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = keep(small, "links")
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.shiftright(F.xxhash64("u", "v"), 24)), F.lit(0))).first()
        if seen == mark:
            break
        mark = seen
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
