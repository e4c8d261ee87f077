"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (u, v) is linked with.

    Large stars and small stars take turns until the edges form stars around the roots; the rounds
    grow with the logarithm of the nodes. Every round is cut by a checkpoint. Loops and repeated
    edges are dropped; an empty table gives no rows.
    """

    def tidy(e: DataFrame) -> DataFrame:
        return e.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def told(e: DataFrame) -> tuple:
        """How many edges there are, and sums of two hashes of them: equal for equal tables."""
        h = [F.xxhash64("u", "v", F.lit(x)).cast("decimal(20,0)") for x in (1, 2)]
        return tuple(e.agg(F.count("*"), *map(F.sum, h)).first())

    now = cut(tidy(edges))
    mark = told(now)
    while True:
        # Large star: every larger neighbour of u is linked to u's smallest neighbour, or u.
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = tidy(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        # Small star: u and its smaller neighbours are linked to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = cut(tidy(small))
        mark, last = told(after), mark
        now = after
        if mark == last:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
