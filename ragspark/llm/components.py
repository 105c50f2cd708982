"""Connected components of a graph given as a table of edges, by alternating large and small stars.

Each half round hangs the neighbours of every node on the smallest of them: first those above the node, then those
below it. The edges end as one star per component. Nodes and edges stay distributed; the driver sees two numbers per
round. Every round is a stored table, so a lost executor costs one half round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of the ``a``, ``b`` edges; loops are allowed."""
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = stored(edges.select(high, low).where("a <> b").distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = stored(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                       .where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        below = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(below.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b") % 1000003), F.lit(0)).alias("s")).first()
    return row["n"], row["s"]
