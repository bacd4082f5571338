"""Connected components of an edge table, by alternating large-star and small-star.

Each round is two aggregates and two joins over edges; the edges end as one
``(node, root)`` each.  Rounds are written to the shared folder.  Nothing but two
numbers a round, which tell whether the edges still change, reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.scratch import Scratch

#: Edges up to which a round's least neighbours, no more than twice as many, are broadcast.
BROADCAST_EDGES = 200_000


def components(edges: DataFrame, work: Scratch) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b) but the roots; the root is a component's least node."""
    few = lambda t: F.broadcast(t) if said[0] <= BROADCAST_EDGES else t
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = work.keep(edges.where("a <> b").select(high, low).distinct())
    told = None
    while True:
        said = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if said == told or not said[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        told = said
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(few(least), "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(few(least), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        before, now = now, work.keep(small)
        work.drop(before)
