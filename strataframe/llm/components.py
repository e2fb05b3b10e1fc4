"""Connected components by alternating star contractions, every round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strataframe.llm.shared import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Least node reachable from every node that has an edge.

    ``edges`` has two columns of one orderable type. Returns ``node`` and ``root``; nodes
    without an edge to another node are not returned. A round points each node at the least
    neighbour of its neighbours, in two shuffled aggregates and joins; a hub is one row of the
    aggregate, and its edges are spread by adaptive skew handling. The rounds grow with the
    logarithm of the longest path.
    """
    a, b = edges.columns
    pairs = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct()
    pairs = scratch.write(pairs, "edges")
    before = None
    while True:
        # Large star: from each node, its larger neighbours go to the least of its neighbourhood.
        both = pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(
            pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        large = scratch.write(large.where("lo < hi").distinct(), "large")
        # Small star: a node and its smaller neighbours go to the least of them.
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(
            F.explode(F.array(F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")),
                              F.struct(F.col("m").alias("lo"), F.col("hi")))).alias("e")).select("e.*")
        pairs = scratch.write(small.where("lo < hi").distinct(), "small")
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        pairs.select("lo", "lo").distinct())
