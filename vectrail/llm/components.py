"""Connected components by alternating star steps, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.llm.skew import join_counted
from vectrail.session import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node that is reachable.

    Each round links every larger neighbour of a node to the smallest node next to
    it, then every smaller one likewise, until each component is a star around its
    root: about log(nodes) rounds. A node's minimum is an aggregate that is joined
    back; that of a node with very many edges is broadcast, so they are never
    gathered in one place. Rounds are checkpointed.
    """
    linked = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    current = checkpointed(linked.distinct())
    state = None
    while True:
        mark = F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))
        now = current.agg(F.count("*"), mark).first()
        if now == state:
            return current.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state, edge_count = now, now[0]
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = checkpointed(
            join_counted(both, least, "u", 2 * edge_count)
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        below = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = (
            join_counted(large, below, "u", edge_count)
            .where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).unionByName(below.select("u", F.col("m").alias("v")))
        current = checkpointed(small.distinct())
