"""Connected components of a link table, by alternating large-star and small-star rounds.

Only links between different nodes are kept; nothing is collected.  Each round is two aggregations
(with map-side combining, so a node of many links is no hot key) and two joins, whose result is
checkpointed.  Rounds end when the links no longer change, after about log2 of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MOST_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def roots(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link, root being the least node of its component. links: u, v (long)."""
    edges = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            break
        # Large star: every larger neighbour of a node is linked to the least of its neighbourhood.
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every smaller neighbour of a node, and the node, are linked to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small)
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    # Settled links are stars around the roots.
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
