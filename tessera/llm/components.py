"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("_u", "_v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least node around it."""
    both = edges.select("_u", "_v").unionByName(edges.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
    least = both.groupBy("_u").agg(F.min("_v").alias("_m")).select("_u", F.least("_u", "_m").alias("_m"))
    return (both.where("_v > _u").join(least, "_u")
            .select(F.col("_v").alias("_u"), F.col("_m").alias("_v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them (edges go downwards)."""
    least = edges.groupBy("_u").agg(F.min("_v").alias("_m"))
    tied = edges.join(least, "_u").where("_v > _m").select(F.col("_v").alias("_u"), F.col("_m").alias("_v"))
    return tied.unionByName(least.select("_u", F.col("_m").alias("_v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(_node, _component) for the nodes of ``links`` (_u, _v): the least node that can be reached.

    Links may be in any direction and repeated; those from a node to itself are left out. The
    edges of each round are written to the shared folder. Ends when a round changes nothing.
    """
    edges = links.select(F.greatest("_u", "_v").alias("_u"), F.least("_u", "_v").alias("_v")).where("_u > _v").distinct()
    edges = materialize(edges, "cc-0")
    state, k = _state(edges), 0
    while state[0]:
        k += 1
        edges = materialize(_small_star(_large_star(edges)), f"cc-{k}")
        new = _state(edges)
        if new == state:
            break
        state = new
    least = edges.select(F.col("_u").alias("_node"), F.col("_v").alias("_component"))
    return least.unionByName(edges.select(F.col("_v").alias("_node"), F.col("_v").alias("_component"))).distinct()
