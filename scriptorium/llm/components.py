"""Connected components of a graph of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.frames import forget, materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component) of the nodes of edges (u, v): the least node that can be reached.

    Large-star and small-star contractions take turns until the edges are stars.
    Each round's edges are written in the shared folder.  Neighbours are never
    gathered: their least comes from an aggregate, and is joined back, so a node
    with very many neighbours is spread over tasks.
    """
    edges = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = _both_ways(edges)
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # each edge now leads from a node to a smaller one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        last, edges = edges, materialise(small.filter("u <> v").distinct(), "edges")
        forget(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
        before = now
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
