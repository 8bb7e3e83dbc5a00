"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, few, join_back, scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node with a link to another one; the root is the component's smallest node.

    A round hooks each node's larger neighbours, then its smaller ones, to the smallest neighbour; the number of rounds
    grows with the logarithm of the number of nodes. A node's smallest neighbour is an aggregate joined back by
    join_back(), so that a node with very many links never meets them in one task. Each round is a scratch table, the
    one before it is deleted. No links: no rows. Null nodes and loops are left out; repeated links count once.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    edges = links.where(f"`{a}` <> `{b}`").select(high.alias("a"), low.alias("b")).distinct()
    edges = scratch(edges, "edges")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = join_back(both, least, "a", "n", 2 * state[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large if few(2 * state[0]) else scratch(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_back(large, least, "a", "n", 2 * state[0]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = scratch(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        drop(edges, large)
        edges, last = new, state
        state = _state(edges)
        if state == last:
            break
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
