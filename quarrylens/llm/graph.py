"""Connected components of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.operators.lineage import cut

MAX_ROUNDS = 40


def _state(edges: DataFrame) -> tuple:
    """A digest of an edge set that is the same only if nothing changed."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the smallest node reachable.

    Each round points every node's larger neighbours, then its smaller ones, at its smallest
    neighbour; it takes about log(n) rounds.  The smallest neighbours are pre-aggregated and
    written before they are joined back, so a node with very many links is an ordinary skewed
    join, which adaptive execution splits.
    """
    edges = cut(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    for _ in range(MAX_ROUNDS):
        state = _state(edges)
        if state == before or state[0] == 0:
            break
        before = state
        # Large star: neighbours above u point at the smallest of u and its neighbours.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        smallest = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = (
            both.filter("v > u").join(smallest, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        )
        large = cut(large)
        # Small star: u and its smaller neighbours point at the smallest of them.
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        moved = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
    else:
        raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return found.unionByName(roots)
