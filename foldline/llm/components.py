"""Connected components of a large, sparse graph, with joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.llm.common import forget, stored

SMALL = 250_000  # edges up to which the least neighbours are broadcast instead of shuffled


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component) of all nodes that edges (a, b) with a <> b name: component is the smallest node reachable.

    Alternates large-star and small-star steps: each node's neighbours are hung on the smallest of
    them, first the larger neighbours, then the smaller ones, until nothing changes. Each step is a
    minimum for each node (combined before the shuffle) and a join; no neighbourhood is collected.
    Each round's edges are written to the shared folder. Loops and repeated edges are harmless.
    """
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        n = edges.count()
        hint = F.broadcast if n <= SMALL else lambda df: df
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = stored(both.filter("b > a").join(hint(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = stored(large.join(hint(low), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct())
        forget(edges, large)
        edges = small
        # A forest of stars: each node has one smaller neighbour, which has none.
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter("below + above > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"components are not found after {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
