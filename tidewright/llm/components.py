"""Connected components by alternating large-star and small-star steps (MapReduce style)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.tables import removed, written


def _star(pairs: DataFrame, keep) -> DataFrame:
    """Each u of (u, v) and its least neighbour m, joined to the pairs that keep selects: (larger, m)."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(least, "u").filter(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """Per node of edges: node, component (the least node reachable). Edges may repeat, point either way or be loops.

    Each round is aggregates and joins over the edges, written to the shared folder; the number of
    rounds grows with the logarithm of the longest path.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges, before = written(edges, "edges"), None
    for _ in range(max_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out.written_to = edges.written_to
            return out
        before = tuple(state)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "v > u").distinct()
        # Small star: edges point from the larger to the smaller node; the node itself joins its least neighbour.
        small = _star(large.unionByName(large.select("u", F.col("u").alias("v"))), "true").distinct()
        edges, last = written(small, "edges"), edges
        removed(last)
    raise RuntimeError("components didn't settle")
