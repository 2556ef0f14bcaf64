"""Connected components of a distributed edge list.

Alternating large-star and small-star rounds: every round keeps the components
and moves each node's edges to smaller ids, until all edges form stars round
the smallest id.  Minima are taken by partial aggregation and joined back, so a
node with very many edges is split by the skew join and never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import materialize, release


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root): each node that has an edge to another, and the smallest id reachable.

    Null ends and loops are dropped; repeated edges count once; no edges give
    an empty frame.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v")
    state, seen = materialize(pairs.distinct(), "edges"), None
    while True:
        found = state.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).first()
        if seen == tuple(found) or not found.n:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = tuple(found)
        after = materialize(_small_star(_large_star(state)), "edges")
        release(state)
        state = after


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the node's smallest neighbour or itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).repartition("m", "u")
    moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).repartition("m", "u")
    joined = edges.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return joined.distinct()
