"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapane.llm.common import scratch, staged


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """Every node's neighbours go to the least of them and the node.

    Large star: neighbours above the node, over both directions.  Small star:
    neighbours below it and the node itself.  The minimum is combined map-side;
    the join behind it is one that adaptive execution can split for a node with
    very many neighbours.
    """
    if large:
        pairs = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    met = pairs.join(least, "u")
    out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v); root is the least node it reaches.

    Each round is written to the shared folder, and the one before dropped.  Done
    when a round changes nothing: every node then points at its root.
    """
    with scratch():
        state = staged(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        mark = None
        for _ in range(most_rounds):
            now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if tuple(now) == mark or now[0] == 0:
                return staged(state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), lasting=True)
            mark = tuple(now)
            state = staged(_starred(_starred(state, large=True), large=False))
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
