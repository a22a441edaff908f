"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.runtime import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links every neighbour of a node that is larger (large) or not (small) to the least of its neighbourhood."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) for every node with an edge (u, v); the component is its smallest node.

    A round is two shuffles on the node; both stars keep the number of edges from growing. Every
    round is cut with checkpoint(), so a lost executor costs one round at most. Self-loops and nulls give nothing.
    """
    low, high = F.least("u", "v"), F.greatest("u", "v")
    now = edges.where("u is not null and v is not null and u != v").select(high.alias("u"), low.alias("v")).distinct()
    now = cut(now)
    mark = None
    for _ in range(most_rounds):
        now = cut(_star(_star(now, True), False))
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == mark:
            break
        mark = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
