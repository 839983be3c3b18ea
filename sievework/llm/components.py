"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (u, v): link neighbours to the least of the neighbourhood.

    The least neighbour comes from a grouped minimum (partial sums before the shuffle), then joins back;
    a node with very many neighbours is split by the adaptive skew join.
    """
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = both.join(least, "u")
    if large:
        return near.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    moved = near.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def connected_components(edges: DataFrame, name: str = "cc", rounds: int = 50) -> DataFrame:
    """(node, root) for every node of edges (u, v) of any ordered type; root is the least node it is linked to.

    Null ends and self links are ignored; repeated links count once; no edges give no rows.
    """
    now = cut(edges.filter("u is not null and v is not null and u != v").select("u", "v").distinct(), name)
    seen = None
    for _ in range(rounds):
        before, now = now, cut(_star(_star(now, True), False), name)
        discard(before)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots).distinct()
