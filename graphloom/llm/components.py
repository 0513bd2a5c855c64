"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, scratch


def _step(edges: DataFrame, both: DataFrame, name: str) -> DataFrame:
    """The least neighbour of each src goes to all neighbours: rows of edges as (dst, least).

    Least neighbours are a written table, so the join is one of two plain shuffles, and a hub's rows are split by the skew-join rule.
    """
    least = scratch(both.groupBy("src").agg(F.min("dst").alias("m")), f"{name}-least")
    moved = edges.join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved, least


def connected_components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of links (src, dst long) that is not its root.

    A round is a large star (every larger neighbour of a node moves to the node's least neighbour or itself) and a small star
    (every smaller neighbour, and the node, move to the least of them), each written to the shared folder. Rounds go on until
    one changes nothing, which takes about the logarithm of the nodes. Self links and repeated links are dropped.
    """
    down = lambda e: e.where("src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    sign = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst"))).first())
    edges = scratch(down(links).distinct(), "cc-0")
    seen, k = sign(edges), 0
    while seen[0]:
        k += 1
        up = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        own = edges.select(F.col("dst").alias("src"), "dst")  # a node is a neighbour of itself; others than dst have a smaller one
        moved, least = _step(up, edges.unionByName(up).unionByName(own), f"cc-{k}-large")
        large = scratch(down(moved).distinct(), f"cc-{k}-large")
        drop(edges, least)
        moved, least = _step(large, large, f"cc-{k}-small")
        edges = scratch(down(moved).unionByName(least.select("src", F.col("m").alias("dst"))).distinct(), f"cc-{k}")
        drop(large, least)
        now = sign(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
