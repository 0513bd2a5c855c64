"""Supports of stars at hubs without their embeddings: a vertex of degree d has about d**k of them, but only domains count.

On a graph without parallel edges a neighbour is reached by one edge, so leaves of different (edge label, vertex label) never
compete. A vertex is a centre if it has as many neighbours of each kind as the star has leaves; the images of a leaf are
all centres' neighbours of its kind.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def star_support(arcs: DataFrame, centre: int, leaves: list[tuple[int, int]]) -> DataFrame:
    """support of the star with a centre label and leaves (edge label, vertex label)."""
    want = Counter(leaves)
    kind = lambda e, b: (F.col("elabel") == e) & (F.col("dst_label") == b)
    near = arcs.where((F.col("src_label") == centre) & reduce(lambda a, b: a | b, [kind(*k) for k in want]))
    enough = reduce(lambda a, b: a & b, [F.count_if(kind(*k)) >= n for k, n in want.items()])
    centres = near.groupBy("src").agg(enough.alias("ok")).where("ok").select("src")
    seen = near.join(centres, "src", "left_semi").select("elabel", "dst_label", "dst").distinct().groupBy("elabel", "dst_label").agg(F.count(F.lit(1)).alias("n"))
    sizes = seen.select("n").union(centres.agg(F.count(F.lit(1)).alias("n")))
    return sizes.agg(F.min("n").alias("support"))
