"""Partitioned graphs: cut edges, one-hop ghosts, and the rows of local partition files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between partitions, with src_part and dst_part."""
    part = lambda end: vertices.select(F.col("vid").alias(end), F.col("part_id").alias(f"{end}_part"))
    return edges.join(part("src"), "src").join(part("dst"), "dst").where("src_part != dst_part").select("src", "dst", "elabel", "src_part", "dst_part")


def ghosts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """part_id, vid, label, owner: vertices of other partitions next to a partition's own."""
    cut = cut_edges(vertices, edges)
    seen = cut.select(F.col("src_part").alias("part_id"), F.col("dst").alias("vid")).union(cut.select("dst_part", "src")).distinct()
    return seen.join(vertices.select("vid", "label", F.col("part_id").alias("owner")), "vid").select("part_id", "vid", "label", "owner")


def has_ghosts(vertices: DataFrame, edges: DataFrame) -> bool:
    return bool(cut_edges(vertices, edges).limit(1).count())


def local_rows(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """file, owner, vid, label, adjacent (array of struct vid, elabel): a partition's own vertices and its ghosts.

    Own vertices have all their arcs, ghosts those to the partition's own.
    """
    arcs = edges.select("src", "dst", "elabel").union(edges.select("dst", "src", "elabel"))
    own = vertices.select(F.col("part_id").alias("file"), F.col("part_id").alias("owner"), "vid", "label")
    other = ghosts(vertices, edges).select(F.col("part_id").alias("file"), "owner", "vid", "label")
    owned = arcs.join(vertices.select(F.col("vid").alias("src"), F.col("part_id").alias("file")), "src").select("file", F.col("src").alias("vid"), F.col("dst").alias("to"), "elabel")
    inward = arcs.join(vertices.select(F.col("vid").alias("dst"), F.col("part_id").alias("file")), "dst").join(other.select("file", F.col("vid").alias("src")), ["file", "src"], "left_semi").select("file", F.col("src").alias("vid"), F.col("dst").alias("to"), "elabel")
    lists = owned.union(inward).groupBy("file", "vid").agg(F.array_sort(F.collect_list(F.struct("to", "elabel"))).alias("adjacent"))
    return own.union(other).join(lists, ["file", "vid"], "left").select("file", "owner", "vid", "label", F.coalesce("adjacent", F.array().cast("array<struct<to:bigint,elabel:int>>")).alias("adjacent"))


def distinct_arcs(*parts: DataFrame) -> DataFrame:
    """Union of arcs gathered from several partitions, every arc once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["src", "dst", "elabel"])


def without(arcs: DataFrame, known: DataFrame) -> DataFrame:
    """Arcs whose end the receiver (known: vid) doesn't hold yet."""
    return arcs.join(known.select(F.col("vid").alias("dst")), "dst", "left_anti").select(arcs.columns)
