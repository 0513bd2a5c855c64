"""Graphs as tables. vertices: vid long, label int (part_id int). edges: src, dst long, elabel int, one row an undirected edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean_edges(edges: DataFrame) -> DataFrame:
    """src < dst, no self loops, every (src, dst, elabel) once."""
    ordered = edges.where("src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "elabel")
    return ordered.dropDuplicates(["src", "dst", "elabel"])


def arcs(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Both directions of every clean edge with its ends' labels: src, dst, elabel, src_label, dst_label."""
    e = clean_edges(edges)
    name = lambda end: vertices.select(F.col("vid").alias(end), F.col("label").cast("int").alias(f"{end}_label"))
    known = e.join(name("src"), "src").join(name("dst"), "dst").select("src", "dst", F.col("elabel").cast("int").alias("elabel"), "src_label", "dst_label")
    turned = known.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "elabel", F.col("dst_label").alias("src_label"), F.col("src_label").alias("dst_label"))
    return known.unionByName(turned)


def edge_ids(arcs_: DataFrame) -> DataFrame:
    """arcs with eid: equal for both directions of an edge and for no others (the triple of its ends and label)."""
    return arcs_.withColumn("eid", F.struct(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "elabel"))


def edge_size(arcs_: DataFrame) -> int:
    return edge_ids(arcs_).select("eid").distinct().count()


def invalid_arcs(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no vertex."""
    ids = vertices.select("vid")
    bad = edges.join(ids, F.col("src") == F.col("vid"), "left_anti")
    rest = edges.join(ids, F.col("src") == F.col("vid"), "left_semi").join(ids, F.col("dst") == F.col("vid"), "left_anti")
    return bad.unionByName(rest)


def degrees(vertices: DataFrame, arcs_: DataFrame) -> DataFrame:
    d = arcs_.groupBy(F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("degree"))
    return vertices.select("vid").join(d, "vid", "left").select("vid", F.coalesce("degree", F.lit(0)).alias("degree"))


def delete_vertices(vertices: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph without the vertices of gone (vid) and their edges."""
    gone = gone.select("vid")
    kept = edges.join(gone, F.col("src") == F.col("vid"), "left_anti").join(gone, F.col("dst") == F.col("vid"), "left_anti")
    return vertices.join(gone, "vid", "left_anti"), kept


def find_arcs(arcs_: DataFrame, ends: DataFrame) -> DataFrame:
    """Arcs of the pairs (src, dst) in ends."""
    return arcs_.join(ends.select("src", "dst").distinct(), ["src", "dst"], "left_semi")


def encode_labels(rows: DataFrame, column: str, into: str = "label") -> DataFrame:
    """rows with an int for each distinct value of column, in the values' order (a table of values, joined back)."""
    from .ranking import dense_numbers

    return rows.join(dense_numbers(rows.select(column).distinct(), column, into), column)
