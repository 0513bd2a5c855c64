"""Readers of graph text formats. Each gives (vertices, edges); fields are separated by any white space, lines have any length.

``txt``    ``t # k``, ``v id label``, ``e from to elabel``; the first graph only.
``adj``    METIS: a header, then for each vertex ``label (to elabel)*``, all 1-based.
``ladjp``  a folder of files 0 to K-1: a header, then ``part gvid label (to_local elabel)*``, 0-based; own rows, then ghosts.
``adjp``   ``adj`` and a file with a partition id for each vertex.
Self loops and repeated edges are dropped. Types may be given with or without a leading dash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import split_fields
from ..operators.graph import clean_edges, invalid_arcs

TYPES = ("txt", "adj", "adjp", "ladjp")


def file_type(name: str) -> str:
    kind = name.removeprefix("-")
    if kind not in TYPES:
        raise ValueError(f"unknown filetype {name}")
    return kind


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """at (0, 1, ... in file order), f (fields) of the lines of a file, or of a folder's files in the order of their part numbers and names.

    Spark scans files and their blocks in any order. So lines are numbered by file, block and place in the block, from the blocks' line
    counts; no task sees a whole file.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(meta["file_path"].alias("_file"), meta["file_block_start"].alias("_block"), F.monotonically_increasing_id().alias("_id"), split_fields("value").alias("f"))
    blocks = lines.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    number = F.regexp_extract("_file", r"part-(\d+)[^/]*$", 1).try_cast("long")
    before = Window.orderBy(number.asc_nulls_first(), "_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of the scan
    base = blocks.select("_file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    return lines.join(base, ["_file", "_block"]).select((F.col("_base") + F.col("_id")).alias("at"), "f")


def _pairs(first: int) -> F.Column:
    """Struct (to, elabel) of every two fields from a place on."""
    n = F.floor((F.size("f") - first) / 2).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda k: F.struct(F.get("f", first + 2 * k).cast("long").alias("to"), F.get("f", first + 2 * k + 1).cast("int").alias("elabel")))


def read_txt(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = numbered_lines(spark, path)
    starts = [r.at for r in rows.where(F.get("f", 0) == "t").orderBy("at").limit(2).collect()]
    if len(starts) > 1:
        rows = rows.where(F.col("at") < starts[1])
    f = lambda k, kind: F.get("f", k).try_cast(kind)
    vertices = rows.where((F.get("f", 0) == "v") & (F.size("f") >= 3)).select(f(1, "long").alias("vid"), f(2, "int").alias("label"))
    edges = rows.where((F.get("f", 0) == "e") & (F.size("f") >= 4)).select(f(1, "long").alias("src"), f(2, "long").alias("dst"), f(3, "int").alias("elabel"))
    if bad := invalid_arcs(vertices, edges).limit(1).collect():
        raise ValueError(f"Format Error: edge {bad[0].src} {bad[0].dst} has an end that is no vertex")
    return vertices, clean_edges(edges)


def read_adj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A blank line is a vertex with label 0 if a vertex comes after it, and nothing at the end."""
    rows = numbered_lines(spark, path).where("at > 0").withColumn("vid", F.col("at") - 1)
    last = rows.where("size(f) > 0").agg(F.max("vid")).first()[0]
    rows = rows.where(F.col("vid") <= F.lit(-1 if last is None else last))
    vertices = rows.select("vid", F.coalesce(F.get("f", 0).try_cast("int") - 1, F.lit(0)).alias("label"))
    edges = rows.select(F.col("vid").alias("src"), F.inline(_pairs(1))).select("src", (F.col("to") - 1).alias("dst"), (F.col("elabel") - 1).alias("elabel"))
    return vertices, clean_edges(edges)


def read_partition_file(spark: SparkSession, path: str) -> DataFrame:
    return numbered_lines(spark, path).where(F.size("f") > 0).select(F.col("at").alias("vid"), F.get("f", 0).cast("int").alias("part_id"))


def read_adjp(spark: SparkSession, path: str, partition_path: str) -> tuple[DataFrame, DataFrame]:
    vertices, edges = read_adj(spark, path)
    return vertices.join(read_partition_file(spark, partition_path), "vid"), edges


def read_ladjp(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files are read whole, a task each; ghosts' rows only name vertices."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).cast("int").alias("file"), F.split("value", "\n").alias("lines"))
    rows = files.select("file", F.posexplode("lines").alias("at", "line")).where("at > 0").select("file", (F.col("at") - 1).cast("long").alias("local"), split_fields("line").alias("f")).where("size(f) >= 3").cache()
    own = rows.where(F.get("f", 0).cast("int") == F.col("file"))
    vertices = own.select(F.get("f", 1).cast("long").alias("vid"), F.get("f", 2).cast("int").alias("label"), F.col("file").alias("part_id"))
    names = rows.select("file", F.col("local").alias("to"), F.get("f", 1).cast("long").alias("dst"))
    edges = own.select("file", F.get("f", 1).cast("long").alias("src"), F.inline(_pairs(3))).join(names, ["file", "to"]).select("src", "dst", "elabel")
    return vertices, clean_edges(edges)


def read_graph(spark: SparkSession, kind: str, path: str, partition_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    kind = file_type(kind)
    if kind == "adjp":
        if partition_path is None:
            raise ValueError("adjp needs a partition file")
        return read_adjp(spark, path, partition_path)
    return {"txt": read_txt, "adj": read_adj, "ladjp": read_ladjp}[kind](spark, path)
