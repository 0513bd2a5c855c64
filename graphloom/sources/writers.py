"""Sinks: pattern files and counts, and graphs in the readers' formats."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dfscode
from ..operators.graph import arcs as arcs_of
from ..operators.graph import clean_edges
from ..operators.partitioned import local_rows
from .readers import read_adjp


class PatternSink(Protocol):
    def put(self, patterns: DataFrame) -> None: ...
    def count(self) -> int: ...


class CountSink:
    """Only counts (output ``-``)."""

    def __init__(self) -> None:
        self._n = 0

    def put(self, patterns: DataFrame) -> None:
        self._n += patterns.count()

    def count(self) -> int:
        return self._n


class FileSink:
    """Text files of ``code:support`` lines, or of codes alone; a call replaces what was there."""

    def __init__(self, path: str, with_support: bool = True) -> None:
        self.path, self.with_support, self._n = path, with_support, 0

    def put(self, patterns: DataFrame) -> None:
        line = F.concat(F.col("code"), F.lit(":"), F.col("support").cast("string")) if self.with_support else F.col("code")
        patterns.select(line.alias("value")).write.mode("overwrite").text(self.path)
        self._n = patterns.count()

    def count(self) -> int:
        return self._n


def canonical_text(vertex_labels: list[int], edges: list[tuple[int, int, int]]) -> str:
    """A pattern graph as the text of its least code."""
    return dfscode.format_code(dfscode.min_dfs_code(vertex_labels, edges))


def write_txt(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    v = vertices.select(F.lit(0).alias("k"), F.col("vid").alias("a"), F.lit(0).cast("long").alias("b"), F.concat_ws(" ", F.lit("v"), "vid", "label").alias("value"))
    e = clean_edges(edges).select(F.lit(1).alias("k"), F.col("src").alias("a"), F.col("dst").alias("b"), F.concat_ws(" ", F.lit("e"), "src", "dst", "elabel").alias("value"))
    head = vertices.sparkSession.range(1).select(F.lit(-1).alias("k"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit("t # 0").alias("value"))
    head.union(v).union(e).orderBy("k", "a", "b", "value").select("value").write.mode("overwrite").text(path)


def write_adj(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """METIS lines, 1-based; vids must be 0, 1, ..."""
    a = arcs_of(vertices, edges).groupBy(F.col("src").alias("vid")).agg(F.array_sort(F.collect_list(F.struct("dst", "elabel"))).alias("adjacent"))
    line = F.concat_ws(" ", (F.col("label") + 1).cast("string"), F.array_join(F.transform("adjacent", lambda x: F.concat_ws(" ", x["dst"] + 1, x["elabel"] + 1)), " "))
    rows = vertices.join(a, "vid", "left").select("vid", F.trim(line).alias("value"))
    head = vertices.sparkSession.createDataFrame([(-1, f"{vertices.count()} {clean_edges(edges).count()} 011")], "vid long, value string")
    head.union(rows).orderBy("vid").select("value").write.mode("overwrite").text(path)


def ladjp_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """file, at, value: lines of every partition's file; own rows by vid, then ghosts by vid, ends as line places."""
    from pyspark.sql import Window

    rows = local_rows(vertices, clean_edges(edges))
    place = F.row_number().over(Window.partitionBy("file").orderBy((F.col("owner") != F.col("file")).cast("int"), "vid")) - 1  # a partition is a file
    rows = rows.withColumn("at", place)
    names = rows.select("file", F.col("vid").alias("to"), F.col("at").alias("to_at"))
    ends = rows.select("file", "vid", F.inline("adjacent")).join(names, ["file", "to"]).groupBy("file", "vid").agg(F.array_sort(F.collect_list(F.struct("to_at", "elabel"))).alias("ends"))
    line = F.concat_ws(" ", "owner", "vid", "label", F.array_join(F.transform(F.coalesce("ends", F.array().cast("array<struct<to_at:int,elabel:int>>")), lambda x: F.concat_ws(" ", x["to_at"], x["elabel"])), " "))
    body = rows.join(ends, ["file", "vid"], "left").select("file", F.col("at").cast("long").alias("at"), F.trim(line).alias("value"))
    head = rows.groupBy("file").agg(F.count(F.lit(1)).cast("string").alias("value")).select("file", F.lit(-1).cast("long").alias("at"), "value")
    return head.union(body)


def write_ladjp(vertices: DataFrame, edges: DataFrame, path: str) -> list[str]:
    """Folder path/<part>, one file each, as Spark names them; the files in order."""
    lines = ladjp_lines(vertices, edges)
    out = lines.repartition("file").sortWithinPartitions("file", "at").select("file", "value")
    out.write.mode("overwrite").partitionBy("file").text(path)
    return rename_parts(vertices.sparkSession, path)


def rename_parts(spark: SparkSession, path: str) -> list[str]:
    """Moves path/file=k/part-* to path/k, on any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = []
    for folder in fs.listStatus(root):
        name = folder.getPath().getName()
        if name.startswith("file="):
            for part in fs.listStatus(folder.getPath()):
                if part.getPath().getName().startswith("part-"):
                    to = jvm.org.apache.hadoop.fs.Path(root, name[5:])
                    fs.rename(part.getPath(), to)
                    done.append(to.toString())
            fs.delete(folder.getPath(), True)
        elif name.startswith("_"):
            fs.delete(folder.getPath(), True)
    return sorted(done)


def convert_to_partitions(spark: SparkSession, adj: str, partition_file: str, out: str) -> list[str]:
    """METIS graph and partition file to a folder of local partition files."""
    return write_ladjp(*read_adjp(spark, adj, partition_file), out)
