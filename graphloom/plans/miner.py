"""Frequent-subgraph mining: level by level, all patterns of a level in one job.

On the driver are the codes of the frequent patterns and the next level's candidates: least codes by one frequent edge more. That
suits thousands of patterns, not millions. On the executors are embeddings. A level joins them with the arcs (hashed by src once and
kept so) and looks the candidates up, writes the embeddings of the next level, and counts distinct images; supports come back, infrequent
patterns' embeddings are left out of the next join.
"""

from __future__ import annotations

import logging
import time
import uuid
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dfscode
from ..operators import extend, support
from ..operators.graph import arcs as arcs_of

log = logging.getLogger(__name__)


@dataclass
class Mined:
    """patterns: (code, support) of every frequent pattern; seconds and embeddings by level."""

    patterns: list[tuple[dfscode.Code, int]]
    levels: list[dict] = field(default_factory=list)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(dfscode.format_code(c), len(c), dfscode.node_count(c), n) for c, n in sorted(self.patterns, key=lambda p: dfscode.code_key(p[0]))]
        return spark.createDataFrame(rows, "code string, n_edges int, n_vertices int, support long")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (tests), one in the warehouse."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_levels").rstrip("/")


def materialise(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A written table in the shared folder, and its path: lineage is cut and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "lz4").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def single_edge_codes(arcs: DataFrame) -> DataFrame:
    """from_label, edge_label, to_label, support of every one-edge pattern."""
    roots = extend.forward_roots(arcs)
    by = ["from_label", "edge_label", "to_label"]
    ends = roots.select(
        F.col("src_label").alias("from_label"), F.col("elabel").alias("edge_label"), F.col("dst_label").alias("to_label"), F.inline(F.array(F.struct(F.lit(0).alias("pos"), F.col("src").alias("vid")), F.struct(F.lit(1).alias("pos"), F.col("dst").alias("vid"))))
    )
    return ends.distinct().groupBy(*by, "pos").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.min("n").alias("support"))


def frequent_arcs(arcs: DataFrame, triples: set[tuple[int, int, int]]) -> DataFrame:
    """Arcs whose labels, either way round, are a frequent one-edge pattern (labels are few: the table is a row a frequent edge pattern)."""
    both = {(a, e, b) for a, e, b in triples} | {(b, e, a) for a, e, b in triples}
    table = arcs.sparkSession.createDataFrame(sorted(both) or [(0, 0, 0)], "src_label int, elabel int, dst_label int")
    kept = arcs.join(table, ["src_label", "elabel", "dst_label"], "left_semi").select(arcs.columns)
    return kept if both else kept.where("1 = 0")


#: Rows of candidates that are broadcast (a few MB); more are joined as the optimiser sees fit.
BROADCAST_STEPS = 100_000


def small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_STEPS else table


def mine(
    spark: SparkSession, vertices: DataFrame, edges: DataFrame, minsup: int, max_edges: int | None = None, embedding_budget: int | None = None, simple: bool = True
) -> Mined:
    """All frequent patterns with exact supports. max_edges bounds their size; a level that would have more embeddings than
    embedding_budget stops with an error before it is made. simple=False also finds patterns with several edges between two vertices."""
    if minsup < 1:
        raise ValueError("minsup must be at least 1")
    began = time.time()
    arcs = arcs_of(vertices, edges).persist(StorageLevel.MEMORY_AND_DISK)
    first = {(r.from_label, r.edge_label, r.to_label): r.support for r in single_edge_codes(arcs).where(F.col("support") >= minsup).collect()}
    out = Mined([(((0, 1, *t),), n) for t, n in first.items()], [{"edges": 1, "frequent": len(first), "seconds": time.time() - began}])
    triples = set(first) | {(b, e, a) for a, e, b in first}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept_arcs = frequent_arcs(arcs, set(first))
    useful = extend.by_src(kept_arcs, parts).persist(StorageLevel.MEMORY_AND_DISK)
    codes: dict[int, dfscode.Code] = dict(enumerate(((0, 1, *t),) for t in sorted(first)))
    seeds = spark.createDataFrame([(k, *c[0][2:]) for k, c in codes.items()] or [(0, 0, 0, 0)], "pattern int, src_label int, elabel int, dst_label int")
    embeddings = extend.forward_roots(kept_arcs).join(seeds, ["src_label", "elabel", "dst_label"]).select("pattern", F.col("src").alias("v0"), F.col("dst").alias("v1"))
    level, written = 1, ""
    while codes and (max_edges is None or level < max_edges):
        began = time.time()
        steps, children = [], {}
        for k, code in codes.items():
            for i, j, _, e, b in dfscode.candidates(code, triples, simple):
                children[len(children)] = (*code, (i, j, dfscode.labels(code)[i], e, b))
                steps.append((k, len(children) - 1, i, j, e, b))
        if not steps:
            break
        table = small(spark.createDataFrame(steps, "pattern int, child int, i int, j int, edge_label int, to_label int"), len(steps))
        spots = sorted({(k, i, dfscode.node_count(codes[k])) for k, _, i, *_ in steps})
        positions = small(spark.createDataFrame(spots, "pattern int, i int, nodes int"), len(spots))
        new = extend.grow(embeddings, useful, positions, table)
        if embedding_budget is not None and extend.growth_bound(embeddings, useful, positions, table) > embedding_budget and (n := new.count()) > embedding_budget:
            raise MemoryError(f"level {level + 1} has {n} embeddings, more than {embedding_budget}; lower max_edges or raise minsup")
        grown, path = materialise(new, f"level-{level + 1}")
        if written:
            delete(spark, written)  # the level before
        written = path
        counted = {r.pattern: r.support for r in support.support(grown).where(F.col("support") >= minsup).collect()}
        codes = {k: children[k] for k in counted}
        out.patterns += [(children[k], n) for k, n in counted.items()]
        level += 1
        out.levels.append({"edges": level, "candidates": len(steps), "frequent": len(codes), "seconds": time.time() - began})
        log.info("level %s", out.levels[-1])
        kept = spark.createDataFrame([(k,) for k in codes] or [(-1,)], "pattern int")
        embeddings = grown.join(kept, "pattern", "left_semi")
    if written:
        delete(spark, written)
    useful.unpersist()
    arcs.unpersist()
    return out


class Miner:
    """The same as an object: set a graph, a support and a sink, then run."""

    def __init__(self, spark: SparkSession, max_edges: int | None = None) -> None:
        self.spark, self.max_edges, self.minsup, self.graph, self.sink, self.result = spark, max_edges, -1, None, None, None

    def set_graph(self, vertices: DataFrame, edges: DataFrame) -> Miner:
        self.graph = (vertices, edges)
        return self

    def set_min_support(self, minsup: int) -> Miner:
        self.minsup = minsup
        return self

    def set_output(self, sink) -> Miner:
        self.sink = sink
        return self

    def run(self) -> Mined:
        if self.graph is None:
            raise ValueError("no graph is set")
        self.result = mine(self.spark, *self.graph, self.minsup, self.max_edges)
        if self.sink is not None:
            self.sink.put(self.result.frame(self.spark))
        return self.result

    def report(self) -> dict:
        return {"total_frequent_graphs": len(self.result.patterns), "total_time": sum(x["seconds"] for x in self.result.levels)}
