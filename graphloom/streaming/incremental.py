"""Mining a growing graph: a stream of edges, mined again after every micro-batch that adds some.

The mined problem itself is static; this is Structured Streaming's foreachBatch around it. Batches are written with their id, so a
batch that is run again after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.miner import Mined, mine


def mine_stream(
    edges: DataFrame, vertices: DataFrame, store: str, checkpoint: str, minsup: int, max_edges: int, put: Callable[[int, Mined], None], available_now: bool = True
) -> StreamingQuery:
    """Starts a query over a stream of edges (src, dst, elabel); put gets the batch's number and all patterns of the graph so far."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.select("src", "dst", "elabel").write.mode("overwrite").parquet(f"{store}/batch={number}")
        spark = rows.sparkSession
        seen = spark.read.option("basePath", store).parquet(f"{store}/batch=*").where(f"batch <= {number}").select("src", "dst", "elabel")
        put(number, mine(spark, vertices, seen, minsup, max_edges=max_edges))

    writer = edges.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
