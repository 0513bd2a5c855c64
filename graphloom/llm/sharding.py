"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, with DataFrame functions only.

The ring has 2**14 cells. Every shard has ``virtual`` nodes on it, every row a key, the md5 of doc_id and text checksum; a
row belongs to the first node clockwise from its cell. A shard's load is bounded. With ``slack`` 0 the bounds are the rows over the shards,
one more for the first shards if it does not divide, so counts differ by one at most (law ``rows``); with more slack,
(1 + slack) times the mean, fewer rows move when shards are added. Rows in key order fill their own shard first; rows beyond
its bound continue clockwise to the next shard with room.

Only the counts of the ring's cells, as many for any input, reach the driver, which walks the ring and hands back for each
cell which ranks go to which shard. Rows are ranked within their cell. Slots count the rows of a shard in key order.

Null texts count as empty, null doc_ids are a key like any other. The law ``rows`` goes before groups: equal rows and rows with equal texts
get slots of their own and may lie in different shards. Other columns are ignored by :func:`assign` and kept by :func:`add_shards`,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read_table, scratch
from .ranks import digest_key

SHARDS = 24
VIRTUAL = 128
CELLS = 1 << 14
COLUMNS = ("doc_id", "size", "text_crc32", "key", "shard", "slot")


def nodes(shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """Cell and shard of every virtual node, clockwise."""
    digest = lambda s, v: int(hashlib.md5(f"shard {s} node {v}".encode()).hexdigest()[:8], 16)
    return sorted((digest(s, v) % CELLS, s) for s in range(shards) for v in range(virtual))


def bounds(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    if slack:
        return [ceil((1 + slack) * rows / shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(counts: dict[int, int], shards: int, virtual: int = VIRTUAL, slack: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """Segments (cell, first rank, end rank, shard, first slot) from the rows of each cell."""
    ring = nodes(shards, virtual)
    room = bounds(sum(counts.values()), shards, slack)
    owner, i = {}, 0
    for cell in range(CELLS):
        while i < len(ring) and ring[i][0] < cell:
            i += 1
        owner[cell] = i % len(ring)
    segments, over = [], []
    for cell in sorted(counts):
        shard = ring[owner[cell]][1]
        kept = min(counts[cell], room[shard])
        room[shard] -= kept
        if kept:
            segments.append((cell, 0, kept, shard))
        if kept < counts[cell]:
            over.append((cell, kept))
    onward = list(range(len(ring)))  # for a node: itself or a later one with room, as far as known

    def with_room(i: int) -> int:
        path = []
        while room[ring[i][1]] == 0:
            path.append(i)
            i = onward[i] if onward[i] != i else (i + 1) % len(ring)
        for j in path:
            onward[j] = i
        return i

    for cell, rank in over:
        at = owner[cell]
        while rank < counts[cell]:
            at = with_room(at)
            shard = ring[at][1]
            n = min(counts[cell] - rank, room[shard])
            room[shard] -= n
            segments.append((cell, rank, rank + n, shard))
            rank += n
    slots, out = [0] * shards, []
    for cell, lo, hi, shard in sorted(segments):
        out.append((cell, lo, hi, shard, slots[shard]))
        slots[shard] += hi - lo
    return out


def keyed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns keep and doc_id, size, text_crc32, key, cell of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)], F.col("doc_id").cast("long"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("key", digest_key(F.col("doc_id"), F.col("text_crc32")))
    return rows.withColumn("cell", F.shiftright(F.conv(F.substring("key", 1, 4), 16, 10).cast("int"), 2))


def _placed(docs: DataFrame, shards: int, virtual: int, slack: float, keep: list[str]) -> DataFrame:
    rows = keyed(docs, keep) if keep else scratch(keyed(docs, []), "shard-rows")
    counts = {r.cell: r.n for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # CELLS rows at most
    table = docs.sparkSession.createDataFrame(walk(counts, shards, virtual, slack), "_cell int, _lo long, _hi long, shard int, _slot long")
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("key", "doc_id", "size", "text_crc32")) - 1
    ranked = rows.withColumn("_rank", rank)
    placed = ranked.join(F.broadcast(table), (F.col("cell") == F.col("_cell")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    return placed.withColumn("slot", F.col("_slot") + F.col("_rank") - F.col("_lo"))


def assign(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, key, shard, slot of every row."""
    return _placed(docs, shards, virtual, slack, []).select(*COLUMNS)


def add_shards(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL, slack: float = 0.0) -> DataFrame:
    """Rows of docs, all columns, with shard and slot (in the place of columns of these names)."""
    keep = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    return _placed(docs, shards, virtual, slack, keep).select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)], "shard", "slot")


def op9(spark, sf_dir: str) -> DataFrame:
    out = assign(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
