"""Token-ID output: texts to ids, ids to rANS block files in ascending doc_id order, and back.

1. Every whole text is tokenized once (:mod:`tokens`) and closed with an end id; ids go to a written table.
2. Ids are counted over all documents; one frequency table for all blocks comes from the counts.
3. Rows are range-partitioned and sorted by doc_id, and coded (:mod:`rans`) in blocks of whole documents. Files are Parquet:
   one row a block with part and seq (order), doc_ids and their numbers of ids, and the block's bytes; Spark's commit protocol makes
   lost tasks and executors harmless. The frequency table lies beside them.
4. Readers decode blocks in parallel, from the block's start or a checkpoint; starts are prefix sums over block totals.

Ids take 16 or 32 bits on the way, as the vocabulary needs. Null texts are empty: the end id alone. Null doc_ids come first. Equal
doc_ids are ordered by a hash of their ids and then the ids, so a doc_id with very many rows is split too. Other columns are
ignored. An empty table gives no blocks. A document's ids must fit one task's memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_folder, map_arrow, n_partitions, new_folder, read_table, shuffles_freed
from .rans import Coder, quantise, table_bits
from .textvec import STEP_BYTES, binary, steps
from .tokens import Encoder

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
BLOCK_IDS = 1 << 18
_encoders: dict[int, Encoder] = {}


def public_tokenizer(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoder(config: str) -> Encoder:
    """A worker's encoder; its table of words lives as long as the worker."""
    if (key := hash(config)) not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(config)
    return _encoders[key]


def id_type(config: str, end: int) -> str:
    """numpy type of the ids of a tokenizer (its file's text) and the end id."""
    from tokenizers import Tokenizer

    most = max([end, *Tokenizer.from_str(config).get_vocab(True).values()])
    return "<u2" if most < 1 << 16 else "<u4"


def tokenize(docs: DataFrame, config: str, end: int = END_ID) -> DataFrame:
    """doc_id, n, ids (little-endian, of :func:`id_type`) of every row; config is the text of a tokenizer file."""
    kind = id_type(config, end)
    shared = docs.sparkSession.sparkContext.broadcast(config)  # a file of a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for b in batches:
            raw, off = binary(b.column(1))
            counts, data = [], []
            for lo, hi in steps(off):
                ids, n = encoder.encode(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], end)
                ids = ids.astype(kind)
                cut = np.concatenate([[0], np.cumsum(n)]) * ids.itemsize
                bytes_ = ids.tobytes()
                counts.append(n)
                data += [bytes_[a:z] for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.record_batch([b.column(0), pa.array(n), pa.array(data, pa.binary())], names=["doc_id", "n", "ids"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n long, ids binary")


def count_ids(rows: DataFrame, kind: str) -> dict[int, int]:
    """How often each id comes; the table has a row for each id of the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            raw, _ = binary(b.column(0))
            for lo in range(0, len(raw), STEP_BYTES):
                n = np.bincount(raw[lo : lo + STEP_BYTES].view(kind))
                total = np.concatenate([total, np.zeros(max(len(n) - len(total), 0), np.int64)])
                total[: len(n)] += n
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    sums = map_arrow(rows.select("ids"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r.id: r.n for r in sums.collect()}


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Writes path/blocks and path/table; path/ids is a work table."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:  # on the driver; executors get the text
        config = f.read()
    kind = id_type(config, end)
    width = np.dtype(kind).itemsize
    tokenize(docs, config, end).write.option("compression", "zstd").parquet(f"{path}/ids")
    rows = spark.read.parquet(f"{path}/ids")
    counts = count_ids(rows, kind)
    dense = np.zeros(max(counts, default=-1) + 1, np.int64)
    dense[list(counts)] = list(counts.values())
    freq = quantise(dense, table_bits(len(counts)))
    spark.createDataFrame([(int(i), int(dense[i]), int(freq[i])) for i in np.flatnonzero(dense)], "id long, n long, freq long").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(freq)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seq, ids, docs_, n, held = Coder(shared.value), 0, 0, [], [], [], 0

        def block():
            data = coder.encode(np.frombuffer(b"".join(ids), kind))
            cols = [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([docs_], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64())), pa.array([held], pa.int64()), pa.array([data], pa.binary())]
            return pa.record_batch(cols, names=["part", "seq", "doc_ids", "doc_tokens", "n_tokens", "block"])

        for b in batches:
            for i in range(b.num_rows):
                part = b.column(0)[i].as_py()
                data = b.column(2)[i].as_py()
                ids.append(data)
                docs_.append(b.column(1)[i].as_py())
                n.append(len(data) // width)
                held += len(data) // width
                if held >= block_ids:
                    yield block()
                    seq, ids, docs_, n, held = seq + 1, [], [], [], 0
        if docs_:
            yield block()

    keyed = rows.withColumn("h", F.xxhash64("ids"))
    dealt = keyed.repartitionByRange(n_partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h", "ids").select(F.spark_partition_id().alias("part"), "doc_id", "ids")
    schema = "part int, seq long, doc_ids array<long>, doc_tokens array<long>, n_tokens long, block binary"
    with shuffles_freed(spark):
        map_arrow(dealt, code, schema).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    shared.destroy()
    drop_folder(spark, f"{path}/ids")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, part, seq of every document, decoded from the files."""
    table = spark.read.parquet(f"{path}/table").select("id", "freq").collect()
    freq = np.zeros(max((r.id for r in table), default=-1) + 1, np.int64)
    for r in table:
        freq[r.id] = r.freq
    shared = spark.sparkContext.broadcast(freq)
    blocks = spark.read.parquet(f"{path}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for b in batches:
            for i in range(b.num_rows):
                ids = coder.decode(b.column(4)[i].as_py()).astype("<u4")
                n = np.array(b.column(3)[i].as_py(), np.int64)
                at = np.concatenate([[0], np.cumsum(n)])
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                k = len(n)
                cols = [b.column(2)[i].values, pa.array(at[:-1]), pa.array(n), pa.array(crc, pa.int64()), pa.array(np.full(k, b.column(0)[i].as_py(), np.int32)), pa.array(np.full(k, b.column(1)[i].as_py(), np.int64))]
                yield pa.record_batch(cols, names=["doc_id", "within", "n_tokens", "ids_crc32", "part", "seq"])

    schema = "doc_id long, within long, n_tokens long, ids_crc32 long, part int, seq long"
    out = map_arrow(blocks.select("part", "seq", "doc_ids", "doc_tokens", "block"), run, schema)
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    parts = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("_n").over(before("part")), F.lit(0)).alias("_part_base"))  # a row for each sorted partition
    base = blocks.select("part", "seq", F.coalesce(F.sum("n_tokens").over(before("part", "seq")), F.lit(0)).alias("_seq_base"))
    base = base.join(parts, F.col("part") == F.col("_part")).select("part", "seq", (F.col("_part_base") + F.col("_seq_base")).alias("_base"))
    return out.join(base, ["part", "seq"]).select("doc_id", (F.col("_base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "part", "seq")


def op10(spark, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tokens")
    write(read_table(spark, sf_dir, "documents"), path, public_tokenizer())
    return read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
