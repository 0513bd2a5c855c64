"""Benchmark decontamination by size-partitioned MinHash containment search.

Words are runs of letters and digits of the lower-cased text; a text's shingles are its windows of five words (an item of
fewer words is one shingle). An item leaks into a document that holds at least 0.8 of its distinct shingles.

Items are partitioned by size, a partition for each power of two of distinct shingles, with an index of its own. MinHash keeps, of each item, the
shingles with the smallest hashes: a random sample of the item, so the share of it that a document holds estimates the
containment however long the document is. In a partition of items of up to u shingles the sketch has floor((1 - threshold) u) + 1 + ``EXTRA``
of them (all, if there are fewer). A document that holds an item to the threshold lacks at most floor((1 - threshold) n) of its n shingles, so
it meets the rest of the sketch: an item whose estimate is lower is out, and no leak is lost. Candidates are verified by exact
containment of the items' word windows.

The benchmark is searched in blocks of at most ``block_words`` words, repeated items left out before, so what is collected and broadcast at
once has a fixed size; every block is held against all documents.

Items without words match nothing. Equal items with different ids are reported each, repeated item rows once; a null
item_id is an item like any other. Documents without words hold nothing; repeated documents are reported each; a null
doc_id stays null. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, read_table
from .textvec import Words, binary, shingle_hashes, steps, windows

SHINGLE = 5
THRESHOLD = 0.8
BLOCK_WORDS = 1 << 20
#: Shingles of a sketch beyond those of which one must be met.
EXTRA = 8
#: Bytes between words: all of ASCII but letters and digits.
_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def word_windows(low: bytes, n: int) -> list[tuple[bytes, ...]]:
    w = _WORD.findall(low)
    return list(zip(*(w[k:] for k in range(n)), strict=False))


class Partition:
    """Index of the sketches of items of one size: hash to items, an item's sketch size and how much of it a document must hold."""

    def __init__(self, sketches: list[tuple[int, np.ndarray, int]]):
        """sketches: item, its smallest hashes, how many of its shingles may be missing."""
        self.items = np.array([i for i, _, _ in sketches], np.int64)
        self.size = np.array([len(h) for _, h, _ in sketches], np.int64)
        self.least = np.maximum(1, self.size - np.array([m for _, _, m in sketches], np.int64))
        own = np.repeat(np.arange(len(sketches)), self.size)
        h = np.concatenate([h for _, h, _ in sketches])
        order = np.argsort(h, kind="stable")
        self.keys, first = np.unique(h[order], return_index=True)
        self.at, self.own = np.append(first, len(h)), own[order]
        self.low = np.zeros(1 << 18, bool)
        self.low[self.keys >> np.uint64(46)] = True

    def search(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, item and estimated containment of the candidates among window hashes h of the rows."""
        maybe = np.flatnonzero(self.low[h >> np.uint64(46)])
        place = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        hit = self.keys[place] == h[maybe]
        met = np.unique(row[maybe[hit]] * len(self.keys) + place[hit])  # a shingle counts once a row
        row, key = met // len(self.keys), met % len(self.keys)
        n = self.at[key + 1] - self.at[key]
        own = self.own[np.repeat(self.at[key] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        pair, found = np.unique(np.repeat(row, n) * len(self.items) + own, return_counts=True)
        row, own = pair // len(self.items), pair % len(self.items)
        enough = found >= self.least[own]
        return row[enough], self.items[own[enough]], found[enough] / self.size[own[enough]]


class Items:
    """Size partitions and full shingle sets of a block of items."""

    def __init__(self, rows: list[tuple], threshold: float, shingle: int):
        self.rows, self.threshold, self.shingle = [], threshold, shingle
        sketches: dict[tuple[int, int], list] = {}
        for item_id, text in dict.fromkeys(rows):
            low = pc.utf8_lower(pa.array([text or ""]))[0].as_py().encode()
            n = min(shingle, len(_WORD.findall(low)))
            if not n:
                continue
            grams = frozenset(word_windows(low, n))
            raw = np.frombuffer(low, np.uint8)
            h = np.unique(shingle_hashes(Words(raw, np.array([0, len(raw)]), _BREAK).hashes(None), n))
            level = len(grams).bit_length()
            missing = lambda size: int((1 - threshold) * size + 1e-9)
            kept = h[: missing((1 << level) - 1) + 1 + EXTRA]  # h is sorted: the smallest hashes
            sketches.setdefault((n, level), []).append((len(self.rows), kept, missing(len(grams)) + len(grams) - len(h)))
            self.rows.append((item_id, n, grams))
        self.partitions = {key: Partition(own) for key, own in sketches.items()}

    def candidates(self, raw: np.ndarray, off: np.ndarray) -> dict[int, list[int]]:
        """Items that may leak into each row of lower-cased texts, by the index of each size partition."""
        w, out, hashes = Words(raw, off, _BREAK), {}, {}
        words = w.hashes(None)
        for (n, _), partition in self.partitions.items():
            if n not in hashes:
                at, row = windows(w.first, n)
                hashes[n] = (shingle_hashes(words, n)[at] if len(at) else np.zeros(0, np.uint64)), row
            for r, i, _ in zip(*(x.tolist() for x in partition.search(*hashes[n])), strict=True):
                out.setdefault(r, []).append(i)
        return out

    def leaks(self, raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Row, item and number of its distinct shingles in the row, where these reach the threshold."""
        text = raw.tobytes()
        for r, items in self.candidates(raw, off).items():
            grams: dict[int, set] = {}
            for i in sorted(items):
                _, n, own = self.rows[i]
                if n not in grams:
                    grams[n] = set(word_windows(text[off[r] : off[r + 1]], n))
                shared = len(own & grams[n])
                if shared >= self.threshold * len(own) - 1e-9:
                    yield r, i, shared


def blocks(benchmark: DataFrame, threshold: float, shingle: int, block_words: int) -> Iterator[Items]:
    """The benchmark's items, at most about block_words words at a time on the driver."""
    b = benchmark.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    words = b.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-words // (4 * block_words)))
    for k in range(n):
        yield Items([tuple(r) for r in b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()], threshold, shingle)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles (of the item), containment of every leak."""
    kind = benchmark.schema["item_id"].dataType
    out = None
    for items in blocks(benchmark, threshold, shingle, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for b in batches:
                raw, off = binary(pc.utf8_lower(b.column(1)))
                rows = [(lo + r, i, n) for lo, hi in steps(off) for r, i, n in own.leaks(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])]
                if rows:
                    r, i, n = zip(*rows, strict=True)
                    yield pa.record_batch([b.column(0).take(pa.array(r)), pa.array([own.rows[x][0] for x in i], pa.int64() if kind.typeName() == "long" else None), pa.array(n, pa.int64()), pa.array([len(own.rows[x][2]) for x in i], pa.int64())], names=["doc_id", "item_id", "n_shared", "n_shingles"])

        part = map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, f"doc_id long, item_id {kind.simpleString()}, n_shared long, n_shingles long")
        out = part if out is None else out.union(part)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows of docs, all columns, that hold no item of the benchmark."""
    place = docs.columns.index("text")
    for items in blocks(benchmark, threshold, shingle, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                raw, off = binary(pc.utf8_lower(b.column(place)))
                bad = {lo + r for lo, hi in steps(off) for r, _, _ in shared.value.leaks(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_()))

        docs = map_arrow(docs, run, docs.schema)
    return docs


def op3(spark, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


# Every window of as many words as an item's shingles have is looked up among the items' windows.
OP3_SQL = r"""
WITH i AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
ig AS (SELECT DISTINCT item_id, least(len(w), 5) AS m, array_to_string(w[k + 1 : k + 5], ' ') AS g FROM (SELECT *, unnest(range(greatest(len(w) - 4, 1))) AS k FROM i WHERE len(w) > 0)),
n AS (SELECT item_id, m, count(*) AS n FROM ig GROUP BY item_id, m),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(text), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
dg AS (SELECT DISTINCT r, doc_id, m, array_to_string(w[k + 1 : k + m], ' ') AS g FROM (SELECT *, unnest(range(len(w) - m + 1)) AS k FROM d, (SELECT DISTINCT m FROM ig) WHERE len(w) >= m)),
s AS (SELECT r, doc_id, item_id, m, count(*) AS n_shared FROM dg JOIN ig USING (g, m) GROUP BY r, doc_id, item_id, m)
SELECT doc_id, s.item_id, n_shared, n AS n_shingles, n_shared / n AS containment FROM s JOIN n ON s.item_id IS NOT DISTINCT FROM n.item_id AND s.m = n.m WHERE n_shared >= 0.8 * n - 1e-9
"""
