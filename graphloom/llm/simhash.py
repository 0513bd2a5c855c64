"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link where at most four bits differ. Each fingerprint is cut into two halves of 32 bits; of two
linked fingerprints one half differs in at most two bits. On a half, the anchors are the words of the perfect [31, 26]
Hamming code times the free last bit: every half lies within covering radius 1 of one anchor. A half is replicated to each
anchor that covers a point within one bit of it (covering radius plus half the threshold of a half: at most 17 of 2**27
anchors), so two halves that differ in two bits meet at the anchor of the point between them. No pair is missed.

Equal fingerprints are collapsed first. At an anchor only a spanning forest of the links is emitted, so a group of n near
copies gives n - 1 links rather than n squared. Anchors with more than about ``bucket_rows`` fingerprints are divided
further before the shuffle, by five blocks of the other half, of which linked fingerprints share one: no link is lost, and rows
grow fivefold there, not with the square. Components come from alternating large-star and small-star steps on tables in the shared
folder.

Null or wordless texts have fingerprint zero and link like any other. Rows with a null doc_id keep their row; a component of
only such rows has a null component_id. Repeated rows are kept. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, n_partitions, null_safe_keys, scratch, spare_name
from .components import connected_components

SHINGLE = 4
THRESHOLD = 4
BUCKET_ROWS = 1 << 16
#: Place and width of the blocks of 32 bits.
BLOCKS = ((0, 7), (7, 7), (14, 6), (20, 6), (26, 6))
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes | None, shingle: int = SHINGLE, chunk: int = 1 << 15) -> int:
    """SimHash of one text; the hashes are counted bit by bit in chunks, so long texts take bounded memory."""
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    k = min(shingle, len(words))
    cuts = list(zip(start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True))
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for lo in range(0, len(cuts), chunk):
        h = np.array([digest(joined[a:b], 42) for a, b in cuts[lo : lo + chunk]], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(cuts)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp (64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).cast(pa.large_binary())
            fp = np.array([fingerprint(t.as_py()) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "text_hash", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), _text_hash().alias("text_hash"), F.col("text").cast("string")), run, "doc_id long, text_hash long, fp long")


def _text_hash():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _syndromes(half: np.ndarray) -> np.ndarray:
    """XOR of the positions (1 to 31) of the set bits of the lower 31 bits."""
    out = np.zeros(len(half), np.uint32)
    for position in range(1, 32):
        out ^= ((half >> np.uint32(position - 1)) & np.uint32(1)) * np.uint32(position)
    return out


def _flips() -> np.ndarray:
    """Row s: bits to turn to reach the anchors within two bits of a half with syndrome s; the first is the nearest."""
    rows = np.zeros((32, 16), np.uint32)
    for s in range(1, 32):
        pairs = [(a, a ^ s) for a in range(1, 32) if a < a ^ s]
        rows[s] = [1 << (s - 1)] + [(1 << (a - 1)) | (1 << (b - 1)) for a, b in pairs]
    return rows


_FLIPS = _flips()


def anchors_of(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index into half and anchor, for every anchor that covers a point within one bit."""
    half = half.astype(np.uint32)
    s = _syndromes(half)
    near = half[:, None] ^ _FLIPS[s]
    keep = np.ones(near.shape, bool)
    keep[s == 0, 1:] = False
    index, _ = np.nonzero(keep)
    return np.concatenate([index, np.arange(len(half))]), np.concatenate([near[keep], near[:, 0] ^ np.uint32(1 << 31)])


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def forest(fps: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Links (index, index of the first of its component) of the graph on fps (distinct, unsigned) with links at threshold or fewer bits."""
    left, out = np.arange(len(fps)), []
    while len(left) > 1:
        root, queue, left = int(left[0]), [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = popcount(fps[left] ^ fps[x]) <= threshold
            if near.any():
                found = left[near]
                out += [(root, int(y)) for y in found]
                queue += found.tolist()
                left = left[~near]
    return out


def _linked(cuts: np.ndarray, fp: np.ndarray, threshold: int, small: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Links within the groups fp[cuts[i]:cuts[i+1]]."""
    sizes = np.diff(cuts)
    a, b = [], []
    group, size = np.repeat(np.arange(len(sizes)), sizes), np.repeat(sizes, sizes)
    for k in range(1, small):
        i = np.flatnonzero((group[:-k] == group[k:]) & (size[:-k] <= small)) if len(fp) > k else np.zeros(0, int)
        if not len(i):
            break
        i = i[popcount(fp[i] ^ fp[i + k]) <= threshold]
        a.append(fp[i])
        b.append(fp[i + k])
    for j in np.flatnonzero(sizes > small):
        own = np.unique(fp[cuts[j] : cuts[j + 1]].view(np.int64)).view(np.uint64)  # the least as Spark orders them comes first
        if pairs := forest(own, threshold):
            p = np.array(pairs)
            a.append(own[p[:, 0]])
            b.append(own[p[:, 1]])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """anchor, fp for each anchor of either half of each fingerprint."""
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for side, half in enumerate((fp.view(np.uint64) & np.uint64(0xFFFFFFFF), fp.view(np.uint64) >> np.uint64(32))):
            index, anchor = anchors_of(half)
            yield pa.record_batch([pa.array(anchor.astype(np.int64) | (side << 32)), pa.array(fp[index])], names=["anchor", "fp"])


def hot_anchors(fps: DataFrame, bucket_rows: int) -> DataFrame:
    """anchor of every anchor with more than about bucket_rows fingerprints, judged by a 64th of them (at most, so that 16 are seen).

    This only chooses the plan: a hot anchor that is missed is compared in one task, with the same links.
    """
    share = min(64, max(1, bucket_rows // 16))
    some = fps.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(share)) == 0)
    return map_arrow(some, replicate, "anchor long, fp long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * share > bucket_rows).select("anchor")


def spread(copies: DataFrame) -> DataFrame:
    """Copies at hot anchors, each with five keys: the other half's bits in five blocks.

    Linked fingerprints differ in at most four bits of the other half, so one block of theirs is equal.
    """
    other = F.when(F.shiftright("anchor", 32) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(0xFFFFFFFF))
    blocks = [F.lit(k << 7).cast("long") + F.shiftright(other, at).bitwiseAND((1 << width) - 1) for k, (at, width) in enumerate(BLOCKS)]
    return copies.select("anchor", F.explode(F.array(*blocks)).alias("part"), "fp")


def links(fps: DataFrame, threshold: int = THRESHOLD, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """src, dst: links that connect all distinct fingerprints (column fp) at threshold or fewer bits; threshold is 4 at most."""
    if threshold > THRESHOLD:
        raise ValueError("the covering is built for at most four differing bits")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor and part; the last group of a batch waits for the next batch."""
        held = [np.zeros(0, np.int64)] * 3

        def done(anchor, part, fp):
            cuts = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]), [True]]))
            x, y = _linked(cuts, fp.view(np.uint64), threshold)
            return pa.record_batch([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["src", "dst"])

        for b in batches:
            if not b.num_rows:
                continue
            anchor, part, fp = held = [np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, b.columns, strict=True)]
            same = (anchor == anchor[-1]) & (part == part[-1])
            last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if last:
                yield done(anchor[:last], part[:last], fp[:last])
                held = [anchor[last:], part[last:], fp[last:]]
        if len(held[0]):
            yield done(*held)

    spark = fps.sparkSession
    copies = map_arrow(fps.select("fp"), replicate, "anchor long, fp long")
    hot = scratch(hot_anchors(fps, bucket_rows), "simhash-hot")
    keyed = copies.select("anchor", F.lit(-1).cast("long").alias("part"), "fp")
    if hot.head(1):
        keyed = keyed.join(hot, "anchor", "left_anti").select("anchor", "part", "fp").union(spread(copies.join(hot, "anchor", "left_semi")))
    dealt = keyed.repartition(n_partitions(spark), "anchor", "part").sortWithinPartitions("anchor", "part")
    return map_arrow(dealt, compare, "src long, dst long")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, text_hash, fp, root (of the component), component_id (smallest doc_id of all rows reachable by links)."""
    rows = scratch(fingerprints(docs), "simhash-rows")
    distinct = scratch(rows.groupBy("fp").agg(F.min("doc_id").alias("doc")), "simhash-distinct")
    star = connected_components(links(distinct, threshold, bucket_rows))
    named = scratch(distinct.join(star.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "doc", F.coalesce("root", "fp").alias("root")), "simhash-named")
    least = scratch(named.groupBy("root").agg(F.min("doc").alias("component_id")), "simhash-least")
    of_fp = named.join(least, "root").select("fp", "root", "component_id")
    return rows.join(of_fp, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_first(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Rows of docs, all columns: of each component the document with the smallest doc_id, one row of it.

    Texts are shuffled once: repeated rows collapse before it, and the kept rows meet them on the same keys.
    """
    found = near_duplicates(docs, threshold).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keys = [spare_name(docs, f"_key{k}") for k in range(3)]
    kept = scratch(found.groupBy("root", "doc_id").agg(F.min("text_hash").alias("h")).select(*[c.alias(k) for c, k in zip([*null_safe_keys(F.col("doc_id")), F.col("h")], keys, strict=True)]), "simhash-kept")
    keyed = docs.withColumns(dict(zip(keys, [*null_safe_keys(F.col("doc_id").cast("long")), _text_hash()], strict=True)))
    return keyed.dropDuplicates(keys).join(kept, keys, "left_semi").select(docs.columns)


def op5(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
