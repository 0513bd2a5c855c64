"""Language identification by language-bitmask n-gram filters.

One Bloom filter per language, bit-sliced: slot s holds a mask with one bit for each language, so the AND of an n-gram's k
slots is the set of all languages that contain it, from one lookup. More than 64 languages take several mask words a slot. A text's n-grams are popcounted per language; the counts
c of n lookups are corrected for the filter's false positives p, (c - n p) / (1 - p), and the largest decides. The score is
its share of all corrected counts.

N-grams are 3 and 4 letters of the lower-cased text within one word, its two edges included. A language contains an n-gram
if at least ``min_df`` of its training texts do, and the share of these texts is at least ``keep_ratio`` of that in any other
language. Filters are fitted on a bounded sample: about ``train_docs`` rows of each language, dealt by a hash of doc_id
among all rows that may be learned from. All n-grams of the sample count. Bits are set on the executors; the driver gets the
filters' slots, 16 for each n-gram of the largest language, 2**22 at most (beyond, false positives rise and are corrected for).

A text that is null or has no letter is ``und`` with score 0. If no n-gram of a text is known, the language with most
training rows is given with score 0 (``und`` if nothing was learned). Ties go to the smaller language code. Rows with a null
doc_id or lang are not learned from; null doc_ids count as not held out. Repeated rows are kept, other columns ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, map_arrow, read_table, scratch
from .textvec import binary, mix, steps

ORDERS = (3, 4)
TRAIN_DOCS = 1000
MIN_DF = 2
SLOT_BITS = (12, 22)
KEEP_RATIO = 0.25
HASHES = 3
WORD_BITS = 64
_GAP = np.uint32(32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case code point of every letter, a gap for everything else."""
    out = np.full(0x110000, _GAP, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            out[cp] = ord(c.lower()[0])
    return out


def grams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and rows of all n-grams, and whether each row has a letter."""
    n = len(off) - 1
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[off]
    row = np.repeat(np.arange(n), np.diff(starts))
    folded = _letters()[points]
    has = np.bincount(row[folded != _GAP], minlength=n) > 0
    at = np.concatenate([starts[:-1], starts[1:]])
    order = np.argsort(np.concatenate([np.arange(n) * 2, np.arange(n) * 2 + 1]), kind="stable")
    folded = np.insert(folded, at[order], _GAP)
    row = np.insert(row, at[order], np.concatenate([np.arange(n), np.arange(n)])[order])
    gap = folded == _GAP
    keep = ~gap
    keep[1:] |= ~gap[:-1] | (row[1:] != row[:-1])
    keep[:1] = True
    folded, row, gap = folded[keep].astype(np.uint64), row[keep], gap[keep]
    hashes, rows = [], []
    for k in ORDERS:
        m = len(folded) - k + 1
        if m <= 0:
            continue
        ok = row[:m] == row[k - 1 :]
        for i in range(1, k - 1):
            ok &= ~gap[i : i + m]
        h = np.full(m, k, np.uint64)
        for i in range(k):
            h = h * np.uint64(0x100000001B3) + folded[i : i + m]
        hashes.append(mix(h[ok]))
        rows.append(row[:m][ok])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(hashes), np.concatenate(rows), has) if hashes else (none, none.astype(np.int64), has)


@dataclass
class Filters:
    """langs in order of their bits; slots: for each mask word (64 languages each) a mask for each slot; rate: false positives of each language."""

    langs: list[str]
    slots: np.ndarray
    rate: np.ndarray
    default: int = 0

    def masks(self, h: np.ndarray) -> np.ndarray:
        size = np.uint64(self.slots.shape[1] - 1)
        out = self.slots[:, h & size]
        for k in range(1, HASHES):
            out &= self.slots[:, (h >> np.uint64(20 * k)) & size]
        return out

    def counts(self, h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Corrected count of each row and language, and the row's n-grams."""
        mask, total = self.masks(h), np.bincount(row, minlength=n)
        out = np.empty((n, len(self.langs)))
        for b in range(len(self.langs)):
            hit = (mask[b // WORD_BITS] >> self.slots.dtype.type(b % WORD_BITS)) & self.slots.dtype.type(1)
            out[:, b] = np.bincount(row, weights=hit, minlength=n)
        return np.maximum(out - total[:, None] * self.rate, 0) / (1 - self.rate), total


def learnable(docs: DataFrame) -> DataFrame:
    """Rows with a language whose crc32(doc_id as text) mod 3 is not 1."""
    return docs.where(F.col("lang").isNotNull() & (_remainder() != 1))


def _remainder():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, min_df: int = MIN_DF, keep_ratio: float = KEEP_RATIO) -> Filters:
    known = learnable(docs)
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not sizes:
        return Filters([], np.zeros((1, 1 << 10), np.uint8), np.zeros(0))
    langs = sorted(sizes)
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, train_docs / sizes[lang]))])
    dealt = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30) < share[F.col("lang")]
    sample = known.where(dealt).select("lang", F.col("text").cast("string"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = np.array(b.column(0).to_pylist(), object)
            raw, off = binary(b.column(1))
            for lo, hi in steps(off):
                h, row, has = grams(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                for name in set(lang[lo:hi]):
                    own = np.flatnonzero(lang[lo:hi] == name)
                    mine = np.isin(row, own)
                    order = np.lexsort((h[mine], row[mine]))
                    g, r = h[mine][order], row[mine][order]
                    first = np.ones(len(g), bool)
                    first[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
                    g, n = np.unique(g[first], return_counts=True)
                    yield pa.record_batch([pa.array([name] * len(g)), pa.array(g.view(np.int64)), pa.array(n)], names=["lang", "gram", "df"])

    drawn = {r.lang: r.n for r in sample.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.create_map(*[F.lit(x) for k, lang in enumerate(langs) for x in (lang, k)])
    by = F.create_map(*[F.lit(x) for lang in langs for x in (lang, float(max(1, drawn.get(lang, 0))))])
    df = map_arrow(sample, count, "lang string, gram long, df long").groupBy("lang", "gram").agg(F.sum("df").alias("df"))
    of = df.groupBy("gram").agg(F.collect_list(F.struct(place[F.col("lang")].alias("bit"), "df", (F.col("df") / by[F.col("lang")]).alias("rate"))).alias("of"))  # one entry a language
    best = F.array_max(F.transform("of", lambda x: x["rate"]))
    kept = of.select("gram", F.explode(F.filter("of", lambda x: (x["rate"] >= keep_ratio * best) & (x["df"] >= min_df))).alias("x")).select("gram", "x.bit")
    kept = scratch(kept, "lang-grams")
    largest = kept.groupBy("bit").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    size = 1 << min(max(int(np.ceil(np.log2(16 * largest))), SLOT_BITS[0]), SLOT_BITS[1])
    kind = np.uint8 if len(langs) <= 8 else np.uint16 if len(langs) <= 16 else np.uint32 if len(langs) <= 32 else np.uint64
    at = F.explode(F.array(*[F.shiftright("gram", 20 * k).bitwiseAND(size - 1) for k in range(HASHES)]))
    word, mask = F.floor(F.col("bit") / WORD_BITS), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % WORD_BITS).cast("int"))
    set_bits = kept.select(at.alias("slot"), word.alias("word"), mask.alias("mask")).groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()  # a row a slot at most
    drop(kept)
    slots = np.zeros((-(-len(langs) // WORD_BITS), size), kind)
    slots[set_bits["word"].to_numpy(), set_bits["slot"].to_numpy()] = set_bits["mask"].to_numpy().view(np.uint64).astype(kind)
    fill = np.array([((slots[b // WORD_BITS] >> kind(b % WORD_BITS)) & kind(1)).mean() for b in range(len(langs))])
    return Filters(langs, slots, np.minimum(fill**HASHES, 0.99), max(range(len(langs)), key=lambda b: (sizes[langs[b]], -b)))


def identify(docs: DataFrame, filters: Filters, keep: list[str] | None = None) -> DataFrame:
    """Columns keep (doc_id) of every row with lang_pred, score and coverage (share of the n-grams that its language has)."""
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    source = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col("text").cast("string").alias("_text"))
    fields = source.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        names = np.array([*f.langs, "und"], object)
        for b in batches:
            raw, off = binary(b.column(b.num_columns - 1))
            pred, score, cover = np.empty(b.num_rows, object), np.zeros(b.num_rows), np.zeros(b.num_rows)
            for lo, hi in steps(off):
                h, row, has = grams(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                n = hi - lo
                if not f.langs:
                    pred[lo:hi] = "und"
                    continue
                c, total = f.counts(h, row, n)
                top = np.where(c.max(axis=1) > 0, c.argmax(axis=1), f.default)
                sums, most = c.sum(axis=1), c[np.arange(n), top]
                pred[lo:hi] = names[np.where(has, top, len(f.langs))]
                score[lo:hi] = np.where(has & (sums > 0), most / np.maximum(sums, 1e-12), 0)
                cover[lo:hi] = np.where(has, np.minimum(most / np.maximum(total, 1), 1), 0)
            yield pa.record_batch([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(score), pa.array(cover)], names=[*b.schema.names[:-1], "lang_pred", "score", "coverage"])

    schema = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in fields)
    out = map_arrow(source, run, f"{schema}, lang_pred string, score double, coverage double")
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "coverage")


def drop_unknown(docs: DataFrame, filters: Filters, min_coverage: float = 0.2) -> DataFrame:
    """Rows of docs, all columns, that have a letter and whose language holds at least min_coverage of their n-grams.

    Without any learned language nothing but rows without a letter goes.
    """
    shared, place = docs.sparkSession.sparkContext.broadcast(filters), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            raw, off = binary(b.column(place).cast(pa.string()))
            keep = np.zeros(b.num_rows, bool)
            for lo, hi in steps(off):
                h, row, has = grams(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                keep[lo:hi] = has
                if f.langs:
                    c, total = f.counts(h, row, hi - lo)
                    keep[lo:hi] &= c.max(axis=1) >= min_coverage * total
            yield b.filter(pa.array(keep))

    return map_arrow(docs, run, docs.schema)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs))
    return out.select("doc_id", F.coalesce(_remainder() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "coverage")
