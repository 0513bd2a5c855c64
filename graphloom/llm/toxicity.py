"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over an inverted index.

Terms are the lower-cased words (runs of letters and digits) and their first four and five bytes. All terms of the examples make
the vector space, without any selection; weights are (1 + log tf) log(1 + N / df) with df over all documents, vectors have length
one. A term that no example has adds nothing to any product, so neighbours and their order are those over all terms; the
length of a text's vector is taken over the terms of the space.

The index is inverted and block-max: examples lie in blocks of alike ones, and for each term and block the largest weight is known. For
a query the blocks' upper bounds are added up first; the best blocks are scored in full, which gives the k-th cosine so far, and
then every block whose bound reaches it. Blocks that are passed over can't hold a neighbour, so neighbours are exact. Lists of common
terms are rows of a matrix, whose products are exact for every example; bounds and postings are for the others. Queries are scored together.

A neighbour's vote weighs the square of its cosine, of which each shared term's part counts as far as the term tells labels apart: the
log ratio of the shares of both labels' examples that have it, less two standard errors, and a little in any case. So a few
words that mark a label outweigh all those that alike texts of any label share. Votes are held against the rate of examples
without terms; a logistic curve, fitted on the examples' own scores with themselves left out (of neighbours and of terms' counts),
turns votes into probabilities. Neighbours' doc_ids and cosines are the evidence.

Labels are learned from rows whose crc32(doc_id as text) mod 5 is not 0. The examples are a bounded sample of them: about
``per_label`` rows of each label, dealt by a hash of doc_id, and weighted by what each stands for. Null labels and doc_ids
are not learned from; labels below 0 count as 0, above 1 as 1; of several labels of one doc_id the larger counts, of several
texts the least in code point order is the example. Texts that are null, empty or share no term with
any example get the score of examples without terms. Without examples of both labels every score is the rate of label 1 (0 without any).
Repeated rows are kept, other columns ignored. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, map_arrow, read_table, scratch
from .textvec import Words, binary, mix, span_hashes, steps

#: Chosen by log loss over four rotations of the folds 1 to 4, among 500, 1000 and 2000; fold 0 took no part.
PER_LABEL = 500
NEIGHBOURS = 16
BLOCK = 64
#: Of a vote: what a term that tells nothing counts, standard errors taken off, weight of the prior. Chosen as PER_LABEL.
_ANY, _ERRORS, _PRIOR = 0.01, 2.0, 1e-3
_LONG, _MOST_LONG, _AT_ONCE, _SEEDS = 1 / 24, 2048, 64, 3  # share of the examples that makes a list long, long lists, queries together, blocks scored first
_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def terms_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every term of lower-cased texts."""
    w = Words(raw, off, _BREAK)
    whole = span_hashes(raw, w.start, w.end)
    heads = [mix(span_hashes(raw, w.start, np.minimum(w.end, w.start + n)) + np.uint64(n)) for n in (4, 5)]
    return np.concatenate([whole, *heads]), np.concatenate([w.row] * 3)


@dataclass
class Space:
    """Terms (sorted hashes) and their inverse document frequencies."""

    terms: np.ndarray
    idf: np.ndarray
    first: np.ndarray | None = field(init=False, default=None)  # first term of each range of hashes

    def __getstate__(self) -> dict:
        return self.__dict__ | {"first": None}

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h of the hashes that are terms, and their numbers. Ranges are so short that a term is met at once, mostly."""
        if self.first is None:
            bits = max(10, min(22, len(self.terms).bit_length() + 2))
            self.shift = np.uint64(64 - bits)
            self.first = np.searchsorted(self.terms >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        part = (h >> self.shift).astype(np.int32)
        at, end = self.first[part], self.first[part + 1]
        left, found = np.flatnonzero(at < end), []
        at, end, own = at[left], end[left], h[left]
        while len(left):
            hit = self.terms[at] == own
            found.append((left[hit], at[hit]))
            go = ~hit & (at + 1 < end)
            left, at, end, own = left[go], at[go] + 1, end[go], own[go]
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none)

    def counts(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term number and count, by row and term."""
        h, row = terms_of(raw, off)
        place, term = self.find(h)
        key, n = np.unique(row[place] * max(len(self.terms), 1) + term, return_counts=True)
        return key // max(len(self.terms), 1), key % max(len(self.terms), 1), n

    def weights(self, term: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (1 + np.log(n)) * self.idf[term]
        return w / np.sqrt((w * w).sum()) if len(w) else w


def _spans(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ... of size[0] numbers, then those of the next."""
    return np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())


class Index:
    """Block-max inverted index over the examples' vectors: postings of each term by example, and their blocks with the largest weight."""

    def __init__(self, space: Space, ids: list, labels: np.ndarray, mass: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]]):
        order = self._alike([i for i in range(len(ids)) if len(vectors[i][0])], vectors, len(space.terms))
        self.space, self.ids = space, [ids[i] for i in order]
        self.labels, self.mass = labels[order].astype(float), mass[order].astype(float)
        self.vectors = [vectors[i] for i in order]
        term = np.concatenate([np.zeros(0, np.int32), *(t for t, _ in self.vectors)])
        weight, by = np.concatenate([np.zeros(0), *(w for _, w in self.vectors)]), np.repeat(np.arange(len(order)), [len(t) for t, _ in self.vectors])
        self.have = np.array([np.bincount(term[self.labels[by] == y], minlength=len(space.terms)) for y in (0, 1)], np.int32)  # examples of each label with a term
        self.of = np.array([(self.labels == y).sum() for y in (0, 1)])
        every = np.arange(len(space.terms))
        self.tells = self.telling(every)
        may = np.maximum.reduce([self.tells, *(self.telling(every, without=y) for y in (0, 1))]) > 0
        own = np.flatnonzero(may[term])  # of the examples' vectors, the terms that tell, with or without one example
        self.own_term, self.own_weight, self.own_at = term[own], weight[own], np.searchsorted(by[own], np.arange(len(order) + 1))
        by_term = np.argsort(term, kind="stable")
        self.at = np.searchsorted(term[by_term], np.arange(len(space.terms) + 1))
        self.example = np.repeat(np.arange(len(order), dtype=np.int32), [len(t) for t, _ in self.vectors])[by_term]
        self.weight = weight[by_term]
        self.n_blocks = max(1, -(-len(order) // BLOCK))
        owner, block = term[by_term], self.example // BLOCK
        first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])])[: len(owner)])
        self.entry_at = np.searchsorted(owner[first], np.arange(len(space.terms) + 1))  # a term's entries: one for each block it is in
        self.entry_block, self.entry_lo = block[first], np.append(first, len(owner))
        self.entry_max = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.matrix = self.cell = None
        total = mass.sum()
        self.rate = float((mass * labels).sum() / total) if total else 0.0
        empty = np.array([not len(t) for t, _ in vectors], bool)
        self.none = float(((mass * labels)[empty].sum() + self.rate) / (mass[empty].sum() + 1)) if len(ids) else 0.0
        self.usual = float(np.median(mass)) if len(ids) else 1.0
        self.curve = (0.0, 1.0)

    @staticmethod
    def _alike(order: list[int], vectors: list, n_terms: int) -> list[int]:
        """Examples by their heaviest common term, then by their heaviest term, so that blocks hold alike ones."""
        df = np.bincount(np.concatenate([np.zeros(0, np.int64), *(vectors[i][0] for i in order)]), minlength=n_terms)
        common = df > _LONG * len(order)
        key = lambda i: (int(vectors[i][0][np.argmax(vectors[i][1] * common[vectors[i][0]])]), int(vectors[i][0][np.argmax(vectors[i][1])]), i)
        return sorted(order, key=key)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"vectors": None, "matrix": None, "cell": None}  # executors need the lists only

    def _split(self) -> None:
        """Long lists as a matrix."""
        size = np.diff(self.at)
        rows = np.argsort(-size, kind="stable")[:_MOST_LONG]
        rows = rows[size[rows] > _LONG * len(self.ids)]
        self.place = np.full(len(size), -1, np.int32)  # of a long list in the matrix
        self.place[rows] = np.arange(len(rows))
        self.matrix = np.zeros((len(rows), self.n_blocks * BLOCK))
        for i, t in enumerate(rows):
            own = slice(self.at[t], self.at[t + 1])
            self.matrix[i, self.example[own]] = self.weight[own]

    def cosines(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
        """Cosine of every query (terms and weights) with every example that may be among its k nearest; less for the others."""
        if self.matrix is None:
            self._split()
        n, nb = len(queries), self.n_blocks
        query = np.repeat(np.arange(n), [len(t) for t, _ in queries])
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in queries)])
        weight = np.concatenate([np.zeros(0), *(w for _, w in queries)])
        place = self.place[term]
        long = np.zeros((n, len(self.matrix)))
        long[query[place >= 0], place[place >= 0]] = weight[place >= 0]
        out = long @ self.matrix
        query, term, weight = query[place < 0], term[place < 0], weight[place < 0]
        size = self.entry_at[term + 1] - self.entry_at[term]
        entry = _spans(self.entry_at[term], size)  # of the short lists
        cell, weight = np.repeat(query * nb, size) + self.entry_block[entry], np.repeat(weight, size)
        more = np.bincount(cell, weights=weight * self.entry_max[entry], minlength=n * nb).reshape(n, nb)
        bound = out.reshape(n, nb, BLOCK).max(axis=2) + more

        def score(chosen: np.ndarray) -> None:
            own = chosen.reshape(-1)[cell]
            e = entry[own]
            lo = self.entry_lo[e]
            size = self.entry_lo[e + 1] - lo
            posting = _spans(lo, size)
            at = np.repeat(cell[own] // nb * (nb * BLOCK), size) + self.example[posting]
            out.reshape(-1)[:] += np.bincount(at, weights=np.repeat(weight[own], size) * self.weight[posting], minlength=out.size)

        chosen = np.zeros((n, nb), bool)
        seeds = np.argpartition(-bound, min(_SEEDS, nb) - 1, axis=1)[:, :_SEEDS]
        np.put_along_axis(chosen, seeds, True, axis=1)
        score(chosen)
        full = np.where(np.repeat(chosen, BLOCK, axis=1), out, 0)
        least = np.partition(full, -k, axis=1)[:, -k] if full.shape[1] > k else np.zeros(n)
        rest = (bound >= least[:, None] - 1e-9) & ~chosen
        score(rest)
        return np.where(np.repeat(chosen | rest, BLOCK, axis=1), out, 0)[:, : len(self.ids)]

    def top(self, cosine: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine over 0 (ties to 12 digits: in index order) and their cosines."""
        cosine = cosine.round(12)
        if skip >= 0:
            cosine[skip] = 0
        least = np.partition(cosine, -k)[-k] if len(cosine) > k else 0.0
        ids = np.flatnonzero((cosine > 0) & (cosine >= least))
        ids = ids[np.lexsort((ids, -cosine[ids]))[:k]]
        return ids, cosine[ids]

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        return self.top(self.cosines([(term, weight)], k + 1)[0], k, skip)

    def telling(self, term: np.ndarray, without: int = -1) -> np.ndarray:
        """How far terms tell labels apart, by all examples or all but one, of label without, that has the terms."""
        have, of = self.have[:, term] + 0.5, self.of + 1.0
        if without >= 0:
            have[without] = np.maximum(have[without] - 1, 0.5)
            of[without] -= 1
        ratio = np.log(have[1] / of[1]) - np.log(have[0] / of[0])
        return np.maximum(np.abs(ratio) - _ERRORS * np.sqrt((1 / have).sum(axis=0)), 0)

    def vote(self, term: np.ndarray, weight: np.ndarray, ids: np.ndarray, cosine: np.ndarray, skip: int = -1) -> float:
        """Share of label 1 among the neighbours ids of a text (terms and weights)."""
        if self.cell is None:
            self.cell = np.zeros(len(self.space.terms))  # of a term: its weight in the text as far as it tells
        self.cell[term] = weight * (self.tells[term] if skip < 0 else self.telling(term, int(self.labels[skip])))
        size = self.own_at[ids + 1] - self.own_at[ids]
        at = _spans(self.own_at[ids], size)
        told = np.bincount(np.repeat(np.arange(len(ids)), size), weights=self.cell[self.own_term[at]] * self.own_weight[at], minlength=len(ids))
        self.cell[term] = 0
        w = (told + _ANY * cosine) ** 2 * self.mass[ids]
        prior = _PRIOR * self.usual
        return float(((w * self.labels[ids]).sum() + prior * self.none) / (w.sum() + prior))

    def calibrate(self, k: int, none: list[tuple[float, float]]) -> None:
        """Logistic curve from votes to labels; none: label and mass of examples without terms."""
        x = []
        for lo in range(0, len(self.vectors), _AT_ONCE):
            some = self.vectors[lo : lo + _AT_ONCE]
            x += [self.vote(*v, *self.top(c, k, skip=i), skip=i) for i, (v, c) in enumerate(zip(some, self.cosines(some, k + 1), strict=True), lo)]
        x += [self.none] * len(none)
        y = np.array([*self.labels, *(a for a, _ in none)])
        m = np.array([*self.mass, *(b for _, b in none)])
        if len(y) == 0 or y.min() == y.max():
            return
        x, m, beta = np.array(x), m / m.mean(), np.array([0.0, 1.0])
        z = np.column_stack([np.ones(len(x)), _logit(x)])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            hess = (z * (m * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
            step = np.linalg.solve(hess, z.T @ (m * (y - p)) - 1e-2 * (beta - [0.0, 1.0]))
            beta = beta + np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-9:
                break
        self.curve = (float(beta[0]), float(max(beta[1], 1e-3)))

    def score(self, vote: float) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * _logit(np.array(vote)), -30, 30))))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _fold(c: str = "doc_id"):
    return F.crc32(F.col(c).cast("string").cast("binary")) % 5


def _lower_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return binary(pc.utf8_lower(column))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, k: int = NEIGHBOURS) -> Index:
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (_fold() != 0))
    known = known.groupBy("doc_id").agg(F.greatest(F.least(F.max("toxic"), F.lit(1)), F.lit(0)).alias("toxic"))
    totals = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chance = F.when(F.col("toxic") == 1, min(1.0, per_label / max(1, totals.get(1, 0)))).otherwise(min(1.0, per_label / max(1, totals.get(0, 0))))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30) < chance).select(F.col("doc_id").alias("_id"), "toxic")

    def collect_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = _lower_text(b.column(2))
            out = []
            for lo, hi in steps(off):
                h, row = terms_of(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                at = np.flatnonzero(first)
                n, r, t = np.diff(np.append(at, len(h))), row[at], h[at].view(np.int64)
                cut = np.searchsorted(r, np.arange(hi - lo + 1))
                out += [(t[x:y], n[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([t for t, _ in out], pa.list_(pa.int64())), pa.array([n for _, n in out], pa.list_(pa.int32()))], names=["doc_id", "toxic", "terms", "n"])

    # the drawn labels are about 2 x per_label rows, whatever the input: small enough for every executor
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(drawn), F.col("doc_id") == F.col("_id"))
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # an example a label, however often its doc_id comes
    sample = scratch(map_arrow(texts, collect_terms, "doc_id long, toxic int, terms array<long>, n array<int>"), "toxic-sample")
    got = sample.toArrow()  # at most about 2 x per_label examples: an entry for each term of their texts
    toxic = got["toxic"].to_numpy()
    size = dict(zip(*(x.tolist() for x in np.unique(toxic, return_counts=True)), strict=True))
    lists, tf = (got[c].combine_chunks() for c in ("terms", "n"))
    off = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    flat, tf = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), tf.flatten().to_numpy(zero_copy_only=False)
    both = len(size) == 2
    terms = np.unique(flat) if both else np.zeros(0, np.uint64)
    space = Space(terms, np.zeros(len(terms)))
    df, rows = document_frequencies(docs, space)
    space.idf = np.log(1 + rows / np.maximum(df, 1))

    ids, ys, mass, vectors = [], [], [], []
    for doc_id, i in sorted(zip(got["doc_id"].to_pylist(), range(len(toxic)), strict=True)):
        own = slice(off[i], off[i + 1] if both else off[i])
        t = np.searchsorted(terms, flat[own])
        vectors.append((t.astype(np.int32), space.weights(t, tf[own].astype(float))))
        ids.append(doc_id)
        ys.append(int(toxic[i]))
        mass.append(totals[ys[-1]] / max(1, size[ys[-1]]))
    del got, lists, flat, tf
    drop(sample)
    index = Index(space, ids, np.array(ys, float), np.array(mass, float), vectors)
    index.calibrate(k, [(y, m) for y, m, (t, _) in zip(ys, mass, vectors, strict=True) if not len(t)])
    index.vectors, index.matrix = [], None  # not needed any more, and large
    return index


def document_frequencies(docs: DataFrame, space: Space) -> tuple[np.ndarray, int]:
    """In how many documents each term is, and the number of documents, over all of them."""
    shared = docs.sparkSession.sparkContext.broadcast(space)
    size = len(space.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(size + 1, np.int64), 0
        for b in batches:
            raw, off = _lower_text(b.column(0))
            rows += b.num_rows
            for lo, hi in steps(off):
                _, term, _ = shared.value.counts(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                df += np.bincount(term, minlength=size + 1)
        df[size] = rows
        seen = np.flatnonzero(df)
        yield pa.record_batch([pa.array(seen), pa.array(df[seen])], names=["term", "n"])

    got = map_arrow(docs.select(F.col("text").cast("string")), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    out = np.zeros(size + 1, np.int64)
    out[got["term"].to_numpy()] = got["n"].to_numpy()
    return out[:size], int(out[size])


def score(docs: DataFrame, index: Index, k: int = NEIGHBOURS) -> DataFrame:
    """doc_id, score, neighbours (doc_ids), cosines of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for b in batches:
            raw, off = _lower_text(b.column(1))
            out = np.full(b.num_rows, ix.score(ix.none))
            near, cosines = [[]] * b.num_rows, [[]] * b.num_rows
            for lo, hi in steps(off):
                row, term, n = ix.space.counts(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                cut = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]])) if len(row) else np.zeros(1, int)
                spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
                for at in range(0, len(spans), _AT_ONCE):
                    some = spans[at : at + _AT_ONCE]
                    texts = [(term[x:y], ix.space.weights(term[x:y], n[x:y].astype(float))) for x, y in some]
                    for (x, _), text, c in zip(some, texts, ix.cosines(texts, k), strict=True):
                        i = lo + int(row[x])
                        ids, cosine = ix.top(c, k)
                        out[i] = ix.score(ix.vote(*text, ids, cosine))
                        near[i], cosines[i] = [ix.ids[j] for j in ids], cosine.tolist()
            yield pa.record_batch([b.column(0), pa.array(out), pa.array(near, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))], names=["doc_id", "score", "neighbours", "cosines"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double, neighbours array<long>, cosines array<double>")


def op8(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("neighbours").alias("evidence"), "cosines")
