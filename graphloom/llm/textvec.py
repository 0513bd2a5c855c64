"""Whole texts as flat byte arrays: words and their hashes for many documents at once.

A word is a run of bytes other than ASCII white space. Its hash takes in eight bytes at a time, mixed by multiplications and shifts,
so the cost is a few vector operations for each eight bytes of each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vector step works on (a longer single text is a step of its own).
STEP_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
#: The first n bytes of eight.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads a 64-bit hash over all bits (finaliser with two odd multipliers)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if column.offset:
        column = pa.concat_arrays([column])
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Words:
    """Words of the texts raw[off[i]:off[i+1]]: start, end, row (of each word), first (index of each row's first word)."""

    __slots__ = ("end", "first", "raw", "row", "start")

    def __init__(self, raw: np.ndarray, off: np.ndarray, separator: np.ndarray = SPACE):
        self.raw = raw
        body = ~separator[raw]
        before = np.empty_like(body)
        before[:1] = False
        before[1:] = body[:-1]
        inner = off[:-1][off[:-1] < len(raw)]
        before[inner] = False
        self.start = np.flatnonzero(body & ~before)
        after = np.empty_like(body)
        after[-1:] = False
        after[:-1] = body[1:]
        after[off[1:][off[1:] > 0] - 1] = False
        self.end = np.flatnonzero(body & ~after) + 1
        self.first = np.searchsorted(self.start, off)
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(self.first))

    def hashes(self, fold: np.ndarray | None = FOLD) -> np.ndarray:
        return span_hashes(self.raw if fold is None else fold[self.raw], self.start, self.end)


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, zeros after the end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))


def chunks(view: np.ndarray, start: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Bytes 8 k to 8 k + 7 of the spans, zeros after their ends; spans must be longer than 8 k."""
    return view[start + 8 * k] & _MASK[np.minimum(size - 8 * k, 8)]


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span raw[start:end], none of them empty. Spans of seven bytes or fewer never share one."""
    view, size = eights(raw), end - start
    out = mix(chunks(view, start, size, 0) ^ (size.astype(np.uint64) << np.uint64(56)))
    more, k = np.flatnonzero(size > 8), 1
    while len(more):
        out[more] = mix((out[more] ^ chunks(view, start[more], size[more], k)) * np.uint64(_BASE) + np.uint64(k))
        k += 1
        more = more[size[more] > 8 * k]
    return out


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n words (over row ends too: callers mask these)."""
    out = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for k in range(n):
        out = out * np.uint64(_BASE) + words[k : k + len(out)]
    return mix(out)


def windows(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word and row of every window of n words that lies in one row."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return first[row] + within, row

