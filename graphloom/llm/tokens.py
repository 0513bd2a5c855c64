"""Token ids of many texts at once, by the tokenizers library with a table of words already seen.

One kind of split is known here (lower-cased runs of letters, single digits, runs of other characters, contractions; white
space is dropped). Where a tokenizer file states just this split, texts are cut into its words by vector operations, and the
library's model sees every distinct word once per worker. A word is looked up by a hash and then compared byte by byte
with the word that the table holds. Texts that the split would treat otherwise (beyond Latin-1, control characters, special tokens, a word
whose hash is taken by another) and all texts of other tokenizer files go through the whole library. Ids are the library's in either case.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np

from .textvec import chunks, eights, span_hashes

#: Entries of the word table at most; it starts again beyond.
TABLE_ENTRIES = 1 << 21
# The normaliser, pre-tokeniser and model settings that the split below reproduces.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

_SPACE, _LETTER, _NUMBER, _OTHER, _ODD = range(5)


def _kind(cp: int) -> int:
    if cp in (9, 10, 13, 32):
        return _SPACE
    if cp < 32 or 127 <= cp <= 160:
        return _ODD
    return {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(cp))[0], _OTHER)


_KIND = np.array([_kind(cp) for cp in range(256)], np.uint8)
_LOWER = np.array([ord(chr(cp).lower()) for cp in range(256)], np.int64)


def _byte_names() -> dict[int, int]:
    """Printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 as is, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


def has_known_split(config: dict) -> bool:
    """Whether a tokenizer file's split is the one of this module, and its ids depend on single words only."""
    model = config.get("model", {})
    special = all(t["content"].startswith("<|") and not t["normalized"] for t in config.get("added_tokens", []))
    plain = not config.get("truncation") and not config.get("padding") and model.get("type") == "BPE" and not model.get("dropout")
    return config.get("normalizer") == NORMALIZER and config.get("pre_tokenizer") == PRE_TOKENIZER and special and plain


class WordTable:
    """Open addressing over 64-bit word hashes; values are places in a flat list of ids. Words are kept as chunks of eight bytes."""

    def __init__(self) -> None:
        self.reset(1 << 16)

    def reset(self, size: int) -> None:
        self.keys, self.at = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.used, self.offsets, self.flat = 0, np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)
        self.n_ids = 0
        self.size, self.chunk_at, self.chunk, self.n_chunks = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 13, np.uint64), 0

    def same(self, entry: np.ndarray, view: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the spans are the words of the entries, byte by byte."""
        out = self.size[entry] == size
        left, k = np.flatnonzero(out), 0
        while len(left):
            equal = self.chunk[self.chunk_at[entry[left]] + k] == chunks(view, start[left], size[left], k)
            out[left[~equal]] = False
            k += 1
            left = left[equal & (size[left] > 8 * k)]
        return out

    def _keep(self, view: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """The words of entries from used on."""
        need = -(-size // 8)
        while self.n_chunks + need.sum() > len(self.chunk):
            self.chunk = np.concatenate([self.chunk, np.zeros_like(self.chunk)])
        own = slice(self.used, self.used + len(size))
        self.size[own], self.chunk_at[own] = size, self.n_chunks + np.cumsum(need) - need
        left, k = np.arange(len(size)), 0
        while len(left):
            self.chunk[self.chunk_at[own][left] + k] = chunks(view, start[left], size[left], k)
            k += 1
            left = left[size[left] > 8 * k]
        self.n_chunks += int(need.sum())

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 if it isn't there."""
        mask = np.uint64(len(self.keys) - 1)
        slot = h & mask
        out = np.full(len(h), -1, np.int64)
        seen = self.keys[slot]
        hit = seen == h
        out[hit] = self.at[slot[hit]]
        left = np.flatnonzero(~hit & (seen != 0))
        while len(left):
            slot[left] = (slot[left] + np.uint64(1)) & mask
            seen = self.keys[slot[left]]
            hit = seen == h[left]
            out[left[hit]] = self.at[slot[left[hit]]]
            left = left[~hit & (seen != 0)]
        return out

    def _place(self, h: np.ndarray, at: np.ndarray) -> None:
        mask = np.uint64(len(self.keys) - 1)
        slot = h & mask
        left = np.arange(len(h))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = h[free]
            won = free[self.keys[slot[free]] == h[free]]
            self.at[slot[won]] = at[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + np.uint64(1)) & mask

    def add(self, h: np.ndarray, ids: list[list[int]], view: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        while (self.used + len(h)) * 2 > len(self.keys):
            old = np.flatnonzero(self.keys)
            keys, at = self.keys[old], self.at[old]
            self.keys, self.at = np.zeros(2 * len(self.keys), np.uint64), np.zeros(2 * len(self.at), np.int64)
            self._place(keys, at)
        lengths = np.array([len(x) for x in ids], np.int64)
        flat = np.array([x for own in ids for x in own], np.uint32)
        while self.n_ids + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.used + len(h) + 1 > len(self.offsets):
            self.offsets, self.size, self.chunk_at = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offsets, self.size, self.chunk_at))
        self._keep(view, start, size)
        self.flat[self.n_ids : self.n_ids + len(flat)] = flat
        self.offsets[self.used + 1 : self.used + 1 + len(h)] = self.n_ids + np.cumsum(lengths)
        self._place(h, np.arange(self.used, self.used + len(h)))
        self.used += len(h)
        self.n_ids += len(flat)


class Encoder:
    """Ids of texts with one tokenizer, given as its file's text."""

    def __init__(self, config: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_str(config), has_known_split(json.loads(config))
        self.model, self.names, self.table = self.tokenizer.model, _byte_names(), WordTable()

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, raw: np.ndarray, off: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts raw[off[i]:off[i+1]], each followed by end, and the number of ids of each."""
        n = len(off) - 1
        row_of = np.repeat(np.arange(n), np.diff(off))
        lead = (raw & 0xE0) == 0xC0
        point = raw.astype(np.int64)
        second = np.flatnonzero(lead[:-1]) + 1 if len(raw) else np.zeros(0, np.int64)
        kind = _KIND[raw]
        high = raw >= 0x80
        odd = (kind == _ODD) & ~high
        odd |= raw >= 0xC4
        cp = ((raw[second - 1].astype(np.int64) & 3) << 6) | (raw[second] & 0x3F)
        kind[second] = kind[second - 1] = _KIND[cp]
        odd[second] |= _KIND[cp] == _ODD
        mark = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124)) if len(raw) else np.zeros(0, np.int64)
        odd[mark] = True
        slow = np.zeros(n, bool)
        slow[row_of[odd]] = True
        if not self.fast:
            slow[:] = True
        low = point
        ascii_ = ~high
        low[ascii_] = _LOWER[raw[ascii_]]
        low = low.astype(np.uint8)
        low[second] = 0x80 | (_LOWER[cp] & 0x3F)  # lower case stays under the same lead byte
        if slow.any():
            kind[slow[row_of]] = _SPACE

        # words: runs of one kind, every digit alone
        body = kind != _SPACE
        first = body.copy()
        first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        first[off[:-1][off[:-1] < len(raw)]] |= body[off[:-1][off[:-1] < len(raw)]]
        first[second] = False
        start = np.flatnonzero(first)
        stop = body.copy()
        stop[:-1] &= ~body[1:] | first[1:]
        stop[off[1:][off[1:] > 0] - 1] = body[off[1:][off[1:] > 0] - 1]
        end_at = np.flatnonzero(stop) + 1
        keep = self._contractions(low, kind, start, end_at)
        start, end_at = start[keep], end_at[keep]

        words = span_hashes(low, start, end_at)
        words[words == 0] = 1
        view, size = eights(low), end_at - start
        entry = self.table.find(words)
        if (missing := np.flatnonzero(entry < 0)).size:
            new, at = np.unique(words[missing], return_index=True)
            if self.table.used + len(new) > TABLE_ENTRIES:
                self.table.reset(1 << 16)
                new, at = np.unique(words, return_index=True)
                missing = np.arange(len(words))
            text, model, names, at = low.tobytes(), self.model, self.names, missing[at]
            cuts = zip(start[at].tolist(), end_at[at].tolist(), strict=True)
            self.table.add(new, [[t.id for t in model.tokenize(text[a:b].decode("latin-1").translate(names))] for a, b in cuts], view, start[at], size[at])
            entry = self.table.find(words)
        if not (same := self.table.same(entry, view, start, size)).all():  # another word has the hash
            slow[row_of[start[~same]]] = True
            left = ~slow[row_of[start]]
            start, entry = start[left], entry[left]
        lengths = self.table.offsets[entry + 1] - self.table.offsets[entry]
        row = row_of[start] if len(start) else np.zeros(0, np.int64)
        per_row = np.bincount(row, weights=lengths, minlength=n).astype(np.int64)
        extra = {}
        if slow.any():
            rows = np.flatnonzero(slow)
            ids = self.whole([raw[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace") for i in rows])
            extra = dict(zip(rows.tolist(), ids, strict=True))
            per_row[rows] = [len(x) for x in ids]
        per_row += 1
        base = np.concatenate([[0], np.cumsum(per_row)])
        out = np.full(base[-1], end, np.uint32)
        total = int(lengths.sum())
        before = np.cumsum(lengths) - lengths
        within = np.arange(total) - np.repeat(before, lengths)
        row_first = np.zeros(n, np.int64)
        if len(row):
            lead_word = np.concatenate([[True], row[1:] != row[:-1]])
            row_first[row[lead_word]] = before[lead_word]
        place = np.repeat(base[row] + before - row_first[row], lengths) + within
        out[place] = self.table.flat[np.repeat(self.table.offsets[entry], lengths) + within]
        for i, ids in extra.items():
            out[base[i] : base[i + 1] - 1] = ids
        return out, per_row

    @staticmethod
    def _contractions(low: np.ndarray, kind: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Joins a lone apostrophe with the s, t, m, d, re, ve or ll after it, in place; False for words that this empties."""
        keep = np.ones(len(start), bool)
        if len(start) < 2:
            return keep
        i = np.flatnonzero((end[:-1] - start[:-1] == 1) & (low[start[:-1]] == 39) & (start[1:] == end[:-1]) & (kind[start[1:]] == _LETTER))
        if not len(i):
            return keep
        a = low[start[i + 1]]
        b = np.where(end[i + 1] - start[i + 1] > 1, low[np.minimum(start[i + 1] + 1, len(low) - 1)], 0)
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        n = np.where(one, 1, np.where(two, 2, 0))
        end[i] += n
        start[i + 1] += n
        keep[i + 1] = start[i + 1] < end[i + 1]
        return keep
