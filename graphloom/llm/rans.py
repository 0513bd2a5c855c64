"""Token files by a static range asymmetric numeral system.

One frequency table, shared by all blocks, is made from the counts of all ids: frequencies of at least 1 that sum to 2**20, or a higher
power of two where ids are many (:func:`table_bits`). A block is coded by interleaved lanes, id i by lane i mod lanes; a lane's state stays in [2**31, 2**63) and gives or takes 32
bits at a time. Blocks are independent. Within a block, checkpoints hold all lanes' states and the place in the stream, so a
reader may start there. A checksum covers the whole block.

Layout of a block, little-endian: ``RNS1``, lanes u32, ids u64, steps between checkpoints u32, checkpoints u32; for each
checkpoint the place u64 and the lanes' states u64; then the stream of u32; crc32 u32 of all before.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BITS = 20
LANES = 512
CHECKPOINT_STEPS = 256
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sIQII")


def table_bits(symbols: int) -> int:
    """Bits of a table with room for so many symbols, four places a symbol at least."""
    return max(BITS, min(30, max(symbols, 1).bit_length() + 2))


def quantise(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 where the count is."""
    out = np.zeros(len(counts), np.int64)
    present = counts > 0
    if not present.any():
        return out
    total = int(counts.sum())
    out[present] = np.maximum(1, [int(c) * (1 << bits) // total for c in counts[present]])
    rest = (1 << bits) - int(out.sum())
    order = np.argsort(-out, kind="stable")
    if rest >= 0:
        out[order[0]] += rest
    for i in order:
        if rest >= 0:
            break
        take = min(int(out[i]) - 1, -rest)
        out[i] -= take
        rest += take
    if rest < 0:
        raise ValueError("more symbols than the table has room for")
    return out


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.bits = max(int(freq.sum()).bit_length() - 1, 0)
        self.base = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbol

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> bytes:
        n = len(ids)
        steps = -(-n // lanes)
        f, c = self.freq[ids], self.base[ids]
        limit = f << np.uint64(63 - self.bits)
        state, words, given, marks = np.full(lanes, _LOW, np.uint64), [], 0, []
        shift, half, mask = np.uint64(self.bits), np.uint64(32), np.uint64(0xFFFFFFFF)
        for t in range(steps - 1, -1, -1):
            lo, hi = t * lanes, min(n, (t + 1) * lanes)
            x = state[: hi - lo]
            over = x >= limit[lo:hi]
            out = (x[over] & mask).astype(np.uint32)
            words.append(out)
            given += len(out)
            x = np.where(over, x >> half, x)
            q = x // f[lo:hi]
            state[: hi - lo] = (q << shift) + (x - q * f[lo:hi]) + c[lo:hi]
            if t % every == 0:
                marks.append((given, state.copy()))
        marks.reverse()
        body = [_HEAD.pack(b"RNS1", lanes, n, every, len(marks))]
        for back, s in marks:
            body += [struct.pack("<Q", given - back), s.astype("<u8").tobytes()]
        body.append(np.concatenate(words[::-1]).astype("<u4").tobytes() if words else b"")
        data = b"".join(body)
        return data + struct.pack("<I", zlib.crc32(data))

    def decode(self, block: bytes, checkpoint: int = 0) -> np.ndarray:
        """Ids of a block from a checkpoint on."""
        if zlib.crc32(memoryview(block)[:-4]) != struct.unpack_from("<I", block, len(block) - 4)[0]:
            raise ValueError("checksum does not match")
        magic, lanes, n, every, marks = _HEAD.unpack_from(block, 0)
        if magic != b"RNS1":
            raise ValueError("not a block")
        if not n:
            return np.zeros(0, np.uint32)
        size = 8 + 8 * lanes
        at = _HEAD.size + checkpoint * size
        place = struct.unpack_from("<Q", block, at)[0]
        state = np.frombuffer(block, "<u8", lanes, at + 8).astype(np.uint64)
        first = _HEAD.size + marks * size
        words = np.frombuffer(block, "<u4", (len(block) - 4 - first) // 4, first)
        steps, out = -(-n // lanes), np.empty(n - checkpoint * every * lanes, np.uint32)
        shift, half, low = np.uint64(self.bits), np.uint64(32), np.uint64((1 << self.bits) - 1)
        symbol, freq, base = self.symbol, self.freq, self.base
        done = 0
        for t in range(checkpoint * every, steps):
            m = min(lanes, n - t * lanes)
            x = state[:m]
            slot = x & low
            s = symbol[slot]
            out[done : done + m] = s
            done += m
            x = freq[s] * (x >> shift) + slot - base[s]
            short = np.flatnonzero(x < _LOW)
            if len(short):
                x[short] = (x[short] << half) | words[place : place + len(short)]
                place += len(short)
            state[:m] = x
        return out
