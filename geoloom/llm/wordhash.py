"""Words of whole Arrow text columns as numpy arrays: spans and 64-bit hashes, without a Python string for each word.

A word is a run ``[^\\x20\\x09-\\x0D]+`` of bytes.  Its hash is a polynomial over
its bytes modulo 2^64 (random byte values, odd base), read off one running sum
over the buffer.  The values are fixed, so every executor gets the same hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def flat_utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of each); null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): word k is ``raw[starts[k]:ends[k]]``, text d has words ``first[d]:first[d + 1]``.

    cuts: places where a word ends and another starts although no space lies between.
    space: which of the 256 bytes are no part of a word.
    """
    n = len(raw)
    inside = ~space[raw]
    breaks = np.zeros(n + 1, bool)
    breaks[offsets] = True
    if cuts is not None:
        breaks[cuts] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | breaks[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | breaks[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]))
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, U(base))
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 19) -> np.ndarray:
    """The hash of each span; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        lo = int(starts[k])
        j = max(int(np.searchsorted(ends, lo + step, "right")), k + 1)
        hi = int(ends[j - 1])
        up, down = _powers(hi - lo)
        sums = np.empty(hi - lo + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[raw[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = starts[k:j] - lo, ends[k:j] - lo
        out[k:j] = (sums[e] - sums[s]) * down[s]
        k = j
    return scrambled(out ^ (ends - starts).astype(np.uint64))


def scrambled(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def column_words(column: pa.Array, lower: bool = False):
    """(raw, starts, ends, first, hashes) of a text column; with ``lower``, A-Z count as a-z."""
    raw, offsets = flat_utf8(column)
    if lower:
        raw = ascii_lower(raw)
    starts, ends, first = word_spans(raw, offsets)
    return raw, starts, ends, first, span_hashes(raw, starts, ends)


def ascii_lower(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return raw + ((raw >= 65) & (raw <= 90)).view(np.uint8) * np.uint8(32)


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` values: sum of ``h[i + j] * B**j`` modulo 2^64, scrambled."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers(len(h))
    sums = np.empty(len(h) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return scrambled((sums[size:] - sums[:n]) * down[:n])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``starts[k] .. starts[k] + lengths[k] - 1`` one after another."""
    total = np.cumsum(lengths)
    if not len(total) or not total[-1]:
        return np.empty(0, np.int64)
    return np.arange(total[-1]) + np.repeat(starts - (total - lengths), lengths)


class HashIndex:
    """An open-addressing table from 64-bit hashes to 0, 1, 2, ... in order of arrival, looked up in bulk."""

    def __init__(self, bits: int = 16):
        self.clear(bits)

    def clear(self, bits: int = 16) -> None:
        self.bits, self.n = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where there is none."""
        out = np.full(len(h), -1, np.int32)
        at, slot, mask = None, (h >> U(64 - self.bits)).astype(np.int64), (1 << self.bits) - 1
        want = h
        while len(slot):
            value = self.values[slot]
            hit = (self.keys[slot] == want) & (value >= 0)
            if at is None:
                out = np.where(hit, value, -1).astype(np.int32)
                at = np.flatnonzero(~hit & (value >= 0))
                slot, want = slot[at], want[at]
            else:
                out[at[hit]] = value[hit]
                more = ~hit & (value >= 0)
                at, slot, want = at[more], slot[more], want[more]
            slot = (slot + 1) & mask
        return out

    def add(self, h: np.ndarray) -> None:
        """Number the hashes, which are distinct and not yet in the table, from ``n`` on."""
        while (self.n + len(h)) * 2 > 1 << self.bits:
            old = self.keys[self.values >= 0], self.values[self.values >= 0]
            self.bits += 1
            self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
            self._put(*old)
        self._put(h, np.arange(self.n, self.n + len(h), dtype=np.int32))
        self.n += len(h)

    def _put(self, h: np.ndarray, value: np.ndarray) -> None:
        slot, mask = (h >> U(64 - self.bits)).astype(np.int64), (1 << self.bits) - 1
        while len(h):
            free = self.values[slot] < 0
            s = slot[free]
            self.values[s] = value[free]
            self.keys[s] = h[free]  # of those that want one slot the last wins both writes
            left = self.keys[slot] != h
            h, value, slot = h[left], value[left], (slot[left] + 1) & mask
