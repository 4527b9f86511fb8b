"""Simple-8b: word-aligned coding of integers, vectorised over blocks.

A 64-bit word has a selector in its low 4 bits and a payload of 60 bits.  The
selector names how many values share the payload and how wide each is.  Selector
0 is the escape: the next word is one literal value of up to 64 bits.  No word
crosses a block of ``BLOCK`` values; a block's last word may hold fewer values
than its selector names, as the block's length tells.  So blocks are coded and
decoded side by side, from the word offsets of their starts.
"""

from __future__ import annotations

import numpy as np

BLOCK = 4096
# Fixed: values in a payload for selectors 1 to 14; the width is 60 // count.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.where(np.arange(15) == 0, 64, 60 // COUNTS)
U = np.uint64


_SHORT = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def bit_length(v: np.ndarray) -> np.ndarray:
    """Bits that each unsigned value needs."""
    if not len(v) or int(v.max()) < 1 << 16:
        return _SHORT[v.astype(np.uint16)]
    out = np.zeros(len(v), np.uint8)
    for shift in (0, 16, 32, 48):
        part = _SHORT[((v >> U(shift)) & U(0xFFFF)).astype(np.uint16)]
        out = np.where(part > 0, part + np.uint8(shift), out)
    return out


def _choose(need: np.ndarray) -> np.ndarray:
    """For each place of each block (a row, zeros after its end): the selector of the most values that fit from there."""
    width = need.shape[1] - 60
    widest, reach = {1: need}, 1
    for c in sorted({int(c) for c in COUNTS} - {1}):
        z = widest[reach].copy()  # the window of c is two overlapping windows of the next smaller count
        lead = c - reach
        while lead > reach:
            z[:, :-reach] = np.maximum(z[:, :-reach], z[:, reach:].copy())
            lead -= reach
        z[:, :-lead] = np.maximum(z[:, :-lead], z[:, lead:].copy())
        widest[c], reach = z, c
    pick = np.zeros(need.shape, np.uint8)
    for s in range(14, 0, -1):
        np.copyto(pick, np.uint8(s), where=widest[int(COUNTS[s])] <= WIDTHS[s])
    return pick[:, :width]


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): offsets[k] is the first word of block k, with the number of words at the end."""
    v = np.ascontiguousarray(values, np.uint64)
    n = len(v)
    n_blocks = -(-n // block)
    if not n:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    flat = np.zeros(n_blocks * block, np.uint8)
    flat[:n] = bit_length(v)
    need = np.zeros((n_blocks, block + 60), np.uint8)
    need[:, :block] = flat.reshape(n_blocks, block)
    pick = _choose(need).ravel()[:n]
    step = COUNTS[pick]
    pos = np.arange(n_blocks) * block
    stop = np.minimum(pos + block, n)
    where, owner, live = [], [], np.arange(n_blocks)
    while len(live):
        here = pos[live]
        where.append(here)
        owner.append(live)
        pos[live] = here = here + step[here]
        live = live[here < stop[live]]
    start, owner = np.concatenate(where), np.concatenate(owner)
    order = np.argsort(start)
    start, owner = start[order], owner[order]
    sel = pick[start]
    size = 1 + (sel == 0)
    first = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in np.unique(sel):
        rows = np.flatnonzero(sel == s)
        p, last = start[rows], stop[owner[rows]]
        if s == 0:
            words[first[rows] + 1] = v[p]
            continue
        word = np.full(len(rows), s, np.uint64)
        for k in range(int(COUNTS[s])):
            at = p + k
            word |= np.where(at < last, v[np.minimum(at, n - 1)], U(0)) << U(4 + k * int(WIDTHS[s]))
        words[first[rows]] = word
    per_block = np.bincount(owner, weights=size, minlength=n_blocks).astype(np.int64)
    return words, np.concatenate([[0], np.cumsum(per_block)])


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` values; any run of whole blocks can be decoded on its own with its offsets from 0."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    w = np.asarray(words, np.uint64)
    literal = np.zeros(len(w), bool)
    sel = (w & U(15)).astype(np.int64)
    # a literal follows an escape; a literal that looks like an escape is none, so runs of zeros alternate
    zero = np.flatnonzero(sel == 0)
    if len(zero):
        block_of = np.searchsorted(offsets, zero, "right")
        new = np.concatenate([[True], (np.diff(zero) > 1) | (np.diff(block_of) > 0)])
        begin = zero[new][np.cumsum(new) - 1]
        escape = zero[(zero - begin) % 2 == 0]
        literal[escape + 1] = True
    head = np.flatnonzero(~literal)
    sel = sel[head]
    owner = np.searchsorted(offsets, head, "right") - 1
    full = COUNTS[sel]
    before = np.cumsum(full) - full
    first_of = np.searchsorted(head, offsets[:-1])
    start = owner * block + before - before[first_of][owner]
    stop = np.minimum((owner + 1) * block, n)
    for s in np.unique(sel):
        rows = np.flatnonzero(sel == s)
        p = start[rows]
        if s == 0:
            out[p] = w[head[rows] + 1]
            continue
        payload, keep = w[head[rows]] >> U(4), U((1 << int(WIDTHS[s])) - 1)
        for k in range(int(COUNTS[s])):
            ok = p + k < stop[rows]
            out[p[ok] + k] = (payload[ok] >> U(k * int(WIDTHS[s]))) & keep
    return out
