"""SimHash fingerprints of word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, doc_columns, text_bytes, tidy

_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)
_BYTE_SLOT = (np.arange(8, dtype=np.int64) * 256)[None, :]


def words_of(raw: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; other letters stay."""
    return raw.lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` space-joined words, repeats included; fewer words make one run."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(42)), np.uint64, len(words) - size + 1)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent hash of each hash: k=0 is the hash itself, others a splitmix step away."""
    if k == 0:
        return h
    x = h + np.uint64((0x9E3779B97F4A7C15 * k) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bit_votes(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    seen = np.bincount((h.view(np.uint8).reshape(-1, 8) + _BYTE_SLOT).ravel(), minlength=2048)
    return (seen.reshape(8, 256) @ _BYTE_BITS).ravel()


def fingerprint(h: np.ndarray, n_words: int = 1) -> bytes:
    """``n_words`` 64-bit little-endian words; a bit is 1 if set in over half the hashes."""
    if not len(h):
        return bytes(8 * n_words)
    return b"".join(np.packbits(bit_votes(mixed(h, k)) * 2 > len(h), bitorder="little").tobytes() for k in range(n_words))


def set_hash(unique: np.ndarray) -> int:
    """A signed 64-bit hash of a set of shingle hashes, given in order."""
    return int(np.uint64(xxhash.xxh64_intdigest(unique.tobytes(), 7)).view(np.int64))


def fingerprints(docs: DataFrame, shingle: int = 3, bits: int = 64, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, fp)`` for every row; fp is binary, ``bits / 8`` bytes.

    Whole texts are read.  Null and empty texts get the zero fingerprint.  With
    ``distinct`` a repeated shingle votes once, and ``(set_hash, n)`` of the set of
    shingles follow.  Rows are kept one for one, null and repeated ids included.
    """
    if bits % 64 or bits <= 0 or shingle <= 0:
        raise ValueError("bits must be a multiple of 64, shingle positive")
    n_words = bits // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in byte_slices(whole, "text")):
            fps, hashes, sizes = [], [], []
            for raw in text_bytes(b.column("text")):
                h = shingle_hashes(words_of(raw), shingle)
                if distinct:
                    h = np.unique(h)
                    hashes.append(set_hash(h))
                    sizes.append(len(h))
                fps.append(fingerprint(h, n_words))
            columns, names = [b.column("doc_id"), b.column("text_hash"), pa.array(fps, pa.binary())], ["doc_id", "text_hash", "fp"]
            if distinct:
                columns, names = [*columns, pa.array(hashes, pa.int64()), pa.array(sizes, pa.int64())], [*names, "set_hash", "n"]
            yield pa.RecordBatch.from_arrays(columns, names)
        tidy()

    own = doc_columns(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return own.mapInArrow(run, "doc_id long, text_hash long, fp binary" + ", set_hash long, n long" * distinct)
