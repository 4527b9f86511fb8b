"""Operator 9: quality rules by counts and by bands of zstandard ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import doc_columns
from .wordhash import column_words, window_hashes

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, chunks long, chunks_out long, base_failed boolean, kept boolean"


@dataclass(frozen=True)
class Bands:
    """Limits of raw size over compressed size.

    whole: ``(bytes from, lowest, highest)`` by ascending length of the text; chunk:
    ``(lowest, highest)`` of each full chunk of ``chunk_bytes``; the bytes after the last
    full chunk are a chunk with the limits of their own length.  A text fails if more
    than ``chunks_out`` of its chunks lie outside.  A text compresses better the longer
    it is, so both limits rise with its length.  The lowest are just under the least
    ratio of clean text of that length; from 128 bytes they lie over that of base64,
    from 1.3 KB over that of random letters; below that some clean text is as dense.
    Below 64 bytes the frame's own bytes outweigh the text and nothing is judged.
    """

    whole: tuple = (
        (64, 0.86, 3.0), (96, 0.90, 3.0), (128, 1.04, 3.0), (192, 1.15, 3.0), (256, 1.28, 3.2), (384, 1.33, 3.2), (512, 1.42, 3.2), (768, 1.50, 3.2), (1024, 1.64, 3.6), (1280, 1.70, 3.6),
        (1536, 1.76, 3.6), (2048, 1.84, 3.6), (3072, 1.92, 3.6), (4096, 1.92, 4.2), (16384, 2.15, 5.0), (65536, 2.15, 6.0),
    )
    chunk_bytes: int = 4096
    chunk: tuple = (1.92, 4.4)
    chunks_out: float = 0.25
    level: int = 3

    def limits(self, size: int) -> tuple[float, float]:
        low, high = 0.0, float("inf")
        for start, a, b in self.whole:
            if size >= start:
                low, high = a, b
        return low, high


def compression(raw: bytes, bands: Bands, coder: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """(ratio of the whole text, chunks, chunks out of the band, verdict); a rest of 64 bytes or more after the full chunks is one too."""
    if not raw:
        return 0.0, 0, 0, True
    ratio = len(raw) / len(coder.compress(raw))
    low, high = bands.limits(len(raw))
    n = len(raw) // bands.chunk_bytes
    out = 0
    for k in range(n):
        r = bands.chunk_bytes / len(coder.compress(raw[k * bands.chunk_bytes : (k + 1) * bands.chunk_bytes]))
        out += not bands.chunk[0] <= r <= bands.chunk[1]
    rest = raw[n * bands.chunk_bytes :]
    if n and len(rest) >= bands.whole[0][0]:
        low_rest, high_rest = bands.limits(len(rest))
        n += 1
        out += not low_rest <= len(rest) / len(coder.compress(rest)) <= high_rest
    return ratio, n, out, low <= ratio <= high and out <= bands.chunks_out * n


def repeated_words(h: np.ndarray, size: int = 5) -> int:
    """Words in windows of ``size`` words that are found twice or more, the first included."""
    w = window_hashes(h, size)
    if len(w) < 2:
        return 0
    order = np.argsort(w)
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that are equal to an earlier line."""
    if b"\n" not in raw:
        return 0
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
    return len(lines) - len(set(lines))


def quality_rules(docs: DataFrame, bands: Bands | None = None, min_words: int = 10, max_repeat_percent: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs`` with its counts, its zstandard ratios and whether it is kept.

    base_failed: fewer than ``min_words`` words, or over ``max_repeat_percent`` of them
    in repeated 5-word windows.  kept: false if so, else whether the ratios lie in
    the bands.  Whole texts are read.  Null and empty texts have no words, so they
    fail.  Nothing moves between tasks.
    """
    bands = bands or Bands()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=bands.level)
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                b = whole.slice(k, 500)
                _, _, _, first, h = column_words(b.column("text"))
                rows = []
                for d, text in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                    raw = text or b""
                    own = h[first[d] : first[d + 1]]
                    n = len(own)
                    points = len(raw.decode()) if not raw.isascii() else len(raw)
                    chars = points - (len(raw) - len(raw.translate(None, _SPACE)))
                    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
                    repeat = repeated_words(own)
                    ratio, chunks, out, fine = compression(raw, bands, coder)
                    failed = n < min_words or 100 * repeat > max_repeat_percent * n
                    rows.append((n, chars, symbols, duplicate_lines(raw), repeat, ratio, chunks, out, failed, fine and not failed))
                kinds = [pa.int64()] * 5 + [pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], [x.split()[0] for x in _SCHEMA.split(", ")])

    return doc_columns(docs, id_col, text_col).mapInArrow(run, _SCHEMA)
