"""Operator 5: packing neighbouring documents along a Hilbert curve into sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, doc_columns, scratch_path, tidy
from .tokens import encoder_for, tokenizer_text
from .wordhash import scrambled

DIMS, BITS = 3, 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of grid coordinates (``bits`` bits each), by Skilling's transpose (2004)."""
    x = [cells[:, k].astype(np.int64).copy() for k in range(cells.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for k in range(len(x)):
            high = (x[k] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[k]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[k] = x[k] if k == 0 else x[k] ^ swap
        q >>= 1
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    t = np.zeros(len(x[0]), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros(len(t), np.int64)
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | ((axis ^ t) >> b & 1)
    return key


def document_cells(ids: np.ndarray, offsets: np.ndarray, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """Grid coordinates of each document: its hashed token vector projected to ``dims`` random signs and scaled by its length."""
    n = np.maximum(np.diff(offsets), 1)
    out = np.empty((len(n), dims), np.int64)
    for k in range(dims):
        weight = (scrambled(ids.astype(np.uint64) + np.uint64((k + 1) << 40)) >> np.uint64(40)).astype(np.float64) / 2**23 - 1.0
        sums = np.concatenate([[0.0], np.cumsum(weight)])
        z = (sums[offsets[1:]] - sums[offsets[:-1]]) / n  # a mean of about -1 to 1
        out[:, k] = np.clip((np.tanh(4 * z) + 1) / 2 * ((1 << bits) - 1), 0, (1 << bits) - 1)
    return out


def cut_tail(lengths: list[int], size: int) -> Iterator[tuple[int, int, int, int, int]]:
    """An unfilled sequence cut at powers of two, the largest first.

    lengths: those of its pieces.  Gives ``(piece, begin in the piece, length, part, offset in the part)``.
    """
    left = sum(lengths)
    limits = [1 << b for b in range(size.bit_length() - 1, -1, -1) if left >> b & 1]
    part, offset = 0, 0
    for k, length in enumerate(lengths):
        at = 0
        while at < length:
            take = min(length - at, limits[part] - offset)
            yield k, at, take, part, offset
            at, offset = at + take, offset + take
            if offset == limits[part]:
                part, offset = part + 1, 0


def packed(docs: DataFrame, tokenizer_path: str, end_id: int = 2, size: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents in sequences of at most ``size`` tokens, neighbours along the curve together.

    Token ids are written once to the shared folder; then only they move, sorted by
    Hilbert key, id and a row number, which also parts copies of one text over the tasks.  Each
    task fills sequences without a gap and cuts what is left at the end at powers of
    two, so no sequence needs padding.  ``sequence_id`` is the task's number times
    2^32 plus a count.  with_ids: each piece has its token ids in a column ``ids``, so
    that a sequence is its pieces' ids in the order of their offsets.

    Null and empty texts are the end token alone.  Null and repeated ids are kept as
    rows of their own.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(tokenizer_text(tokenizer_path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(spec.value)
        for whole in batches:
            for b in byte_slices(whole, "text"):
                ids, offsets = encoder.encode_column(b.column("text"), end_id)
                keys = hilbert_keys(document_cells(ids, offsets))
                small = len(ids) == 0 or int(ids.max()) < 1 << 16
                raw = memoryview(ids.astype("<u2" if small else "<u4").tobytes())
                at = (offsets * (2 if small else 4)).tolist()
                texts = [bytes(raw[i:j]) for i, j in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(keys), pa.array(np.diff(offsets)), pa.array(texts, pa.binary())], ["doc_id", "curve", "n", "ids"])
        tidy()

    path = scratch_path(spark, "packing")
    doc_columns(docs, id_col, text_col).mapInArrow(encode, "doc_id long, curve long, n long, ids binary").write.parquet(path)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, full = TaskContext.get().partitionId() << 32, 0
        fill, tail = 0, []  # the open sequence: its tokens, and (document, start, length) in it
        rows: list[tuple] = []

        def row(doc, start: int, length: int, sequence: int, offset: int) -> tuple:
            doc_id, raw, n = doc
            piece = raw[4 * start : 4 * (start + length)]
            return doc_id, start, length, zlib.crc32(piece), n, base + sequence, offset, piece

        for b in batches:
            for doc_id, n, ids in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("ids").to_pylist(), strict=True):
                raw = ids if len(ids) == 4 * n else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                doc, start = (doc_id, memoryview(raw), n), 0
                while start < n:
                    take = min(n - start, size - fill)
                    tail.append((doc, start, take))
                    start, fill = start + take, fill + take
                    if fill == size:
                        at = 0
                        for d, s, k in tail:
                            rows.append(row(d, s, k, full, at))
                            at += k
                        full, fill, tail = full + 1, 0, []
            if rows:
                yield _batch(rows, with_ids)
                rows = []
        if tail:
            cut = cut_tail([length for _, _, length in tail], size)
            yield _batch([row(tail[k][0], tail[k][1] + at, take, full + part, offset) for k, at, take, part, offset in cut], with_ids)

    stored = spark.read.parquet(path).withColumn("_tie", F.monotonically_increasing_id())
    order = ["curve", "doc_id", "_tie"]
    return stored.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie").mapInArrow(pack, PIECES + (", ids array<int>" if with_ids else ""))


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECES.split(", ")]
    *columns, pieces = zip(*rows, strict=True)
    arrays = [pa.array(c, pa.int64()) for c in columns]
    if with_ids:
        at = np.concatenate([[0], np.cumsum(columns[2])]).astype(np.int32)
        arrays.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(pieces), "<i4"))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names)
