"""Operator 12: draw documents like a target set, weights by bit-sliced aggregation over hashed n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, checkpointed, doc_columns, in_order, small_batches, tidy
from .wordhash import ascii_lower, flat_utf8, word_spans

#: Bytes that part words: all of ASCII but digits and lower-case letters.
BREAK = np.ones(256, bool)
BREAK[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
SHORT = 64


def _steps() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (table & np.uint32(1)))
    return table


_STEP = _steps()
_BYTES = np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32))[:, None]


def _applied(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit values, given by its values for each byte at each of 4 places."""
    return table[0][x & 255] ^ table[1][x >> 8 & 255] ^ table[2][x >> 16 & 255] ^ table[3][x >> 24]


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """What a CRC becomes when 0 .. 63 bytes of zero follow, and when 64, 128, 256 .. do."""
    few = np.empty((SHORT + 1, 4, 256), np.uint32)
    few[0] = _BYTES
    for k in range(SHORT):
        few[k + 1] = _STEP[few[k] & 255] ^ few[k] >> 8
    many = [few[SHORT]]
    for _ in range(34):
        many.append(_applied(many[-1], many[-1]))
    return few, many


_FEW, _MANY = _shift_tables()


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC-32 of ``A`` carried over ``length`` more bytes: ``crc(A + B) == shifted(crc(A), len(B)) ^ crc(B)``."""
    low = length % SHORT
    out = _FEW[low, 0, crc & 255] ^ _FEW[low, 1, crc >> 8 & 255] ^ _FEW[low, 2, crc >> 16 & 255] ^ _FEW[low, 3, crc >> 24]
    rest, k = length // SHORT, 0
    while rest.any():
        odd = (rest & 1).astype(bool)
        out[odd] = _applied(_MANY[k], out[odd])
        rest, k = rest >> 1, k + 1
    return out


def span_crcs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each span of bytes, a byte of all short spans at a time."""
    length = ends - starts
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    live = np.flatnonzero(length <= SHORT)
    for k in range(SHORT):
        live = live[length[live] > k]
        if not len(live):
            break
        s = state[live]
        state[live] = _STEP[(s ^ raw[starts[live] + k]) & 255] ^ s >> 8
    out = state ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(length > SHORT).tolist():
        out[k] = zlib.crc32(raw[starts[k] : ends[k]])
    return out


def text_features(column: pa.Array, longest: int = 3, buckets: int = 10000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, text of each feature, bucket of each feature): runs of 1 to ``longest`` words joined by a space."""
    raw, offsets = flat_utf8(column)
    raw = ascii_lower(raw)
    starts, ends, first = word_spans(raw, offsets, space=BREAK)
    own, length, words = span_crcs(raw, starts, ends), ends - starts, np.diff(first)
    text = np.repeat(np.arange(len(words)), words)
    texts, found, run = [text], [own % buckets], own
    one = np.ones(1, np.int64)
    space = np.uint32(zlib.crc32(b" "))
    for n in range(2, longest + 1):
        # the run that begins at each word, carried over a space and the word after it
        run = shifted(shifted(run[:-1], one) ^ space, length[n - 1 :]) ^ own[n - 1 :]
        whole = text[: len(run)] == text[n - 1 :]
        texts.append(text[: len(run)][whole])
        found.append(run[whole] % buckets)
    return words, np.concatenate(texts), np.concatenate(found)


def bucket_counts(texts: DataFrame, longest: int = 3, buckets: int = 10000) -> DataFrame:
    """``(bucket, n)``: features of all texts in each bucket that has any; a task adds up its own before they move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for whole in batches:
            for b in byte_slices(whole, "text"):
                total += np.bincount(text_features(b.column("text"), longest, buckets)[2], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])
        tidy()

    return texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, longest: int = 3, buckets: int = 10000) -> DataFrame:
    """``(bucket, gain)``, a row for every bucket: ``floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))``.

    s and t: features of ``docs`` and of ``target`` in the bucket, S and T in all.
    """
    counts = checkpointed(bucket_counts(docs, longest, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(bucket_counts(target, longest, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))))
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    held = counts.unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    total = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    d = lambda c, more: F.col(c).cast("double") + F.lit(float(more))
    return held.crossJoin(F.broadcast(total)).select("bucket", F.floor(1000 * F.ln(d("t", 1) * d("all_s", buckets) / (d("s", 1) * d("all_t", buckets)))).cast("long").alias("gain"))


def gain_planes(gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bit planes, what a bit of each is worth) of signed values in two's complement: the top plane counts below zero."""
    bits = int(max(gains.max(initial=0), ~gains.min(initial=0))).bit_length() + 1
    planes = [_plane(gains >> k & 1) for k in range(bits)]
    worth = [1 << k for k in range(bits - 1)] + [-(1 << (bits - 1))]
    return np.stack(planes), np.array(worth, np.int64)


def _plane(bits: np.ndarray) -> np.ndarray:
    """0 and 1 along the last axis as 64-bit words."""
    n = -bits.shape[-1] % 64
    padded = np.concatenate([bits, np.zeros((*bits.shape[:-1], n), bits.dtype)], axis=-1).astype(np.uint8)
    return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)


def sliced_weights(counts: np.ndarray, planes: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """``counts @ gains``, exactly: each pair of a count plane and a gain plane is ANDed, its bits counted and worth a power of two."""
    out = np.zeros(len(counts), np.int64)
    for k in range(int(counts.max(initial=0)).bit_length()):
        own = _plane(counts >> k & 1)
        for plane, each in zip(planes, worth.tolist(), strict=True):
            out += np.bitwise_count(own & plane).sum(axis=1, dtype=np.int64) * (each << k)
    return out


def document_weights(docs: DataFrame, gains: np.ndarray, longest: int = 3) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` of each row of ``(doc_id, text)``: the sum of its features' gains."""
    held = docs.sparkSession.sparkContext.broadcast(gain_planes(gains))
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, worth = held.value
        for whole in batches:
            for b in byte_slices(whole, "text", rows=64):
                words, text, bucket = text_features(b.column("text"), longest, buckets)
                counts = np.bincount(text * buckets + bucket, minlength=b.num_rows * buckets).reshape(b.num_rows, buckets)
                n = np.bincount(text, minlength=b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, (words, n, sliced_weights(counts, planes, worth)))], ["doc_id", "n_words", "n_features", "weight"])
        tidy()

    return docs.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, longest: int = 3, buckets: int = 10000, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` for every row of ``docs``; rows that are drawn have a rank.

    Words are runs of digits, lower-cased a-z and what is beyond ASCII; features all
    runs of 1 to ``longest`` words, in ``buckets`` by CRC-32.  A bucket's gain says how
    much likelier it is in ``target``; a document's weight is the sum over its
    features, from bit planes of its bucket counts and of the gains.  The score adds
    Gumbel noise of the id's hash, so the highest scores are a draw in proportion to
    exp(weight / 1000) without replacement.  Of the N rows of ``least_words`` words or
    more, ``percent`` hundredths are drawn, rounded down, ties to the smaller id.

    Both tables are counted whole.  Texts are read twice and never move: a row for
    each bucket and task does, and ids with scores, which are sorted by ranges.  Only
    the gains, one for each bucket, reach every task.

    Null and empty texts have no features, weight 0 and are not drawn.  A null id
    hashes like an empty one and sorts last; repeated rows are drawn each for itself.
    Empty ``target`` or ``docs``: its counts are 0; no documents give no rows.
    """
    if not 0 <= percent <= 100:
        raise ValueError("percent must be from 0 to 100")
    own = doc_columns(docs, id_col, text_col)
    small_batches(docs.sparkSession)
    wanted = target.select(F.col(f"`{target_text}`").cast("string").alias("text"))
    gains = np.zeros(buckets, np.int64)
    for row in bucket_gains(own.select("text"), wanted, longest, buckets).collect():  # a row for each bucket
        gains[row["bucket"]] = row["gain"]
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = document_weights(own, gains, longest).withColumn("score", (F.col("weight") + noise).cast("long"))
    order = [F.col("n_words") < least_words, F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_tie")]
    scored = checkpointed(scored.withColumn("_tie", F.monotonically_increasing_id()))
    drawn = (scored.agg(F.count_if(F.col("n_words") >= least_words)).first()[0] or 0) * percent // 100
    ranked = in_order(scored, order, "rank").withColumn("rank", F.col("rank") + 1)
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that :func:`resampled` draws; all columns stay.  Rows that share a drawn id stay together, rows without an id go."""
    ids = resampled(docs, target, id_col=id_col, **options).where("rank is not null and doc_id is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, F.col(f"`{id_col}`").cast("long") == F.col("_drawn"), "left_semi")
