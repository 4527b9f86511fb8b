"""Operator 8: words of passages that repeat anywhere, by super-k-mer partitioning.

A window is ``size`` consecutive words.  Its key is the least hash of its runs of
``run`` words (its minimiser), so equal windows have equal keys.  Consecutive
windows of one key travel as one packed string to the bucket of the key, where
sorting counts each window among all that are equal to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, checkpointed, doc_columns, marked, parted, row_key, skew_join
from .wordhash import column_words, ragged, scrambled, window_hashes

U = np.uint64


@dataclass(frozen=True)
class Plan:
    """size: words in a window; run: words in a minimiser."""

    size: int = 35
    run: int = 4


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    if len(x) < width:
        return x[:0]
    reach = 1
    while reach * 2 <= width:
        x, reach = np.minimum(x[:-reach], x[reach:]), reach * 2
    return np.minimum(x[: len(x) - (width - reach)], x[width - reach :]) if width > reach else x


def segments(h: np.ndarray, first: np.ndarray, plan: Plan):
    """(start, end, text, key, spots) of the runs of windows that share a key.

    start, end: first and last window, numbered by first word; spots: places of the
    minimiser in the segment, two or more if the text may repeat within itself.
    """
    n = len(h) - plan.size + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, none, none.astype(np.uint64), none
    runs = window_hashes(h, plan.run)
    key = sliding_min(runs, plan.size - plan.run + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    valid = np.arange(n) + plan.size <= first[text + 1]
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]
    start = np.flatnonzero(new & valid)
    last = np.ones(n, bool)
    last[:-1] = new[1:] | ~valid[1:]
    end = np.flatnonzero(last & valid)
    spans = end - start + plan.size - plan.run + 1
    spots = np.zeros(len(start), np.int64)
    if len(start):
        at = np.cumsum(spans) - spans
        spots = np.add.reduceat((runs[ragged(start, spans)] == np.repeat(key[start], spans)).astype(np.int64), at)
    return start, end, text[start], key[start], spots


def joined_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All words with one space after each, and where each begins (with the total at the end)."""
    size = ends - starts + 1
    at = np.concatenate([[0], np.cumsum(size)])
    out = raw[np.minimum(ragged(starts, size), max(len(raw) - 1, 0))] if len(starts) else np.empty(0, np.uint8)
    out[at[1:] - 1] = 0x20
    return out.tobytes(), at


def window_pair(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each window, which sorting compares before the words."""
    return window_hashes(h, size), window_hashes(scrambled(h ^ U(0xD1B54A32D192ED03)), size)


def window_digests(line: bytes, at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """128-bit BLAKE2 digests, as two numbers, of the words of the windows that start at word ``rows`` of a line of :func:`joined_words`."""
    digest = hashlib.blake2b
    whole = b"".join([digest(line[i:j], digest_size=16).digest() for i, j in zip(at[rows].tolist(), (at[rows + size] - 1).tolist(), strict=True)])
    return np.frombuffer(whole, np.int64).reshape(-1, 2)


def repeated_windows(packed: list[bytes], times: np.ndarray, plan: Plan) -> list[np.ndarray]:
    """For each packed string the windows that start more than once, a string counting ``times`` times."""
    raw, starts, ends, first, h = column_words(pa.array(packed, pa.binary()))
    a, b = window_pair(h, plan.size)
    owner = np.repeat(np.arange(len(packed)), np.diff(first))[: len(a)]
    rows = np.flatnonzero(np.arange(len(a)) + plan.size <= first[owner + 1]) if len(a) else np.empty(0, np.int64)
    if not len(rows):
        return [np.empty(0, np.int64) for _ in packed]
    order = rows[np.lexsort((b[rows], a[rows]))]
    same = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
    text = raw.tobytes()
    lo, hi = starts[order], ends[order + plan.size - 1]
    group = np.concatenate([[0], np.cumsum(~same)])
    unlike = {int(group[k]) for k in np.flatnonzero(same).tolist() if text[lo[k] : hi[k]] != text[lo[k + 1] : hi[k + 1]]}
    for g in unlike:  # equal hashes of other words: each sequence is a group of its own
        own: dict[bytes, int] = {}
        spare = int(group.max()) + 1
        for k in np.flatnonzero(group == g).tolist():
            group[k] = own.setdefault(text[lo[k] : hi[k]], spare + len(own))
    total = np.bincount(group, weights=times[owner[order]])
    dup = np.sort(order[total[group] > 1])
    cut = np.searchsorted(dup, first)
    return [dup[cut[k] : cut[k + 1]] - first[k] for k in range(len(packed))]


def merged(windows: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Word ranges that the windows cover."""
    if not len(windows):
        return []
    gap = np.flatnonzero(np.diff(windows) > size)
    return list(zip(windows[np.concatenate([[0], gap + 1])].tolist(), (windows[np.concatenate([gap, [len(windows) - 1]])] + size).tolist(), strict=True))


def key_tables(own: DataFrame, plan: Plan, filter_bits: int, crowded_rows: int) -> tuple[np.ndarray, np.ndarray | None, int]:
    """(bit table of keys with two places or more, one of those with over ``crowded_rows`` or None, places of all others that are marked).

    Counts are summed a key, then each slot of the table takes the most of its keys,
    so a page of the table is made of at most as many rows as it has bits.
    """
    page_bits = min(18, filter_bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_slices(whole, "text"):
                _, _, _, first, h = column_words(b.column("text"))
                _, _, _, key, spots = segments(h, first, plan)
                keys, at = np.unique(key, return_inverse=True)
                n = np.bincount(at, weights=spots, minlength=len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    def bit_page(table: pa.Table) -> pa.Table:
        slot, n = table.column("slot").to_numpy(), table.column("n").to_numpy()
        flat, hot = np.zeros(1 << page_bits, np.uint8), np.zeros(1 << page_bits, np.uint8)
        flat[slot], hot[slot[n > crowded_rows]] = 1, 1
        written = [np.packbits(x, bitorder="little").tobytes() for x in (flat, hot)]
        calm = int(table.column("calm").to_numpy().sum())
        return pa.table({"page": table.column("page").slice(0, 1), "bits": pa.array(written[:1], pa.binary()), "hot": pa.array([written[1] if hot.any() else None], pa.binary()), "calm": pa.array([calm])})

    counted = own.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    place = F.shiftrightunsigned("key", 64 - filter_bits)
    slots = counted.groupBy(F.shiftrightunsigned(place, page_bits).cast("int").alias("page"), place.bitwiseAND(F.lit((1 << page_bits) - 1)).cast("int").alias("slot"))
    slots = slots.agg(F.max("n").alias("n"), F.sum(F.when(F.col("n") <= crowded_rows, F.col("n")).otherwise(0)).alias("calm"))
    marks, crowded, calm = np.zeros((1 << filter_bits) // 8, np.uint8), np.zeros((1 << filter_bits) // 8, np.uint8), 0
    page_bytes = (1 << page_bits) // 8
    for row in slots.groupBy("page").applyInArrow(bit_page, "page int, bits binary, hot binary, calm long").toLocalIterator():
        at = slice(row["page"] * page_bytes, (row["page"] + 1) * page_bytes)
        marks[at], calm = np.frombuffer(row["bits"], np.uint8), calm + row["calm"]
        if row["hot"]:
            crowded[at] = np.frombuffer(row["hot"], np.uint8)
    return marks, crowded if crowded.any() else None, calm


def repeated_ranges(docs: DataFrame, plan: Plan = Plan(), bucket_rows: int = 20_000, filter_bits: int = 26, crowded_rows: int = 100_000, few: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, a, b)``: words a to b - 1 of a text lie in windows that also start elsewhere.

    A first pass counts keys: one that has a single place cannot have equal windows,
    and its string need not travel.  The keys with two places or more are marked in a
    bit table of fixed size (``2 ** filter_bits`` bits, 8 MB as set), which tasks
    read; a false mark costs a string, nothing else.  The pass also tells how many
    strings will travel, and there are as many buckets as give each about
    ``bucket_rows``.  Strings that are equal within a task's batch travel once, with
    their places; in a bucket, equal hashes are compared word for word.

    The windows of a key with over ``crowded_rows`` segments (a second bit table)
    would crowd one bucket.  They are counted by a 128-bit digest of their words, in
    partial counts; equal digests stand for equal words.  The digests found twice are
    read in a second pass over the texts if there are at most ``few``, as is usual
    where much of a corpus repeats one passage, and joined back otherwise, without a
    task that holds all places of a window.
    """
    spark = docs.sparkSession
    own = doc_columns(docs, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    marks, crowded, calm = key_tables(own, plan, filter_bits, crowded_rows)
    buckets = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-calm // bucket_rows))
    shared = spark.sparkContext.broadcast((marks, crowded))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, crowded = shared.value
        for whole in batches:
            places: dict[tuple[int, bytes], list[tuple]] = {}
            for b in byte_slices(whole, "text"):
                raw, starts, ends, first, h = column_words(b.column("text"))
                start, end, text, key, _ = segments(h, first, plan)
                wanted = marked(table, key, filter_bits)
                if crowded is not None:
                    wanted &= ~marked(crowded, key, filter_bits)
                start, end, text, key = start[wanted], end[wanted], text[wanted], key[wanted]
                line, at = joined_words(raw, starts, ends)
                ids, hashes = b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist()
                bucket = (scrambled(key) % U(buckets)).tolist()
                for k, i, j, d, s in zip(bucket, at[start].tolist(), (at[end + plan.size] - 1).tolist(), text.tolist(), (start - first[text]).tolist(), strict=True):
                    places.setdefault((k, line[i:j]), []).append((ids[d], hashes[d], s))
            items = list(places.items())
            for k in range(0, len(items), 4000):
                part = items[k : k + 4000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x, _ in part], pa.int32()),
                        pa.array([x[1] for x, _ in part], pa.binary()),
                        *(pa.array([[p[c] for p in y] for _, y in part], pa.list_(pa.int64())) for c in range(3)),
                    ],
                    ["bucket", "packed", "ids", "hashes", "at"],
                )

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        packed = table.column("packed").to_pylist()
        times = np.diff(table.column("at").chunk(0).offsets.to_numpy()).astype(np.int64)
        out: list[tuple] = []
        lists = [table.column(c) for c in ("ids", "hashes", "at")]
        for k, windows in enumerate(repeated_windows(packed, times, plan)):
            if len(windows):
                ranges = merged(windows, plan.size)
                out += [(i, h, s + a, s + b) for i, h, s in zip(*(c[k].as_py() for c in lists), strict=True) for a, b in ranges]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "text_hash", "a", "b"), columns, strict=True)})

    sent = own.mapInArrow(send, "bucket int, packed binary, ids array<long>, hashes array<long>, at array<long>")
    found = sent.groupBy("bucket").applyInArrow(search, "doc_id long, text_hash long, a long, b long")
    if crowded is None:
        return found

    def crowded_windows(b: pa.RecordBatch):
        """(digests, text, first word in it) of the windows of crowded keys."""
        raw, starts, ends, first, h = column_words(b.column("text"))
        start, end, text, key, _ = segments(h, first, plan)
        hot = marked(shared.value[1], key, filter_bits)
        start, end, text = start[hot], end[hot], text[hot]
        rows, owner = ragged(start, end - start + 1), np.repeat(text, end - start + 1)
        line, at = joined_words(raw, starts, ends)
        return window_digests(line, at, rows, plan.size), owner, rows - first[owner]

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_slices(whole, "text"):
                both, _, _ = crowded_windows(b)
                if len(both):
                    each, n = np.unique(both, axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(each[:, 0].copy()), pa.array(each[:, 1].copy()), pa.array(n.astype(np.int64))], ["wa", "wb", "n"])

    twice = checkpointed(own.select("text").mapInArrow(tallied, "wa long, wb long, n long").groupBy("wa", "wb").agg(F.sum("n").alias("n")).where("n > 1").select("wa", "wb"))
    if twice.count() <= few:
        known = twice.toPandas().to_numpy(np.int64)  # at most ``few`` pairs of numbers
        known = spark.sparkContext.broadcast(np.sort(np.ascontiguousarray(known).view("i8,i8").ravel()))

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = known.value
            for whole in batches:
                for b in byte_slices(whole, "text"):
                    both, owner, at = crowded_windows(b)
                    if not len(both) or not len(table):
                        continue
                    flat = np.ascontiguousarray(both).view("i8,i8").ravel()
                    hit = table[np.minimum(np.searchsorted(table, flat), len(table) - 1)] == flat
                    owner, at = owner[hit], at[hit]
                    cuts = np.flatnonzero(np.diff(owner)) + 1
                    out = [(int(d[0]), a, z) for d, s in zip(np.split(owner, cuts), np.split(at, cuts), strict=True) if len(d) for a, z in merged(s, plan.size)]
                    rows = pa.array([d for d, _, _ in out], pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), b.column("text_hash").take(rows), *(pa.array([r[k] for r in out], pa.int64()) for k in (1, 2))], ["doc_id", "text_hash", "a", "b"])

        return found.unionByName(own.mapInArrow(places, "doc_id long, text_hash long, a long, b long"))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_slices(whole, "text"):
                both, owner, at = crowded_windows(b)
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), b.column("doc_id").take(rows), b.column("text_hash").take(rows), pa.array(at)], ["wa", "wb", "doc_id", "text_hash", "a"])

    windows = checkpointed(own.mapInArrow(single, "wa long, wb long, doc_id long, text_hash long, a long"))
    hits = skew_join(windows, twice, ["wa", "wb"], "left_semi")
    return found.unionByName(hits.select("doc_id", "text_hash", "a", (F.col("a") + plan.size).alias("b")))


def without_repeats(docs: DataFrame, size: int = 35, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, **options) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256[, kept_text])`` for each row of ``docs``.

    Removed are all words of windows of ``size`` words whose sequence also starts at
    any other place of any row, that row included; windows are judged on the input.
    The first place is removed like the others.  kept_sha256 is of the kept words
    joined by one space.  Only texts that may lose words are moved.

    Null and empty texts have no words.  Rows of one id and one text count as two
    places, so both lose what they share.  A null id is kept.  An empty table gives
    no rows.
    """
    plan = Plan(size, min(4, size))
    ranges = repeated_ranges(docs, plan, id_col=id_col, text_col=text_col, **options).distinct()
    ranges = checkpointed(ranges.groupBy("doc_id", "text_hash").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b")))
    calm, touched = parted(doc_columns(docs, id_col, text_col), ranges.select(row_key().alias("key")))
    none = F.lit(None).cast("array<long>")
    # a null id has a number of its own side by side with the id, so that rows join by equality
    known = [F.coalesce("_id", F.lit(0)).alias("_i"), F.col("_id").isNull().alias("_none"), F.col("_hash").alias("_h")]
    told = ranges.select(*[c for c in (F.coalesce("doc_id", F.lit(0)).alias("_i"), F.col("doc_id").isNull().alias("_none"), F.col("text_hash").alias("_h"))], "a", "b")
    both = skew_join(touched.select("doc_id", "text", *known), told, ["_i", "_none", "_h"], "left").select("doc_id", "text", "a", "b")
    both = calm.select("doc_id", "text", none.alias("a"), none.alias("b")).unionByName(both)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_slices(whole, "text"):
                raw, starts, ends, first, _ = column_words(b.column("text"))
                edge = np.zeros(len(starts) + 1, np.int64)
                for d, (lo, hi) in enumerate(zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)):
                    if lo:
                        np.add.at(edge, first[d] + np.array(lo), 1)
                        np.add.at(edge, first[d] + np.array(hi), -1)
                keep = np.cumsum(edge[:-1]) == 0
                upto = np.concatenate([[0], np.cumsum(keep)])
                line, at = joined_words(raw, starts[keep], ends[keep])
                n, kept = np.diff(first), np.diff(upto[first])
                cut = at[upto[first]].tolist()
                texts = [line[i : max(i, j - 1)] for i, j in zip(cut, cut[1:], strict=False)]
                columns = [b.column("doc_id"), pa.array(n), pa.array(n - kept), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    columns, names = [*columns, pa.array(texts, pa.binary()).cast(pa.string())], [*names, "kept_text"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return both.mapInArrow(strip, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
