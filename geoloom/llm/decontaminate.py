"""Operator 2: benchmark items in documents, by item-sized windows that share an item's heaviest shingles.

SimHash fingerprints of windows can't give whole results for this similarity, which is
weighted and one-sided: a window may hold nearly all of an item's weight in a third of
its shingles.  README.md has the figures.  Candidates come from a prefix filter instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_table, byte_slices, checkpointed, doc_columns, marked, parted, row_key, skew_join, tidy
from .wordhash import column_words, scrambled, window_hashes

U = np.uint64
ITEM = ["item_id", "item_hash"]
ANY, HEAD, CLASS = 0, 1 << 40, 2 << 40


def length_class(words: int) -> int:
    """Items of about equal length are looked for together first: classes grow by an eighth."""
    return words if words < 16 else int(np.log(words / 16) / np.log(1.125)) + 16


def sized(keys: np.ndarray, words: int) -> np.ndarray:
    """Hashes of shingles as parts of items of that many words."""
    return scrambled(keys ^ U(words * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def item_shingles(items: DataFrame, shingle: int, item_col: str, text_col: str) -> DataFrame:
    """``(item_id, item_hash, words, key, n)``: each distinct shingle of each item and how often it occurs; items without words have none.

    An item is an id with a text (``item_hash``): texts under one id are items of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, _, first, h = column_words(b.column("text"), lower=True)
            rows = []
            for d, (item, text) in enumerate(zip(b.column("item_id").to_pylist(), b.column("item_hash").to_pylist(), strict=True)):
                own = h[first[d] : first[d + 1]]
                if len(own):
                    keys, n = np.unique(window_hashes(own, min(shingle, len(own))), return_counts=True)
                    rows += [(item, text, len(own), k, c) for k, c in zip(keys.view(np.int64).tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True)) or [()] * 5], [*ITEM, "words", "key", "n"])

    own = items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    own = own.where("item_id is not null").withColumn("item_hash", F.xxhash64("text")).dropDuplicates(ITEM)
    return own.mapInArrow(run, "item_id long, item_hash long, words long, key long, n long")


def profile_items(shingles: DataFrame, similarity: float) -> DataFrame:
    """``(item_id, item_hash, words, keys, counts, weights, needed, heads)``, one row for each item.

    A shingle weighs one over the number of items that hold it.  needed: the fewest
    shingles a window must share to be similar, whichever they are.  heads: the
    heaviest shingles, so many that a window without any of them is not similar.
    """
    weighed = shingles.join(shingles.groupBy("key").agg((1.0 / F.count("*")).alias("w")), "key")

    def profile(table: pa.Table) -> pa.Table:
        keys, n, w = (table.column(c).to_numpy() for c in ("key", "n", "w"))
        order = np.argsort(keys)
        keys, n, w = keys[order], n[order], w[order]
        spare = np.cumsum(np.sort(np.repeat(w, n)))
        needed = len(spare) - int((spare <= (1 - similarity) * spare[-1] + 1e-9).sum())
        heavy = np.argsort(-w * n, kind="stable")
        upto = np.cumsum((w * n)[heavy])
        heads = keys[heavy[: int((upto <= (1 - similarity) * upto[-1] + 1e-9).sum()) + 1]]
        return pa.table(
            {
                **{c: table.column(c).slice(0, 1) for c in (*ITEM, "words")}, "keys": pa.array([keys.tolist()]), "counts": pa.array([n.tolist()]), "weights": pa.array([w.tolist()]),
                "needed": pa.array([max(1, needed)], pa.int64()), "heads": pa.array([heads.tolist()]),
            }
        )

    return weighed.groupBy(*ITEM).applyInArrow(profile, "item_id long, item_hash long, words long, keys array<long>, counts array<long>, weights array<double>, needed long, heads array<long>")


def marks_of(profiles: DataFrame) -> DataFrame:
    """``(key)``: the items' shingles alone, with their length class and with their length, and the heads with their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words, keys, heads in zip(b.column("words").to_pylist(), b.column("keys"), b.column("heads"), strict=True):
                keys, heads = (np.asarray(x.values).view(np.uint64) for x in (keys, heads))
                every = np.concatenate([keys, sized(keys, CLASS + length_class(words)), sized(keys, words), sized(heads, HEAD + words)])
                yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64))], ["key"])

    return profiles.select("words", "keys", "heads").mapInArrow(run, "key long")


def window_starts(hits: np.ndarray, needed: int, heads: np.ndarray, n: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to): runs of the starts 0 .. last of windows of ``n`` places that hold ``needed`` of the places ``hits`` and one of ``heads`` (both sorted)."""
    edges = np.unique(np.concatenate([[0], hits - n + 1, hits + 1, heads - n + 1, heads + 1, [last + 1]]))
    edges = edges[(edges >= 0) & (edges <= last + 1)]
    held = lambda at: np.searchsorted(at, edges[:-1] + n) - np.searchsorted(at, edges[:-1])
    full = (held(hits) >= needed) & (held(heads) >= 1)
    a, b = edges[:-1][full], edges[1:][full]
    new = np.flatnonzero(np.append(True, a[1:] != b[:-1])) if len(a) else np.empty(0, np.int64)
    return a[new], b[np.append(new[1:], len(b)) - 1] if len(a) else b


def window_weights(region: np.ndarray, span: int, keys: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weight that each window of ``span`` places of a region shares with an item, its shingles ``keys`` being sorted.

    A place counts for the windows that hold it but not so many earlier places of the
    same shingle as the item has; so each adds its weight to one run of starts.
    """
    k = np.minimum(np.searchsorted(keys, region), len(keys) - 1)
    at = np.flatnonzero(keys[k] == region)
    k = k[at]
    order = np.argsort(k, kind="stable")
    at, k = at[order], k[order]
    first = np.searchsorted(k, k)
    back = np.arange(len(k)) - counts[k]
    before = np.where(back >= first, at[np.maximum(back, 0)], -1)
    starts = len(region) - span + 1
    change = np.zeros(starts + 1)
    lo, hi = np.maximum(np.maximum(at - span, before) + 1, 0), np.minimum(at + 1, starts)
    some = lo < hi
    np.add.at(change, lo[some], weights[k[some]])
    np.add.at(change, hi[some], -weights[k[some]])
    return np.cumsum(change[:-1])


def contaminated(docs: DataFrame, items: DataFrame, shingle: int = 5, similarity: float = 0.8, filter_bits: int | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, text_hash, item_id, similarity, start, words)``: the best window of each document for each item it holds.

    Words are lower-cased in A-Z.  For an item of L words every window of L words of
    a document is judged by its shingles of ``shingle`` words (of L words, if the item
    is shorter); a document of fewer words is one window as a whole.  A window is
    similar if the weight it shares with the item is ``similarity`` of the item's;
    repeated shingles count as often as in both.

    Nothing similar is lost: a similar window has at least ``needed`` shingles of items
    of its length, and at least one of the item's heads, its heaviest shingles.  A bit
    table of all items' shingles (16 bits a mark, 2 MB to 128 MB; false marks only
    cost work) tells such windows where the texts lie.  Runs of them travel as one
    row of shingle hashes, so their size grows with the text and not with the item;
    they meet the items whose head they hold by a join, and a pass over each run
    weighs all its windows.

    Whole texts and all items are read; the tables are joined, neither is broadcast
    whole.  Equal runs are verified once, and one that many documents share is
    dealt back without a task that holds all its places.  Null and empty texts and
    items match nothing; equal items of one id count once, different texts under one
    id are items of their own and the best of them is told.  A null doc_id is carried.
    Documents without a match give no row.
    """
    profiles = checkpointed(profile_items(item_shingles(items, shingle, item_col, item_text), similarity))
    lengths = {r["words"]: r["needed"] for r in profiles.groupBy("words").agg(F.min("needed").alias("needed")).collect()}  # a row for each length
    if not lengths:
        return docs.sparkSession.createDataFrame([], "doc_id long, text_hash long, item_id long, similarity double, start long, words long")
    bits = filter_bits or max(24, min(30, (64 * profiles.agg(F.sum(F.size("keys"))).first()[0]).bit_length()))
    classes: dict[int, list[tuple[int, int]]] = {}
    for words, needed in sorted(lengths.items()):
        classes.setdefault(length_class(words), []).append((words, needed))
    marks = docs.sparkSession.sparkContext.broadcast((bit_table(marks_of(profiles), bits), classes))
    names = ["doc_id", "text_hash", "start", "words", "span", "keys", "heads"]

    def region(b: pa.RecordBatch, d: int, start: int, words: int, span: int, keys: np.ndarray, heads: np.ndarray) -> pa.RecordBatch:
        one = [pa.array([v], pa.int64()) for v in (start, words, span)]
        lists = [pa.array([v.view(np.int64)], pa.list_(pa.int64())) for v in (keys, np.unique(heads))]
        return pa.RecordBatch.from_arrays([b.column("doc_id").slice(d, 1), b.column("text_hash").slice(d, 1), *one, *lists], names)

    def of_length(b: pa.RecordBatch, runs: np.ndarray, hits: np.ndarray, text: np.ndarray, first: np.ndarray, table: np.ndarray, words: int, size: int, needed: int) -> Iterator[pa.RecordBatch]:
        own = hits[marked(table, sized(runs[hits], words), bits)]
        own = own[own + size <= first[text[own] + 1]]  # shingles of one text
        if len(own) < needed:
            return
        heads = own[marked(table, sized(runs[own], HEAD + words), bits)]
        n = words - size + 1
        some = np.unique(text[heads])
        cut, top = (np.searchsorted(x, np.append(first[some], first[some + 1])).reshape(2, -1) for x in (own, heads))
        for d, o, p in zip(some.tolist(), cut.T, top.T, strict=True):
            low, length = int(first[d]), int(first[d + 1] - first[d])
            if o[1] - o[0] < needed or length < size:
                continue
            mine, lead = own[o[0] : o[1]] - low, heads[p[0] : p[1]] - low
            keys = runs[low : low + length - size + 1]
            if length < words:  # a text shorter than the item is one window
                yield region(b, d, 0, words, len(keys), keys, keys[lead])
                continue
            for x, y in zip(*(v.tolist() for v in window_starts(mine, needed, lead, n, length - words)), strict=True):
                step = max(4096, 4 * n)
                for at in range(x, y, step):
                    upto = min(at + step, y) - 1 + n
                    yield region(b, d, at, words, n, keys[at:upto], keys[lead[np.searchsorted(lead, at) : np.searchsorted(lead, upto)]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, wanted = marks.value
        for whole in batches:
            for b in byte_slices(whole, "text"):
                _, _, _, first, h = column_words(b.column("text"), lower=True)
                text = np.repeat(np.arange(len(first) - 1), np.diff(first))
                seen: dict[int, tuple] = {}
                for group, members in wanted.items():
                    near: dict[int, np.ndarray] = {}
                    for words, needed in members:
                        size = min(shingle, words)
                        if size not in seen:
                            runs = window_hashes(h, size)
                            seen[size] = runs, np.flatnonzero(marked(table, runs, bits))
                        runs, hits = seen[size]
                        if size not in near:
                            near[size] = hits[marked(table, sized(runs[hits], CLASS + group), bits)]
                        if len(near[size]) >= needed:
                            yield from of_length(b, runs, near[size], text, first, table, words, size, needed)
        tidy()

    own = doc_columns(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    regions = checkpointed(own.mapInArrow(scan, "doc_id long, text_hash long, start long, words long, span long, keys array<long>, heads array<long>").withColumn("rid", F.xxhash64("words", "keys")))
    distinct = checkpointed(regions.groupBy("words", "span", "rid").agg(F.first("keys").alias("keys"), F.first("heads").alias("heads")))
    index = profiles.select(*ITEM, "words", F.explode("heads").alias("head"))
    pairs = distinct.select("words", "span", "rid", F.explode("heads").alias("head")).join(index, ["words", "head"]).select("words", "span", "rid", *ITEM).distinct()
    parts = profiles.select(*ITEM, F.col("keys").alias("item_keys"), "counts", "weights")
    both = skew_join(checkpointed(pairs.join(distinct.drop("heads"), ["words", "span", "rid"])), parts, ITEM)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, start = [], []
            for keys, span, item, counts, weights in zip(*(b.column(c) for c in ("keys", "span", "item_keys", "counts", "weights")), strict=True):
                counts, weights = (np.asarray(x.values) for x in (counts, weights))
                shared = np.round(window_weights(np.asarray(keys.values), span.as_py(), np.asarray(item.values), counts, weights) / (counts * weights).sum(), 12)
                start.append(int(shared.argmax()))
                best.append(float(shared[start[-1]]))
            own = ["words", "span", "rid", "item_id"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(best, pa.float64()), pa.array(start, pa.int64())], [*own, "similarity", "at"])

    judged = both.mapInArrow(verify, "words long, span long, rid long, item_id long, similarity double, at long").where(F.col("similarity") >= similarity - 1e-9)
    told = judged.groupBy("words", "span", "rid").agg(F.collect_set(F.struct("item_id", "similarity", "at")).alias("told"))  # the items near one run
    places = regions.select("doc_id", "text_hash", "start", "words", "span", "rid")
    found = skew_join(places, checkpointed(told), ["words", "span", "rid"]).withColumn("t", F.explode("told"))
    best = found.groupBy("doc_id", "text_hash", "t.item_id").agg(F.max(F.struct("t.similarity", (-F.col("start") - F.col("t.at")).alias("s"), "words")).alias("m"))
    return best.select("doc_id", "text_hash", "item_id", F.round("m.similarity", 9).alias("similarity"), (-F.col("m.s")).alias("start"), "m.words")


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item; all columns stay.  Only rows that may hold one are moved."""
    bad = contaminated(docs, items, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h")).distinct()
    bad = checkpointed(bad)
    calm, doubtful = parted(docs, bad.select(row_key("_i", "_h").alias("key")), id_col, text_col)
    clean = doubtful.join(bad, doubtful["_id"].eqNullSafe(bad["_i"]) & (doubtful["_hash"] == bad["_h"]), "left_anti")
    return calm.unionByName(clean).select(*docs.columns)
