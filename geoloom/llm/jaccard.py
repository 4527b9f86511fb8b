"""Exact links between sets of shingles, within candidate groups that fingerprints have found."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_table, byte_slices, doc_columns, marked, row_key, text_bytes, tidy
from .simhash import shingle_hashes, words_of
from .wordhash import ragged


def exact_links(ids: np.ndarray, tokens: np.ndarray, offsets: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that join the same rows as all pairs of sets with that Jaccard similarity or more do: each row to the least id of its group.

    Row k is the set ``tokens[offsets[k]:offsets[k + 1]]``.  The most central row not
    yet linked is compared with all others, until each row is linked to such a pivot
    or is one.  A pair that is still apart has an end outside the largest group, so
    only those rows are compared with all others too.  One group ends the search.
    """
    n, size = len(ids), np.diff(offsets)
    if n < 2:
        return []
    _, token, df = np.unique(tokens, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    posting = owner[np.argsort(token, kind="stable")]
    begin = np.concatenate([[0], np.cumsum(df)])
    label = np.arange(n)

    def compare(row: int) -> np.ndarray:
        """Rows similar to this one; their groups become one."""
        own = token[offsets[row] : offsets[row + 1]]
        shared = np.bincount(posting[ragged(begin[own], df[own])], minlength=n)
        both = size[row] + size - shared
        near = np.flatnonzero(shared >= similarity * both - 1e-9)
        merge = np.zeros(n, bool)
        merge[label[near]] = True
        label[merge[label]] = label[row]
        return near

    weight = np.bincount(owner, weights=df[token], minlength=n) / np.maximum(size, 1)
    compared, linked = np.zeros(n, bool), np.zeros(n, bool)
    for row in np.argsort(-weight, kind="stable").tolist():
        if not linked[row]:
            linked[compare(row)] = compared[row] = True
    groups, count = np.unique(label, return_counts=True)
    if len(groups) > 1:
        for row in np.flatnonzero(~compared & (label != groups[np.argmax(count)])).tolist():
            compare(row)
            if (label == label[0]).all():
                break
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    return [(a, b) for a, b in zip(ids.tolist(), least[label].tolist(), strict=True) if a != b]


def verified_links(docs: DataFrame, candidates: DataFrame, shingle: int, similarity: float, part_bytes: int = 1 << 22, filter_bits: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(a, b)`` links between nodes whose texts have that similarity, within each candidate group.

    candidates: ``(node long, component long, n long, doc_id long, text_hash long)``: the
    nodes to compare, their groups, about how many shingles each has, and a row that
    has its text.  The texts of those rows are read again; a bit table of fixed size
    passes over most others before anything moves (a false mark costs work only), and
    a task reads a repeated row once.  Small groups share tasks of about
    ``part_bytes`` of shingle hashes.  A group beyond that is dealt as pairs of
    salted parts, so every pair of its rows meets in a task and no task holds it
    whole; the work of one such group grows with the square of its distinct texts.
    """
    spark = docs.sparkSession
    sizes = candidates.groupBy("component").agg(F.sum("n").alias("total"))
    whole = sizes.agg(F.sum("total")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-8 * whole // part_bytes))
    wanted = spark.sparkContext.broadcast(bit_table(candidates.select(row_key().alias("key")), filter_bits))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys = batch.column("key").to_numpy()
            fresh = [k for k in np.flatnonzero(marked(wanted.value, keys.view(np.uint64), filter_bits)).tolist() if not (keys[k] in seen or seen.add(keys[k]))]
            b = batch.take(pa.array(fresh, pa.int64()))
            for part in byte_slices(b, "text"):
                sets = [np.unique(shingle_hashes(words_of(raw), shingle)).tobytes() for raw in text_bytes(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(sets, pa.binary())], ["_id", "_hash", "tokens"])
        tidy()

    own = doc_columns(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text")).withColumn("key", row_key())
    sets = own.mapInArrow(read, "_id long, _hash long, tokens binary")
    parts = F.ceil(8 * F.col("total") / part_bytes).cast("int")
    dealt = candidates.join(sizes, "component").select("doc_id", "text_hash", "node", "component", F.greatest(F.lit(1), parts).alias("m"))
    dealt = dealt.select("doc_id", "text_hash", "node", "component", "m", F.pmod(F.xxhash64("node", F.lit(5)), F.col("m")).cast("int").alias("s"))
    rows = sets.join(dealt, sets["_id"].eqNullSafe(dealt["doc_id"]) & (sets["_hash"] == dealt["text_hash"])).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    group = F.when(F.col("m") > 1, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(buckets)))
    rows = rows.select("node", "component", "tokens", (F.col("m") > 1).alias("hot"), group.alias("g"), F.least("s", "t").alias("p"), F.greatest("s", "t").alias("q"))

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        component, ids = table.column("component").to_numpy(), table.column("node").to_numpy()
        sets = table.column("tokens").to_pylist()
        order = np.argsort(component, kind="stable")
        links = []
        for at in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
            own = [np.frombuffer(sets[k], np.uint64) for k in at]
            links += exact_links(ids[at], np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])]), similarity)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return rows.groupBy("hot", "g", "p", "q").applyInArrow(search, "a long, b long")
