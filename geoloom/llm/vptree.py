"""Vantage-point trees over bit blocks of fingerprints, and the sharded search for near pairs.

A tree node holds a vantage point and a distance ``mu``.  Fingerprints nearer
than ``mu`` go inside, the others outside.  If two fingerprints differ by at most
r bits, the triangle inequality keeps their distances to the vantage point within
r; so an inside fingerprint can have a neighbour outside only if its own distance
is ``mu - r`` or more.  Those, and only those, are also sent outside: every near
pair then meets in at least one leaf.  A leaf is a shard that one task searches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


@dataclass
class Node:
    """A leaf if ``inside`` is None; else the vantage point and where it splits."""

    leaf: int = -1
    point: np.ndarray | None = None
    mu: int = 0
    inside: Node | None = None
    outside: Node | None = None


@dataclass
class Tree:
    """One tree over the bits that ``mask`` selects; pairs within ``radius`` bits there meet in a leaf."""

    mask: np.ndarray
    radius: int
    root: Node = field(default_factory=Node)
    leaves: int = 0


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits over the last axis of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def build_tree(sample: np.ndarray, mask: np.ndarray, radius: int, leaf_rows: float, seed: int = 0) -> Tree:
    """Fit a tree on a bounded sample (rows of 64-bit words); leaves hold about ``leaf_rows`` sample rows."""
    tree, rng = Tree(mask, radius), np.random.default_rng(seed)

    def grow(rows: np.ndarray, depth: int) -> Node:
        if len(rows) > max(leaf_rows, 2) and depth < 40:
            best = None
            for at in rng.choice(len(rows), min(4, len(rows)), replace=False):
                d = hamming(rows, rows[at])
                for mu in {int(np.median(d)), int(np.median(d)) + 1}:
                    n_in, n_out = int((d < mu).sum()), int((d >= mu - radius).sum())
                    cost = n_in**2 + n_out**2
                    if 0 < n_in and n_out < len(rows) and (best is None or cost < best[0]):
                        best = (cost, at, mu, d)
            if best and best[0] < 0.97 * len(rows) ** 2:
                _, at, mu, d = best
                return Node(point=rows[at].copy(), mu=mu, inside=grow(rows[d < mu], depth + 1), outside=grow(rows[d >= mu - radius], depth + 1))
        tree.leaves += 1
        return Node(leaf=tree.leaves - 1)

    tree.root = grow(np.unique(sample & mask, axis=0), 0)
    return tree


def route(tree: Tree, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of each fingerprint, boundary copies included."""
    rows, leaves, masked = [], [], fps & tree.mask
    todo = [(tree.root, np.arange(len(fps)))]
    while todo:
        node, at = todo.pop()
        if not len(at):
            continue
        if node.inside is None:
            rows.append(at)
            leaves.append(np.full(len(at), node.leaf, np.int64))
            continue
        d = hamming(masked[at], node.point)
        todo += [(node.inside, at[d < node.mu]), (node.outside, at[d >= node.mu - tree.radius])]
    return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


def local_links(ids: np.ndarray, fps: np.ndarray, radius: int, mask: np.ndarray, block_radius: int, step: int = 256) -> list[tuple[int, int]]:
    """Links that join the same rows as all pairs within ``radius``, and within ``block_radius`` under ``mask``, do.

    Each row is linked to the least id of its group only, so a crowd of near copies gives as many links as rows.
    """
    n, used = len(ids), np.flatnonzero(mask)
    parent, label = np.arange(n), np.arange(n)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for s in range(0, n, step):
        own = fps[s : s + step]
        d = sum(np.bitwise_count((own[:, None, j] ^ fps[None, s:, j]) & mask[j]) for j in used)
        near = np.argwhere(d <= block_radius)
        a, b = near[:, 0] + s, near[:, 1] + s
        fresh = label[a] != label[b]
        a, b = a[fresh], b[fresh]
        close = hamming(fps[a], fps[b]) <= radius
        if not close.any():
            continue
        for x, y in np.unique(np.stack([label[a[close]], label[b[close]]], 1), axis=0).tolist():
            x, y = find(x), find(y)
            if x != y:
                lo, hi = (x, y) if ids[x] < ids[y] else (y, x)
                parent[hi] = lo
        while not (parent[parent] == parent).all():
            parent = parent[parent]
        label = parent[label]
    moved = np.flatnonzero(label != np.arange(n))
    return list(zip(ids[moved].tolist(), ids[label[moved]].tolist(), strict=True))


def blocks_of(bits: int, n_blocks: int) -> list[np.ndarray]:
    """Masks of ``n_blocks`` runs of neighbouring bits that cover all ``bits`` once."""
    edge = [round(bits * k / n_blocks) for k in range(n_blocks + 1)]
    out = []
    for lo, hi in zip(edge, edge[1:], strict=False):
        flat = np.zeros(bits, np.uint8)
        flat[lo:hi] = 1
        out.append(np.packbits(flat, bitorder="little").view(np.uint64))
    return out


def near_links(groups: DataFrame, bits: int, radius: int, n_blocks: int, block_radius: int, sample: int = 16384, leaf_rows: int = 2048, hot_leaf: int = 16384, most: int = 131_072) -> DataFrame:
    """``(a, b)`` links between the ``rep`` ids of distinct fingerprints within ``radius`` bits.

    groups: ``(fp binary, rep long)``, one row for each distinct fingerprint.  There
    is one tree for each of ``n_blocks`` bit blocks.  If
    ``n_blocks * (block_radius + 1) > radius``, a pair within radius is within
    block_radius in some block (pigeonhole) and none is lost; with less, a pair is
    found with the probability that one block is close enough.  The links span the
    same components as all pairs.

    The trees are fitted on ``sample`` fingerprints, the ones with the smallest
    hashes, or a 64th of all up to ``most`` if that is more; every fingerprint is routed.  A leaf that gets more than
    ``hot_leaf`` rows is dealt as pairs of salted parts, so no task holds it whole.
    """
    spark = groups.sparkSession
    total = groups.count()
    if total < 2:
        return spark.createDataFrame([], "a long, b long")
    w = bits // 64
    drawn = groups.select("fp", F.xxhash64("fp").alias("k")).orderBy("k").limit(max(sample, min(most, total // 64))).select("fp").toPandas()["fp"]
    points = np.frombuffer(b"".join(map(bytes, drawn)), np.uint64).reshape(-1, w)
    per_leaf = leaf_rows * len(points) / total
    trees = [build_tree(points, m, block_radius, per_leaf, seed=i) for i, m in enumerate(blocks_of(bits, n_blocks))]
    shared = spark.sparkContext.broadcast(trees)
    routed = "tree int, leaf long, rep long, fp binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, rep = b.column("fp"), b.column("rep")
            if not b.num_rows:
                continue
            fps = np.frombuffer(b"".join(fp.to_pylist()), np.uint64).reshape(-1, w)
            for i, tree in enumerate(shared.value):
                rows, leaves = route(tree, fps)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), i, np.int32)), pa.array(leaves), rep.take(at), fp.take(at)], ["tree", "leaf", "rep", "fp"])

    sent = groups.select("fp", "rep").mapInArrow(send, routed)
    if total > hot_leaf:
        sent = checkpointed(sent)  # counted and then dealt: routed once
    crowded = sent.groupBy("tree", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > hot_leaf).collect() if total > hot_leaf else []
    if crowded:
        parts = spark.createDataFrame([(r["tree"], r["leaf"], -(-r["n"] // hot_leaf) * 2) for r in crowded], "tree int, leaf long, m int")
        sent = sent.join(parts, ["tree", "leaf"], "left").withColumn("m", F.coalesce("m", F.lit(1)))
        sent = sent.withColumn("p", F.pmod(F.xxhash64("rep"), F.col("m")).cast("int"))
        sent = sent.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        sent = sent.select("tree", "leaf", "rep", "fp", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
    else:
        sent = sent.withColumns({"p": F.lit(0), "q": F.lit(0)})

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table.column("rep").to_numpy()
        fps = np.frombuffer(b"".join(table.column("fp").to_pylist()), np.uint64).reshape(-1, w)
        tree = shared.value[table.column("tree")[0].as_py()]
        links = local_links(ids, fps, radius, tree.mask, tree.radius)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return sent.groupBy("tree", "leaf", "p", "q").applyInArrow(search, "a long, b long")
