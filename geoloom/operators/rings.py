"""Rings put together from chains of edges that were made in different tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.graph import checkpointed

CHAIN = "xs array<double>, ys array<double>, closed boolean"


def linked_places(following: DataFrame, most: int = 1 << 20) -> DataFrame:
    """``(id, ring, place)`` for a table ``(id, next)`` of circles: the least id of its circle, and how far from it each id is.

    Up to ``most`` rows (two numbers each, counted) are followed in one task.  Beyond
    that all ids jump at once over twice as many steps in each round: first until each
    knows the least of its circle, then for the distance to the circle's end.  Rounds
    are the logarithm of the longest circle, and no task holds a circle.
    """
    following = checkpointed(following.select("id", "next"))
    if following.limit(most + 1).count() <= most:
        return following.coalesce(1).mapInArrow(_followed, "id long, ring long, place long")
    state = following.withColumn("ring", F.least("id", "next"))
    while True:
        ahead = state.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("ring").alias("_ring"))
        new = state.join(ahead, "next").select("id", F.col("_next").alias("next"), F.least("ring", "_ring").alias("ring"), (F.col("_ring") < F.col("ring")).alias("changed"))
        new = checkpointed(new)
        if not new.where("changed").limit(1).count():
            break
        state = new.drop("changed")
    # cut each circle before its least id, and count the steps to its end
    last = F.col("next") == F.col("ring")
    walk = checkpointed(following.join(new.select("id", "ring"), "id").select("id", "ring", F.when(~last, F.col("next")).alias("next"), F.when(last, 0).otherwise(1).cast("long").alias("left")))
    while walk.where("next is not null").limit(1).count():
        ahead = walk.select(F.col("id").alias("_id"), F.col("next").alias("_next"), F.col("left").alias("_left"))
        walk = checkpointed(walk.join(ahead, F.col("next") == F.col("_id"), "left").select("id", "ring", F.col("_next").alias("next"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left")))
    return walk.select("id", "ring", (-F.col("left")).alias("place"))


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    ids, after = (np.concatenate([b.column(c).to_numpy() for b in held]) if held else np.empty(0, np.int64) for c in ("id", "next"))
    order = np.argsort(ids)
    ids, after = ids[order], np.searchsorted(ids[order], after[order])
    ring, jump = np.minimum(np.arange(len(ids)), after), after
    while True:
        new, jump = np.minimum(ring, ring[jump]), jump[jump]
        if (new == ring).all():
            break
        ring = new
    end = after == ring
    left, jump = np.where(end, 0, 1), np.where(end, np.arange(len(ids)), after)
    while (jump[jump] != jump).any():
        left, jump = left + left[jump], jump[jump]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[ring]), pa.array(-left)], ["id", "ring", "place"])


def rings_of_chains(chains: DataFrame, keys: list[str], most: int = 1 << 20) -> DataFrame:
    """``(keys.., xs, ys)``: the rings of each key from its chains (``xs``, ``ys``, ``closed``), without the closing vertex.

    A chain goes on with the one of its key that begins where it ends; if several do,
    the one that turns most to the left, so rings that only touch stay apart.  Circles
    of chains are found on their numbers alone (:func:`linked_places`); each ring is
    then one row.  Chains that no other goes on with are an error.
    """
    numbered = checkpointed(chains.withColumn("id", F.monotonically_increasing_id()))
    whole = numbered.where("closed").select(*keys, "xs", "ys")
    open_ = numbered.where("not closed")
    if not open_.limit(1).count():
        return whole
    come = open_.select(*keys, F.col("id").alias("a"), *[F.element_at(c, -1).alias(f"p{c[0]}") for c in ("xs", "ys")], *[(F.element_at(c, -1) - F.element_at(c, -2)).alias(f"c{c[0]}") for c in ("xs", "ys")])
    go = open_.select(*keys, F.col("id").alias("b"), *[F.element_at(c, 1).alias(f"p{c[0]}") for c in ("xs", "ys")], *[(F.element_at(c, 2) - F.element_at(c, 1)).alias(f"w{c[0]}") for c in ("xs", "ys")])
    turn = F.atan2(F.col("cx") * F.col("wy") - F.col("cy") * F.col("wx"), F.col("cx") * F.col("wx") + F.col("cy") * F.col("wy"))
    best = Window.partitionBy("a").orderBy(turn.desc(), "b")
    pairs = come.join(go, [*keys, "px", "py"], "left").withColumn("_r", F.row_number().over(best)).where("_r = 1").select(F.col("a").alias("id"), F.col("b").alias("next"))
    pairs = checkpointed(pairs)
    odd = pairs.agg(F.count("*").alias("n"), F.count_distinct("next").alias("m")).first()
    if odd["n"] != odd["m"]:
        raise ValueError(f"{odd['n'] - odd['m']} chains of edges do not close")
    told = open_.join(linked_places(pairs, most), "id")
    own = told.select(*keys, "ring", F.struct("place", *[F.slice(c, 1, F.size(c) - 1).alias(c) for c in ("xs", "ys")]).alias("part"))
    rings = own.groupBy(*keys, "ring").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return whole.unionByName(rings.select(*keys, *[F.flatten(F.col(f"parts.{c}")).alias(c) for c in ("xs", "ys")]))


def chain_rows(rings: list[np.ndarray], chains: list[np.ndarray]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Columns ``xs``, ``ys`` and ``closed`` of rings and open chains."""
    every = [*rings, *chains]
    at = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in every])]).astype(np.int32))
    xy = np.concatenate(every) if every else np.empty((0, 2))
    return *(pa.ListArray.from_arrays(at, pa.array(xy[:, k].astype(float))) for k in (0, 1)), pa.array([True] * len(rings) + [False] * len(chains), pa.bool_())
