"""Operator 10: contiguous shards of near equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, doc_columns

ORDER = ["_h", "text_crc32", "doc_id"]


def moved_cuts(total: int, shards: int, groups: list[tuple[int, int]], slack: float) -> list[float]:
    """Where the order is cut: at each equal share of ``total``, or at the nearest end of the group (begin, end) that holds that place, if that is within ``slack`` of a share."""
    cuts, share = [], total / shards
    for k in range(1, shards):
        at = total * k / shards
        held = next(((a, b) for a, b in groups if a < at < b), None)
        near = min(held, key=lambda end: (abs(end - at), end)) if held else at
        cuts.append(float(near) if abs(near - at) <= slack * share else at)
    return cuts


def balanced_shards(docs: DataFrame, shards: int = 24, row_bytes: int = 8, slack: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row.

    Rows are sorted by a hash of their text, then by id, so equal texts lie side by
    side.  Each task sums the sizes of its range; the sums of the tasks before it give
    each row its place in the whole, and the order is cut where the running size passes
    each equal share.  A cut that falls into a group of equal texts moves to the
    group's nearer end if that is at most ``slack`` of a share away: such groups stay
    whole and sizes stay near equal; larger groups are cut.  A row belongs to the
    shard that holds its middle.  Only ids, hashes and sizes move.

    Null texts are empty: size ``row_bytes``.  Null and repeated ids are rows like
    any other.  An empty table gives no rows.  Few rows may leave shards empty.
    """
    if shards <= 0:
        raise ValueError("shards must be positive")
    raw = F.coalesce("text", F.lit("")).cast("binary")
    place = F.conv(F.substring(F.md5(raw), 1, 15), 16, 10).cast("long").alias("_h")
    sized = doc_columns(docs, id_col, text_col).select("doc_id", (F.octet_length(raw) + F.lit(row_bytes)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), place)
    # rows that are equal in all of the order are parted by a number, so that any number of copies is dealt to many tasks
    order = [*ORDER, "_tie"]
    ranged = checkpointed(checkpointed(sized.withColumn("_tie", F.monotonically_increasing_id())).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each task
    base = totals.select("_part", F.coalesce(F.sum("_bytes").over(ahead), F.lit(0)).alias("_before"))
    total = totals.agg(F.sum("_bytes")).first()[0] or 0
    within = Window.partitionBy("_part").orderBy(*order)
    placed = ranged.withColumns({"_upto": F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_row": F.row_number().over(within)})
    placed = checkpointed(placed.join(F.broadcast(base), "_part").withColumn("_end", F.col("_before") + F.col("_upto")).drop("_before", "_upto", "_tie"))
    share = lambda v: F.floor(v * shards / F.lit(max(total, 1)))
    held = F.broadcast(placed.where(share(F.col("_end")) > share(F.col("_end") - F.col("size"))).select("_h", "text_crc32").distinct())  # a row for each cut at most
    groups = placed.join(held, ["_h", "text_crc32"]).groupBy("_h", "text_crc32").agg(F.min(F.col("_end") - F.col("size")).alias("a"), F.max("_end").alias("b")).collect()
    cuts = moved_cuts(total, shards, sorted((r["a"], r["b"]) for r in groups), slack)
    middle = F.col("_end") - F.col("size") / 2
    placed = placed.withColumn("shard", sum(((middle >= c).cast("int") for c in cuts), F.lit(0)))
    counts = placed.groupBy("_part", "shard").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    earlier = counts.select("_part", "shard", "_first", F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    out = placed.join(F.broadcast(earlier), ["_part", "shard"])
    slot = F.col("_ahead") + F.col("_row") - F.col("_first")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
