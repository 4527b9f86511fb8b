"""Operator 1: near duplicates by SimHash fingerprints and vantage-point trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.graph import connected_components

from .common import checkpointed, parted, row_key, skew_join
from .jaccard import verified_links
from .simhash import fingerprints
from .vptree import near_links


def _grouped(fps: DataFrame, same: list[str], *more) -> DataFrame:
    """One row for each distinct ``same``: ``gid`` numbers it, ``first`` is its first row by id and text hash, those without an id last; stored, so the numbers stay."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    return checkpointed(fps.groupBy(*same).agg(F.min(first).alias("first"), *more).withColumn("gid", F.monotonically_increasing_id()))


def _joined(groups: DataFrame, links: DataFrame, same: list[str]) -> DataFrame:
    """``(same.., first)``: for each group the first row of all groups it is linked with, over any number of links."""
    found = connected_components(links)
    held = groups.join(found, groups["gid"] == found["node"], "left").withColumn("c", F.coalesce("component", "gid"))
    held = checkpointed(held.select(*same, "c", "first"))
    return skew_join(held.drop("first"), held.groupBy("c").agg(F.min("first").alias("first")), ["c"]).select(*same, "first")


def _near_rows(docs: DataFrame, shingle: int = 3, bits: int = 64, radius: int = 3, n_blocks: int = 2, block_radius: int = 1, distinct: bool = False, sample: int = 16384, leaf_rows: int = 2048, hot_leaf: int = 16384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, fp, first)`` for each row, by fingerprints within ``radius`` bits."""
    fps = checkpointed(fingerprints(docs, shingle, bits, distinct, id_col, text_col))
    groups = _grouped(fps, ["fp"])
    links = near_links(groups.select("fp", F.col("gid").alias("rep")), bits, radius, n_blocks, block_radius, sample, leaf_rows, hot_leaf)
    return skew_join(fps, checkpointed(_joined(groups, links, ["fp"])), ["fp"]).select("doc_id", "text_hash", "fp", "first")


def _similar_rows(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bits: int = 256, radius: int = 64, n_blocks: int = 16, block_radius: int = 1, sample: int = 16384, leaf_rows: int = 4096, hot_leaf: int = 16384, part_bytes: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, first)`` for each row, by the similarity of its shingle set."""
    fps = checkpointed(fingerprints(docs, shingle, bits, True, id_col, text_col))
    same = ["fp", "set_hash"]
    groups = _grouped(fps, same, F.max("n").alias("n"))
    loose = connected_components(near_links(groups.select("fp", F.col("gid").alias("rep")), bits, radius, n_blocks, block_radius, sample, leaf_rows, hot_leaf))
    candidates = checkpointed(groups.join(loose, groups["gid"] == loose["node"]).select("node", "component", "n", F.col("first.id").alias("doc_id"), F.col("first.hash").alias("text_hash")))
    links = verified_links(docs, candidates, shingle, similarity, part_bytes, id_col=id_col, text_col=text_col)
    return skew_join(fps, checkpointed(_joined(groups, links, same)), same).select("doc_id", "text_hash", "first")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, fp binary, component_id)``: one row for each row of ``docs``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked;
    component_id is the smallest doc_id reachable, itself included.  Equal
    fingerprints are one group from the start, so copies cost a pre-aggregated
    minimum and never become pairs.  Options: ``shingle`` words, ``bits``, ``radius``,
    ``distinct`` (a repeated shingle counts once) and those of
    :func:`geoloom.llm.vptree.near_links`.

    Null and empty texts share the zero fingerprint and are linked like any other.
    Rows of one id with different texts are documents of their own.  A row without
    an id links like others; its component is null if no row reachable has an id.
    Repeated rows come back repeated.  An empty table gives no rows.
    """
    return _near_rows(docs, **options).select("doc_id", "fp", F.col("first.id").alias("component_id"))


def similar_documents(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, component_id)``: documents linked if the Jaccard similarity of their shingle sets is ``similarity`` (0.8) or more.

    Texts of one shingle set are one group from the start.  Fingerprints of the sets
    and vantage-point trees find candidate groups, and the sets themselves then
    decide each link (:func:`geoloom.llm.jaccard.verified_links`): no dissimilar pair
    is linked.  At a similarity of 0.8 two sets differ in 39 of 256 bits, give or
    take 6, so a radius of 64 loses none, and sixteen trees of radius 1 over blocks
    of 16 bits find 99 % of such pairs, nearer ones more surely.  That is the recall
    of a hash: no setting is sure to find every pair of 64 bits, as that would take
    ``n_blocks * (block_radius + 1) > radius``.

    Null and empty texts have the empty set and are linked with each other only.  Ids
    that are null or repeated, and empty tables, are as in :func:`near_duplicates`.
    """
    return _similar_rows(docs, **options).select("doc_id", F.col("first.id").alias("component_id"))


def keep_one(docs: DataFrame, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the smallest id, a row without an id only where no other is.

    Groups are those of :func:`similar_documents` if ``similarity`` is given, else
    those of :func:`near_duplicates`, whose options are taken.  A row is told by its
    id and its text together, so different texts under one id don't displace each
    other.  All columns of ``docs`` are returned; if several rows share the kept id
    and text, one of them stays.  Only rows that go, or may be repeated, are moved.
    """
    if similarity is None:
        found = _near_rows(docs, id_col=id_col, text_col=text_col, **options)
    else:
        found = _similar_rows(docs, similarity=similarity, id_col=id_col, text_col=text_col, **options)
    kept = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.hash"))
    told = found.select("doc_id", "text_hash", kept.alias("kept")).groupBy("doc_id", "text_hash", "kept").agg(F.count("*").alias("n"))
    told = checkpointed(told.where("not kept or n > 1").select(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h"), "kept"))
    calm, doubtful = parted(docs, told.select(row_key("_i", "_h").alias("key")), id_col, text_col)
    both = doubtful.join(told, doubtful["_id"].eqNullSafe(told["_i"]) & (doubtful["_hash"] == told["_h"]), "left")
    calm = calm.select(*docs.columns).unionByName(both.where("kept is null").select(*docs.columns))
    repeated = both.where("kept")
    return calm.unionByName(repeated.dropDuplicates(["_id", "_hash"]).select(*docs.columns)) if told.where("kept").limit(1).count() else calm


def fp_hex(fp: str = "fp"):
    """A 64-bit fingerprint as 16 lower-case hex digits."""
    return F.lower(F.concat(*[F.hex(F.substring(fp, i, 1)) for i in range(8, 0, -1)]))
