"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.operators.graph import checkpointed, shared_dir, skew_join

__all__ = ["bit_table", "byte_slices", "checkpointed", "crc32_of_id", "discard", "doc_columns", "in_order", "marked", "parted", "row_key", "scratch_path", "shared_dir", "skew_join", "small_batches", "text_bytes", "tidy"]


def scratch_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`scratch_path` named, once nothing reads it any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Let an Arrow batch hold at most ``most`` bytes in this session: texts are long, and a Python task and the JVM hold a batch each way."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if not now or not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= most:
        spark.conf.set(name, str(most))


def doc_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator needs, under fixed names, for tasks on small batches; all others, clashing or not, are left out."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def text_bytes(column: pa.Array):
    """UTF-8 bytes of each text of an Arrow column; null reads as empty."""
    return (v or b"" for v in column.cast(pa.binary()).to_pylist())


def crc32_of_id(col: Column) -> Column:
    """crc32 of the id written as text (null id: of the empty text)."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def byte_slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20, rows: int = 2000):
    """The batch in parts of at most ``rows`` rows whose texts have about ``most`` bytes at most; a longer text is a part of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(size)])
    k = 0
    while k < batch.num_rows:
        j = min(max(k + 1, int(np.searchsorted(upto, upto[k] + most, "right")) - 1), k + rows)
        yield batch.slice(k, j - k)
        k = j


def tidy() -> None:
    """Give memory that a task has freed back to the machine, as Python workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def bit_table(keys: DataFrame, bits: int, key: str = "key") -> np.ndarray:
    """A table of ``2 ** bits`` bits, packed, with the top bits of each 64-bit key marked.

    Its size is fixed whatever the number of keys.  Each page of it is made in a task
    and fetched one after another.
    """
    page_bits = min(18, bits)
    place = F.shiftrightunsigned(F.col(key), 64 - bits)
    pages = keys.select(F.shiftrightunsigned(place, page_bits).cast("int").alias("page"), place.bitwiseAND(F.lit((1 << page_bits) - 1)).cast("int").alias("slot"))

    def page(table: pa.Table) -> pa.Table:
        flat = np.zeros(1 << page_bits, np.uint8)
        flat[table.column("slot").to_numpy()] = 1
        return pa.table({"page": table.column("page").slice(0, 1), "bits": pa.array([np.packbits(flat, bitorder="little").tobytes()], pa.binary())})

    out, size = np.zeros(max(1, (1 << bits) // 8), np.uint8), (1 << page_bits) // 8
    for row in pages.distinct().groupBy("page").applyInArrow(page, "page int, bits binary").toLocalIterator():
        out[row["page"] * size : (row["page"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out


def marked(table: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Whether each 64-bit key is marked in a :func:`bit_table`."""
    slot = keys >> np.uint64(64 - bits)
    return ((table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def row_key(id_col: str = "doc_id", hash_col: str = "text_hash") -> Column:
    """One 64-bit key of a row's id, which may be null, and its text's hash."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(hash_col))


def parted(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = 30) -> tuple[DataFrame, DataFrame]:
    """(rows of ``docs`` whose :func:`row_key` surely isn't among ``keys``, the other rows): both with ``_id`` and ``_hash``, id and text hash.

    keys: ``(key)``, stored.  Bitmaps with 16 bits a key, at most ``2 ** most_bits`` in
    all (128 MB), are broadcast and tell rows apart where they lie, so that texts which
    nothing is known of need not move.  The other rows may hold some whose key isn't
    listed: a 16th of all, more where the bitmaps have reached their bound.
    """
    bits = max(16, min(most_bits, (16 * keys.count()).bit_length()))
    place = lambda key: F.shiftrightunsigned(key, 64 - bits)
    maps = keys.select(place(F.col("key")).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits"))
    maps = checkpointed(maps)
    told = docs.withColumns({"_id": F.col(f"`{id_col}`").cast("long"), "_hash": F.xxhash64(F.col(f"`{text_col}`").cast("string"))}).withColumn("_p", place(row_key("_id", "_hash")))
    told = told.join(F.broadcast(maps), F.bitmap_bucket_number("_p") == F.col("_bucket"), "left")
    at = F.bitmap_bit_position("_p")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    listed = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) > 0, F.lit(False))
    names = [*docs.columns, "_id", "_hash"]
    return told.where(~listed).select(*names), told.where(listed).select(*names)


def in_order(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place (from 0) in a total order: sorted by ranges, each task's rows numbered after those of the tasks before it.

    The order must tell all rows apart, so that any number of equal rows is dealt to many tasks.
    """
    ranged = checkpointed(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    ahead = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # over a row for each task
    base = ranged.groupBy("_part").agg(F.count("*").alias("_rows")).select("_part", F.coalesce(ahead, F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + F.col("_before")
    return ranged.join(F.broadcast(base), "_part").withColumn(name, at.cast("long")).drop("_part", "_before")
