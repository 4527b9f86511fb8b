"""Operator 4: token ids of all texts in Simple-8b files, and their reading.

A file has, little-endian: 8 bytes of magic; the words of all blocks; then
``offsets`` (n_blocks + 1 words, unsigned 64-bit: first word of each block),
doc_ids (signed 64-bit), null flags of the ids (bytes) and n_tokens (unsigned
64-bit) of each document; at the end six unsigned 64-bit numbers: n_words,
n_blocks, block size, n_ids, n_docs and the magic again.  A block can be read by
its offset alone.  Files are named by task and number, in the order of doc_id, and
rolled at a stated size; ``manifest.json`` lists them with the ids before each.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b
from .common import byte_slices, doc_columns, scratch_path, tidy
from .tokens import encoder_for, tokenizer_text

MAGIC = b"S8BTOK01"
_TALLY = "part int, number int, n_docs long, n_ids long"
_READ = "doc_id long, start long, n_tokens long, ids binary"


class FileWriter:
    """Streams documents into one file: whole blocks are coded as they fill, the index goes last."""

    def __init__(self, out, block: int = simple8b.BLOCK):
        self.out, self.block = out, block
        self.rest = np.empty(0, np.uint32)
        self.offsets, self.ids, self.nulls, self.lengths = [np.zeros(1, np.uint64)], [], [], []
        self.n_words = self.n_ids = 0
        out.write(MAGIC)

    def add(self, doc_ids: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.ids.append(np.array([x or 0 for x in doc_ids], np.int64))
        self.nulls.append(np.array([x is None for x in doc_ids], np.uint8))
        self.lengths.append(lengths.astype(np.uint64))
        self.n_ids += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        whole = len(self.rest) // self.block * self.block
        if whole:
            self._code(self.rest[:whole])
            self.rest = self.rest[whole:].copy()

    def _code(self, ids: np.ndarray) -> None:
        words, offsets = simple8b.encode(ids, self.block)
        self.out.write(words.astype("<u8").tobytes())
        self.offsets.append(offsets[1:].astype(np.uint64) + np.uint64(self.n_words))
        self.n_words += len(words)

    def finish(self) -> tuple[int, int]:
        if len(self.rest):
            self._code(self.rest)
        offsets, ids, nulls, lengths = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (self.offsets, self.ids, self.nulls, self.lengths))
        for part, kind in ((offsets, "<u8"), (ids, "<i8"), (nulls, "u1"), (lengths, "<u8")):
            self.out.write(part.astype(kind).tobytes())
        self.out.write(np.array([self.n_words, len(offsets) - 1, self.block, self.n_ids, len(ids)], "<u8").tobytes() + MAGIC)
        return len(ids), self.n_ids


class FileReader:
    """Reads documents of an open file by block ranges; only the index and one range are held."""

    def __init__(self, source):
        self.source, size = source, source.size()
        tail = source.read_at(48, size - 48)
        if source.read_at(8, 0) != MAGIC or tail[-8:] != MAGIC:
            raise ValueError("not a token file")
        n_words, n_blocks, self.block, self.n_ids, n_docs = (int(x) for x in np.frombuffer(tail, "<u8", 5))
        at = 8 + 8 * n_words
        index = source.read_at(size - 48 - at, at)
        self.offsets = np.frombuffer(index, "<u8", n_blocks + 1).astype(np.int64)
        ids = np.frombuffer(index, "<i8", n_docs, at := 8 * (n_blocks + 1))
        nulls = np.frombuffer(index, "u1", n_docs, at := at + 8 * n_docs)
        self.lengths = np.frombuffer(index, "<u8", n_docs, at + n_docs).astype(np.int64)
        self.doc_ids = pa.array(ids.astype(np.int64), mask=nulls.astype(bool))
        self.upto = np.concatenate([[0], np.cumsum(self.lengths)])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop`` of the file, from the blocks that hold them."""
        if start == stop:
            return np.empty(0, np.uint64)
        a, b = start // self.block, -(-stop // self.block)
        first, last = int(self.offsets[a]), int(self.offsets[b])
        words = np.frombuffer(self.source.read_at(8 * (last - first), 8 + 8 * first), "<u8")
        found = simple8b.decode(words, self.offsets[a : b + 1] - first, min(b * self.block, self.n_ids) - a * self.block, self.block)
        return found[start - a * self.block : stop - a * self.block]

    def ranges(self, most_ids: int = 1 << 20, most_docs: int = 2000) -> Iterator[tuple[int, int]]:
        """Runs of documents of about ``most_ids`` ids at most; a longer one is a run of its own."""
        k = 0
        while k < len(self.lengths):
            j = min(max(k + 1, int(np.searchsorted(self.upto, self.upto[k] + most_ids, "right")) - 1), k + most_docs)
            yield k, j
            k = j


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, roll_bytes: int = 256 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts, each followed by ``end_id``, and write them under ``path`` in ascending order of id.

    Ids that are null come first; rows of one id are ordered by the hash of their
    text, and rows that are equal in both in no order, so that any number of such
    rows is dealt to many tasks.  Null texts are empty.  A task begins a new file
    when one holds ``roll_bytes``.  A file is written under a name of its own task
    attempt and then renamed, so a task that runs again leaves the same files.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(tokenizer_text(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = pafs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        encoder = encoder_for(spec.value)
        number, writer, out, tally = 0, None, None, []

        def close() -> None:
            nonlocal number, writer
            tally.append((task.partitionId(), number, *writer.finish()))
            out.close()
            store.move(own, f"{root}/{file_name(task.partitionId(), number)}")
            number, writer = number + 1, None

        for whole in batches:
            for b in byte_slices(whole, "text"):
                if writer is None:
                    own = f"{root}/.attempt-{task.partitionId()}-{number}-{task.taskAttemptId()}"
                    out = store.open_output_stream(own)
                    writer = FileWriter(out)
                ids, offsets = encoder.encode_column(b.column("text"), end_id)
                writer.add(b.column("doc_id").to_pylist(), ids, np.diff(offsets))
                if 8 * writer.n_words >= roll_bytes:
                    close()
        if writer is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*tally, strict=True)) or [()] * 4, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["part", "number", "n_docs", "n_ids"])
        tidy()

    own = doc_columns(docs, id_col, text_col).withColumns({"_hash": F.xxhash64("text"), "_tie": F.monotonically_increasing_id()})
    order = ["doc_id", "_hash", "_tie"]
    dealt = own.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    tally = sorted(map(tuple, dealt.mapInArrow(run, _TALLY).collect()))  # a row for each file
    files, before = [], 0
    for part, number, n_docs, n_ids in tally:
        files.append({"file": file_name(part, number), "before": before, "n_docs": n_docs, "n_ids": n_ids})
        before += n_ids
    store, root = pafs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({"format": MAGIC.decode(), "end_id": end_id, "files": files}).encode())


def file_name(part: int, number: int) -> str:
    """The name of a task's file: names sort in the order of doc_id."""
    return f"part-{part:06d}-{number:06d}.s8b"


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids binary)`` of all documents: ids are little-endian unsigned 32-bit, start counts those before.

    A task reads whole files of the manifest, one range of documents after another.
    """
    store, root = pafs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        files = [(x["file"], x["before"]) for x in json.loads(f.read())["files"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(path)
        for b in batches:
            for name, before in zip(b.column("file").to_pylist(), b.column("before").to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as source:
                    reader = FileReader(source)
                    for k, j in reader.ranges():
                        upto = reader.upto[k : j + 1]
                        raw = memoryview(reader.ids(int(upto[0]), int(upto[-1])).astype("<u4").tobytes())
                        at = (4 * (upto - upto[0])).tolist()
                        texts = [bytes(raw[x:y]) for x, y in zip(at, at[1:], strict=False)]
                        yield pa.RecordBatch.from_arrays([reader.doc_ids.slice(k, j - k), pa.array(upto[:-1] + before), pa.array(reader.lengths[k:j]), pa.array(texts, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
        tidy()

    if not files:
        return spark.createDataFrame([], _READ)
    listed = spark.createDataFrame(files, "file string, before long").repartition(min(len(files), 10_000), "file")
    return listed.mapInArrow(run, _READ)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from the files under ``path``."""
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def written_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 1, roll_bytes: int = 256 << 20) -> DataFrame:
    """Write all documents to a new folder in the shared one and return what its files say of them."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id, roll_bytes)
    return token_digests(docs.sparkSession, path)


__all__ = ["FileReader", "FileWriter", "file_name", "read_tokens", "token_digests", "write_tokens", "written_and_read"]
