"""Operator 13: product codes of vectors, codebooks by Lloyd rounds over partition-local cover trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, skew_join, tidy

NODES = ("start", "stop", "centre", "child", "children")
BOUND = 1 << 26


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, exact: whole numbers below 2^53 in doubles, others in 64-bit integers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 52:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], axis=1)


def cover_tree(x: np.ndarray, leaf: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, nodes, radius) of a cover tree over the rows of ``x``.

    A node holds the rows ``order[start:stop]``, all within ``radius`` of its centre,
    which is a row of its own.  Its children's centres are a net of half the radius:
    each is further than that from those before it, the first is the node's own
    centre, and each row belongs to the first centre that reaches it.  Children lie
    side by side in ``nodes``.  Rows that are equal, or few, are a leaf.
    """
    order = np.arange(len(x))
    nodes, radius, k = [[0, len(x), 0, 0, 0]] if len(x) else [], [], 0
    while k < len(nodes):
        start, stop, centre, _, _ = nodes[k]
        left = order[start:stop].copy()
        far = ((x[left] - x[centre]) ** 2).sum(1)
        most = int(far.max())
        radius.append(np.sqrt(float(most)))
        if most and stop - start > leaf:
            nodes[k][3], at = len(nodes), start
            while len(left):
                near = 4 * far <= most
                own = left[near]
                nodes.append([at, at + len(own), centre, 0, 0])
                order[at : at + len(own)] = own
                at, left = at + len(own), left[~near]
                if len(left):
                    centre = int(left[0])
                    far = ((x[left] - x[centre]) ** 2).sum(1)
            nodes[k][4] = len(nodes) - nodes[k][3]
        k += 1
    return order.astype(np.int32), np.array(nodes, np.int32).reshape(-1, 5), np.array(radius)


def tree_codes(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray], entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(code of each row, rows of each entry, their sums, rows compared singly) under the nearest of ``entries``, ties to the lower.

    A node whose nearest entry is nearer to its centre than the second by more than
    twice its radius gives all its rows to it, and their sum is a difference of
    running sums.  Other nodes are opened; in leaves the rows are compared exactly.
    """
    order, nodes, radius = tree
    codes, n, sums, single = np.zeros(len(x), np.int64), np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64), 0
    upto = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x[order], axis=0)])
    front = np.arange(min(1, len(nodes)))
    while len(front):
        start, stop, centre, child, children = nodes[front].T.astype(np.int64)
        far = squares(x[centre], entries)
        best = far.argmin(axis=1)
        if len(entries) > 1:
            two = np.sqrt(np.partition(far, 1, axis=1)[:, :2].astype(np.float64))
            sure = two[:, 1] - two[:, 0] > 2 * radius[front] + 1e-9 * (1 + two[:, 1])
        else:
            sure = np.ones(len(front), bool)
        sure |= radius[front] == 0
        a, b, entry = start[sure], stop[sure], best[sure]
        np.add.at(sums, entry, upto[b] - upto[a])
        np.add.at(n, entry, b - a)
        codes[order[_places(a, b)]] = np.repeat(entry, b - a)
        rows = order[_places(start[~sure & (children == 0)], stop[~sure & (children == 0)])]
        if len(rows):
            own = squares(x[rows], entries).argmin(axis=1)
            np.add.at(sums, own, x[rows])
            n += np.bincount(own, minlength=len(n))
            codes[rows] = own
            single += len(rows)
        wide = ~sure & (children > 0)
        front = _places(child[wide], child[wide] + children[wide])
    return codes, n, sums, single


def _places(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a[0] .. b[0] - 1, a[1] .. b[1] - 1, and so on."""
    size = b - a
    return np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(a) else np.empty(0, np.int64)


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(vec_id, label, x array<long>)`` of the rows whose vector holds finite numbers alone; x is ``floor(256 * component)``."""
    given = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    fine = given.where("v is not null and forall(v, c -> c is not null and not isnan(c) and abs(c) <= 1.7976931348623157e308)")
    return fine.select("vec_id", "label", F.expr("transform(v, c -> CAST(floor(256 * c) AS LONG))").alias("x"))


def _planted(rows: DataFrame, parts: int, leaf: int, block_cells: int) -> DataFrame:
    """A row for each block of rows of a task: their ids, labels and components, and the cover tree of each part."""
    names = ["vec_id", "label", "x", "order", "nodes", "radius"]

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        wide = x.shape[1] // parts
        trees = [cover_tree(x[:, p * wide : (p + 1) * wide], leaf) for p in range(parts)]
        columns = [pa.array([table.column(c).to_pylist()], pa.list_(t)) for c, t in (("vec_id", pa.int64()), ("label", pa.string()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([x.astype("<i4").tobytes()], pa.binary()), *[pa.array([[t[k].tobytes() for t in trees]], pa.list_(pa.binary())) for k in range(3)]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cells = [], 0
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                held.append(b)
                cells += len(b.column("x").flatten())
                if cells >= block_cells:
                    yield block(held)
                    held, cells = [], 0
        if held:
            yield block(held)
        tidy()

    return rows.mapInArrow(run, "vec_id array<long>, label array<string>, x binary, order array<binary>, nodes array<binary>, radius array<binary>")


def _opened(batch: pa.RecordBatch, dims: int):
    """(row, components, tree of each part) of each block."""
    for k in range(batch.num_rows):
        x = np.frombuffer(batch.column("x")[k].as_py(), "<i4").astype(np.int64).reshape(-1, dims)
        order, nodes, radius = (batch.column(c)[k].as_py() for c in ("order", "nodes", "radius"))
        trees = [(np.frombuffer(o, np.int32), np.frombuffer(n, np.int32).reshape(-1, 5), np.frombuffer(r, np.float64)) for o, n, r in zip(order, nodes, radius, strict=True)]
        yield k, x, trees


def _moved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, component) after one round: each entry the floored mean of its parts, unused ones as they are."""
    parts, size, wide = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, size), np.int64), np.zeros(books.shape, np.int64)
        for b in batches:
            for _, x, trees in _opened(b, parts * wide):
                for p in range(parts):
                    _, own_n, own_sums, _ = tree_codes(x[:, p * wide : (p + 1) * wide], trees[p], books[p])
                    n[p] += own_n
                    sums[p] += own_sums
        p, e = np.nonzero(n)
        columns = [np.repeat(p, wide), np.repeat(e, wide), np.tile(np.arange(wide), len(p)), np.repeat(n[p, e], wide), sums[p, e].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["p", "e", "c", "n", "s"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    out = books.copy()
    for r in blocks.mapInArrow(run, "p long, e long, c long, n long, s long").groupBy("p", "e", "c").agg(exact("n"), exact("s")).collect():  # a row for each number of the codebooks
        out[r["p"], r["e"], r["c"]] = int(r["s"]) // int(r["n"])
    return out


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, leaf: int = 8, block_cells: int = 1 << 20, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` for every row whose vector holds finite numbers alone.

    Components become ``floor(256 * x)`` and vectors ``parts`` equal parts, each coded
    by the nearest of ``entries`` of its codebook, two hex digits each.  Codebooks
    start as the parts of the rows with the smallest ids and move ``rounds`` times to
    the floored mean of their parts.  All numbers are whole, so the result does not
    depend on how rows lie in tasks.

    Each task builds cover trees over blocks of ``block_cells`` components once and
    stores them; a round gives whole subtrees to an entry where the triangle
    inequality allows it and adds up running sums, so it returns a sum for each number
    of the codebooks, whatever the rows.  Vectors don't move.

    Rows that are repeated are coded each; ties of ids among the first are taken by
    their components, null ids last.  Fewer rows than ``entries`` make a smaller
    codebook.  Null labels are one label.  No rows give no rows.  Vectors of different
    lengths, lengths that ``parts`` does not divide, and components beyond 2^18 are
    refused with an error.
    """
    rows = checkpointed(whole_vectors(vectors, id_col, vector_col, label_col))
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    span = rows.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("dims"), F.max(F.expr("array_max(transform(x, c -> greatest(c, -c)))")).alias("most")).first()
    if span["dims"] is None:
        return rows.sparkSession.createDataFrame([], schema)
    dims = span["dims"]
    if span["least"] != dims or dims % parts or not dims:
        raise ValueError(f"vectors of {span['least']} to {dims} components can't be cut into {parts} equal parts")
    if span["most"] > BOUND:
        raise ValueError("components beyond 2^18 can't be coded")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, dims // parts).swapaxes(0, 1)
    blocks = checkpointed(_planted(rows, parts, leaf, block_cells))
    for _ in range(rounds):
        books = _moved(blocks, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    wide = dims // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{e:02x}" for e in range(len(books[0]))], "S2")
        for b in batches:
            for k, x, trees in _opened(b, dims):
                codes = np.stack([tree_codes(x[:, p * wide : (p + 1) * wide], trees[p], books[p])[0] for p in range(parts)], axis=1)
                error = sum(((x[:, p * wide : (p + 1) * wide] - books[p][codes[:, p]]) ** 2).sum(1) for p in range(parts))
                text = np.ascontiguousarray(digits[codes]).view(f"S{2 * parts}")[:, 0].astype(str)
                ids, labels = b.column("vec_id")[k].values, b.column("label")[k].values
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text), pa.array(error)], ["vec_id", "label", "code", "error"])
        tidy()

    coded = blocks.mapInArrow(run, "vec_id long, label string, code string, error long")
    # a null label is told from an empty one
    coded = checkpointed(coded.select("vec_id", F.col("label").isNull().alias("_none"), F.coalesce("label", F.lit("")).alias("_label"), "code", "error"))
    totals = coded.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"))
    out = skew_join(coded, totals, ["_none", "_label"])
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
