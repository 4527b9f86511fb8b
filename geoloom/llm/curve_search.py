"""Operator 11: nearest neighbours from several shifted Hilbert orderings of projected vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, in_order, skew_join, tidy
from .packing import hilbert_keys

DIMS, BITS = 4, 15
FOUND = "q long, g long, d double, least long"


def sound_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(uid, vec_id, v array<double>)`` of the rows that take part, stored: uid tells rows apart."""
    v = F.transform(F.col(f"`{vector_col}`").cast("array<double>"), lambda c: c + 0.0)  # -0.0 becomes 0.0
    given = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"))
    fine = "vec_id is not null and v is not null and forall(v, c -> c is not null and not isnan(c) and abs(c) <= 1.7976931348623157e308) and exists(v, c -> c <> 0)"
    return checkpointed(given.where(fine).withColumn("uid", F.monotonically_increasing_id()).select("uid", "vec_id", "v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


class Curves:
    """Hilbert orderings: for each a projection to ``DIMS`` directions, scaled by a sample's spread, and a shift of the grid."""

    def __init__(self, sample: np.ndarray, count: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.middle = sample.mean(axis=0)
        self.ways = rng.normal(size=(count, sample.shape[1], DIMS))
        spread = np.einsum("nd,sdk->snk", sample - self.middle, self.ways).std(axis=1)
        self.ways /= np.where(spread > 0, spread, 1.0)[:, None, :]
        self.shifts = rng.uniform(0, 0.5, (count, DIMS))

    def keys(self, v: np.ndarray, s: int) -> np.ndarray:
        """The place of each vector along ordering ``s``: coordinates fill half of the grid's side, moved by the shift."""
        z = (v - self.middle) @ self.ways[s]
        cells = (0.25 * (1 + np.tanh(0.8 * z)) + self.shifts[s]) * ((1 << BITS) - 1)
        return hilbert_keys(cells.astype(np.int64), BITS)


def nearest_rows(q: np.ndarray, c: np.ndarray, least: np.ndarray, k: int, step: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, distance): the ``k`` nearest rows of ``c`` for each row of ``q``, ties to the lower ``least``; distances are summed from differences."""
    out = [], [], []
    k = min(k, len(c))
    own = (c * c).sum(axis=1)
    rows = max(1, step // max(1, len(c)))
    for a in range(0, len(q) if k else 0, rows):
        x = q[a : a + rows]
        lone = (x * x).sum(axis=1)
        far = own[None, :] - 2 * (x @ c.T) + lone[:, None]
        limit = np.partition(far, k - 1, axis=1)[:, k - 1 : k] + 1e-9 * (lone[:, None] + own.max())
        i, j = np.nonzero(far <= limit)  # the product rounds: all that may be among the nearest are measured again
        d = np.sqrt(((x[i] - c[j]) ** 2).sum(axis=1))
        order = np.lexsort((least[j], d, i))
        i, j, d = i[order], j[order], d[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        top = place < k
        for whole, part in zip(out, (i[top] + a, j[top], d[top]), strict=True):
            whole.append(part)
    return tuple(np.concatenate(x) if x else np.empty(0, t) for x, t in zip(out, (np.int64, np.int64, np.float64), strict=True))


def _top(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each query, each once; tasks keep their own nearest before rows move."""
    order = Window.partitionBy("q").orderBy("d", "least", "g")
    return found.distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def _searched(rows: DataFrame, queries: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``(q, g, d, least)``: rows ``(keys.., g, least, v)`` and queries ``(keys.., q, v)`` of each key compared."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(("q", "g", "d", "least"), (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)})
        c, q = (_matrix(t.column(n).combine_chunks()) for t, n in ((left, "v"), (right, "_v")))
        g, least = left.column("g").to_numpy(), left.column("least").to_numpy()
        i, j, d = nearest_rows(q, c, least, k)
        return pa.table({"q": right.column("q").to_numpy()[i], "g": g[j], "d": d, "least": least[j]})

    asked = queries.select(*[F.col(c).alias(f"_{c}") for c in keys], "q", F.col("v").alias("_v"))
    return rows.groupBy(*keys).cogroup(asked.groupBy(*[f"_{c}" for c in keys])).applyInArrow(run, FOUND)


def exact_sample(rows: DataFrame, queries: np.ndarray, k: int) -> DataFrame:
    """``(q, g, d, least)``: the ``k`` nearest of ``(g, least, v)`` for a bounded number of queries, compared with every row."""
    held = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.empty(0, t) for t in (np.int64, np.int64, np.float64, np.int64)]
        for b in batches:
            g, least = b.column("g").to_numpy(), b.column("least").to_numpy()
            i, j, d = nearest_rows(held.value, _matrix(b.column("v")), least, k)
            best = [np.concatenate(x) for x in zip(best, (i, g[j], d, least[j]), strict=True)]
            order = np.lexsort((best[3], best[2], best[0]))
            best = [x[order] for x in best]
            top = np.arange(len(order)) - np.searchsorted(best[0], best[0]) < k
            best = [x[top] for x in best]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], ["q", "g", "d", "least"])

    return _top(rows.mapInArrow(run, FOUND), k)


def chosen(apart: np.ndarray, blocks: int, recall: float) -> tuple[int, int]:
    """(orderings, reach) with the fewest comparisons that find a share ``recall`` of sampled neighbours.

    apart: blocks between each sampled query and neighbour (rows) in each ordering
    (columns).  At least two orderings are used; with reach ``blocks - 1`` all are found.
    """
    best = (math.inf, 2, blocks - 1)
    for s in range(2, apart.shape[1] + 1):
        near = np.sort(apart[:, :s].min(axis=1))
        reach = int(near[min(len(near) - 1, math.ceil(recall * len(near)) - 1)]) if len(near) else 0
        best = min(best, (s * min(2 * reach + 1, blocks), s, reach))
    return best[1:]


def nearest_vectors(vectors: DataFrame, k: int = 10, every: int = 100, recall: float = 0.97, orderings: int = 6, block_rows: int = 2048, chunk: int = 4096, sample: int = 4096, asked: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows found for each row whose id is divisible by ``every``.

    Vectors are projected to four directions and sorted along Hilbert curves over
    shifted grids; each ordering is range-partitioned into blocks of about
    ``block_rows``, and a query meets the rows of the blocks within ``reach`` of its
    own.  The candidates of all orderings are merged and ranked by the Euclidean
    distance of the original vectors, ties to the smaller id.

    Only the projections' scale (``sample`` vectors) and the number of orderings and
    the reach are fitted on a sample: up to ``asked`` queries are compared with every
    row, and the cheapest setting that finds a share ``recall`` of their neighbours is
    taken.  Every row is indexed, and no block or candidate list is capped: queries of
    a block are dealt in chunks to as many tasks as needed.  Data without structure
    needs a reach over most blocks, which is then close to comparing everything.

    Equal vectors are searched once, with the k + 1 smallest ids of each, as no other
    can be in a result; so copies fill no window.  Rows whose id or vector is null,
    or whose vector is empty, zero or holds null or non-finite components, take no
    part, nor do vectors of another length than the longest.  Each repeated row is a
    query and a candidate of its own.  Fewer candidates than ``k`` are all returned;
    no rows give no rows.
    """
    spark = vectors.sparkSession
    rows = sound_vectors(vectors, id_col, vector_col)
    dims = rows.agg(F.max(F.size("v"))).first()[0]
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == dims)
    least = Window.partitionBy("v").orderBy("vec_id", "uid")
    firsts = rows.withColumn("_r", F.row_number().over(least)).where(F.col("_r") <= k + 1)
    members = checkpointed(firsts.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("vec_id", "uid"))).alias("ids")).withColumn("g", F.monotonically_increasing_id()))
    distinct = members.select("g", F.col("ids")[0]["vec_id"].alias("least"), "v")
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    asking = skew_join(rows.where(is_query), members.select("v", "g"), ["v"]).select("uid", "vec_id", F.col("g").alias("q"))
    asking = checkpointed(asking)
    n = members.count()
    queries = checkpointed(distinct.join(asking.select(F.col("q").alias("g")).distinct(), "g", "left_semi").select(F.col("g").alias("q"), "v"))
    found = _merged(distinct, queries, n, k, recall, orderings, block_rows, chunk, sample, asked)
    held = checkpointed(found.join(members.select("g", "ids"), "g").select("q", "d", F.explode("ids").alias("m")).select("q", "d", "m.vec_id", "m.uid"))
    nearest = Window.partitionBy("q").orderBy("d", "vec_id", "uid")
    listed = held.withColumn("_r", F.row_number().over(nearest)).where(F.col("_r") <= k + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("d", "vec_id", "uid"))).alias("top"))
    own = skew_join(asking, listed, ["q"]).select(F.col("vec_id").alias("query_id"), F.slice(F.filter("top", lambda m: m["uid"] != F.col("uid")), 1, k).alias("top"))
    out = own.select("query_id", F.posexplode("top").alias("_p", "m"))
    return out.select("query_id", (F.col("_p") + 1).cast("int").alias("rank"), "m.vec_id", F.col("m.d").alias("score"))


def _merged(distinct: DataFrame, queries: DataFrame, n: int, k: int, recall: float, orderings: int, block_rows: int, chunk: int, sample: int, asked: int) -> DataFrame:
    """``(q, g, d, least)``: the k + 1 nearest distinct vectors found for each distinct query, itself included."""
    dims = len(distinct.select("v").first()["v"])
    most = max(64, min(sample, (1 << 19) // dims))
    lead = np.array([r["v"] for r in distinct.orderBy(F.xxhash64("v")).select("v").limit(most).collect()])
    curves = distinct.sparkSession.sparkContext.broadcast(Curves(lead, orderings))
    blocks = max(1, round(n / block_rows))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("v"))
            for s in range(orderings):
                yield pa.RecordBatch.from_arrays([b.column("g"), pa.array(np.full(len(v), s, np.int32)), pa.array(curves.value.keys(v, s))], ["g", "s", "key"])
        tidy()

    keys = checkpointed(distinct.mapInArrow(keyed, "g long, s int, key long"))
    placed = in_order(keys, [F.col("s"), F.col("key"), F.col("g")])
    placed = checkpointed(placed.select("g", "s", F.floor((F.col("place") - F.col("s") * n) * blocks / n).cast("int").alias("block")))
    few = queries.orderBy(F.xxhash64("v")).limit(asked).collect()
    exact = exact_sample(distinct, np.array([r["v"] for r in few]), k + 1) if few else None
    apart = np.empty((0, orderings), np.int64)
    if few and blocks > 1:
        names = distinct.sparkSession.createDataFrame([(i, r["q"]) for i, r in enumerate(few)], "q long, own long")
        pairs = exact.join(F.broadcast(names), "q").where("g <> own").select("own", "g")
        pairs = checkpointed(pairs)
        at = placed.join(F.broadcast(pairs.select(F.col("g")).union(pairs.select("own")).distinct()), "g", "left_semi").collect()  # at most asked * (k + 2) vectors
        where = {(r["g"], r["s"]): r["block"] for r in at}
        apart = np.array([[abs(where[r["own"], s] - where[r["g"], s]) for s in range(orderings)] for r in pairs.collect()], np.int64).reshape(-1, orderings)
    used, reach = chosen(apart, blocks, recall)
    if blocks == 1:
        used, reach = 2, 0
    asks = queries.count()
    chunks = max(1, math.ceil(asks * min(2 * reach + 1, blocks) / blocks / chunk))
    near = placed.where(F.col("s") < used)
    dealt = near.join(distinct, "g").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    around = F.explode(F.sequence(F.greatest(F.col("block") - reach, F.lit(0)), F.least(F.col("block") + reach, F.lit(blocks - 1))))
    sent = near.join(queries.withColumnRenamed("q", "g"), "g").select("s", F.col("g").alias("q"), "v", around.alias("block"), F.pmod(F.xxhash64("g"), F.lit(chunks)).cast("int").alias("chunk"))
    return _top(_searched(dealt, sent, ["s", "block", "chunk"], k + 1), k + 1)
