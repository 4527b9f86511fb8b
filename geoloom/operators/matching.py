"""Image matching: nearest neighbours of descriptors, corners, keypoints, registration, stitching."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.params import in_range, one_of
from geoloom.operators.focal import TILE, corner_response, gaussian_weights, separable, tile_apply, tiles
from geoloom.operators.graph import checkpointed, small_join
from geoloom.operators.project import back_to_source, dealt_to_tiles, seen_in, tile_boxes, warp
from geoloom.operators.raster import stretched


_FOUND = "query_id long, train_id long, distance double"


def _best_two(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "train_id")
    return found.withColumn("rank", F.row_number().over(order)).where("rank <= 2")


def _block_nearest(metric: str, skip_own: bool):
    """The function that gives the two nearest train rows (``side`` 1) of each query (``side`` 0) of a group."""

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1].sort_values("id")
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "train_id": [], "distance": []})
        x, y = np.stack(a["vec"].to_numpy()).astype(float), np.stack(b["vec"].to_numpy()).astype(float)
        if metric == "hamming":
            d = np.bitwise_count(x.astype(np.int64)[:, None, :] ^ y.astype(np.int64)[None, :, :]).sum(2).astype(float)
        else:
            d = np.concatenate([((x[k : k + 64, None, :] - y[None, :, :]) ** 2).sum(2) for k in range(0, len(x), 64)])
        if skip_own:
            d[a["id"].to_numpy()[:, None] == b["id"].to_numpy()[None, :]] = np.inf
        take = np.argsort(d, axis=1, kind="stable")[:, :2]
        rows = np.repeat(np.arange(len(x)), take.shape[1])
        dist = d[rows, take.ravel()]
        out = pd.DataFrame({"query_id": a["id"].to_numpy()[rows], "train_id": b["id"].to_numpy()[take.ravel()], "distance": dist if metric == "hamming" else np.sqrt(dist)})
        return out[np.isfinite(dist)]

    return nearest


def two_nearest(queries: DataFrame, train: DataFrame, metric: str = "l2", block: int = 2048, skip_own: bool = False) -> DataFrame:
    """``(query_id, train_id, distance, rank)``: the two nearest of ``train`` for each query, exactly.

    Both tables are ``(id, vec)``.  Queries and train rows are dealt to blocks and each
    block pair is one numpy product; a pair gives two rows a query, and the best two of
    all pairs follow by a window.  Ties go to the smaller id.  With ``skip_own`` both
    tables share their ids, and a query's own row is not its neighbour.
    """
    one_of("metric", metric, ("l2", "hamming"))
    nq, nt = (max(1, -(-t.count() // block)) for t in (queries, train))
    side = lambda t, n, s: t.select("id", "vec", F.lit(s).alias("side"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("own"))
    q = side(queries, nq, 0).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(nt - 1)))).select("id", "vec", "side", F.col("own").alias("qb"), F.col("other").alias("tb"))
    t = side(train, nt, 1).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).select("id", "vec", "side", F.col("other").alias("qb"), F.col("own").alias("tb"))

    found = q.unionByName(t).groupBy("qb", "tb").applyInPandas(_block_nearest(metric, skip_own), _FOUND)
    return _best_two(found)


def _centres(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Centres of a sample by Lloyd's rounds; those that lose all rows stay where they are."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        own = _apart(x, centres).argmin(axis=1)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x to all rows of y."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :], 0.0))


def pruned_nearest(queries: DataFrame, train: DataFrame, lists: int | None = None, sample: int = 8192, part: int = 4096, skip_own: bool = False, seed: int = 1, compared: bool = False) -> DataFrame:
    """As :func:`two_nearest` (L2), exactly, by an inverted file whose lists and rows are passed over by the triangle inequality.

    Centres are fitted on ``sample`` rows; every row of ``train`` joins the list of its
    nearest centre and keeps its distance r to it.  A query first searches its nearest
    list, which bounds its second neighbour by t.  Another list can hold a nearer row
    only if its distance to the query less its radius is t or less, and of its rows
    only those whose r differs from the query's distance to the centre by t or less
    are compared.  Lists are dealt in parts of about ``part`` rows and as many queries.
    On vectors without clusters nothing can be passed over, and all pairs are compared.

    compared: gives ``(query_id, pairs)`` instead, the rows that each query was compared with.
    """
    n = train.count()
    if not n:
        return two_nearest(queries, train, skip_own=skip_own)
    lists = lists or max(1, min(1024, round(math.sqrt(n))))
    centres = _centres(np.array([r["vec"] for r in train.orderBy(F.xxhash64("id")).select("vec").limit(sample).collect()], float), lists, seed=seed)

    def listed(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["vec"].to_numpy()).astype(float)
                far = _apart(x, centres)
                own = far.argmin(axis=1)
                yield pdf.assign(list=own, r=np.sqrt(((x - centres[own]) ** 2).sum(1)))

    rows = checkpointed(train.select("id", "vec").mapInPandas(listed, "id long, vec array<double>, list int, r double"))
    told = {r["list"]: r for r in rows.groupBy("list").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count("*").alias("n")).collect()}  # a row for each list
    held = np.array(sorted(told))
    low, high = (np.array([told[k][c] for k in held.tolist()]) for c in ("low", "high"))

    def nearest_list(batches):
        for pdf in batches:
            if len(pdf):
                far = _apart(np.stack(pdf["vec"].to_numpy()).astype(float), centres[held])
                own = far.argmin(axis=1)
                yield pdf.assign(list=held[own], r=far[np.arange(len(own)), own], t=np.inf)

    def other_lists(batches):
        for pdf in batches:
            if len(pdf):
                far = _apart(np.stack(pdf["vec"].to_numpy()).astype(float), centres[held])
                t = pdf["t"].to_numpy()[:, None] * (1 + 1e-9) + 1e-9
                open_ = (far - high <= t) & (low - far <= t)
                open_[np.arange(len(far)), far.argmin(axis=1)] = False
                ids, vecs = pdf["id"].to_numpy(), pdf["vec"].to_numpy()
                for i, k in _slices(*np.nonzero(open_), len(vecs[0])):
                    yield pd.DataFrame({"id": ids[i], "vec": vecs[i], "list": held[k], "r": far[i, k], "t": t[i, 0]})

    asked = "id long, vec array<double>, list int, r double, t double"
    first = checkpointed(queries.select("id", "vec").mapInPandas(nearest_list, asked))
    one = checkpointed(_in_lists(rows, first, part, skip_own))
    bound = one.groupBy("query_id").agg(F.when(F.count("train_id") >= 2, F.max("distance")).otherwise(float("inf")).alias("t"))
    more = queries.select("id", "vec").join(bound, F.col("id") == F.col("query_id"), "left").select("id", "vec", F.coalesce("t", F.lit(float("inf"))).alias("t"))
    two = _in_lists(rows, checkpointed(more.mapInPandas(other_lists, asked)), part, skip_own)
    found = one.unionByName(two)
    if compared:
        return found.groupBy("query_id").agg(F.sum("pairs").alias("pairs"))
    return _best_two(found.where("train_id is not null").select("query_id", "train_id", "distance"))


def _slices(i: np.ndarray, k: np.ndarray, length: int, most: int = 1 << 20):
    """Pairs (i, k) in slices of at most ``most`` numbers, if a vector of ``length`` goes with each pair: a query may be sent to every list."""
    step = max(1, most // max(1, length))
    for at in range(0, len(i), step):
        yield i[at : at + step], k[at : at + step]


def _in_lists(rows: DataFrame, asked: DataFrame, part: int, skip_own: bool) -> DataFrame:
    """``(query_id, train_id, distance, pairs)``: the two nearest of the rows of each list whose r is within t of the query's; pairs, of a query and part, on its first row."""

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            left = left.sort_values(["r", "id"])
            ids, r, y = left["id"].to_numpy(), left["r"].to_numpy(), np.stack(left["vec"].to_numpy()).astype(float)
            for q, vec, far, t in zip(right["_id"], right["_vec"], right["_r"], right["_t"], strict=True):
                a, b = np.searchsorted(r, far - t - 1e-9), np.searchsorted(r, far + t + 1e-9, "right")
                d = np.sqrt(((y[a:b] - np.asarray(vec, float)) ** 2).sum(1))
                if skip_own:
                    d[ids[a:b] == q] = np.inf
                near = np.lexsort((ids[a:b], d))[:2]
                near = near[np.isfinite(d[near])]
                out += [(q, int(ids[a + k]), float(d[k]), int(b - a) if not i else 0) for i, k in enumerate(near)] or [(q, None, None, int(b - a))]
        return pd.DataFrame(out, columns=["query_id", "train_id", "distance", "pairs"]).astype({"train_id": "Int64"})

    size = rows.groupBy("list").agg(F.ceil(F.count("*") / part).cast("int").alias("m"))
    want = asked.groupBy("list").agg(F.ceil(F.count("*") / part).cast("int").alias("c"))
    both = checkpointed(size.join(want, "list"))  # a row for each list
    dealt = lambda t: t.join(F.broadcast(both), "list")
    here = dealt(rows).select("list", "id", "vec", "r", F.pmod(F.xxhash64("id"), F.col("m")).cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("q"))
    there = dealt(asked).select(F.col("list").alias("_list"), F.col("id").alias("_id"), F.col("vec").alias("_vec"), F.col("r").alias("_r"), F.col("t").alias("_t"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("_p"), F.pmod(F.xxhash64("id"), F.col("c")).cast("int").alias("_q"))
    return here.groupBy("list", "p", "q").cogroup(there.groupBy("_list", "_p", "_q")).applyInPandas(search, "query_id long, train_id long, distance double, pairs long")


def ratio_matches(nearest: DataFrame, ratio: float = 0.75) -> DataFrame:
    """``(idx1, idx2, distance)`` of queries whose nearest is nearer than ``ratio`` times the second (Lowe's test); a query without a second has no match."""
    in_range("ratio", ratio, 0, 1, open_low=True)
    pair = nearest.groupBy("query_id").agg(F.min_by("train_id", "rank").alias("idx2"), F.min("distance").alias("distance"), F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("second"))
    return pair.where(F.col("distance") < ratio * F.col("second")).select(F.col("query_id").alias("idx1"), "idx2", "distance")


def _buckets(x: np.ndarray, planes: np.ndarray, shift: np.ndarray, width: float) -> np.ndarray:
    """The bucket of each vector in each table (rows x tables): ``planes`` is tables x projections x length."""
    tables, k, length = planes.shape
    at = np.floor((x @ planes.reshape(tables * k, length).T).reshape(len(x), tables, k) / width + shift).astype(np.int64)
    out = np.broadcast_to(np.arange(tables, dtype=np.int64), (len(x), tables)).copy()
    for j in range(k):
        out = (out * np.int64(1_000_003)) ^ at[:, :, j]
    return out


def _plan_tables(x: np.ndarray, y: np.ndarray, others: np.ndarray, recall: float, most_tables: int, most_work: float, seed: int) -> tuple | None:
    """(planes, shift, width) by which a share ``recall`` of the true pairs x[i], y[i] meet, with the fewest chance pairs; None if that takes over ``most_work`` of all pairs."""
    rng = np.random.default_rng(seed)
    scale = float(np.median(np.sqrt(((x - y) ** 2).sum(1)))) or 1e-9
    best = None
    for k in (1, 2, 3, 4, 6, 8, 12):
        planes, shift = rng.normal(size=(most_tables, k, x.shape[1])), rng.random((most_tables, k))
        for width in (0.5 * scale, scale, 2 * scale, 4 * scale, 8 * scale):
            hx, hy, ho = (_buckets(v, planes, shift, width) for v in (x, y, others))
            met = np.logical_or.accumulate(hx == hy, axis=1).mean(0)
            if met[-1] < recall:
                continue
            n = int(np.argmax(met >= recall)) + 1
            work = sum(float((hx[:, None, t] == ho[None, :, t]).mean()) for t in range(n))
            if best is None or work < best[0]:
                best = work, (planes[:n], shift[:n], width)
    return best[1] if best and best[0] <= most_work else None


def lsh_nearest(queries: DataFrame, train: DataFrame, recall: float = 0.9, part: int = 2048, sample: int = 256, most_tables: int = 32, most_work: float = 0.5, skip_own: bool = False, seed: int = 1) -> DataFrame:
    """As :func:`two_nearest` (L2) by random-projection hashes, with at least about ``recall`` of its rows.

    The bucket width, the projections a table and the number of tables come from
    ``sample`` queries and their exact neighbours: tables are added until ``recall``
    and 0.03 more of these are met.  Vectors so far from each other that buckets would
    compare over ``most_work`` of all pairs are left to :func:`two_nearest`, which
    costs less then.  Crowded buckets are dealt as pairs of salted parts of about
    ``part`` rows, and queries with fewer than two candidates are answered exactly.
    """
    in_range("recall", recall, 0, 1, open_low=True)
    queries, train = checkpointed(queries.select("id", "vec")), checkpointed(train.select("id", "vec"))
    few = lambda t, n: t.orderBy(F.xxhash64("id"), "id").limit(n)
    asked = few(queries, sample)
    true = two_nearest(asked, train, skip_own=skip_own).select("query_id", "train_id")
    true = true.join(asked.select(F.col("id").alias("query_id"), F.col("vec").alias("q")), "query_id").join(train.select(F.col("id").alias("train_id"), F.col("vec").alias("t")), "train_id").select("q", "t").toPandas()
    others = few(train, 1024).select("vec").toPandas()["vec"]
    if not len(true):
        return two_nearest(queries, train, skip_own=skip_own)
    stacked = lambda v: np.stack(v.to_numpy()).astype(float)
    plan = _plan_tables(stacked(true["q"]), stacked(true["t"]), stacked(others), min(1.0, recall + 0.03), most_tables, most_work, seed)
    if plan is None:
        return two_nearest(queries, train, skip_own=skip_own)

    def hashed(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(buckets=list(_buckets(stacked(pdf["vec"]), *plan)))

    spread = lambda t: t.mapInPandas(hashed, "id long, vec array<double>, buckets array<long>").select("id", "vec", F.explode("buckets").alias("bucket"))
    doubles = lambda t: t.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    q, t = spread(doubles(queries)), spread(doubles(train))
    parts = lambda v, name: v.groupBy("bucket").agg(F.ceil(F.count("*") / part).cast("int").alias(name))
    sizes = checkpointed(parts(q, "qn").join(parts(t, "tn"), "bucket"))
    side = lambda v, s, own, other: v.join(sizes, "bucket").select("id", "vec", F.lit(s).alias("side"), "bucket", F.pmod(F.xxhash64("id"), F.col(own)).cast("int").alias(own[0] + "b"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[0] + "b"))
    met = side(q, 0, "qn", "tn").unionByName(side(t, 1, "tn", "qn"))
    found = met.groupBy("bucket", "qb", "tb").applyInPandas(_block_nearest("l2", skip_own), _FOUND)
    near = checkpointed(_best_two(found.groupBy("query_id", "train_id").agg(F.min("distance").alias("distance"))))
    full = near.where("rank = 2").select(F.col("query_id").alias("id"))
    lone = checkpointed(queries.join(full, "id", "left_anti"))
    return near.join(full.withColumnRenamed("id", "query_id"), "query_id", "left_semi").unionByName(two_nearest(lone, train, skip_own=skip_own))


def lsh_matches(queries: DataFrame, train: DataFrame, ratio: float = 0.75, recall: float = 0.9, skip_own: bool = False) -> DataFrame:
    """As :func:`ratio_matches` over :func:`lsh_nearest`."""
    return ratio_matches(lsh_nearest(queries, train, recall, skip_own=skip_own), ratio)


def suppressed(candidates: DataFrame, min_distance: float = 10, shape: str = "square") -> DataFrame:
    """The candidates ``(raster_id, row, col, response)`` that a greedy pass in order of response keeps, none nearer than ``min_distance`` to a kept one.

    In rounds: a point better than all undecided neighbours is kept and its neighbours
    go; the set is that of the greedy order (ties by row, then column).  Each round
    decides the best point left at least, and rounds go on until all are decided.
    Neighbours are found by a grid join, so a round costs no all-pairs comparison.
    """
    in_range("min_distance", min_distance, 0)
    if min_distance <= 0:
        return candidates
    d = float(min_distance)
    state = checkpointed(candidates.select("raster_id", "row", "col", "response", F.lit(0).alias("kept")))
    better = F.struct(F.col("o_response"), -F.col("o_row"), -F.col("o_col")) > F.struct(F.col("response"), -F.col("row"), -F.col("col"))
    dy, dx = F.col("row") - F.col("o_row"), F.col("col") - F.col("o_col")
    close = (F.abs(dy) < d) & (F.abs(dx) < d) if shape == "square" else dy * dy + dx * dx < d * d

    def beside(points: DataFrame, others: DataFrame) -> DataFrame:
        cells = F.array(*[F.struct((F.floor(F.col("row") / d) + i).alias("cy"), (F.floor(F.col("col") / d) + j).alias("cx")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        spread = points.withColumn("cell", F.explode(cells))
        own = others.select("raster_id", F.struct(F.floor(F.col("row") / d).alias("cy"), F.floor(F.col("col") / d).alias("cx")).alias("cell"), F.col("row").alias("o_row"), F.col("col").alias("o_col"), F.col("response").alias("o_response"))
        return spread.join(own, ["raster_id", "cell"]).where(close)

    while state.where("kept = 0").limit(1).count():
        undecided = state.where("kept = 0")
        beaten = beside(undecided, undecided).where(better).select("raster_id", "row", "col").distinct()
        won = checkpointed(undecided.join(beaten, ["raster_id", "row", "col"], "left_anti").withColumn("kept", F.lit(1)))
        gone = beside(undecided, won).select("raster_id", "row", "col").distinct()
        state = checkpointed(state.where("kept = 1").unionByName(won).unionByName(undecided.join(gone, ["raster_id", "row", "col"], "left_anti").join(won.select("raster_id", "row", "col"), ["raster_id", "row", "col"], "left_anti")))
    return state.where("kept = 1").drop("kept")


def corners(pixels: DataFrame, method: str = "harris", max_corners: int = 5000, quality: float = 0.01, min_distance: float = 10) -> DataFrame:
    """``(raster_id, row, col, response)``: local maxima above ``quality`` of the greatest response, thinned and cut to the best ``max_corners`` of each raster.

    Responses count to ten digits, so that those which only the order of a sum tells apart are ties.
    """
    in_range("quality", quality, 0, 1, open_low=True)
    in_range("max_corners", max_corners, 1)
    response = checkpointed(corner_response(pixels, method).withColumn("value", F.round("value", 10)))
    peaks = tile_apply(response, lambda g: np.where(g[1:-1, 1:-1] >= sliding_window_view(g, (3, 3)).max(axis=(2, 3)), g[1:-1, 1:-1], np.nan), 1, "low")
    top = response.groupBy("raster_id").agg((F.max("value") * quality).alias("floor"), F.max("row").alias("h"), F.max("col").alias("w"))
    found = peaks.join(top, "raster_id").where("value > floor and row > 0 and col > 0 and row < h and col < w").select("raster_id", "row", "col", F.col("value").alias("response"))
    kept = suppressed(found, min_distance, "square" if method == "harris" else "round")
    order = Window.partitionBy("raster_id").orderBy(F.col("response").desc(), "row", "col")
    return kept.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_corners).drop("n")


PATCH = 8
_PAIRS = np.random.default_rng(11).integers(-PATCH, PATCH + 1, (256, 4))


def halved(pixels: DataFrame) -> DataFrame:
    """The raster at half its size, each pixel the mean of the four below it; an odd last row or column goes."""
    size = pixels.groupBy("raster_id", "band").agg((F.floor((F.max("row") + 1) / 2)).alias("_h"), (F.floor((F.max("col") + 1) / 2)).alias("_w"))
    small = small_join(pixels, size, ["raster_id", "band"]).withColumns({c: F.floor(F.col(c) / 2).cast("int") for c in ("row", "col")})
    return small.where("row < _h and col < _w").groupBy("raster_id", "band", "row", "col").agg(F.avg("value").alias("value"))


def keypoints(pixels: DataFrame, max_points: int = 5000, octaves: int = 1) -> DataFrame:
    """``(raster_id, row, col, size, response, angle, descriptor)``: corners with a steered 256-bit comparison descriptor (four 64-bit numbers).

    octaves: how often the raster is also searched at half its size.  A point's place
    is in the raster's own pixels, and its size, the width of what its descriptor
    sees, doubles with each octave.  Of points of neighbouring octaves that lie within
    a pixel of the smaller raster, the one with the stronger response stays, the finer
    of equals.
    """
    in_range("octaves", octaves, 1)
    found, level = None, pixels
    for octave in range(octaves):
        if octave:
            level = checkpointed(halved(level))
        scale = 2**octave
        one = _keypoints(level, max_points).withColumns({"octave": F.lit(octave), **{c: (F.col(c) * scale + (scale - 1) // 2).cast("int") for c in ("row", "col")}, "size": F.lit(float((2 * PATCH + 1) * scale))})
        found = one if found is None else found.unionByName(one)
    names = ["raster_id", "row", "col", "size", "response", "angle", "descriptor"]
    if octaves == 1:
        return found.select(*names)
    found = checkpointed(found.withColumn("id", F.monotonically_increasing_id()))
    # a point and one of the octave above it meet in cells as wide as a pixel of that octave
    cell = lambda c, o, d: F.floor((F.col(c)) / F.pow(F.lit(2.0), F.lit(o) if isinstance(o, int) else o)) + d
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("d")
    up = found.select("raster_id", (F.col("octave") + 1).alias("octave"), "id", "response", "row", "col", near)
    up = up.select("raster_id", "octave", F.col("id").alias("fine"), F.col("response").alias("fine_response"), F.col("row").alias("_r"), F.col("col").alias("_c"), cell("row", F.col("octave"), F.col("d.i")).alias("y"), cell("col", F.col("octave"), F.col("d.j")).alias("x"))
    coarse = found.select("raster_id", "octave", "id", "response", "row", "col", cell("row", F.col("octave"), 0).alias("y"), cell("col", F.col("octave"), 0).alias("x"))
    width = F.pow(F.lit(2.0), F.col("octave"))
    pairs = up.join(coarse, ["raster_id", "octave", "y", "x"]).where((F.abs(F.col("_r") - F.col("row")) < width) & (F.abs(F.col("_c") - F.col("col")) < width))
    beaten = pairs.select(F.when(F.col("response") > F.col("fine_response"), F.col("fine")).otherwise(F.col("id")).alias("id")).distinct()
    return found.join(beaten, "id", "left_anti").select(*names)


def _keypoints(pixels: DataFrame, max_points: int) -> DataFrame:
    """``(raster_id, row, col, response, angle, descriptor)`` of one octave.

    The patch's centroid gives the angle; comparison places turn with it.  Points whose
    patch leaves the raster have no descriptor and are left out.
    """
    best = corners(pixels, "harris", max_points, 0.01, 3)
    halo = PATCH * 2
    smooth = gaussian_weights(5, 1.5)
    sent = tiles(stretched(pixels), halo).select("raster_id", "row", "col", "value", "ty", "tx", F.lit(None).cast("double").alias("response"))
    at = best.select("raster_id", "row", "col", F.lit(0.0).alias("value"), F.floor(F.col("row") / 256).cast("int").alias("ty"), F.floor(F.col("col") / 256).cast("int").alias("tx"), "response")

    def describe(pdf: pd.DataFrame) -> pd.DataFrame:
        pts, px = pdf[pdf["response"].notna()], pdf[pdf["response"].isna()]
        out = []
        if len(pts) and len(px):
            y0, x0 = px["row"].min(), px["col"].min()
            grid = np.full((px["row"].max() - y0 + 1, px["col"].max() - x0 + 1), np.nan)
            grid[px["row"] - y0, px["col"] - x0] = px["value"]
            soft = np.pad(separable(grid, smooth, smooth), 2, constant_values=np.nan)
            yy, xx = np.mgrid[-PATCH : PATCH + 1, -PATCH : PATCH + 1]
            for r, c, resp in zip(pts["row"] - y0, pts["col"] - x0, pts["response"], strict=True):
                patch = soft[max(r - halo, 0) : r + halo + 1, max(c - halo, 0) : c + halo + 1]
                if patch.shape != (2 * halo + 1, 2 * halo + 1) or np.isnan(patch).any():
                    continue
                core = patch[halo - PATCH : halo + PATCH + 1, halo - PATCH : halo + PATCH + 1]
                angle = math.atan2((core * yy).sum(), (core * xx).sum())
                co, si = math.cos(angle), math.sin(angle)
                turn = lambda x, y: (np.rint(y * co + x * si).astype(int) + halo, np.rint(x * co - y * si).astype(int) + halo)  # noqa: E731, B023
                bits = patch[turn(_PAIRS[:, 0], _PAIRS[:, 1])] < patch[turn(_PAIRS[:, 2], _PAIRS[:, 3])]
                out.append((int(pdf["raster_id"].iat[0]), int(r + y0), int(c + x0), float(resp), angle, np.packbits(bits).view(np.int64).tolist()))
        return pd.DataFrame(out, columns=["raster_id", "row", "col", "response", "angle", "descriptor"])

    return sent.unionByName(at).groupBy("raster_id", "ty", "tx").applyInPandas(describe, "raster_id long, row int, col int, response double, angle double, descriptor array<long>")


MODELS = {"translation": 1, "similarity": 2, "affine": 3, "projective": 4}


def solve(model: str, src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """The 3 x 3 matrix of a model that takes src points (n x 2) to dst, by least squares; None if they don't fix it."""
    x, y, u, v = src[:, 0], src[:, 1], dst[:, 0], dst[:, 1]
    z, o = np.zeros_like(x), np.ones_like(x)
    if model == "translation":
        return np.array([[1, 0, (u - x).mean()], [0, 1, (v - y).mean()], [0, 0, 1]])
    if model == "similarity":
        rows, want = np.concatenate([np.stack([x, -y, o, z], 1), np.stack([y, x, z, o], 1)]), np.concatenate([u, v])
    elif model == "affine":
        rows, want = np.concatenate([np.stack([x, y, o, z, z, z], 1), np.stack([z, z, z, x, y, o], 1)]), np.concatenate([u, v])
    else:
        rows = np.concatenate([np.stack([x, y, o, z, z, z, -u * x, -u * y], 1), np.stack([z, z, z, x, y, o, -v * x, -v * y], 1)])
        want = np.concatenate([u, v])
    p, _, rank, _ = np.linalg.lstsq(rows, want, rcond=None)
    if rank < rows.shape[1]:
        return None
    if model == "similarity":
        return np.array([[p[0], -p[1], p[2]], [p[1], p[0], p[3]], [0, 0, 1]])
    return np.array([[p[0], p[1], p[2]], [p[3], p[4], p[5]], [0, 0, 1]]) if model == "affine" else np.append(p, 1).reshape(3, 3)


def refit(inliers: DataFrame, model: str) -> np.ndarray | None:
    """The least-squares matrix of all ``(x1, y1, x2, y2)`` rows; None if they don't fix it.

    Only sums reach the driver: first means and spreads, by which the places are
    scaled, then the normal equations of the model's 2 to 8 parameters.
    """
    names = ("x1", "y1", "x2", "y2")
    size = inliers.agg(*[f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.avg, F.stddev_pop)], F.count("*").alias("n")).first()
    if not size["n"]:
        return None
    mean, spread = [size[f"avg_{n}"] for n in names], [max(size[f"stddev_pop_{a}"], size[f"stddev_pop_{b}"]) or 1.0 for a, b in (("x1", "y1"), ("x2", "y2"))]
    if model == "translation":
        return np.array([[1, 0, mean[2] - mean[0]], [0, 1, mean[3] - mean[1]], [0, 0, 1.0]])
    x, y, u, v = ((F.col(n) - mean[k]) / spread[k // 2] for k, n in enumerate(names))
    zero, one = F.lit(0.0), F.lit(1.0)
    rows = {
        "similarity": (([x, -y, one, zero], u), ([y, x, zero, one], v)),
        "affine": (([x, y, one, zero, zero, zero], u), ([zero, zero, zero, x, y, one], v)),
        "projective": (([x, y, one, zero, zero, zero, -u * x, -u * y], u), ([zero, zero, zero, x, y, one, -v * x, -v * y], v)),
    }[model]
    n = len(rows[0][0])
    sums = inliers.agg(*[F.sum(sum((r[i] * r[j] for r, _ in rows), zero)).alias(f"h{i}_{j}") for i in range(n) for j in range(i, n)], *[F.sum(sum((r[i] * w for r, w in rows), zero)).alias(f"g{i}") for i in range(n)]).first()
    h = np.array([[sums[f"h{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
    if np.linalg.matrix_rank(h, hermitian=True) < n:
        return None
    p = np.linalg.solve(h, np.array([sums[f"g{i}"] for i in range(n)]))
    m = np.array([[p[0], -p[1], p[2]], [p[1], p[0], p[3]], [0, 0, 1]]) if model == "similarity" else np.append(p, [0, 0, 1][n - 9 :] if n < 8 else [1]).reshape(3, 3)
    before = np.array([[1 / spread[0], 0, -mean[0] / spread[0]], [0, 1 / spread[0], -mean[1] / spread[0]], [0, 0, 1]])
    after = np.array([[spread[1], 0, mean[2]], [0, spread[1], mean[3]], [0, 0, 1]])
    m = after @ m @ before
    return m / m[2, 2]


def fit_transform(matches: DataFrame, model: str = "affine", trials: int = 256, tolerance: float = 3.0, sample: int = 4096, seed: int = 1) -> np.ndarray:
    """The matrix that takes ``(x1, y1)`` to ``(x2, y2)`` for most matches (RANSAC).

    Hypotheses come from seeded draws of a bounded sample of matches (those with the
    smallest hashes).  All matches then vote in one aggregate, a count for each
    hypothesis, and the winner is refitted to all its inliers (:func:`refit`).
    """
    one_of("model", model, MODELS)
    need = MODELS[model]
    drawn = matches.select("x1", "y1", "x2", "y2").orderBy(F.xxhash64("x1", "y1", "x2", "y2")).limit(sample).toPandas().to_numpy(float)
    if len(drawn) < max(4, need):
        raise ValueError(f"registration needs 4 matches, there are {len(drawn)}")
    rng = np.random.default_rng(seed)
    found = []
    for _ in range(trials):
        rows = drawn[rng.choice(len(drawn), need, replace=False)]
        m = solve(model, rows[:, :2], rows[:, 2:])
        if m is not None and np.isfinite(m).all():
            found.append(m)
    if not found:
        raise ValueError("no sample of matches fixes the model")
    table = np.array(found)
    limit = tolerance * tolerance

    def inside(m: np.ndarray) -> Column:
        z = float(m[2, 0]) * F.col("x1") + float(m[2, 1]) * F.col("y1") + float(m[2, 2])
        dx = (float(m[0, 0]) * F.col("x1") + float(m[0, 1]) * F.col("y1") + float(m[0, 2])) / z - F.col("x2")
        dy = (float(m[1, 0]) * F.col("x1") + float(m[1, 1]) * F.col("y1") + float(m[1, 2])) / z - F.col("y2")
        return dx * dx + dy * dy <= limit

    def vote(batches):
        for pdf in batches:
            p = np.stack([pdf["x1"], pdf["y1"], np.ones(len(pdf))])
            q = table @ p
            hit = (q[:, 0] / q[:, 2] - pdf["x2"].to_numpy()) ** 2 + (q[:, 1] / q[:, 2] - pdf["y2"].to_numpy()) ** 2 <= limit
            yield pd.DataFrame({"k": np.arange(len(table)), "n": hit.sum(1)})

    votes = matches.select("x1", "y1", "x2", "y2").mapInPandas(vote, "k int, n long").groupBy("k").agg(F.sum("n").alias("n"))
    best = found[votes.orderBy(F.col("n").desc(), "k").first()["k"]]
    refined = refit(matches.where(inside(best)), model)
    return best if refined is None else refined


def match_keypoints(a: DataFrame, b: DataFrame, ratio: float = 0.75) -> DataFrame:
    """``(idx1, idx2, distance, x1, y1, x2, y2)`` of keypoint tables by Hamming distance and Lowe's test.

    Equal descriptors are one in the search, so a picture that is there several times
    does not fail the test by its own copies: the second nearest is another descriptor.
    Of the points that share a descriptor, each of ``a`` meets the one of ``b``; or, if
    both sides have as many, the k-th from above and left meets the k-th.  Other numbers
    leave open which belong together, and the points go.
    """
    number = lambda t: t.select(F.xxhash64("raster_id", "row", "col").alias("id"), F.col("descriptor").alias("vec"), F.col("col").alias("x"), F.col("row").alias("y"))
    p, q = checkpointed(number(a)), checkpointed(number(b))
    kinds = lambda t: checkpointed(t.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    u, v = kinds(p), kinds(q)
    found = ratio_matches(two_nearest(u.select("id", "vec"), v.select("id", "vec"), "hamming"), ratio).withColumnsRenamed({"idx1": "kind1", "idx2": "kind2"})

    def named(points: DataFrame, own: DataFrame, k: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("kind").orderBy("y", "x", "id"))
        told = points.join(own.select("vec", F.col("id").alias("kind"), "n"), "vec").withColumn("place", place)
        return told.select(*[F.col(c).alias(f"{to}{k}") for c, to in (("kind", "kind"), ("n", "n"), ("place", "place"), ("id", "idx"), ("x", "x"), ("y", "y"))])

    both = found.join(named(p, u, 1), "kind1").join(named(q, v, 2), "kind2").where("n2 = 1 or (n1 = n2 and place1 = place2)")
    return both.select("idx1", "idx2", "distance", "x1", "y1", "x2", "y2")


def registration(reference: DataFrame, moving: DataFrame, model: str = "affine") -> np.ndarray:
    """The matrix from places of the reference to those of ``moving``, by their keypoints."""
    return fit_transform(match_keypoints(keypoints(reference), keypoints(moving)), model)


def register(reference: DataFrame, moving: DataFrame, height: int, width: int, model: str = "affine", method: str = "bilinear") -> tuple[DataFrame, np.ndarray]:
    """(``moving`` on the reference's grid, the matrix from reference to moving places)."""
    m = registration(reference, moving, model)
    return warp(moving, height, width, tuple(float(x) for x in m.ravel()), method), m


def ecc_register(reference: DataFrame, moving: DataFrame, height: int, width: int, motion: str = "translation", iterations: int = 200, epsilon: float = 1e-6) -> tuple[DataFrame, np.ndarray]:
    """(``moving`` aligned by intensity, the matrix from reference to moving places): Gauss-Newton on the correlation of the two.

    Each holds one raster and band.  They are brought together once, as tiles that carry
    what the matrix shows of ``moving`` and 16 pixels around; an iteration reads the tiles
    and returns the sums of the normal equations of the motion's 2 to 8 parameters, no
    row moves.  Tiles are only made anew if a place leaves what its tile carries.
    """
    n = {"translation": 2, "euclidean": 3, "affine": 6, "homography": 8}[one_of("motion", motion, ("translation", "euclidean", "affine", "homography"))]
    spark = reference.sparkSession
    batch = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")
    if not batch.isdigit() or not 0 < int(batch) <= 8 << 20:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))  # a row is a tile
    ref, moving = (checkpointed(t.select("raster_id", "band", "row", "col", "value")) for t in (reference, moving))
    names = moving.select("raster_id", "band").distinct().limit(2).collect()
    if len(names) > 1:
        raise ValueError("an image has several rasters or bands")
    far = moving.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.avg("value").alias("mean")).first()
    centre = [ref.agg(F.avg("value")).first()[0], far["mean"]]
    if None in centre:
        raise ValueError("an image is flat where they overlap")
    make = lambda m: checkpointed(_ecc_tiles(ref, moving, height, width, m, far))
    ask = lambda held, m: _ecc_sums(held, height, width, m, n, far, centre)
    m, last = np.eye(3), -np.inf
    held = make(m)
    for _ in range(iterations):
        sums = ask(held, m)
        if sums is None:
            held = make(m)
            sums = ask(held, m)
        count, (ti, t), (tt, ii, it), jj, (j1, jt, ji) = sums
        t, i = (t / count, ti / count) if count else (0.0, 0.0)
        st, si = (math.sqrt(max(0.0, v / count - mean * mean)) if count else 0.0 for v, mean in ((tt, t), (ii, i)))
        if min(si / (1 + abs(centre[1])), st / (1 + abs(centre[0]))) < 1e-10:
            raise ValueError("an image is flat where they overlap")
        rho = (it / count - i * t) / (si * st)
        if abs(rho - last) < epsilon:
            break
        last = rho
        g = ((jt - t * j1) / st - (ji - i * j1) / si) / si
        p = np.linalg.lstsq(jj / (si * si), g, rcond=None)[0]
        if n == 2:
            step = np.array([[1, 0, p[0]], [0, 1, p[1]], [0, 0, 1]])
        elif n == 3:
            c, s = math.cos(p[0]), math.sin(p[0])
            step = np.array([[c, -s, p[1]], [s, c, p[2]], [0, 0, 1]])
        else:
            step = np.array([[1 + p[0], p[1], p[2]], [p[3], 1 + p[4], p[5]], [p[6] if n == 8 else 0, p[7] if n == 8 else 0, 1]])
        m = m @ step
        m = m / m[2, 2]
    else:
        if ask(held, m) is None:
            held = make(m)
    raster, band = (int(v) for v in names[0])

    def show(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                grid, _ = _ecc_grids(r)
                out = seen_in(grid, r.r0, r.c0, np.arange(r.ty, min(r.ty + TILE, height)), np.arange(r.tx, min(r.tx + TILE, width)), tuple(m.ravel()), "bilinear")
                y, x = np.nonzero(~np.isnan(out))
                yield pd.DataFrame({"raster_id": raster, "band": band, "row": y + r.ty, "col": x + r.tx, "value": out[y, x]})

    return held.mapInPandas(show, "raster_id long, band int, row int, col int, value double"), m


def _ecc_tiles(ref: DataFrame, moving: DataFrame, height: int, width: int, m: np.ndarray, far, margin: int = 16) -> DataFrame:
    """``(ty, tx, r0, c0, h, w, moving, reference)``: for each tile of the reference, named by its first pixel, the values of the h x w pixels of ``moving`` from (r0, c0) on that ``m`` shows there or nearly, and its own."""
    boxes = tile_boxes(ref.sparkSession, height, width, tuple(float(v) for v in m.ravel()), margin, 1)
    # what is over the horizon may be anywhere; elsewhere the box ends with the image
    cut = {c: (F.greatest if c.endswith("0") else F.least)(F.coalesce(c, F.lit(far[c])), F.lit(far[c])).cast("int") for c in ("r0", "r1", "c0", "c1")}
    boxes = checkpointed(boxes.withColumns(cut))
    place = lambda r, c, v, side: [F.col(r).alias("row"), F.col(c).alias("col"), v.cast("double").alias("value"), F.lit(side).alias("side")]
    own = ref.where((F.col("row") < height) & (F.col("col") < width) & (F.col("row") >= 0) & (F.col("col") >= 0)).withColumns({"ty": F.floor(F.col("row") / TILE).cast("int"), "tx": F.floor(F.col("col") / TILE).cast("int")})
    parts = [dealt_to_tiles(moving, boxes).select("ty", "tx", *place("row", "col", F.col("value"), 0)), own.select("ty", "tx", *place("row", "col", F.col("value"), 1))]
    parts += [boxes.select("ty", "tx", *place(f"r{k}", f"c{k}", F.lit(None), 2 + k)) for k in (0, 1)]

    def hold(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(pdf["ty"].iat[0]) * TILE, int(pdf["tx"].iat[0]) * TILE
        side = [pdf[pdf["side"] == k] for k in range(4)]
        (r0, c0), (r1, c1) = ((int(side[k]["row"].iat[0]), int(side[k]["col"].iat[0])) for k in (2, 3))
        grid, known = np.full((max(0, r1 - r0 + 1), max(0, c1 - c0 + 1)), np.nan), np.full((min(TILE, height - ty), min(TILE, width - tx)), np.nan)
        for g, t, y, x in ((grid, side[0], r0, c0), (known, side[1], ty, tx)):
            g[t["row"].to_numpy() - y, t["col"].to_numpy() - x] = t["value"].to_numpy()
        return pd.DataFrame({"ty": [ty], "tx": [tx], "r0": [r0], "c0": [c0], "h": [grid.shape[0]], "w": [grid.shape[1]], "moving": [grid.tobytes()], "reference": [known.tobytes()]})

    return reduce(DataFrame.unionByName, parts).groupBy("ty", "tx").applyInPandas(hold, "ty int, tx int, r0 int, c0 int, h int, w int, moving binary, reference binary")


def _ecc_grids(r) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(r.moving).reshape(r.h, r.w), np.frombuffer(r.reference)


def _ecc_sums(held: DataFrame, height: int, width: int, m: np.ndarray, n: int, far, centre: list[float]):
    """(count, (sum of i, of t), (of tt, ii, it), the n x n sums of products of the slopes, (theirs, by t, by i)) over all pixels, i and t being the two images less ``centre``; None if a place leaves what its tile carries."""
    flat = tuple(float(v) for v in m.ravel())
    low, high = (far["r0"], far["c0"]), (far["r1"], far["c1"])

    def run(batches):
        for pdf in batches:
            total = np.zeros(7 + n * n + 3 * n)
            for r in pdf.itertuples():
                grid, known = _ecc_grids(r)
                rows, cols = np.arange(r.ty, min(r.ty + TILE + 1, height)), np.arange(r.tx, min(r.tx + TILE + 1, width))
                total[0] += not _carried(grid.shape, r.r0, r.c0, rows, cols, flat, low, high)
                seen = seen_in(grid, r.r0, r.c0, rows, cols, flat, "bilinear") - centre[1]
                known = known.reshape(min(TILE, height - r.ty), min(TILE, width - r.tx))[: len(rows) - 1, : len(cols) - 1] - centre[0]
                i = seen[:-1, :-1]
                gx, gy = seen[:-1, 1:] - i, seen[1:, :-1] - i
                on = ~(np.isnan(gx) | np.isnan(gy) | np.isnan(known))
                y, x = np.nonzero(on)
                i, t, gx, gy, x, y = i[on], known[on], gx[on], gy[on], x + r.tx + 0.5, y + r.ty + 0.5
                j = [gx, gy] if n == 2 else [gy * x - gx * y, gx, gy] if n == 3 else [gx * x, gx * y, gx, gy * x, gy * y, gy]
                if n == 8:
                    j += [-(gx * x + gy * y) * x, -(gx * x + gy * y) * y]
                j = np.stack(j)
                total[1:] += np.concatenate([[len(i), i.sum(), t.sum(), t @ t, i @ i, i @ t], (j @ j.T).ravel(), j.sum(1), j @ t, j @ i])
            yield pd.DataFrame({"k": np.arange(len(total)), "v": total})

    told = {r["k"]: r["v"] for r in held.mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}  # at most 95 rows
    v = np.array([told.get(k, 0.0) for k in range(7 + n * n + 3 * n)])
    if v[0]:
        return None
    return v[1], v[2:4], v[4:7], v[7 : 7 + n * n].reshape(n, n), v[7 + n * n :].reshape(3, n)


def _carried(shape: tuple[int, int], top: int, left: int, rows: np.ndarray, cols: np.ndarray, m: tuple[float, ...], low: tuple[int, int], high: tuple[int, int]) -> bool:
    """Whether a grid from (top, left) on has every pixel of the image from ``low`` to ``high`` that ``m`` shows at the target pixels."""
    with np.errstate(all="ignore"):
        sx, sy = back_to_source(m, cols[None, :] + 0.5, rows[:, None] + 0.5)
    for r in (np.floor(sy - 0.5), np.floor(sy - 0.5) + 1):
        for c in (np.floor(sx - 0.5), np.floor(sx - 0.5) + 1):
            there = (r >= low[0]) & (r <= high[0]) & (c >= low[1]) & (c <= high[1])
            if (there & ((r < top) | (r >= top + shape[0]) | (c < left) | (c >= left + shape[1]))).any():
                return False
    return True


def match_graph(images: list[DataFrame], model: str = "translation", tolerance: float = 3.0) -> list[tuple[float, int, int, np.ndarray]]:
    """(confidence, i, j, matrix from places of i to those of j) of each pair of images that match: inliers / (8 + 0.3 matches), as panorama work has it, the surest first.

    Keypoints are found once for each image; a pair without matches enough for the
    model is left out.
    """
    points = [checkpointed(keypoints(image)) for image in images]
    pairs = []
    for i in range(len(images)):
        for j in range(i + 1, len(images)):
            matches = checkpointed(match_keypoints(points[i], points[j]))
            try:
                m = fit_transform(matches, model, tolerance=tolerance)
            except ValueError:
                continue  # too few matches, or none that fix the model
            n = matches.agg(F.count("*").alias("n"), F.count_if(_moved_within(m, tolerance)).alias("inside")).first()
            pairs.append((n["inside"] / (8 + 0.3 * n["n"]), i, j, m))
    return sorted(pairs, key=lambda p: (-p[0], p[1], p[2]))


def _moved_within(m: np.ndarray, tolerance: float) -> Column:
    """Whether a match lies within ``tolerance`` of where a matrix takes it."""
    row = lambda k: float(m[k, 0]) * F.col("x1") + float(m[k, 1]) * F.col("y1") + float(m[k, 2])
    dx, dy = row(0) / row(2) - F.col("x2"), row(1) / row(2) - F.col("y2")
    return dx * dx + dy * dy <= tolerance * tolerance


def spanning_tree(n: int, pairs: list[tuple[float, int, int, np.ndarray]], least: float) -> dict[int, np.ndarray]:
    """The matrix from the first image's places to each image's, over the surest pairs that join the images: a maximum spanning tree of the largest group that pairs of ``least`` confidence or more hold together."""
    group, kept = list(range(n)), []
    for sure, i, j, m in pairs:
        if sure >= least and group[i] != group[j]:
            kept.append((i, j, m))
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
    largest = max(set(group), key=lambda g: (group.count(g), -group.index(g)))
    root = group.index(largest)
    placed, open_ = {root: np.eye(3)}, [root]
    while open_:
        at = open_.pop()
        for i, j, m in kept:
            for a, b, way in ((i, j, m), (j, i, np.linalg.inv(m))):
                if a == at and b not in placed:
                    placed[b] = way @ placed[at]
                    open_.append(b)
    return placed


def stitch(images: list[DataFrame], model: str = "translation", method: str = "nearest", stitch_confidence: float = 0.5) -> DataFrame:
    """``(band, row, col, value)``: images in any order on one canvas; a later one overwrites.

    All pairs are matched (:func:`match_graph`), and the surest place the images, over a
    maximum spanning tree.  Images that no pair of ``stitch_confidence`` or more joins
    with the largest group are left out; if fewer than two are left that is an error.
    The canvas holds every image whole: its corners are taken to the places of the
    first of the group, and each image is warped to the box they span.  Rows and
    columns count from the canvas's upper left corner.
    """
    in_range("images", len(images), 2)
    in_range("stitch_confidence", stitch_confidence, 0)
    from geoloom.operators.mosaic import mosaic

    tree = spanning_tree(len(images), match_graph(images, model), stitch_confidence)
    if len(tree) < 2:
        raise ValueError("no two images match well enough to be stitched")
    placed = []
    for k, to_image in sorted(tree.items()):
        box = images[k].agg(F.min("col"), F.min("row"), F.max("col") + 1, F.max("row") + 1).first()
        corners_ = np.linalg.inv(to_image) @ np.array([[box[a], box[b], 1] for a in (0, 2) for b in (1, 3)], float).T
        at = np.round(corners_[:2] / corners_[2], 6)
        (x0, y0), (x1, y1) = np.floor(at.min(1)), np.ceil(at.max(1))
        shift = np.array([[1, 0, x0], [0, 1, y0], [0, 0, 1]])
        seen = warp(images[k], int(y1 - y0), int(x1 - x0), tuple(float(v) for v in (to_image @ shift).ravel()), method)
        placed.append((seen, (float(x0), 1.0, 0.0, -float(y0), 0.0, -1.0)))
    return mosaic(placed)
