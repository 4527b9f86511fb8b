"""Exact spatial joins: which shapes meet, hold or lie within which, by coverings of quadtree cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import arrow_geometry as A
from geoloom.functions import geometry as G
from geoloom.functions.covering import CellEdges, box_of, cover, inside_rows, meets_box, rows_meet, rows_within
from geoloom.functions.params import extent, in_range, one_of
from geoloom.operators.graph import alike, checkpointed

CELLS = "level int, cx long, cy long, inside boolean, area boolean, corner boolean, edges array<double>, n long"


def shape_edges(kind: str, parts: A.Parts) -> np.ndarray:
    """All edges of a shape, n x 4: rings of areas are closed, a point is an edge of no length."""
    out = []
    for r in (r for p in parts for r in p if len(r)):
        if "Polygon" in kind and not (r[0] == r[-1]).all():
            r = np.concatenate([r, r[:1]])
        out.append(np.hstack([r[:-1], r[1:]]) if len(r) > 1 and "Point" not in kind else np.hstack([r, r]))
    e = np.concatenate(out) if out else np.empty((0, 4))
    return e[(e[:, :2] != e[:, 2:]).any(axis=1)] if "Polygon" in kind else e


def covering(features: DataFrame, fid: str, cell: float) -> DataFrame:
    """``(fid, level, cx, cy, inside, area, corner, edges, n)``: the cells of each shape, n being their number.

    Cells inside an area are as large as they can be (side ``cell * 2 ** level``) and
    need no geometry; those that a border or a line passes have side ``cell`` and hold
    the edges that pass.  Null and empty geometries have none.
    """
    in_range("cell", cell, 0, open_low=True)
    own = features.where(~G.is_empty(F.col("geom"))).select(F.col(fid).alias("fid"), "geom")
    names = ["fid", *[x.split()[0] for x in CELLS.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = b.column("geom").flatten()[0].to_pylist()
            for row, (kind, parts) in enumerate(zip(kinds, A.parts_of(b.column("geom")), strict=True)):
                edges = shape_edges(kind, parts)
                if not len(edges):
                    continue
                level, cx, cy, inside, corner, first, held = cover(edges, "Polygon" in kind, cell)
                lists = pa.ListArray.from_arrays(pa.array((4 * first).astype(np.int32)), pa.array(held.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("fid").take(pa.array(np.full(len(level), row))), pa.array(level.astype(np.int32)), pa.array(cx), pa.array(cy), pa.array(inside), pa.array(np.full(len(level), "Polygon" in kind)), pa.array(corner), lists, pa.array(np.full(len(level), len(level)))], names)

    return own.mapInArrow(run, f"fid {dict(own.dtypes)['fid']}, {CELLS}")


def _cells(table: pa.RecordBatch, side: str, cell: float) -> CellEdges:
    lists = table.column(f"{side}_edges")
    at = lists.offsets.to_numpy().astype(np.int64)
    edges = lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].reshape(-1, 4)
    x, y, size = box_of(np.zeros(len(lists)), table.column("cx").to_numpy(), table.column("cy").to_numpy(), cell)
    area, corner = (table.column(f"{side}_{c}").to_numpy(zero_copy_only=False) for c in ("area", "corner"))
    return CellEdges((at - at[0]) // 4, edges, area, corner, x, y, size)


def _named(cells: DataFrame, p: str) -> DataFrame:
    return cells.select(*[F.col(c).alias(f"{p}_{c}") for c in ("fid", "level", "inside", "area", "corner", "edges", "n")], "cx", "cy")


def _met(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of cells of which b's holds a's or is the same: a is dealt to the cells of all levels of b that are above it."""
    levels = sorted(r[0] for r in b.select("level").distinct().collect())  # a row for each level, under 50
    if not levels:
        return _named(a, "a").join(_named(b, "b"), ["cx", "cy"]).limit(0)
    above = F.explode(F.filter(F.array(*[F.lit(k) for k in levels]), lambda k: k >= F.col("level"))).alias("key")
    up = lambda c: F.expr(f"shiftright(`{c}`, key - level)")
    left = a.select("*", above).withColumns({"kx": up("cx"), "ky": up("cy")})
    left = left.select(*[F.col(c).alias(f"a_{c}") for c in ("fid", "level", "inside", "area", "corner", "edges", "n")], "cx", "cy", "key", "kx", "ky")
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in ("fid", "level", "inside", "area", "corner", "edges")], F.col("level").alias("key"), F.col("cx").alias("kx"), F.col("cy").alias("ky"))
    return left.join(right, ["key", "kx", "ky"]).drop("key", "kx", "ky")


def _told(pairs: DataFrame, cell: float, work, out: list[str]) -> DataFrame:
    """``(a_fid, b_fid, out..)``: what ``work`` says of the edges in each cell that both shapes' borders pass."""
    types = dict(pairs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.diff(b.column("a_edges").offsets.to_numpy()).astype(np.int64) * np.diff(b.column("b_edges").offsets.to_numpy())
            upto, k = np.concatenate([[0], np.cumsum(size)]), 0
            while k < b.num_rows:  # slices of a bounded number of pairs of edges
                j = max(k + 1, int(np.searchsorted(upto, upto[k] + (1 << 22), "right")) - 1)
                part = b.slice(k, j - k)
                part = pa.RecordBatch.from_arrays([c.take(pa.array(np.arange(len(c)))) for c in part.columns], part.schema.names)
                found = work(_cells(part, "a", cell), _cells(part, "b", cell))
                yield pa.RecordBatch.from_arrays([part.column("a_fid"), part.column("b_fid"), *map(pa.array, found)], ["a_fid", "b_fid", *out])
                k = j

    own = pairs.select("a_fid", "b_fid", "cx", "cy", "a_area", "b_area", "a_corner", "b_corner", "a_edges", "b_edges")
    return own.mapInArrow(run, ", ".join([f"a_fid {types['a_fid']}", f"b_fid {types['b_fid']}", *(f"{c} boolean" for c in out)]))


def spatial_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, predicate: str = "intersects", cell: float = 1.0) -> DataFrame:
    """``(left_id, right_id)`` of all pairs of shapes for which the predicate holds exactly.

    ``intersects``: they share a point, borders count.  ``contains``: no point of the
    right shape is outside the left one, and some lie off its border.  ``within``: the
    other way round.  Points, lines and areas with holes may stand on either side.

    Shapes are covered by quadtree cells and joined on them.  A cell inside an area
    settles every pair in it without geometry; edges are compared only in cells of side
    ``cell`` that both borders pass, so a large shape is spread over its cells and no
    task holds all that meet it.  Equal shapes are covered and compared once, and their
    pairs given to every row that has them.  Null and empty geometries meet nothing; ids
    should tell rows apart.
    """
    one_of("predicate", predicate, ("intersects", "contains", "within"))
    if predicate == "contains":
        return spatial_join(right, left, right_id, left_id, "within", cell).select(left_id, right_id)
    (one, mine), (other, others) = alike(left, left_id), alike(right, right_id)
    a, b = (checkpointed(covering(_dealt(t, fid), fid, cell)) for t, fid in ((one, left_id), (other, right_id)))
    pairs = (_meeting if predicate == "intersects" else _within)(a, b, cell)
    for side, fid, rows in (("a_fid", left_id, mine), ("b_fid", right_id, others)):
        if rows is not None:
            named = rows.select(F.col("_alike").alias(side), F.col(fid).alias("_own"))
            pairs = pairs.join(named, side).drop(side).withColumnRenamed("_own", side)
    return pairs.select(F.col("a_fid").alias(left_id), F.col("b_fid").alias(right_id))


def _dealt(shapes: DataFrame, fid: str, most: int = 500) -> DataFrame:
    """Stored shapes in tasks of about ``most``, at most 2,000: a covering takes milliseconds, and small rows would meet in few tasks."""
    return shapes.repartition(min(2000, max(1, shapes.count() // most)), fid)


def _meeting(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """``(a_fid, b_fid)`` of shapes that share a point, from two coverings."""
    ids = ["a_fid", "b_fid"]
    up = _met(a, b)
    sure = up.where("a_inside or b_inside").select(*ids)
    down = _met(b, a).where("a_level < b_level").select(F.col("b_fid").alias("a_fid"), F.col("a_fid").alias("b_fid"))
    sure = checkpointed(sure.unionByName(down).distinct())
    open_ = up.where("not a_inside and not b_inside").join(sure, ids, "left_anti")
    return sure.unionByName(_told(open_, cell, lambda p, q: [rows_meet(p, q)], ["met"]).where("met").select(*ids).distinct())


def _within(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """``(a_fid, b_fid)``: a within b, if each cell of a is in a cell inside b or shares a border cell in which nothing of a is outside."""
    up = _met(a, b).where("b_inside or not a_inside")
    easy = up.where("b_inside").groupBy("a_fid", "b_fid").agg(F.count("*").alias("fine"), F.lit(0).cast("long").alias("bad"), F.lit(True).alias("strict"), F.max("a_n").alias("n"))
    hard = up.where("not b_inside")
    n = a.select(F.col("fid").alias("a_fid"), "n").distinct()
    told = _told(hard, cell, rows_within, ["ok", "strict"]).groupBy("a_fid", "b_fid").agg(F.count_if("ok").alias("fine"), F.count_if(~F.col("ok")).alias("bad"), F.max("strict").alias("strict"))
    told = told.where("bad = 0").join(n, "a_fid")
    both = easy.select("a_fid", "b_fid", "fine", "strict", "n").unionByName(told.select("a_fid", "b_fid", "fine", "strict", "n"))
    return both.groupBy("a_fid", "b_fid").agg(F.sum("fine").alias("fine"), F.max("strict").alias("strict"), F.max("n").alias("n")).where("fine = n and strict").select("a_fid", "b_fid")


def meets_extent(features: DataFrame, box) -> DataFrame:
    """Features whose shape itself, not only its box, shares a point with an extent.

    Boxes decide first, as column predicates; only shapes whose box sticks out of the
    extent are compared by their edges.
    """
    x0, y0, x1, y1 = extent(box)
    near = features.where((F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0))
    sure = (F.col("xmin") >= x0) & (F.col("xmax") <= x1) & (F.col("ymin") >= y0) & (F.col("ymax") <= y1) | G.is_box()
    names = features.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for kind, parts in zip(b.column("geom").flatten()[0].to_pylist(), A.parts_of(b.column("geom")), strict=True):
                e = shape_edges(kind, parts)
                n = np.ones(len(e))
                hit = meets_box(e, x0 * n, y0 * n, (x1 - x0) * n, (y1 - y0) * n).any()
                keep.append(bool(hit or ("Polygon" in kind and len(e) and inside_rows(np.array([x0]), np.array([y0]), e)[0])))
            yield b.filter(pa.array(keep, pa.bool_()))

    return near.where(sure).unionByName(near.where(~sure).mapInArrow(run, near.schema).select(*names))
