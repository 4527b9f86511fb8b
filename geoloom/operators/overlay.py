"""Area overlays: clip, difference, union, dissolve, buffer, repair.

Rectangles along the axes are overlaid by column expressions.  Only pairs and groups
with another shape go to numpy, a pair or a bounded group in each row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import arrow_geometry as A
from geoloom.functions import geometry as G
from geoloom.functions import polygons as P
from geoloom.functions.covering import cover, cut_at_cells
from geoloom.functions.params import in_range
from geoloom.operators.graph import alike, checkpointed, skew_join
from geoloom.operators.project import require_projected, require_same
from geoloom.operators.rings import CHAIN, chain_rows, rings_of_chains
from geoloom.operators.vector import BOX, near_pairs, overlap_ratio

FAN_IN = 64


def _names(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c not in ("geom", *BOX)]


def rings_of(parts: A.Parts) -> P.Rings:
    """The rings of an area without their closing vertices."""
    return [r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r for p in parts for r in p if len(r)]


def parts_of(rings: P.Rings) -> A.Parts:
    """Parts of closed rings, each shell with its holes."""
    return [[np.concatenate([r, r[:1]]) for r in p] for p in P.nested(rings)]


def _shaped(table: DataFrame, columns: list[str], shapes: list[str], work: Callable[..., P.Rings]) -> DataFrame:
    """``columns`` of each row and the MultiPolygon that ``work`` makes of its geometry columns ``shapes``; rows with nothing left go.

    A column of arrays of geometries is given as a list of areas.
    """
    types = dict(table.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in columns), f"geom {G.TYPE}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = []
            for c in shapes:
                column = b.column(c)
                several = pa.types.is_list(column.type) or pa.types.is_large_list(column.type)
                given.append([[rings_of(p) for p in x] for x in A.lists_of(column)] if several else [rings_of(p) for p in A.parts_of(column)])
            out = [parts_of(work(*row)) for row in zip(*given, strict=True)]
            keep = [k for k, parts in enumerate(out) if parts]
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in columns), A.geometries("MultiPolygon", [out[k] for k in keep])], [*columns, "geom"])

    return table.select(*columns, *[c for c in shapes if c not in columns]).mapInArrow(run, schema)


def normalized(features: DataFrame) -> DataFrame:
    """Features with self-crossing areas rebuilt; empty and null geometries go.  Rectangles need no repair."""
    names = _names(features)
    v = features.where(~G.is_empty(F.col("geom"))).select(*names, "geom")
    box = G.is_box()
    fine = v.where(box).withColumn("geom", G.promoted(F.col("geom")))
    return G.with_box(fine.unionByName(_each_once(v.where(~box), names, lambda t, own: _shaped(t, own, ["geom"], P.repaired))))


def _each_once(features: DataFrame, names: list[str], work: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """``names`` and ``geom`` of what ``work``, given rows and the columns to keep, makes of each shape: equal shapes once, if most rows are copies."""
    numbered = checkpointed(features.select(*names, "geom").withColumn("_row", F.monotonically_increasing_id()))
    shapes, rows = alike(numbered, "_row", stored=True)
    if rows is None:
        return work(numbered.drop("_row"), names)
    made = work(shapes, ["_row"]).select(F.col("_row").alias("_alike"), "geom")
    return numbered.drop("geom").join(rows, "_row").join(made.hint("merge"), "_alike").select(*names, "geom")


def _marked(features: DataFrame, fid: str) -> DataFrame:
    """``(fid, geom, box, box_only)`` of the features that have a geometry."""
    return features.where(~G.is_empty(F.col("geom"))).select(fid, "geom", *BOX, G.is_box().alias("box_only"))


def united(pieces: DataFrame, keys: list[str], fan_in: int = FAN_IN) -> DataFrame:
    """``(keys.., geom)``: the union of each key's areas ``geom`` as a MultiPolygon.

    Keys of up to ``fan_in`` areas are united in one step.  The areas of others are
    dealt to parts of about that many by their hash, and the parts united in rounds,
    so a step never gathers more.  A key of one area, and rectangles that lie apart,
    need no arrangement.
    """
    in_range("fan_in", fan_in, 2)
    pieces = checkpointed(pieces.select(*keys, "geom"))
    done = None
    while True:
        sizes = pieces.groupBy(*keys).agg(F.count("*").alias("_n"))
        crowded = checkpointed(sizes.where(F.col("_n") > fan_in).select(*keys, F.ceil(F.col("_n") / fan_in).cast("int").alias("_m")))
        if not crowded.limit(1).count():
            last = _merged(pieces, keys)
            return last if done is None else done.unionByName(last)
        calm = _merged(pieces.join(crowded, _same(keys, pieces, crowded), "left_anti"), keys)
        done = calm if done is None else done.unionByName(calm)
        named = crowded.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
        dealt = pieces.join(named, _same(keys, pieces, named, [f"_k{i}" for i in range(len(keys))])).select(*keys, "geom", F.pmod(F.xxhash64("geom"), F.col("_m")).alias("_part"))
        pieces = checkpointed(_merged(dealt.dropDuplicates([*keys, "_part", "geom"]), [*keys, "_part"]).select(*keys, "geom"))


def _same(keys: list[str], a: DataFrame, b: DataFrame, named: list[str] | None = None):
    out = F.lit(True)
    for k, n in zip(keys, named or keys, strict=True):
        out = out & a[k].eqNullSafe(b[n])
    return out


def _merged(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """One step of :func:`united`: each key's areas in one row."""
    v = G.with_box(pieces).withColumn("box_only", G.is_box())
    grouped = v.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*BOX, "geom", "box_only"))).alias("_s"))
    apart = "forall(sequence(1, size(_s)), k -> forall(slice(_s, k + 1, size(_s)), o -> o.xmin > element_at(_s, k).xmax OR o.xmax < element_at(_s, k).xmin OR o.ymin > element_at(_s, k).ymax OR o.ymax < element_at(_s, k).ymin))"
    easy = F.expr(f"size(_s) = 1 OR (forall(_s, s -> s.box_only) AND {apart})")
    told = grouped.select(*keys, easy.alias("_easy"), F.expr("_s.geom").alias("_g"))
    plain = told.where("_easy").select(*keys, G.geometry("MultiPolygon", F.expr("flatten(_g.parts)")).alias("geom"))
    return plain.unionByName(_shaped(told.where("not _easy"), keys, ["_g"], lambda g: P.union_all(g)))


def _pieces(own: DataFrame, others: DataFrame, fid: str, oid: str, cell: float) -> DataFrame:
    """``(fid, geom)``: the part of each feature in each overlay shape, a row for each pair that has one."""
    near = checkpointed(near_pairs(own, others, fid, oid, cell, keep=("box_only",)))
    x0, y0, x1, y1 = (f"{'greatest' if c.endswith('min') else 'least'}(a_{c}, b_{c})" for c in BOX)
    boxes = near.where(f"a_box_only AND b_box_only AND {x1} > {x0} AND {y1} > {y0}").select(F.col("a_id").alias(fid), G.box_area(x0, y0, x1, y1).alias("geom"))
    rest = near.where("NOT (a_box_only AND b_box_only)").select(F.col("a_id").alias(fid), F.col("b_id").alias("_oid"))
    rest = skew_join(rest.join(own.select(fid, "geom").hint("merge"), fid), others.select(F.col(oid).alias("_oid"), F.col("geom").alias("_o")), ["_oid"])
    return boxes.unionByName(_shaped(rest, [fid], ["geom", "_o"], P.intersection))


def _overlay(overlay: DataFrame, oid: str, merged_up_to: int = 128) -> DataFrame:
    """Overlay shapes, repaired once and kept; up to ``merged_up_to`` of them, if they aren't all rectangles, are united first and each part of the whole is a shape."""
    shapes = checkpointed(_marked(normalized(overlay), oid))
    told = shapes.limit(merged_up_to + 1).agg(F.count("*").alias("n"), F.min("box_only").alias("boxes")).first()
    if told["boxes"] or not 1 < told["n"] <= merged_up_to:
        return shapes
    whole = united(shapes.select(F.lit(0).alias("_all"), "geom"), ["_all"])
    parts = whole.select(F.posexplode("geom.parts").alias(oid, "_part")).select(oid, G.geometry("Polygon", F.array("_part")).alias("geom"))
    return checkpointed(_marked(G.with_box(parts), oid))


def clip(features: DataFrame, overlay: DataFrame, fid: str, oid: str, cell: float, srid: int | None = None, overlay_srid: int | None = None) -> DataFrame:
    """Features within the merged overlay: attributes stay, geometry is the common part, features off it go, those within one shape of it keep their vertices.

    ``fid`` and ``oid`` number the rows of each table.  Layers of different CRS are refused.
    """
    require_same(srid, overlay_srid)
    common = united(_pieces(_marked(features, fid), _overlay(overlay, oid), fid, oid, cell), [fid])
    return G.with_box(features.select(*_names(features)).join(common.hint("merge"), fid).select(*_names(features), "geom"))


def difference(features: DataFrame, overlay: DataFrame, fid: str, oid: str, cell: float, srid: int | None = None, overlay_srid: int | None = None) -> DataFrame:
    """Features less the overlay: those off it stay unchanged, those within it and null geometries go."""
    require_same(srid, overlay_srid)
    names, own = _names(features), _marked(features, fid)
    taken = united(_pieces(own, _overlay(overlay, oid), fid, oid, cell), [fid]).select(fid, F.col("geom").alias("_cut"))
    both = features.where(~G.is_empty(F.col("geom"))).select(*names, "geom").join(taken.hint("merge"), fid, "left")
    whole = G.is_box() & (G.area(F.col("_cut")) >= G.area(F.col("geom")) * (1 - 1e-12))
    alone = both.where("_cut is null").select(*names, "geom")
    cut = _shaped(both.where(F.col("_cut").isNotNull() & ~whole), names, ["geom", "_cut"], P.difference)
    return G.with_box(alone.unionByName(cut))


def union(features: DataFrame, overlay: DataFrame, fid: str, oid: str, cell: float, keep_attributes: bool = False, srid: int | None = None, overlay_srid: int | None = None) -> DataFrame:
    """``(fid, source, geom)``: each feature united with all overlay shapes whose boxes meet its own (``union``) if it touches any, else itself (``input``).  Equal features are united once."""
    require_same(srid, overlay_srid)
    names = _names(features) if keep_attributes else [fid]
    numbered = checkpointed(features.select(*names, "geom", *BOX).withColumn("_row", F.monotonically_increasing_id()))
    others = _overlay(overlay, oid, 0)
    shapes, rows = alike(numbered, "_row", stored=True)
    if rows is None:
        return G.with_box(_with_overlay(numbered, others, "_row", oid, cell, names))
    made = _with_overlay(G.with_box(shapes), others, "_row", oid, cell, ["_row"]).withColumnRenamed("_row", "_alike")
    given = numbered.select("_row", *names).join(rows, "_row").join(made.hint("merge"), "_alike").select(*names, "source", "geom")
    return G.with_box(given.unionByName(numbered.where("geom is null").select(*names, F.lit("input").alias("source"), "geom")))


def _with_overlay(features: DataFrame, others: DataFrame, fid: str, oid: str, cell: float, names: list[str]) -> DataFrame:
    """``(names.., source, geom)`` of :func:`union`; others: the overlay of :func:`_overlay`."""
    own = _marked(features, fid)
    near = checkpointed(near_pairs(own, others, fid, oid, cell, keep=("box_only",)))
    shapes = near.where("b_box_only").select(F.col("a_id").alias(fid), G.box_area(*[f"b_{c}" for c in BOX]).alias("geom"))
    others_ = skew_join(near.where("not b_box_only").select(F.col("a_id").alias(fid), F.col("b_id").alias("_oid")), others.select(F.col(oid).alias("_oid"), "geom"), ["_oid"]).select(fid, "geom")
    around = united(shapes.unionByName(others_), [fid]).select(fid, F.col("geom").alias("_all"))
    sure = near.where("a_box_only and b_box_only").select(F.col("a_id").alias(fid)).distinct().withColumn("_sure", F.lit(True))
    kept = [fid, *[n for n in names if n != fid]]
    tasks = min(2000, max(1, features.count() // 500))  # an arrangement takes milliseconds, and small rows would meet in few tasks
    both = checkpointed(features.select(*kept, "geom").join(around.hint("merge"), fid, "left").join(sure.hint("merge"), fid, "left").repartition(tasks, fid))
    alone = both.where("_all is null").select(*names, F.lit("input").alias("source"), "geom")
    joined = _shaped(both.where("_sure").withColumn("source", F.lit("union")), [*names, "source"], ["geom", "_all"], P.union)
    doubtful = both.where("_all is not null and _sure is null")
    met = _shaped(doubtful.withColumn("source", F.lit("union")), [*kept, "source"], ["geom", "_all"], lambda a, b: P.union(a, b) if P.touches(a, b) else [])
    apart = doubtful.join(met.select(F.col(fid).alias("_met")), F.col(fid) == F.col("_met"), "left_anti").select(*names, F.lit("input").alias("source"), "geom")
    return alone.unionByName(joined).unionByName(met.select(*names, "source", "geom")).unionByName(apart)


def require_simple_overlay(overlay: DataFrame, oid: str, cell: float, least: int = 3, ratio: float = 0.25) -> None:
    """Refuse a line union over an overlay of ``least`` shapes or more of which ``ratio`` of the pairs overlap."""
    row = overlap_ratio(overlay, oid, cell).first()
    if row["total"] >= least * (least - 1) / 2 and row["ratio"] >= ratio:
        raise ValueError(f"overlay shapes overlap too much for a line union: {row['ratio']:.2f}")


def dissolve(features: DataFrame, field: str | None = None, cell: float = 16.0, fan_in: int = FAN_IN, srid: int | None = None, most: int = 1 << 20) -> DataFrame:
    """``(field, geom)``: the union of each group as a MultiPolygon, null keys as an empty text; without a field, of all.

    Shapes are dealt to cells, so small that the most crowded ``cell`` would have about
    ``fan_in`` features in each if they were spread evenly.  A cell that lies inside
    one shape has no border and is left out.  In others edges are cut at the cell's
    sides, and equal edges of a key added up before they move: copies are one, and
    edges that two shapes share in opposite directions cancel.  A task arranges the
    edges left in a cell and keeps those with the union on one side alone, as chains;
    chains of all cells are then linked to rings (:func:`rings_of_chains`).  So only
    the outline itself comes together, a ring in a row, and those of a key in one.
    A geographic CRS is refused.
    """
    if srid is not None:
        require_projected(srid)
    if field is not None and field not in features.columns:
        raise ValueError(f"no field {field!r}")
    in_range("cell", cell, 0, open_low=True)
    name = field or "group"
    key = F.coalesce(F.col(field).cast("string"), F.lit("")) if field else F.lit("")
    v = checkpointed(normalized(features.withColumn("_k", key).select(F.col("_k").alias(name), "geom").distinct()))  # copies add nothing
    crowd = v.groupBy(name, F.floor(F.col("xmin") / cell), F.floor(F.col("ymin") / cell)).count().agg(F.max("count")).first()[0] or 0
    fine = cell / 2 ** min(10, max(0, math.ceil(math.log(max(1, crowd) / fan_in, 4))))
    span = v.agg(*[F.max(F.abs(c)).alias(c) for c in BOX]).first()
    grid = 2.0 ** math.ceil(math.log2(2 * max([span[c] or 0 for c in BOX] + [fine]) * 1e-10))
    pieces = checkpointed(_cell_pieces(v, name, fine, grid))
    inner = pieces.where("level is not null").select(name, "level", "cx", "cy").distinct()
    edges = pieces.where("level is null").groupBy(name, "cx", "cy", "x0", "y0", "x1", "y1").agg(F.sum("w").alias("w")).where("w <> 0")
    levels = sorted(r[0] for r in inner.select("level").distinct().collect())  # a row for each level, under 50
    for level in levels:
        above = inner.where(F.col("level") == level).select(F.col(name).alias("_k"), F.col("cx").alias("_x"), F.col("cy").alias("_y"))
        edges = edges.join(above, (F.col(name) == F.col("_k")) & (F.expr(f"shiftright(cx, {level})") == F.col("_x")) & (F.expr(f"shiftright(cy, {level})") == F.col("_y")), "left_anti")

    def arrange(table: pa.Table) -> pa.Table:
        e, w = np.stack([table.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1")], axis=1), table.column("w").to_numpy()
        lone = np.isnan(e[:, 0])
        cx, cy = table.column("cx")[0].as_py(), table.column("cy")[0].as_py()
        rings, chains = P.outline_in_cell(e[~lone], w[~lone], int(w[lone].sum()), cx, cy, fine, grid)
        xs, ys, closed = chain_rows(rings, chains)
        return pa.table({name: table.column(name).take(pa.array(np.zeros(len(closed), np.int64))), "xs": xs, "ys": ys, "closed": closed})

    chains = edges.groupBy(name, "cx", "cy").applyInArrow(arrange, f"`{name}` string, {CHAIN}")
    rings = rings_of_chains(chains, [name], most)
    return G.with_box(_polygons(rings, [name], "MultiPolygon"))


def _cell_pieces(v: DataFrame, name: str, cell: float, grid: float) -> DataFrame:
    """``(name, level, cx, cy, x0, y0, x1, y1, w)``: cells inside a shape (with a level), and edges cut at cells' sides with their weights; NaN edges count the shapes that hold a cell's lower left corner."""
    names = [name, "level", "cx", "cy", "x0", "y0", "x1", "y1", "w"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, parts in enumerate(A.parts_of(b.column("geom"))):
                edges = np.rint(P.edges_of(P.oriented(rings_of(parts))) / grid) * grid
                edges = edges[(edges[:, :2] != edges[:, 2:]).any(axis=1)]
                if not len(edges):
                    continue
                level, cx, cy, inside, corner, _, _ = cover(edges, True, cell)
                ex, ey, e, w = cut_at_cells(edges, np.ones(len(edges), np.int64), cell, grid)
                held = ~inside & corner
                n, m, k = int(inside.sum()), int(held.sum()), len(e)
                none = np.full((n + m, 4), np.nan)
                xy = np.concatenate([none, e])
                columns = [np.concatenate([cx[inside], cx[held], ex]), np.concatenate([cy[inside], cy[held], ey]), *xy.T, np.concatenate([np.ones(n + m, np.int64), w])]
                levels = pa.array(np.concatenate([level[inside], np.zeros(m + k, np.int64)]).astype(np.int32), mask=np.concatenate([np.zeros(n, bool), np.ones(m + k, bool)]))
                yield pa.RecordBatch.from_arrays([b.column(name).take(pa.array(np.full(n + m + k, row))), levels, *map(pa.array, columns)], names)

    return v.select(name, "geom").mapInArrow(run, f"`{name}` string, level int, cx long, cy long, x0 double, y0 double, x1 double, y1 double, w long")


def _polygons(rings: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """``(keys.., geom)`` of the rings ``xs``, ``ys`` of each key: shells with their holes, without vertices on straight runs."""
    types = dict(rings.dtypes)
    gathered = rings.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("xs", "ys"))).alias("rings"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for given in b.column("rings"):
                xs, ys = given.values.flatten()
                at = xs.offsets.to_numpy()
                xy = np.stack([c.values.to_numpy() for c in (xs, ys)], axis=1)
                shape = [P.straightened(xy[i:j]) for i, j in zip(at, at[1:], strict=False)]
                out.append(parts_of([r for r in shape if len(r) > 2]))
            keep = [k for k, parts in enumerate(out) if parts]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(keep, pa.int64())) for c in keys), A.geometries(kind, [out[k] for k in keep])], [*keys, "geom"])

    return gathered.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keys), f"geom {G.TYPE}"]))


def buffer(features: DataFrame, distance: float, srid: int, segments: int = 30) -> DataFrame:
    """Features widened by ``distance``, attributes kept; a geographic CRS is refused, null geometries give no row.  Equal shapes are widened once."""
    require_projected(srid)
    in_range("segments", segments, 1)
    v = features.where(~G.is_empty(F.col("geom")))

    def widened(table: DataFrame, names: list[str]) -> DataFrame:
        types = dict(table.dtypes)
        schema = ", ".join([*(f"`{c}` {types[c]}" for c in names), f"geom {G.TYPE}"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                kinds = b.column("geom").flatten()[0].to_pylist()
                given = [[rings_of([p]) if "Polygon" in k else p for p in parts] for k, parts in zip(kinds, A.parts_of(b.column("geom")), strict=True)]
                out = [parts_of(P.buffer(k, parts, distance, segments)) for k, parts in zip(kinds, given, strict=True)]
                keep = [n for n, parts in enumerate(out) if parts]
                at = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in names), A.geometries("MultiPolygon", [out[n] for n in keep])], [*names, "geom"])

        return table.select(*names, "geom").mapInArrow(run, schema)

    return G.with_box(_each_once(v, _names(features), widened))


def buffer_report(features: DataFrame, buffered: DataFrame, distance: float) -> DataFrame:
    """``(feature_count, buffered_count, distance, srs_type)``: feature_count also counts null geometries."""
    return features.agg(F.count("*").alias("feature_count")).crossJoin(buffered.agg(F.count("*").alias("buffered_count"))).select("*", F.lit(f"{distance:g}").alias("distance"), F.lit("projected").alias("srs_type"))
