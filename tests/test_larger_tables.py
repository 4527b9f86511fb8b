"""Cases that only larger tables showed."""

import heapq
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.functions import rtree
from geoloom.operators import graph as GR
from geoloom.operators import matching as K
from geoloom.operators import mosaic as M
from geoloom.operators import overlay as O
from geoloom.operators import predicates as R
from geoloom.operators import project as P
from geoloom.operators import raster
from geoloom.operators import segment as S
from geoloom.operators import vector as V
from geoloom.operators import zonal as Z
from geoloom.sources import fixtures as X
from geoloom.sources import io as IO


def joins_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scenes_broadcast_no_pixels(spark, data):
    """The grid is made by explode(), whose rows no size estimate counts, and where() turns the outer join into an inner one."""
    plan = joins_of(X.scenes(spark, data).where("b1 > 180"))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("method", ["nearest", "mode", "bilinear"])
def test_resampling_broadcasts_no_targets(spark, method):
    pixels = spark.range(16).selectExpr("0L AS raster_id", "1 AS band", "CAST(id / 4 AS INT) AS row", "CAST(id % 4 AS INT) AS col", "CAST(id AS DOUBLE) AS value")
    targets = P.grid_targets(pixels, 2, 2, lambda x, y: (x * 2, y * 2), method == "mode")
    plan = joins_of(P.resample(pixels, targets, method))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_line_parallel_to_an_edge(spark):
    ring = F.array(*[G.vertex(F.lit(x), F.lit(y)) for x, y in ((5.5, 0.0), (0.0, 4.5), (-5.5, 0.0), (0.0, -4.5), (5.5, 0.0))])
    areas = G.with_box(spark.range(1).select(F.col("id").alias("fid"), G.geometry("Polygon", F.array(F.array(ring))).alias("geom")))
    line = F.array(G.vertex(F.lit(-11.0), F.lit(-9.0)), G.vertex(F.lit(11.0), F.lit(9.0)))
    lines = spark.range(1).select(F.col("id").alias("lid"), G.geometry("LineString", F.array(F.array(line))).alias("geom"))
    got = V.clip_lines(lines, areas, "lid", "fid", 4.0).select(G.length(F.col("geom")).alias("n")).collect()
    assert [round(r["n"], 6) for r in got] == [round((5.5**2 + 4.5**2) ** 0.5, 6)]


@pytest.mark.parametrize("name", ["k3_corners_harris", "k3_corners_shi_tomasi"])
def test_corners_that_tie(spark, monkeypatch, name):
    """Responses that differ by the order of a sum alone are ties, and the upper one wins."""
    noise = F.when(F.col("row") == 8, 1e-13).otherwise(0.0)
    peak = F.when((F.col("col") == 5) & F.col("row").isin(5, 8), F.lit(0.5) + noise).otherwise(0.01)
    response = spark.range(256).selectExpr("0L AS raster_id", "1 AS band", "CAST(id / 16 AS INT) AS row", "CAST(id % 16 AS INT) AS col").withColumn("value", peak)
    monkeypatch.setattr(K, "corner_response", lambda pixels, method: pixels)
    got = K.corners(response, name.removeprefix("k3_corners_"), 10, 0.5, 5).select("row", "col").collect()
    assert [tuple(r) for r in got] == [(5, 5)]


def test_stats_over_more_than_a_thousand_rasters(spark):
    """1,100 rasters of 2 x 2 pixels in a row."""
    grid = [F.lit(1.0).alias("px"), F.lit(2.0).alias("oy"), F.lit(-1.0).alias("py"), F.lit(2).alias("width"), F.lit(2).alias("height"), F.lit(3857).alias("srid"), F.lit(0.0).alias("nodata")]
    catalog = spark.range(1100).select(F.col("id").alias("raster_id"), (F.col("id") * 2.0).alias("ox"), F.col("id").alias("priority"), *grid)
    places = spark.range(4).selectExpr("CAST(id / 2 AS INT) AS row", "CAST(id % 2 AS INT) AS col")
    pixels = spark.range(1100).crossJoin(places).select(F.col("id").alias("raster_id"), "row", "col", (F.col("id") % 2 + 1.0).alias("value"))
    zones = V.rectangles(spark.createDataFrame([(7, "all", 0.0, 0.0, 2200.0, 2.0)], "fid long, fname string, xmin double, ymin double, xmax double, ymax double"))
    got = Z.stats_over_rasters(zones, 3857, catalog, pixels, Z.parse_class_map(spark, '{"1": "a", "2": "b"}'))
    assert sorted((r["class_value"], r["pixel_count"]) for r in got.where("feature_id = '7'").collect()) == [(1, 2200), (2, 2200)]


def test_many_rows_of_a_small_estimate_are_not_broadcast(spark):
    """Cells met with rasters come from explode() and Python, so Spark's estimate of them is that of a few rows."""
    pixels = spark.range(100).selectExpr("id AS k", "id AS v")
    many = spark.range(2).select(F.explode(F.sequence(F.lit(0), F.lit(49))).alias("n"), "id").selectExpr("id * 50 + n AS k", "n")
    got = GR.small_join(pixels, many, ["k"], most=60)
    plan = joins_of(got)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and got.count() == 100
    assert "BroadcastHashJoin" in joins_of(GR.small_join(pixels, many, ["k"], most=100))


def test_boxes_that_all_meet_come_in_runs():
    tree = rtree.PackedTree(np.tile([0.0, 0.0, 4.0, 4.0], (3000, 1)))
    runs = list(tree.runs(np.tile([1.0, 1.0, 1.0, 1.0], (200, 1)), 1 << 12))
    assert max(len(i) for i, _ in runs) <= 1 << 12
    assert len({(a, b) for i, j in runs for a, b in zip(i.tolist(), j.tolist(), strict=True)}) == sum(len(i) for i, _ in runs) == 600_000


def _copies(spark, n: int):
    """n copies of one rectangle, and one other that meets them."""
    return spark.range(n + 1).select(F.col("id").alias("oid"), F.when(F.col("id") < n, 0.0).otherwise(2.5).alias("xmin"), F.lit(0.0).alias("ymin"), F.when(F.col("id") < n, 3.0).otherwise(4.0).alias("xmax"), F.lit(2.0).alias("ymax"))


def test_equal_shapes_are_covered_once(spark, monkeypatch):
    seen, covering = [], R.covering
    monkeypatch.setattr(R, "covering", lambda t, i, cell: (seen.append(t.count()), covering(t, i, cell))[1])
    many = V.rectangles(_copies(spark, 50))
    got = R.spatial_join(many, many.where("oid = 50").withColumnRenamed("oid", "fid"), "oid", "fid").collect()
    assert sorted(tuple(r) for r in got) == [(k, 50) for k in range(51)]
    assert seen == [2, 1]


def test_equal_boxes_are_compared_once(spark, monkeypatch):
    seen, pairs = [], V.grid_pairs
    monkeypatch.setattr(V, "grid_pairs", lambda *a, **b: (seen.append(pairs(*a, **b).count()), pairs(*a, **b))[1])
    got = V.overlap_ratio(_copies(spark, 50), "oid", 1.0).first()
    assert (got["pairs"], got["total"], seen) == (50 * 49 // 2 + 50, 51 * 50 // 2, [4])


def test_equal_shapes_are_worked_on_once(spark):
    seen = []
    many = V.rectangles(_copies(spark, 50))
    got = O._each_once(many, ["oid"], lambda t, names: (seen.append(t.count()), t.select(*names, "geom"))[1]).select("oid").collect()
    assert sorted(r["oid"] for r in got) == list(range(51)) and seen == [2]
    wide = O.buffer(many.select("oid", "geom"), 0.5, 3857).collect()
    assert len(wide) == 51 and {(r["xmin"], r["xmax"]) for r in wide} == {(-0.5, 3.5), (2.0, 4.5)}


def test_grid_join_broadcasts_no_cells(spark):
    many = _copies(spark, 5)
    plan = joins_of(V.grid_pairs(many, many.withColumnRenamed("oid", "other"), "oid", "other", 1.0))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_equal_boxes_meet_once_in_the_grid_join(spark, monkeypatch):
    """50 features of one box and one of another are two rows of the grid; all pairs are there, those of a feature without a number too."""
    seen, pairs = [], V.grid_pairs
    monkeypatch.setattr(V, "grid_pairs", lambda a, b, *rest, **more: (seen.append((a.count(), b.count())), pairs(a, b, *rest, **more))[1])
    many = _copies(spark, 50).withColumn("oid", F.expr("nullif(oid, 7)"))
    got = V.grid_join(many, many.withColumnRenamed("oid", "other"), "oid", "other", 1.0).collect()
    assert seen == [(2, 2)] and len(got) == 51 * 51
    names = {None if k == 7 else k for k in range(51)}
    assert {tuple(r) for r in got} == {(a, b) for a in names for b in names}
    lists = V._listed(many, "oid", most=8).select(F.size("oid").alias("n")).collect()
    assert sum(r["n"] for r in lists) == 51 and max(r["n"] for r in lists) < 25
    lone = many.where("oid >= 49")
    assert V._listed(lone, "oid") is None and V.grid_join(lone, many.withColumnRenamed("oid", "other"), "oid", "other", 1.0).count() == 2 * 51


def test_points_on_the_border_of_a_rectangle(spark):
    """Left and lower sides are inside; rectangles decide where the pair is found, without a join with their geometry."""
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 1.0), (3, 1.0, 2.0), (4, 1.0, 1.0)], "pid long, x double, y double")
    areas = V.rectangles(_copies(spark, 1)).where("oid = 0")
    got = V.points_in_areas(points, areas, "pid", "oid", 1.0)
    assert sorted(r["pid"] for r in got.collect()) == [1, 4]
    assert "BroadcastHashJoin" not in joins_of(got)


def _noise(spark, side: int = 40):
    """Two rasters with two bands; some pixels are missing, some null, some not finite."""
    places = spark.range(side * side * 4).selectExpr("CAST(id % 2 AS LONG) AS raster_id", "CAST(id / 2 AS INT) % 2 + 1 AS band", f"CAST(id / 4 AS INT) DIV {side} AS row", f"CAST(id / 4 AS INT) % {side} AS col")
    h = F.pmod(F.xxhash64("raster_id", "band", "row", "col"), F.lit(1000))
    value = F.when(h < 30, F.lit(None)).when(h < 33, F.lit(float("nan"))).when(h < 36, F.lit(float("inf"))).otherwise((h % 5).cast("double"))
    return places.withColumn("value", value).where(h > 9)


@pytest.mark.parametrize("method", ["nearest", "average", "mode", "gaussian", "cubic"])
def test_overviews_in_tiles_are_those_of_aggregates(spark, monkeypatch, method):
    monkeypatch.setattr(M, "TILE", 16)
    pixels = _noise(spark)
    key = ["raster_id", "band", "level", "row", "col"]
    rows = lambda t: {tuple(r[k] for k in key): None if r["value"] is None else str(round(r["value"], 9) + 0.0) for r in t.collect()}
    tiled, plain = M.overviews(pixels, (2, 3, 4), method), M._wide_overviews(pixels, [2, 3, 4], method)
    assert rows(tiled) == rows(plain) and tiled.count() == plain.count()
    plan = joins_of(tiled)
    assert "FlatMapGroupsInArrow" in plan and "Generate explode([2,3,4])" not in plan


def _flood_of_the_whole(value, marks):
    best = {p: (value[p], 0, k) for p, k in marks.items()}
    heap = [(*c, p) for p, c in best.items()]
    heapq.heapify(heap)
    while heap:
        h, s, k, p = heapq.heappop(heap)
        if best[p] != (h, s, k):
            continue
        for q in ((p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)):
            if q in value:
                new = (value[q], 0, k) if value[q] > h else (h, s + 1, k)
                if q not in best or new < best[q]:
                    best[q] = new
                    heapq.heappush(heap, (*new, q))
    return {p: best[p][2] if p in best else 0 for p in value}


@pytest.mark.parametrize("tile", [4, 7, 64])
def test_watershed_of_tiles_is_that_of_the_whole(spark, tile):
    """A label that a tile had before its neighbours' better ones came must not stay beyond it."""
    rng = np.random.default_rng(11)
    rows, marked, want = [], [], {}
    for rid in range(12):
        places = [(y, x) for y in range(24) for x in range(24) if rng.random() > 0.05]
        value = {p: int(rng.integers(0, 256 if rid % 2 else 12)) for p in places}
        marks = {p: int(k) for p, k in zip(places, rng.integers(1, 90, len(places)), strict=True) if rng.random() < 0.06} if rid else {}
        rows += [(rid, 1, *p, float(v)) for p, v in value.items()]
        marked += [(rid, 1, *p, k) for p, k in marks.items()]
        want |= {(rid, *p): k for p, k in _flood_of_the_whole(value, marks).items()}
    pixels = spark.createDataFrame(rows, "raster_id long, band int, row int, col int, value double")
    got = S.watershed(pixels, spark.createDataFrame(marked, "raster_id long, band int, row int, col int, label long"), tile)
    assert {(r["raster_id"], r["row"], r["col"]): r["label"] for r in got.collect()} == want


def test_distances_in_one_tile_take_one_round(spark, monkeypatch):
    kept, keep = [], S.checkpointed
    monkeypatch.setattr(S, "checkpointed", lambda df: (kept.append(1), keep(df))[1])
    mask = spark.range(400).selectExpr("0L AS raster_id", "1 AS band", "CAST(id DIV 20 AS INT) AS row", "CAST(id % 20 AS INT) AS col", "CAST(id > 0 AS DOUBLE) AS value")
    far = {(r["row"], r["col"]): r["value"] for r in S.distance_transform(mask).collect()}
    assert far[0, 19] == 19 and far[19, 0] == 19 and len(kept) == 2


def test_stores_have_no_folder_a_raster(spark, tmp_path):
    pixels = spark.range(16 * 300).selectExpr("CAST(id DIV 16 AS LONG) AS raster_id", "1 AS band", "CAST(id % 16 DIV 4 AS INT) AS row", "CAST(id % 4 AS INT) AS col", "CAST(id AS DOUBLE) AS value")
    IO.write_tiles(pixels, f"file://{tmp_path}/tiles", 2)
    IO.write_pixels(pixels, f"file://{tmp_path}/pixels")
    for name, most in (("tiles", 5), ("pixels", 1)):
        found = [d for d, _, files in os.walk(tmp_path / name) if any(f.endswith(".parquet") for f in files)]
        assert 1 <= len(found) <= most
    cells = spark.createDataFrame([(7, 1, 3), (250, 2, 0)], "raster_id long, row int, col int")
    got = IO.read_tiles(spark, f"file://{tmp_path}/tiles", cells, 2).collect()
    assert sorted((r["raster_id"], r["row"] // 2, r["col"] // 2) for r in got) == [(7, 0, 1)] * 4 + [(250, 1, 0)] * 4
    assert all(r["value"] == r["raster_id"] * 16 + r["row"] * 4 + r["col"] for r in got)
    assert sorted(r["value"] for r in spark.read.parquet(f"file://{tmp_path}/pixels").collect()) == list(range(4800))


def test_kml_files_are_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(IO, "VERTICES", 50)
    path = f"file://{tmp_path}/kml"
    IO.write_features(V.rectangles(_copies(spark, 50)).coalesce(1), path, "KML")
    assert len(list((tmp_path / "kml").glob("part-*"))) == 6
    assert sorted(r["oid"] for r in IO.read_features(spark, path, "KML", "oid long").collect()) == list(range(51))


def test_equal_features_are_united_once(spark, monkeypatch):
    seen, shaped = [], O._shaped
    monkeypatch.setattr(O, "_shaped", lambda t, *a: (seen.append(t.count()), shaped(t, *a))[1])
    many = V.rectangles(_copies(spark, 50))
    other = V.rectangles(spark.createDataFrame([(1, 2.0, 1.0, 3.5, 3.0)], "fid long, xmin double, ymin double, xmax double, ymax double"))
    lost = many.where("oid = 0").select((F.col("oid") + 90).alias("oid"), F.lit(None).cast(G.TYPE).alias("geom"), *[F.lit(None).cast("double").alias(c) for c in V.BOX])
    got = O.union(many.unionByName(lost), other, "oid", "fid", 4.0).select("oid", "source", G.area(F.col("geom")).alias("area")).collect()
    assert sorted(r["oid"] for r in got) == [*range(51), 90]
    assert {(r["source"], round(r["area"], 9)) for r in got} == {("union", 8.0), ("union", 5.0), ("input", 0.0)}
    assert max(seen) == 2


def test_queries_go_to_their_lists_in_slices():
    i, k = np.nonzero(np.ones((300, 40), bool))
    parts = list(K._slices(i, k, 64, 4096))
    assert max(len(a) for a, _ in parts) == 64 and (np.concatenate([a for a, _ in parts]) == i).all() and (np.concatenate([b for _, b in parts]) == k).all()


def test_scaling_onto_a_grid_explodes_no_neighbours(spark):
    """12 x 9 pixels on 30 x 20, in tiles of 8: as with all neighbours of each target at once."""
    pixels = _noise(spark).where("row < 12 and col < 9 and raster_id = 0 and not (value = 'NaN' or value = 'Infinity')")
    pixels = pixels.unionByName(spark.createDataFrame([(0, 1, 11, 8, 2.0), (0, 2, 11, 8, 2.0)], pixels.schema)).dropDuplicates(["band", "row", "col"])
    grid = spark.range(600).selectExpr("0L AS raster_id", "CAST(id DIV 20 AS INT) AS row", "CAST(id % 20 AS INT) AS col").where("(row + col) % 11 <> 3")
    got = raster.onto_grid(pixels, grid, 8)
    assert "Generate explode(sequence(-1, 2" not in joins_of(got)
    held = {(r["band"], r["row"], r["col"]): r["value"] for r in pixels.collect()}
    kernel = lambda t: 1.25 * t**3 - 2.25 * t**2 + 1 if t < 1 else -0.75 * t**3 + 3.75 * t**2 - 6 * t + 3 if t < 2 else 0.0
    want = {}
    for g in grid.collect():
        y, x = (g["row"] + 0.5) * 12 / 30 - 0.5, (g["col"] + 0.5) * 9 / 20 - 0.5
        for band in (1, 2):
            near = [(int(np.floor(y)) + a, int(np.floor(x)) + b) for a in range(-1, 3) for b in range(-1, 3)]
            own = [(held[k], kernel(abs(y - r)) * kernel(abs(x - c))) for r, c in near if (k := (band, min(max(r, 0), 11), min(max(c, 0), 8))) in held]
            known = [v * w for v, w in own if v is not None]
            if own:
                want[band, g["row"], g["col"]] = sum(known) if known else None
    rows = got.collect()
    assert {(r["band"], r["row"], r["col"]): r["value"] for r in rows} == pytest.approx(want, abs=1e-9) and len(rows) == len(want)


@pytest.mark.parametrize("method", ["nearest", "mode"])
@pytest.mark.parametrize(("factor", "height", "width"), [(0.64, 62, 70), (2.5, 16, 17), (1.0, 40, 40), (0.1, 50, 30), (7 / 3, 18, 12)])
def test_scaling_makes_no_grid_of_targets(spark, method, factor, height, width):
    """Pixels name the targets they are for; the result is that of targets joined with their sources."""
    pixels = _noise(spark)
    got = P.resize(pixels, height, width, factor, method)
    targets = P.grid_targets(pixels, height, width, lambda x, y: (x * factor, y * factor), method == "mode")
    rows = lambda t: sorted((r["raster_id"], r["band"], r["row"], r["col"], str(r["value"])) for r in t.collect())
    assert rows(got) == rows(P.resample(pixels, targets, method)) and got.dtypes == P.resample(pixels, targets, method).dtypes
    plan = joins_of(got)
    assert "Join" not in plan and (method == "mode" or "Exchange" not in plan)


@pytest.mark.parametrize("cut", [V.clip_lines, V.difference_lines, V.union_lines])
def test_cutting_lines_broadcasts_no_segments(spark, cut):
    """Only the few areas may go to every task; segments, cuts and lines are exploded or computed and may be many."""
    line = F.array(G.vertex(F.lit(-11.0), F.lit(1.0)), G.vertex(F.col("id") * 1.0, F.lit(1.0)), G.vertex(F.lit(30.0), F.lit(9.0)))
    lines = spark.range(12).select(F.col("id").alias("lid"), G.geometry("LineString", F.array(F.array(line))).alias("geom"))
    areas = V.rectangles(_copies(spark, 1)).withColumnRenamed("oid", "fid").select("fid", "geom", *V.BOX)
    got = cut(lines, areas, "lid", "fid", 4.0)
    assert got.count() >= 12
    assert [x for x in joins_of(got).splitlines() if "BroadcastHashJoin" in x and "BroadcastHashJoin [fid" not in x] == []


def test_shapes_are_covered_in_many_tasks(spark, monkeypatch):
    """1,600 small shapes are few bytes, which would come together in one task."""
    seen, covering = [], R.covering
    monkeypatch.setattr(R, "covering", lambda t, i, cell: (seen.append(t.rdd.getNumPartitions()), covering(t, i, cell))[1])
    many = V.rectangles(spark.range(1600).selectExpr("id AS oid", "id * 2.0D AS xmin", "0D AS ymin", "id * 2.0D + 1 AS xmax", "1D AS ymax"))
    got = R.spatial_join(many, many.where("oid < 3").withColumnRenamed("oid", "fid"), "oid", "fid").collect()
    assert sorted(tuple(r) for r in got) == [(0, 0), (1, 1), (2, 2)] and seen == [3, 1]


@pytest.mark.parametrize("motion", ["affine"])
def test_intensity_registration_warps_no_pixel_table(spark, monkeypatch, motion):
    """Images of several tiles, further apart than a tile carries at first."""
    y, x = np.mgrid[0:270, 0:530]
    wave = lambda dy, dx: 100 + 60 * np.sin((x + dx) / 47) * np.cos((y + dy) / 35) + 30 * np.sin((x + dx + y + dy) / 61)
    rows = lambda v: spark.createDataFrame(pd.DataFrame({"raster_id": 3, "band": np.int32(2), "row": y.ravel().astype(np.int32), "col": x.ravel().astype(np.int32), "value": v.ravel()}))
    made, tiles = [], K._ecc_tiles
    monkeypatch.setattr(K, "_ecc_tiles", lambda *a, **b: (made.append(1), tiles(*a, **b))[1])
    monkeypatch.setattr(K, "warp", None)
    out, m = K.ecc_register(rows(wave(0, 0)), rows(wave(-3.25, -21.5)), 270, 530, motion)
    assert (m[0, 2], m[1, 2]) == pytest.approx((21.5, 3.25), abs=0.05) and len(made) == 2
    got = out.toPandas()
    assert set(got["raster_id"]) == {3} and set(got["band"]) == {2} and not got.duplicated(["row", "col"]).any()
    inside = got[(got["row"] < 265) & (got["col"] < 505)]
    assert len(inside) == 265 * 505 and np.abs(inside["value"] - wave(0, 0)[inside["row"], inside["col"]]).max() < 0.1


@pytest.mark.parametrize("method", ["nearest", "bilinear"])
@pytest.mark.parametrize("matrix", [(0.9, -0.1, 3.33, 0.1, 0.9, 1.25), (1.0, 0.0, -2.0, 0.0, 1.0, -300.0), (-1.3, 0.4, 300.0, 0.2, 2.5, -7.5)])
def test_warps_on_tiles_are_those_of_the_join(spark, method, matrix):
    source = spark.range(90 * 310).where("id % 7 <> 3").selectExpr("5L AS raster_id", "1 AS band", "CAST(id / 310 AS INT) AS row", "CAST(id % 310 AS INT) AS col", "CAST(xxhash64(id) % 256 AS DOUBLE) AS value")
    got = P.warp(source, 400, 280, matrix, method)
    back = lambda x, y: (matrix[0] * x + matrix[1] * y + matrix[2], matrix[3] * x + matrix[4] * y + matrix[5])
    want = P.resample(source, P.grid_targets(source, 400, 280, back), method)
    table = lambda t: t.toPandas().sort_values(["row", "col"]).reset_index(drop=True)
    a, b = table(got), table(want)
    assert len(a) == len(b) > 100 and (a[["row", "col"]] == b[["row", "col"]]).all(None) and np.allclose(a["value"], b["value"])


def test_repeated_pictures_are_stitched(spark):
    """A picture that is there three times: its points find their own copies as near, and Lowe's test must not refuse them for it."""
    rng = np.random.default_rng(5)
    shared = [v for v in rng.integers(-(2**62), 2**62, (8, 4)).tolist() for _ in range(3)]  # eight descriptors, three places each
    places = [(k // 3, 7 * (k // 3), 100 * (k % 3) + 3 * (k // 3)) for k in range(24)]
    table = lambda dy, dx: spark.createDataFrame([(0, y + dy, x + dx, d) for (_, y, x), d in zip(places, shared, strict=True)], "raster_id long, row int, col int, descriptor array<long>")
    got = K.match_keypoints(table(0, 0), table(3, 2)).collect()
    assert len(got) == 24 and {(r["x2"] - r["x1"], r["y2"] - r["y1"]) for r in got} == {(2, 3)}
    fewer = K.match_keypoints(table(0, 0), table(3, 2).where("col < 200")).collect()
    assert fewer == []  # two of three copies: which belong together is open
    one = K.match_keypoints(table(0, 0), table(3, 2).where("col < 100")).collect()
    assert len(one) == 24  # as without copies on the other side
