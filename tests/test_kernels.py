"""Operators against brute force on small inputs, with tiles and groups small enough to be crossed."""

import collections
import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_golden import grid_of, image, square

from geoloom.functions import geometry as G
from geoloom.functions import polygons
from geoloom.operators import graph, matching, overlay, project, segment, vector
from geoloom.sources import io


def area_of(geom):
    return sum(polygons.signed_area(r) for r in polygons.from_struct(geom)) if geom else 0.0


def shapes(spark, rings, **more):
    """A polygon of each ring, closed here."""
    rows = [(k, {"kind": "Polygon", "parts": [[[{"x": float(x), "y": float(y)} for x, y in [*r, r[0]]]]]}) for k, r in enumerate(rings)]
    return G.with_box(spark.createDataFrame(rows, f"fid long, geom {G.TYPE}"))


def size(rings):
    return sum(map(polygons.signed_area, rings))


def test_overlays_of_any_shape(spark):
    rng = np.random.default_rng(8)
    hulls = [polygons.hull(rng.random((7, 2)) * 9 + rng.random(2) * 20) for _ in range(14)]
    own = [*hulls[:6], np.array([(0.0, 0), (30, 0), (30, 30), (0, 30)]), np.array([(2.0, 2), (9, 2), (9, 9), (2, 9)])]
    tie = np.array([(5.0, 20), (15, 28), (15, 20), (5, 28)])
    other = [*hulls[6:], tie, np.array([(3.0, 3), (6, 3), (6, 6), (3, 6)]), np.array([(6.5, 3), (8, 3), (8, 6), (6.5, 6)])]
    a, b = shapes(spark, own), shapes(spark, other).withColumnRenamed("fid", "oid")
    whole = polygons.union_all([polygons.repaired([r]) for r in other])
    fix = [polygons.repaired([r]) for r in own]
    got = {r["fid"]: area_of(r["geom"]) for r in overlay.clip(a, b, "fid", "oid", 4.0).collect()}
    want = {k: size(polygons.intersection(r, whole)) for k, r in enumerate(fix)}
    assert got == pytest.approx({k: v for k, v in want.items() if v > 1e-9}, abs=1e-5)
    left = {r["fid"]: area_of(r["geom"]) for r in overlay.difference(a, b, "fid", "oid", 4.0).collect()}
    assert left == pytest.approx({k: size(r) - want[k] for k, r in enumerate(fix) if size(r) - want[k] > 1e-9}, abs=1e-5)
    box = lambda r: (*r.min(0), *r.max(0))
    for row in overlay.union(a, b, "fid", "oid", 4.0).collect():
        x = box(own[row["fid"]])
        near = [polygons.repaired([r]) for r in other if (y := box(r))[0] <= x[2] and x[0] <= y[2] and y[1] <= x[3] and x[1] <= y[3]]
        joined = polygons.union_all(near)
        met = bool(near) and polygons.touches(fix[row["fid"]], joined)
        assert row["source"] == ("union" if met else "input")
        assert area_of(row["geom"]) == pytest.approx(size(polygons.union(fix[row["fid"]], joined)) if met else size(fix[row["fid"]]), abs=1e-5)


def test_crowded_groups_are_united_in_rounds(spark):
    rng = np.random.default_rng(9)
    rings = [polygons.hull(rng.random((5, 2)) * 6 + rng.random(2) * 25) for _ in range(60)]
    table = shapes(spark, rings).withColumn("key", F.when(F.col("fid") < 40, "a").otherwise(F.lit(None)))
    want = {key: size(polygons.union_all([[r] for r in part])) for key, part in (("a", rings[:40]), (None, rings[40:]))}
    for fan_in in (2, 7, 64):
        got = {r["key"]: area_of(r["geom"]) for r in overlay.united(table, ["key"], fan_in).collect()}
        assert got == pytest.approx(want, rel=1e-6)
    assert {r["key"]: area_of(r["geom"]) for r in overlay.dissolve(table, "key", 3.0, 4).collect()} == pytest.approx({"a": want["a"], "": want[None]}, rel=1e-6)


def test_layers_of_other_crs_are_refused(spark):
    a, b = square(spark, 0, 0, 2, 2), square(spark, 1, 1, 3, 3).withColumnRenamed("fid", "oid")
    for run in (overlay.clip, overlay.difference, overlay.union):
        with pytest.raises(ValueError, match="different CRS"):
            run(a, b, "fid", "oid", 1.0, srid=4326, overlay_srid=3857)
        assert run(a, b, "fid", "oid", 1.0, srid=3857, overlay_srid=3857).count() == 1
    with pytest.raises(ValueError, match="projected"):
        overlay.dissolve(a, srid=4326)
    with pytest.raises(ValueError):
        project.require_same(None, 3857)


def test_multi_geometries_through_every_format(spark, tmp_path):
    v = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    ring = lambda x, s: v((x, x), (x + s, x), (x + s, x + s), (x, x + s), (x, x))
    rows = [
        (1, {"kind": "MultiPolygon", "parts": [[ring(0, 9), ring(2, 3)], [ring(20, 5)]]}), (2, {"kind": "MultiLineString", "parts": [[v((0, 0), (1, 2))], [v((5, 5), (6, 6), (7, 5))]]}),
        (3, {"kind": "MultiPoint", "parts": [[v((1, 1))], [v((2, 3))]]}), (4, {"kind": "Point", "parts": [[v((4, 4))]]}), (5, {"kind": "Polygon", "parts": [[ring(0, 4)]]}), (6, {"kind": "LineString", "parts": [[v((0, 1), (2, 3))]]}),
    ]
    table = G.with_box(spark.createDataFrame(rows, f"fid long, geom {G.TYPE}"))
    plain = lambda df: {r["fid"]: r["geom"].asDict(True) for r in df.collect()}
    io.write_features(table, f"file://{tmp_path}/parquet")
    for fmt in ("KML", "GeoJSON", "CSV"):
        assert io.convert(spark, f"file://{tmp_path}/parquet", "parquet", f"file://{tmp_path}/{fmt}", fmt, "fid long") == 6
        assert plain(io.read_features(spark, f"file://{tmp_path}/{fmt}", fmt, "fid long")) == plain(table), fmt


def test_watershed_is_the_flood_of_the_whole(spark):
    rng = np.random.default_rng(3)
    value = rng.integers(0, 9, (13, 11))
    marks = {(2, 2): 1, (10, 8): 2, (6, 1): 3}
    best = {p: (int(value[p]), 0, k) for p, k in marks.items()}
    heap = [(*c, p) for p, c in best.items()]
    heapq.heapify(heap)
    while heap:
        h, s, k, p = heapq.heappop(heap)
        if best[p] != (h, s, k):
            continue
        for q in ((p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)):
            if 0 <= q[0] < 13 and 0 <= q[1] < 11:
                new = (int(value[q]), 0, k) if value[q] > h else (h, s + 1, k)
                if q not in best or new < best[q]:
                    best[q] = new
                    heapq.heappush(heap, (*new, q))
    markers = spark.createDataFrame([(0, 1, y, x, k) for (y, x), k in marks.items()], "raster_id long, band int, row int, col int, label long")
    for tile in (3, 256):
        got = {(r["row"], r["col"]): r["label"] for r in segment.watershed(image(spark, value), markers, tile).collect()}
        assert got == {p: k for p, (_, _, k) in best.items()}


def test_distances_and_markers(spark):
    grid = np.ones((20, 23))
    grid[0, :] = grid[9, 9] = grid[15, 2] = 0
    steps = [(sy * a, sx * b, w) for (p, q), w in segment.CHAMFER.items() for a, b in ((p, q), (q, p)) for sy in (1, -1) for sx in (1, -1)]
    want = {(y, x): 0.0 for y, x in zip(*np.nonzero(grid == 0), strict=True)}
    heap = [(0.0, p) for p in want]
    while heap:
        d, (y, x) = heapq.heappop(heap)
        for dy, dx, w in steps:
            q = (y + dy, x + dx)
            if 0 <= q[0] < 20 and 0 <= q[1] < 23 and d + w < want.get(q, np.inf) - 1e-12:
                want[q] = d + w
                heapq.heappush(heap, (d + w, q))
    for tile in (5, 256):
        got = grid_of(segment.distance_transform(image(spark, grid), tile), 20, 23)
        assert np.allclose(got, [[want[y, x] for x in range(23)] for y in range(20)])
    two = np.zeros((20, 40))
    two[3:14, 3:14] = two[4:15, 20:31] = 200
    two[8, 14:20] = 200  # a bridge that is too thin to hold a marker
    marks = segment.auto_markers(image(spark, two), tile=8)
    assert marks.select("label").distinct().count() == 2


def test_refit_takes_every_inlier(spark):
    rng = np.random.default_rng(12)
    src = rng.random((9000, 2)) * 1000
    true = np.array([[0.99, -0.05, 12], [0.05, 0.99, -7], [1e-6, -2e-6, 1]])
    z = np.c_[src, np.ones(9000)] @ true.T
    dst = z[:, :2] / z[:, 2:] + rng.normal(size=(9000, 2)) * 0.3
    table = spark.createDataFrame(np.hstack([src, dst]).tolist(), "x1 double, y1 double, x2 double, y2 double").cache()
    for model in ("translation", "similarity", "affine"):
        assert np.allclose(matching.refit(table, model), matching.solve(model, src, dst), rtol=1e-5, atol=1e-6), model
    seen = np.c_[src, np.ones(9000)] @ matching.refit(table, "projective").T
    assert np.abs(seen[:, :2] / seen[:, 2:] - z[:, :2] / z[:, 2:]).max() < 0.05
    assert matching.refit(table.limit(0), "affine") is None
    assert np.allclose(matching.fit_transform(table, "affine", tolerance=50), matching.solve("affine", src, dst), atol=1e-6)


def test_stitched_canvas_holds_both_images(spark):
    rng = np.random.default_rng(21)
    scene = np.kron(rng.integers(0, 255, (24, 44)), np.ones((4, 4)))[:90, :170] + rng.integers(0, 20, (90, 170))
    left, right = scene[:, :110], scene[10:, 60:]
    got = grid_of(matching.stitch([image(spark, left), image(spark, right)]), 90, 170)
    want = scene.copy()
    want[:10, 110:] = np.nan
    assert np.allclose(got, want, equal_nan=True)


def test_shuffled_pieces_are_stitched(spark):
    rng = np.random.default_rng(22)
    scene = np.kron(rng.integers(0, 255, (40, 44)), np.ones((4, 4)))[:150, :170] + rng.integers(0, 20, (150, 170))
    pieces = [scene[25:, 40:], scene[:120, :135], scene[30:, :140], scene[:115, 45:]]
    stray = np.kron(rng.integers(0, 255, (20, 20)), np.ones((4, 4)))
    got = grid_of(matching.stitch([image(spark, p) for p in [*pieces, stray]]), 150, 170)
    assert np.allclose(got, scene)
    with pytest.raises(ValueError, match="well enough"):
        matching.stitch([image(spark, pieces[0]), image(spark, stray)])


def test_surest_pairs_place_the_images():
    step = lambda x, y: np.array([[1, 0, x], [0, 1, y], [0, 0, 1.0]])
    pairs = [(3.0, 1, 2, step(5, 0)), (2.0, 0, 2, step(9, 1)), (1.0, 0, 1, step(100, 100)), (0.4, 2, 3, step(1, 1))]
    tree = matching.spanning_tree(4, pairs, 0.5)
    assert sorted(tree) == [0, 1, 2] and (tree[2] == step(9, 1)).all() and (tree[1] == step(4, 1)).all()
    assert len(matching.spanning_tree(3, [], 0.5)) == 1


def test_intensity_registration_and_clusters(spark):
    y, x = np.mgrid[0:48, 0:60]
    wave = lambda dy, dx: 100 + 60 * np.sin((x + dx) / 7) * np.cos((y + dy) / 5) + 30 * np.sin((x + dx + y + dy) / 11)
    _, m = matching.ecc_register(image(spark, wave(0, 0)), image(spark, wave(-1.0, -1.5)), 48, 60, "translation")
    assert (m[0, 2], m[1, 2]) == pytest.approx((1.5, 1.0), abs=0.05)
    value = np.where(x < 30, 10.0, 200.0) + (y % 3)
    labels, cost = segment.kmeans(image(spark, value), [1], k=2)
    got = grid_of(labels.withColumnRenamed("label", "value"), 48, 60)
    assert len(set(got[:, :30].ravel())) == len(set(got[:, 30:].ravel())) == 1 and got[0, 0] != got[0, 59]
    assert cost == pytest.approx(sum(((v - v.mean()) ** 2).sum() for v in (value[:, :30], value[:, 30:])))


def test_keypoints_move_with_the_image(spark):
    rng = np.random.default_rng(2)
    scene = np.kron(rng.integers(0, 255, (20, 20)), np.ones((4, 4)))
    a = {(r["row"], r["col"]): tuple(r["descriptor"]) for r in matching.keypoints(image(spark, scene[:70, :70])).collect()}
    b = {(r["row"] + 4, r["col"] + 6): tuple(r["descriptor"]) for r in matching.keypoints(image(spark, scene[4:74, 6:76])).collect()}
    both = [p for p in a if p in b]
    assert len(both) > 10 and sum(a[p] == b[p] for p in both) > 0.9 * len(both)


def test_keypoints_recover_a_scale(spark):
    rng = np.random.default_rng(31)
    scene = np.kron(rng.integers(0, 255, (24, 24)), np.ones((8, 8))) + rng.integers(0, 8, (192, 192))
    whole = image(spark, scene)
    small = matching.halved(whole)
    a, b = matching.keypoints(whole, octaves=3), matching.keypoints(small)
    sizes = {r["size"] for r in a.collect()}
    assert len(sizes) >= 2 and min(sizes) * 2 in sizes
    one = {tuple(r["descriptor"]): (r["row"], r["col"], r["size"]) for r in b.collect()}
    same = [(r, one[tuple(r["descriptor"])]) for r in a.collect() if tuple(r["descriptor"]) in one]
    assert len(same) > 5
    for r, (row, col, size) in same:
        assert r["size"] == 2 * size and abs(r["row"] - 2 * row) <= 1 and abs(r["col"] - 2 * col) <= 1
    places = collections.Counter((r["row"] // 2, r["col"] // 2) for r in a.collect() if r["size"] <= 2 * min(sizes))
    assert max(places.values()) <= 2


def test_kept_lines_by_broadcast_and_by_join(spark):
    rng = np.random.default_rng(32)
    at = {(int(y), int(x)) for y, x in rng.integers(0, 60, (200, 2))} | {(20, x) for x in range(60)} | {(k, k) for k in range(60)}
    edges = spark.createDataFrame([(i, y, x) for i in (0, 1) for y, x in at], "raster_id long, row int, col int")
    one, two = (sorted(map(tuple, segment.hough_lines(edges, 40, 30, 3, most=m).select("raster_id", "rho", "theta", F.round("start", 6), F.round("stop", 6)).collect())) for m in (200_000, 0))
    assert one == two and len(one) >= 4


def test_hubs_and_crowded_keys(spark):
    star = spark.range(1, 12_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    chain = spark.range(20_000, 20_040).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = graph.connected_components(star.unionByName(chain)).groupBy("component").count().collect()
    assert {(r["component"], r["count"]) for r in got} == {(0, 12_001), (20_000, 41)}
    big = spark.range(30_000).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))).alias("k"), "id")
    small = spark.range(0, 30_000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionByName(spark.createDataFrame([(7, 70)], "k long, v long"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        a, b = graph.skew_join(big, small, ["k"], how), big.join(small, ["k"], how)
        assert a.columns == b.columns and a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_crowded_keys_of_large_rows_are_salted(spark):
    big = graph.checkpointed(spark.range(30_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 9000).alias("k"), "id"))
    small = spark.range(-1, 9000).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 50).alias("v"))
    want = sorted(map(tuple, big.join(small, "k").collect()))
    for most in (0, 64 << 20):
        assert sorted(map(tuple, graph.skew_join(big, small, ["k"], most_bytes=most).select("k", "id", "v").collect())) == want


def test_bent_lines(spark):
    rows = [(1, {"kind": "LineString", "parts": [[[{"x": -5.0, "y": 5.0}, {"x": 5.0, "y": 5.0}, {"x": 5.0, "y": 15.0}]]]}), (2, {"kind": "MultiLineString", "parts": [[[{"x": 20.0, "y": 20.0}, {"x": 30.0, "y": 20.0}]], [[{"x": 1.0, "y": 1.0}, {"x": 2.0, "y": 2.0}]]]})]
    lines = spark.createDataFrame(rows, f"lid long, geom {G.TYPE}")
    c = [(0, 0), (10, 0), (10, 10), (6, 10), (6, 4), (4, 4), (4, 10), (0, 10)]  # a U
    area = shapes(spark, [c])
    plain = lambda df: {r["lid"]: [[(v["x"], v["y"]) for v in p[0]] for p in r["geom"]["parts"]] for r in df.collect()}
    assert plain(vector.clip_lines(lines, area, "lid", "fid", 5.0)) == {1: [[(0, 5), (4, 5)]], 2: [[(1, 1), (2, 2)]]}
    assert plain(vector.difference_lines(lines, area, "lid", "fid", 5.0)) == {1: [[(-5, 5), (0, 5)], [(4, 5), (5, 5), (5, 15)]], 2: [[(20, 20), (30, 20)]]}
    assert sorted((r["lid"], r["source"]) for r in vector.union_lines(lines, area, "lid", "fid", 5.0).collect()) == [(1, "split")] * 3 + [(2, "split")] * 2
