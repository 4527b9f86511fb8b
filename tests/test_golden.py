"""Small inputs with known answers, and the refusal of bad arguments."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.functions import params, polygons
from geoloom.operators import focal, graph, matching, mosaic, overlay, project, raster, segment, vector, zonal
from geoloom.plans import registry
from geoloom.sources import io


def image(spark, grid, band=1, rid=0):
    rows = [(rid, band, y, x, float(v)) for y, line in enumerate(grid) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "raster_id long, band int, row int, col int, value double")


def grid_of(df, h, w):
    out = np.full((h, w), np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = r["value"]
    return out


def square(spark, x0, y0, x1, y1, fid=1, **more):
    row = {"fid": fid, "xmin": float(x0), "ymin": float(y0), "xmax": float(x1), "ymax": float(y1)} | more
    return vector.rectangles(spark.createDataFrame([row]))


def test_histogram_counts_every_pixel(spark):
    grid = np.arange(10000).reshape(100, 100) % 256
    assert raster.histogram(image(spark, grid), 16).agg(F.sum("count")).first()[0] == 10000
    assert raster.histogram(image(spark, np.full((5, 5), 3)), 4).count() == 0


def test_ndvi_and_brovey(spark):
    four = [image(spark, np.full((3, 3), v), b) for b, v in enumerate((10, 20, 30, 70), 1)]
    stack = four[0].union(four[1]).union(four[2]).union(four[3])
    assert {round(r["value"], 6) for r in raster.ndvi(stack).collect()} == {0.4}
    multi = image(spark, np.full((3, 3), 30), 1).union(image(spark, np.full((3, 3), 50), 2)).union(image(spark, np.full((3, 3), 70), 3))
    out = raster.pansharpen(multi, image(spark, np.full((3, 3), 120)), [1, 2, 3])
    assert {(r["band"], round(r["value"], 3)) for r in out.collect()} == {(1, 72.0), (2, 120.0), (3, 168.0)}


def test_change_counts_a_block(spark):
    a, b = np.full((20, 20), 10), np.full((20, 20), 10)
    b[5:8, 4:8] = 80
    row = raster.change_summary(raster.change(image(spark, a), image(spark, b)), 1).first()
    assert (row["changed"], round(row["ratio"], 6)) == (12, 0.03)
    with pytest.raises(Exception, match="sizes do not match"):
        raster.change(image(spark, a), image(spark, np.full((28, 28), 1))).collect()


def test_zonal_priority(spark):
    high = np.zeros((10, 10), int)
    high[:4, :4] = 1
    px = image(spark, high).withColumn("priority", F.lit(0)).union(image(spark, np.full((10, 10), 2)).withColumn("priority", F.lit(1))).withColumn("nodata", F.lit(0.0))
    zone = square(spark, 0, 0, 100, 100, fname="area1")
    cells = vector.rasterize(zone, (0.0, 10.0, 0.0, 100.0, 0.0, -10.0)).select("fid", "row", "col")
    found = zonal.resolved(cells, px, zonal.parse_class_map(spark, '{"1": "class1", "2": "class2"}'), ["fid"])
    records = zonal.with_summary(zonal.feature_stats(zone, found, 100.0, "EPSG:3857"))
    assert {(r["feature_id"], r["class_value"], r["pixel_count"]) for r in records.collect()} == {("1", 1, 16), ("1", 2, 84), ("__summary__", 1, 16), ("__summary__", 2, 84)}
    with pytest.raises(ValueError, match="target_epsg"):
        zonal.target_srs([4326])
    assert zonal.target_srs([3857, 4326]) == 3857


def test_line_is_cut_by_a_square(spark):
    lines = spark.createDataFrame([(1, 0.0, 0.0, 200.0, 0.0)], "lid long, x0 double, y0 double, x1 double, y1 double")
    box = square(spark, 80, -20, 120, 20)
    inside = vector.inside_stretches(vector.clip_lines_to_boxes(lines, box, "lid", "fid", 50), "lid")
    part = vector.cut_lines(lines, inside, "lid").first()["geom"]
    assert part["kind"] == "MultiLineString" and [(v["x"], v["y"]) for v in part["parts"][0][0]] == [(80, 0), (120, 0)]
    outside = vector.outside_stretches(lines, inside, "lid")
    assert sorted((r["t0"], r["t1"]) for r in outside.collect()) == [(0.0, 0.4), (0.6, 1.0)]
    nested = square(spark, 25, 25, 75, 75).union(square(spark, 30, 30, 70, 70, 2)).union(square(spark, 35, 35, 65, 65, 3))
    with pytest.raises(ValueError, match="overlap"):
        overlay.require_simple_overlay(nested, "fid", 20)


def test_dissolve_and_repair(spark):
    two = square(spark, 0, 0, 100, 100, 1, type="A").union(square(spark, 100, 0, 200, 100, 2, type="A"))
    row = overlay.dissolve(two, "type", 50).first()
    assert row["geom"]["kind"] == "MultiPolygon" and len(row["geom"]["parts"]) == 1 and polygons.signed_area(polygons.from_struct(row["geom"])[0]) == pytest.approx(20000)
    with pytest.raises(ValueError, match="no field"):
        overlay.dissolve(two, "missing")
    tie = [np.array([(50.0, 50), (150, 150), (150, 50), (50, 150)])]
    assert sum(map(polygons.signed_area, polygons.repaired(tie))) == pytest.approx(5000)


def test_overlay_areas_add_up():
    rng = np.random.default_rng(0)
    size = lambda r: sum(map(polygons.signed_area, r))
    for _ in range(60):
        a, b = ([polygons.hull(rng.random((8, 2)) * 10 + rng.random(2) * 4)] for _ in range(2))
        both, only, either = polygons.intersection(a, b), polygons.difference(a, b), polygons.union(a, b)
        assert size(both) + size(only) == pytest.approx(size(a), abs=1e-6)
        assert size(only) + size(b) == pytest.approx(size(either), abs=1e-6)
    ring = polygons.difference([np.array([(0.0, 0), (10, 0), (10, 10), (0, 10)])], [np.array([(4.0, 4), (6, 4), (6, 6), (4, 6)])])
    assert [len(p) for p in polygons.nested(ring)] == [2] and size(ring) == pytest.approx(96)


def test_buffer_of_lines_and_refusals(spark):
    rows = [(k, float(k), 0.0, k + 10.0, 5.0) for k in range(20)]
    lines = spark.createDataFrame(rows, "lid long, x0 double, y0 double, x1 double, y1 double").withColumn("geom", G.segment(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]))
    out = overlay.buffer(lines, 25, 3857)
    want = 2 * 25 * np.hypot(10, 5) + 60 * 625 * np.sin(np.pi / 60)
    assert all(r[0] == pytest.approx(want, rel=1e-3) for r in out.select(G.area(F.col("geom"))).collect())
    assert overlay.buffer_report(lines, out, 25).first().asDict() == {"feature_count": 20, "buffered_count": 20, "distance": "25", "srs_type": "projected"}
    with pytest.raises(ValueError):
        overlay.buffer(lines, 25, 4326)


def test_clip_mosaic_split(spark):
    gt = (116.0, 0.001, 0.0, 40.0, 0.0, -0.001)
    part = mosaic.clip_extent(image(spark, np.full((10, 20), 5)), (116.005, 39.994, 116.012, 39.998), gt)
    assert part.agg(F.max("col") + 1, F.max("row") + 1).first()[:] == (7, 4)
    a, b = image(spark, np.full((6, 10), 10)), image(spark, np.full((6, 10), 30))
    m = grid_of(mosaic.mosaic([(a, gt), (b, (116.01, *gt[1:]))]), 6, 20)
    assert (m[2, 2], m[2, 15]) == (10, 30)
    assert mosaic.split(image(spark, np.zeros((20, 30))), 16).select("tile").distinct().count() == 4


def test_tiles_agree_with_one_tile(spark):
    rng = np.random.default_rng(3)
    px = image(spark, rng.integers(0, 255, (40, 37)))
    for run in (lambda t: focal.filtered(px, "gaussian", 5, tile=t), lambda t: focal.filtered(px, "morph_close", 5, tile=t), lambda t: focal.corner_response(px, tile=t)):
        assert np.allclose(grid_of(run(16), 40, 37), grid_of(run(256), 40, 37))
    assert grid_of(focal.filtered(px, "morph_open", 3), 40, 37).max() <= 1


def test_components_watershed_contours(spark):
    grid = np.zeros((30, 30), int)
    grid[2:12, 2:12] = 200
    grid[5:8, 5:8] = 0  # a hole, which is filled
    grid[20:26, 18:28] = 220
    px = image(spark, grid)
    for tile in (7, 256):
        assert segment.components(px, 4, tile).select("label").distinct().count() == 4
    assert sorted(r["area"] for r in segment.contours(px, 10).collect()) == [45.0, 81.0]
    ramp = image(spark, np.abs(np.arange(20) - 10)[None, :].repeat(6, 0))
    markers = spark.createDataFrame([(0, 1, 3, 2, 1), (0, 1, 3, 17, 2)], "raster_id long, band int, row int, col int, label long")
    for tile in (5, 256):
        out = {r["label"] for r in segment.watershed(ramp, markers, tile).collect()}
        assert out == {1, 2}
    chain = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101)], "a long, b long")
    assert {r["component"] for r in graph.connected_components(chain).collect()} == {0, 100}
    assert graph.connected_components(chain.limit(0)).count() == 0


def test_projection_of_known_points(spark):
    p = spark.createDataFrame([(116.0, 40.0)], "x double, y double")
    m = project.transform_points(p, 4326, "EPSG:3857").first()
    assert (round(m["x"]), round(m["y"])) == (12913061, 4865942)
    u = project.transform_points(spark.createDataFrame([(117.0, 0.0)], "x double, y double"), 4326, 32650).first()
    assert (round(u["x"], 3), round(u["y"], 3)) == (500000.0, 0.0)
    with pytest.raises(ValueError):
        project.transform_points(p, 4326, 2154)


def test_suppression_is_the_greedy_set(spark):
    rng = np.random.default_rng(5)
    pts = sorted({(int(y), int(x)) for y, x in rng.integers(0, 60, (150, 2))})
    rows = [(0, y, x, float(rng.random())) for y, x in pts]
    kept = []
    for _, y, x, v in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if all(abs(y - a) >= 6 or abs(x - b) >= 6 for a, b, _ in kept):
            kept.append((y, x, v))
    got = matching.suppressed(spark.createDataFrame(rows, "raster_id long, row int, col int, response double"), 6)
    assert sorted((r["row"], r["col"]) for r in got.collect()) == sorted((y, x) for y, x, _ in kept)


def test_transforms_are_recovered(spark):
    rng = np.random.default_rng(2)
    src = rng.random((60, 2)) * 100
    true = np.array([[0.9, -0.2, 5], [0.2, 0.9, -3], [0, 0, 1]])
    dst = src @ true[:2, :2].T + true[:2, 2]
    dst[:15] += rng.random((15, 2)) * 80 + 20  # outliers
    table = spark.createDataFrame([tuple(map(float, (*s, *d))) for s, d in zip(src, dst, strict=True)], "x1 double, y1 double, x2 double, y2 double")
    for model in ("similarity", "affine", "projective"):
        assert np.allclose(matching.fit_transform(table, model), true, atol=1e-6)
    with pytest.raises(ValueError, match="4 matches"):
        matching.fit_transform(table.limit(3), "affine")


def test_tiff_and_parameters(spark, tmp_path):
    grid = np.arange(12, dtype="<u2").reshape(3, 4)
    raw = zlib.compress(grid.tobytes())
    tags = [(256, 3, 1, 4), (257, 3, 1, 3), (258, 3, 1, 16), (259, 3, 1, 8), (273, 4, 1, 8), (277, 3, 1, 1), (278, 3, 1, 3), (279, 4, 1, len(raw)), (339, 3, 1, 1)]
    head = b"II*\0" + struct.pack("<I", 8 + len(raw)) + raw + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + b"\0\0\0\0"
    (tmp_path / "a.tif").write_bytes(head)
    got = io.read_geotiffs(spark, f"file://{tmp_path}")
    assert (grid_of(got, 3, 4) == grid).all()
    assert params.extent("0,0,1,1") == (0, 0, 1, 1) and params.kernel(4) == 5 and params.flag("Yes") is True and params.epsg("EPSG:3857") == 3857
    for bad in (lambda: params.extent("1,1,0,0"), lambda: params.one_of("m", "x", ("a",)), lambda: params.in_range("k", 0, 1), lambda: params.flag("maybe"), lambda: raster.band_expression("B1 +"), lambda: raster.band_expression("B1; drop")):
        with pytest.raises(ValueError):
            bad()


def test_tiles_are_pruned(spark, tmp_path):
    grid = np.arange(40 * 40).reshape(40, 40)
    path = f"file://{tmp_path}/tiles"
    io.write_tiles(image(spark, grid).union(image(spark, grid, rid=7)), path, 8)
    cells = spark.createDataFrame([(7, 3, 5), (7, 4, 6), (0, 30, 39)], "raster_id long, row int, col int")
    got = io.read_tiles(spark, path, cells, 8)
    assert {(r["raster_id"], r["row"] // 8, r["col"] // 8) for r in got.collect()} == {(7, 0, 0), (0, 3, 4)} and got.count() == 128
    assert all(r["value"] == r["row"] * 40 + r["col"] for r in got.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "ty#" in plan.split("PartitionFilters: [")[1]
    assert io.read_tiles(spark, path).count() == 3200 and io.read_tiles(spark, path, cells.select("row", "col"), 8, most=0).count() == 256
    assert io.read_tiles(spark, path, cells.limit(0), 8).count() == 0


def test_layers_and_bad_filters(spark):
    two = square(spark, 0, 0, 1, 1, layer="a").union(square(spark, 0, 0, 1, 1, 2, layer="b"))
    assert vector.layer(two, "a").count() == 1
    assert vector.layer(two.where("layer = 'a'"), "zzz").count() == 1
    with pytest.raises(ValueError):
        vector.layer(two, "zzz")
    with pytest.raises(Exception):
        vector.filter_features(two, where="no_such_column > 1").count()
    with pytest.raises(ValueError):
        vector.filter_features(two)


def test_neighbours_are_sought_among_all_rows(spark, tmp_path):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(401, 8)).astype("f4").astype(float)
    v[100], v[300] = v[0] + 0.01, v[200] + 0.01  # queries that are each other's nearest
    spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    v = v.astype("f4").astype(float)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = {(q, int(t), k + 1) for q in range(0, 401, 100) for k, t in enumerate(np.argsort(d[q])[:2])}
    queries = registry.queries()
    assert {(r["query_id"], r["train_id"], r["rank"]) for r in queries["k2_two_nearest"](spark, str(tmp_path)).collect()} == want
    clear = {(q, int(np.argmin(d[q]))) for q in range(0, 401, 100) if np.sort(d[q])[0] < 0.95 * np.sort(d[q])[1]}
    assert {(0, 100), (100, 0), (200, 300), (300, 200)} <= clear
    for name in ("k2_match", "k2_match_lsh"):
        assert {(r["idx1"], r["idx2"]) for r in queries[name](spark, str(tmp_path)).collect()} == clear, name


def test_lsh_recall_and_lone_queries(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(150, 16)) * 10
    train = np.concatenate([centres[rng.integers(0, 150, 3000)] + rng.normal(size=(3000, 16)), np.full((1, 16), 500.0), np.full((1, 16), 900.0)])
    asked = np.concatenate([centres[:100] + rng.normal(size=(100, 16)), np.full((1, 16), 501.0)])  # the last has one neighbour near and none else
    table = lambda v: spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, vec array<double>").repartition(4)
    q, t = table(asked), table(train)
    d = np.sqrt(((asked[:, None] - train[None]) ** 2).sum(2))
    true = {(k, int(n)) for k in range(len(asked)) for n in np.argsort(d[k])[:2]}
    x, y = np.repeat(asked, 2, axis=0), train[np.argsort(d, axis=1)[:, :2].ravel()]
    assert matching._plan_tables(x, y, train[:1024], 0.93, 32, 0.5, 1) is not None  # so that buckets are what is tested
    for part in (64, 2048):
        got = [(r["query_id"], r["train_id"]) for r in matching.lsh_nearest(q, t, part=part).collect()]
        assert len(got) == len(set(got)) == 2 * len(asked) and len(true & set(got)) >= 0.9 * len(true)
    assert (100, 3000) in {(r["idx1"], r["idx2"]) for r in matching.lsh_matches(q, t).collect()}


def test_large_templates(spark):
    rng = np.random.default_rng(12)
    grid = rng.integers(0, 256, (90, 75)).astype(float)
    grid[0, 0], grid[0, 1] = 0, 255  # so that stretching changes nothing
    part = grid[21:73, 13:54].copy()
    part[0, 0], part[0, 1] = 0, 255
    win = np.lib.stride_tricks.sliding_window_view(grid, part.shape)
    cross, mean = np.einsum("ijkl,kl->ij", win, part), part - part.mean()
    want = {"sqdiff": ((win - part) ** 2).sum((2, 3)), "ccorr": cross, "ccoeff_normed": (win * mean).sum((2, 3)) / np.sqrt((mean**2).sum() * ((win - win.mean((2, 3), keepdims=True)) ** 2).sum((2, 3)))}
    for method, scores in want.items():
        found = focal.template_scores(image(spark, grid), part, method, tile=16)
        assert np.allclose(grid_of(found, *scores.shape), scores)
        top = focal.best_match(found, method).first()
        assert (top["row"], top["col"]) == (21, 13) or method == "ccorr"


def test_a_template_of_512_by_512(spark):
    rng = np.random.default_rng(13)
    grid = np.kron(rng.integers(0, 256, (66, 66)), np.ones((8, 8)))
    grid[0, 0], grid[0, 1] = 0, 255
    part = grid[7 : 7 + 512, 11 : 11 + 512].copy()
    part[0, 0], part[0, 1] = 0, 255
    top = focal.best_match(focal.template_scores(image(spark, grid), part, "ccoeff_normed"), "ccoeff_normed").first()
    assert (top["row"], top["col"]) == (7, 11) and top["value"] == pytest.approx(1, abs=1e-3)


def test_inverted_file_is_exact(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(0, 10, (30, 8))
    vectors = [(k, (centres[k % 30] + rng.normal(0, 0.4, 8)).tolist()) for k in range(3000)] + [(3000 + k, centres[3].tolist()) for k in range(300)]
    t = spark.createDataFrame(vectors, "id long, vec array<double>")
    q = t.where("id % 50 = 0")
    want = sorted(map(tuple, matching.two_nearest(q, t, skip_own=True).select("query_id", "rank", "train_id", F.round("distance", 9)).collect()))
    for lists, part in ((None, 4096), (20, 64), (1, 500)):
        got = matching.pruned_nearest(q, t, lists, part=part, skip_own=True)
        assert sorted(map(tuple, got.select("query_id", "rank", "train_id", F.round("distance", 9)).collect())) == want
    pairs = matching.pruned_nearest(q, t, skip_own=True, compared=True).agg(F.sum("pairs")).first()[0]
    assert pairs < 0.1 * q.count() * t.count()
    few = matching.pruned_nearest(q.limit(2), t.limit(1))
    assert [r["rank"] for r in few.collect()] == [1, 1] and matching.pruned_nearest(q, t.limit(0)).count() == 0


def test_dissolve_of_many_rectangles(spark):
    rng = np.random.default_rng(8)
    at = rng.integers(-20, 20, (600, 2))
    rows = [{"fid": k, "xmin": float(x), "ymin": float(y), "xmax": float(x + 2), "ymax": float(y + 1), "kind": "a" if k % 3 else None} for k, (x, y) in enumerate(at)]
    shapes = vector.rectangles(spark.createDataFrame(rows, "fid long, xmin double, ymin double, xmax double, ymax double, kind string"))
    got = {r["kind"]: sum(map(polygons.signed_area, polygons.from_struct(r["geom"]))) for r in overlay.dissolve(shapes, "kind", 64, fan_in=8).collect()}
    for kind, some in (("a", [r for r in rows if r["kind"]]), ("", [r for r in rows if not r["kind"]])):
        cells = {(x, r["ymin"]) for r in some for x in (r["xmin"], r["xmin"] + 1)}
        assert got[kind] == pytest.approx(len(cells))
    assert len(got) == 2


def test_circles_are_found(spark):
    rows = {(0, round(y + r * np.sin(t)), round(x + r * np.cos(t)), y, x) for y, x, r in ((40, 40, 10), (80, 85, 7)) for t in np.linspace(0, 2 * np.pi, 200)}
    edges = spark.createDataFrame([(i, int(a), int(b), int(b - x), int(a - y)) for i, a, b, y, x in rows], "raster_id long, row int, col int, gx int, gy int")
    assert {(r["row"], r["col"], r["radius"]) for r in segment.hough_circles(edges, 3, 14).collect()} == {(40, 40, 10), (80, 85, 7)}
