"""Outlines put together from chains of many tasks, against one arrangement of the whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_golden import image
from test_kernels import area_of, size
from test_predicates import star, table

from geoloom.functions import covering, polygons
from geoloom.functions import geometry as G
from geoloom.operators import overlay, rings, segment


@pytest.fixture(scope="module")
def crowd():
    """Stars with holes, tiles that share their sides, and repeated shapes."""
    rng = np.random.default_rng(4)
    out = [[star(rng, *rng.uniform(0, 30, 2), rng.uniform(0.5, 4), rng.integers(3, 12))] for _ in range(80)]
    for k in range(0, 80, 5):
        ring = out[k][0]
        out[k] = polygons.repaired([ring, (ring - ring.mean(0)) * 0.4 + ring.mean(0)])
    tiles = [[np.array([(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)], float)] for x in range(5) for y in range(5)]
    return out + tiles + out[:10]


@pytest.mark.parametrize("cell, fan_in, most", [(16.0, 64, 1 << 20), (3.0, 8, 0), (100.0, 1000, 0)])
def test_dissolve_over_cells(spark, crowd, cell, fan_in, most):
    got = overlay.dissolve(table(spark, crowd), None, cell, fan_in, most=most).collect()
    assert len(got) == 1
    points = np.random.default_rng(1).uniform(-5, 36, (4000, 2))
    want = np.any([polygons.inside(points, polygons.edges_of(s)) for s in crowd], axis=0)
    assert (polygons.inside(points, polygons.edges_of(polygons.from_struct(got[0]["geom"]))) == want).all()
    whole = polygons.union_all([polygons.repaired(s) for s in crowd])
    assert area_of(got[0]["geom"]) == pytest.approx(size(whole), abs=1e-5) and len(polygons.from_struct(got[0]["geom"])) == len(whole)


def test_dissolve_of_keys_and_of_nothing(spark):
    grid = [[np.array([(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)], float)] for x in range(40) for y in range(40)]
    tiles = table(spark, grid).withColumn("half", F.when(F.col("fid") < 800, "west").when(F.col("fid") < 1599, "east"))
    got = {r["half"]: r["geom"] for r in overlay.dissolve(tiles, "half", 4.0, 8).collect()}
    assert {k: area_of(g) for k, g in got.items()} == {"west": 800.0, "east": 799.0, "": 1.0}
    assert [len(r) for r in polygons.from_struct(got["west"])] == [4]  # shared sides cancel, the outline is one rectangle
    assert overlay.dissolve(tiles.limit(0), "half", 4.0).collect() == []


def test_edges_and_their_reverse_are_cut_alike():
    rng = np.random.default_rng(2)
    edges = rng.uniform(-50, 50, (200, 4))
    grid = 2.0**-20
    a = covering.cut_at_cells(edges, np.ones(200, np.int64), 3.0, grid)
    b = covering.cut_at_cells(edges[:, [2, 3, 0, 1]], np.ones(200, np.int64), 3.0, grid)
    assert (a[2] == b[2]).all() and (a[3] == -b[3]).all() and (a[0] == b[0]).all()
    assert np.hypot(*(a[2][:, 2:] - a[2][:, :2]).T).sum() == pytest.approx(np.hypot(*(edges[:, 2:] - edges[:, :2]).T).sum(), rel=1e-6)
    for k in (0, 1):
        low = (a[k] - covering.SHIFT[k]) * 3.0
        assert (a[2][:, k::2].min(axis=1) >= low - 1e-5).all() and (a[2][:, k::2].max(axis=1) <= low + 3 + 1e-5).all()


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_circles_are_ranked(spark, most):
    rng = np.random.default_rng(3)
    ids, links, want, at = rng.permutation(500) + 7, [], {}, 0
    for n in (1, 2, 3, 8, 64, 422):
        circle = ids[at : at + n].tolist()
        start = circle.index(min(circle))
        circle = circle[start:] + circle[:start]
        links += list(zip(circle, circle[1:] + circle[:1], strict=True))
        want |= {i: (circle[0], k - n + 1) for k, i in enumerate(circle)}
        at += n
    got = {r["id"]: (r["ring"], r["place"]) for r in rings.linked_places(spark.createDataFrame(links, "id long, next long").repartition(4), most).collect()}
    assert got == want


def test_open_chains_are_an_error(spark):
    rows = [("a", [0.0, 1.0], [0.0, 0.0], False), ("a", [1.0, 1.0], [0.0, 1.0], False)]
    with pytest.raises(ValueError, match="do not close"):
        rings.rings_of_chains(spark.createDataFrame(rows, f"k string, {rings.CHAIN}"), ["k"])


def corners(labels):
    """Vertices of each label's outline: places where an odd number, or two diagonal ones, of four pixels have it."""
    wide = np.pad(labels, 1, constant_values=-1)
    four = np.stack([wide[:-1, :-1], wide[:-1, 1:], wide[1:, :-1], wide[1:, 1:]])
    out = {}
    for k in np.unique(labels):
        held = four == k
        out[k] = int((held.sum(0) % 2 == 1).sum() + 2 * ((held.sum(0) == 2) & (held[0] == held[3])).sum())
    return out


@pytest.mark.parametrize("tile, most", [(4, 0), (5, 1 << 20), (64, 1 << 20)])
def test_polygons_over_tiles(spark, tile, most):
    grid = np.random.default_rng(5).integers(0, 2, (17, 13))
    grid[3:14, 2:12] = 2
    grid[6:9, 5:8] = 1
    labelled = {(r["row"], r["col"]): r["label"] for r in segment.components(image(spark, grid)).collect()}
    labels = np.array([[labelled[y, x] for x in range(13)] for y in range(17)])
    got = G.with_box(segment.polygonize(image(spark, grid), (10.0, 2.0, 0.0, 50.0, 0.0, -3.0), tile=tile, most=most)).collect()
    want = corners(labels)
    assert {r["label"] for r in got} == set(want)
    points = np.stack(np.meshgrid(np.arange(13), np.arange(17)), -1).reshape(-1, 2)
    for r in got:
        shape = polygons.from_struct(r["geom"])
        assert len(r["geom"]["parts"]) == 1 and sum(map(len, shape)) == want[r["label"]]
        assert polygons.signed_area(shape[0]) > 0 and all(polygons.signed_area(h) < 0 for h in shape[1:])
        at = np.stack([10 + 2 * (points[:, 0] + 0.5), 50 - 3 * (points[:, 1] + 0.5)], 1)
        assert (polygons.inside(at, polygons.edges_of(shape)) == (labels[points[:, 1], points[:, 0]] == r["label"])).all()


def test_polygons_of_regions_that_meet_at_corners(spark):
    grid = np.eye(6)
    got = segment.polygonize(image(spark, grid), (0.0, 1.0, 0.0, 6.0, 0.0, -1.0), connectivity=8, tile=4).where("DN = 1").first()
    assert got["geom"]["kind"] == "MultiPolygon" and len(got["geom"]["parts"]) == 6 and area_of(got["geom"]) == 6


@pytest.mark.parametrize("connectivity, tile", [(4, 64), (8, 64), (4, 8), (8, 8)])
def test_regions_in_one_tile_need_no_linking(spark, monkeypatch, connectivity, tile):
    """A tile's polygons are whole if no other tile has pixels of theirs; only the rest is linked, and holes and missing pixels are right."""
    linked, link = [], segment.rings_of_chains
    monkeypatch.setattr(segment, "rings_of_chains", lambda *a: (linked.append(a[0].select("label").distinct().count()), link(*a))[1])
    grid = np.random.default_rng(8).integers(0, 3, (20, 18))
    pixels = image(spark, grid).where("pmod(hash(row, col), 11) <> 0")
    labels = np.full(grid.shape, -1)
    for r in segment.components(pixels, connectivity).collect():
        labels[r["row"], r["col"]] = r["label"]
    got = segment.polygonize(pixels, (0.0, 2.0, 0.0, 9.0, 0.0, 3.0), connectivity, tile).collect()  # upside down
    assert linked == [] if tile == 64 else 0 < linked[0] < len(got)
    assert sorted(r["label"] for r in got) == np.unique(labels[labels >= 0]).tolist()
    points, want = np.stack(np.meshgrid(np.arange(18), np.arange(20)), -1).reshape(-1, 2), corners(labels)
    for r in got:
        shape = polygons.from_struct(r["geom"])
        assert sum(map(len, shape)) == want[r["label"]] and r["DN"] == grid[labels == r["label"]][0]
        assert len(r["geom"]["parts"]) == (1 if connectivity == 4 else sum(polygons.signed_area(s) < 0 for s in shape))
        held = polygons.inside(points * (2, 3) + (1, 10.5), polygons.edges_of(shape))
        assert (held == (labels[points[:, 1], points[:, 0]] == r["label"])).all()


def within_reach(points, path, distance, corners):
    """Whether points lie in the sum of a path and a circle's polygon, segment by segment."""
    out = np.zeros(len(points), bool)
    for a, b in zip(path, path[1:], strict=False):
        ring = polygons.hull(np.concatenate([a + corners, b + corners]))
        out |= polygons.inside(points, polygons.edges_of([ring]))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_offset_curves(seed):
    rng = np.random.default_rng(seed)
    points, far = rng.uniform(-12, 12, (1500, 2)), float(rng.uniform(0.2, 2))
    corners = polygons.circle(far, 8)
    lines = [rng.uniform(-8, 8, (rng.integers(2, 9), 2)) for _ in range(2)]
    got = polygons.buffer("MultiLineString", [[r] for r in lines], far, 8)
    assert (polygons.inside(points, polygons.edges_of(got)) == np.any([within_reach(points, r, far, corners) for r in lines], axis=0)).all()
    ring = star(rng, *rng.uniform(-3, 3, 2), 6, rng.integers(3, 12))
    area = [ring, (ring - ring.mean(0)) * 0.5 + ring.mean(0)]
    held = polygons.inside(points, polygons.edges_of(area))
    rim = np.any([within_reach(points, np.concatenate([r, r[:1]]), far, corners) for r in area], axis=0)
    for distance, want in ((far, held | rim), (-far, held & ~rim)):
        assert (polygons.inside(points, polygons.edges_of(polygons.buffer("Polygon", [area], distance, 8))) == want).all()
    dots = rng.uniform(-8, 8, (5, 2))
    got = polygons.buffer("MultiPoint", [[p[None]] for p in dots], far, 8)
    assert (polygons.inside(points, polygons.edges_of(got)) == np.any([polygons.inside(points, polygons.edges_of([p + corners])) for p in dots], axis=0)).all()


def test_a_line_of_many_vertices():
    t = np.linspace(0, 40, 10_000)
    line = np.stack([t * 20, 30 * np.sin(t * 3)], 1)
    got = polygons.buffer("LineString", [[line]], 1.0, 30)
    length = np.hypot(*np.diff(line, axis=0).T).sum()
    assert len(got) == 1 and polygons.signed_area(got[0]) == pytest.approx(2 * length + np.pi, rel=2e-3)
