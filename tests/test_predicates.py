"""Coverings, exact joins and the packed tree against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_kernels import shapes

from geoloom.functions import covering, polygons, rtree
from geoloom.functions import geometry as G
from geoloom.operators import overlay, predicates, vector


def star(rng, x, y, r, n):
    t, far = np.sort(rng.uniform(0, 2 * np.pi, n)), r * rng.uniform(0.4, 1, n)
    return np.stack([x + far * np.cos(t), y + far * np.sin(t)], 1)


def table(spark, areas, name="fid"):
    """Polygons of rings, closed here."""
    rows = [(k, ("Polygon", [[[tuple(map(float, p)) for p in [*r, r[0]]] for r in a]])) for k, a in enumerate(areas)]
    return G.with_box(spark.createDataFrame(rows, f"{name} long, geom {G.TYPE}"))


def size(rings):
    return sum(map(polygons.signed_area, rings))


def test_coverings(spark):
    rng = np.random.default_rng(0)
    for trial in range(30):
        edges = polygons.edges_of([star(rng, *rng.uniform(-20, 20, 2), rng.uniform(0.1, 15), rng.integers(3, 40))])
        level, cx, cy, inside, corner, first, held = covering.cover(edges, True, 1.0)
        x, y, side = covering.box_of(level, cx, cy, 1.0)
        inner, whole = (side[inside] ** 2).sum(), polygons.edges_of([edges[:, :2]])
        area = abs(polygons.signed_area(edges[:, :2]))
        assert inner <= area + 1e-9 <= inner + (~inside).sum() + 1e-6 and len(whole) == len(edges)
        points = rng.uniform(-40, 40, (500, 2))
        want = polygons.inside(points, edges)
        assert (covering.inside_rows(*points.T, edges) == want).all()
        at = (points[:, None, 0] >= x) & (points[:, None, 0] < x + side) & (points[:, None, 1] >= y) & (points[:, None, 1] < y + side)
        assert (at.sum(1) <= 1).all() and at.any(1)[want].all() and not (at & inside)[~want].any()


@pytest.fixture(scope="module")
def areas():
    rng = np.random.default_rng(4)
    a = [[star(rng, *rng.uniform(-20, 20, 2), rng.uniform(0.05, 3) if k % 2 else rng.uniform(3, 12), rng.integers(3, 20))] for k in range(50)]
    b = [[star(rng, *rng.uniform(-20, 20, 2), rng.uniform(0.3, 12), rng.integers(3, 20))] for _ in range(50)]
    for k in range(0, 50, 3):
        ring = b[k][0]
        b[k] = polygons.repaired([ring, (ring - ring.mean(0)) * 0.3 + ring.mean(0)]) or b[k]
    return a, b


@pytest.mark.parametrize("cell", [0.7, 4.0, 60.0])
def test_spatial_joins(spark, areas, cell):
    a, b = areas
    own, other = table(spark, a), table(spark, b, "oid")
    common = {(i, j): size(polygons.intersection(x, y)) for i, x in enumerate(a) for j, y in enumerate(b)}
    met = {k for k, v in common.items() if v > 1e-9}
    assert {tuple(r) for r in predicates.spatial_join(own, other, "fid", "oid", "intersects", cell).collect()} == met
    inner = {(i, j) for i, j in met if size(polygons.difference(a[i], b[j])) < 1e-7}
    assert {tuple(r) for r in predicates.spatial_join(own, other, "fid", "oid", "within", cell).collect()} == inner and len(inner) > 5
    assert {tuple(r) for r in predicates.spatial_join(other, own, "oid", "fid", "contains", cell).collect()} == {(j, i) for i, j in inner}


def test_borders_lines_and_points(spark):
    square = [np.array([(0.0, 0), (10, 0), (10, 10), (0, 10)]), np.array([(4.0, 4), (6, 4), (6, 6), (4, 6)])]
    area = table(spark, [square], "oid")
    beside = {0: [(10.0, 2), (12, 2), (12, 4), (10, 4)], 1: [(10.0, 10), (11, 10), (11, 11)], 2: [(4.5, 4.5), (5, 4.5), (5, 5)], 3: [(4.0, 4), (6, 4), (6, 6), (4, 6)], 4: [(0.0, 0), (4, 0), (4, 4)], 5: [(10.01, 2), (12, 2), (12, 4)], 6: [(1.0, 1), (9, 1), (9, 9), (1, 9)]}
    own = table(spark, [[np.array(beside[k])] for k in range(7)])
    met = lambda t, how: {r[0] for r in predicates.spatial_join(t, area, "fid", "oid", how, 3.0).collect()}
    assert met(own, "intersects") == {0, 1, 3, 4, 6} and met(own, "within") == {4}
    lines = {0: [(-1.0, 5), (3, 5)], 1: [(1.0, 1), (3, 1), (3, 9)], 2: [(0.0, 0), (10, 0)], 3: [(4.5, 5), (5.5, 5)], 4: [(-1.0, -1), (-5, 3)], 5: [(3.0, 5), (7, 5)], 6: [(0.0, 0), (0, 10), (5, 10), (5, 9)]}
    rows = spark.createDataFrame([(k, ("LineString", [[[tuple(map(float, p)) for p in v]]])) for k, v in lines.items()], f"fid long, geom {G.TYPE}")
    assert met(rows, "intersects") == {0, 1, 2, 5, 6} and met(rows, "within") == {1, 6}
    points = {0: (5.0, 5), 1: (2.0, 2), 2: (10.0, 3), 3: (4.0, 5), 4: (11.0, 3)}
    rows = spark.createDataFrame([(k, ("Point", [[[tuple(map(float, v))]]])) for k, v in points.items()] + [(9, None), (8, ("Polygon", []))], f"fid long, geom {G.TYPE}")
    assert met(rows, "intersects") == {1, 2, 3} and met(rows, "within") == {1}
    none = rows.limit(0)
    assert met(none, "intersects") == set() and met(none, "within") == set()
    assert predicates.spatial_join(own, none.withColumnRenamed("fid", "g"), "fid", "g", "within", 1.0).count() == 0
    with pytest.raises(ValueError):
        predicates.spatial_join(own, area, "fid", "oid", "near", 1.0)


def test_exact_extent(spark):
    corner = table(spark, [[np.array([(0.0, 0), (10, 0), (0, 10)])], [np.array([(-5.0, -5), (20, -5), (20, 20), (-5, 20)]), np.array([(-4.0, -4), (19, -4), (19, 19), (-4, 19)])], [np.array([(-50.0, -50), (50, -50), (0, 50)])]])
    assert {r["fid"] for r in predicates.meets_extent(corner, (6, 6, 9, 9)).collect()} == {2}
    assert {r["fid"] for r in predicates.meets_extent(corner, (5, 5, 9, 9)).collect()} == {0, 2}


def test_packed_tree():
    rng = np.random.default_rng(1)
    for n, m in ((1, 5), (17, 40), (3000, 200), (5, 0)):
        low = rng.uniform(0, 100, (n, 2))
        held = np.hstack([low, low + rng.exponential(2, (n, 2))])
        low = rng.uniform(0, 100, (m, 2))
        asked = np.hstack([low, low + rng.exponential(3, (m, 2))])
        i, j = rtree.PackedTree(held).meeting(asked)
        met = (asked[:, None, 0] <= held[:, 2]) & (held[:, 0] <= asked[:, None, 2]) & (asked[:, None, 1] <= held[:, 3]) & (held[:, 1] <= asked[:, None, 3])
        assert (np.diff(i) >= 0).all() and set(zip(i.tolist(), j.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(met))))


def test_index_and_grid_give_the_same_pairs(spark, areas):
    a, b = (table(spark, x, n) for x, n in zip(areas, ("fid", "oid"), strict=True))
    by_index = vector.near_pairs(a, b, "fid", "oid", 4.0)
    plan = by_index._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan
    by_grid = vector.near_pairs(a, b, "fid", "oid", 4.0, most=10)
    assert "Join" in by_grid._jdf.queryExecution().executedPlan().toString()
    assert sorted(by_index.collect()) == sorted(by_grid.select(*by_index.columns).collect())
    assert vector.near_pairs(a, b.limit(0), "fid", "oid", 4.0).count() == 0


def test_contained_features_stay_as_they_are(spark):
    odd = np.array([(0.1, 0.2), (3.3, 0.30000000000000004), (3.0, 1.0), (3.1, 2.7), (0.7, 1.9)])
    wide = [np.array([(-9.0, -9), (1.7, -11), (1.7, 15), (-9, 12)]), np.array([(1.5, -10.0), (20, -10), (21, 14), (1.5, 14)])]
    out = overlay.clip(shapes(spark, [odd]), shapes(spark, wide).withColumnRenamed("fid", "oid"), "fid", "oid", 4.0).first()
    rings = polygons.from_struct(out["geom"])
    assert len(rings) == 1 and {tuple(p) for p in rings[0]} == {tuple(p) for p in odd}


def test_touching_is_exact():
    a = [np.array([(0.0, 0), (4, 0), (0, 4)])]
    for other, met in (([(2.0, 2), (5, 5), (5, 2)], True), ([(2.01, 2), (5, 5), (5, 2)], False), ([(1.0, 1), (1.5, 1), (1, 1.5)], True), ([(-9.0, -9), (30, -9), (-9, 30)], True), ([(4.0, 0), (8, 0), (8, 1)], True)):
        assert polygons.touches(a, [np.array(other)]) is met and polygons.touches([np.array(other)], a) is met
    hole = [np.array([(-5.0, -5), (9, -5), (9, 9), (-5, 9)]), np.array([(-1.0, -1), (-1, 5), (5, 5), (5, -1)])]
    assert not polygons.touches(a, hole) and not polygons.within(a, hole) and polygons.within([np.array([(6.0, 6), (8, 6), (8, 8)])], hole)


def test_numbers_beyond_the_bounds_are_refused(spark):
    from geoloom.operators import segment
    from geoloom.sources import fixtures  # noqa: F401

    rows = lambda *r: spark.createDataFrame([(0, 1, *x) for x in r], "raster_id long, band int, row int, col int, value double")
    assert segment.components(rows((0, 262143, 1.0), (1, 0, 2.0))).select("label").distinct().count() == 2
    for bad in (rows((0, 262144, 1.0), (1, 0, 2.0)), rows((-1, 0, 1.0)), rows((0, 0, 1.0)).withColumn("raster_id", F.lit(1 << 21).cast("long")), rows((0, 0, 1.0)).withColumn("band", F.lit(64))):
        with pytest.raises(Exception, match="no pixel number"):
            segment.components(bad).collect()


def test_a_layer_among_many_is_found(spark):
    many = spark.range(3000).select(F.col("id").alias("fid"), F.concat(F.lit("layer"), "id").alias("layer"))
    assert vector.layer(many, "layer2999").count() == 1
    with pytest.raises(ValueError, match="no layer"):
        vector.layer(many, "layer3000")
