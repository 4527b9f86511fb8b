"""Geometry as a struct of kind and parts, and expressions over it.

``STRUCT<kind STRING, parts ARRAY<ARRAY<ARRAY<STRUCT<x DOUBLE, y DOUBLE>>>>>``: parts,
rings, vertices.  Ring 0 of an area is its shell, the others are holes; a line is a
part of one ring; a point a part of one ring of one vertex.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPE = "struct<kind:string,parts:array<array<array<struct<x:double,y:double>>>>>"
_BOX = ["xmin", "ymin", "xmax", "ymax"]
RANKS = {"Point": 0, "MultiPoint": 0, "LineString": 1, "MultiLineString": 1, "Polygon": 2, "MultiPolygon": 2}


def vertex(x: Column, y: Column) -> Column:
    """One vertex."""
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def geometry(kind: str, parts: Column) -> Column:
    """A geometry of a kind from its parts."""
    return F.struct(F.lit(kind).alias("kind"), parts.alias("parts"))


def point(x: Column, y: Column) -> Column:
    """A point."""
    return geometry("Point", F.array(F.array(F.array(vertex(x, y)))))


def segment(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A line of two vertices."""
    return geometry("LineString", F.array(F.array(F.array(vertex(x0, y0), vertex(x1, y1)))))


def rectangle(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """A rectangle, counter-clockwise and closed."""
    return geometry("Polygon", F.array(F.array(F.array(vertex(xmin, ymin), vertex(xmax, ymin), vertex(xmax, ymax), vertex(xmin, ymax), vertex(xmin, ymin)))))


def vertices(geom: Column) -> Column:
    """All vertices in one array."""
    return F.flatten(F.flatten(geom["parts"]))


def map_vertices(geom: Column, f: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The geometry with each vertex mapped."""
    move = lambda v: vertex(*f(v["x"], v["y"]))
    return F.struct(geom["kind"].alias("kind"), F.transform(geom["parts"], lambda p: F.transform(p, lambda r: F.transform(r, move))).alias("parts"))


def with_box(features: DataFrame, geom: str = "geom") -> DataFrame:
    """Features with their box in xmin, ymin, xmax, ymax; null for empty geometries."""
    return features.withColumns({f"{a}{c}": F.expr(f"array_{c}(flatten(flatten({geom}.parts)).{a})") for c in ("min", "max") for a in "xy"}).select(*[c for c in features.columns if c not in _BOX], *_BOX)


def ring_area(ring: Column) -> Column:
    """Unsigned area by the shoelace formula."""
    return F.abs(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1))), F.lit(0.0), lambda s, k: s + F.coalesce(F.try_element_at(ring, k)["x"] * F.try_element_at(ring, k + 1)["y"] - F.try_element_at(ring, k + 1)["x"] * F.try_element_at(ring, k)["y"], F.lit(0.0)))) / 2


def ring_length(ring: Column) -> Column:
    """Length along the vertices."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1))), F.lit(0.0), lambda s, k: s + F.coalesce(F.hypot(F.try_element_at(ring, k + 1)["x"] - F.try_element_at(ring, k)["x"], F.try_element_at(ring, k + 1)["y"] - F.try_element_at(ring, k)["y"]), F.lit(0.0)))


def area(geom: Column) -> Column:
    """Shells less holes; 0 for points and lines."""
    part = lambda s, p: s + F.aggregate(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(1))), ring_area(F.element_at(p, 1)), lambda t, r: t - ring_area(r))
    return F.when(rank(geom) == 2, F.aggregate(geom["parts"], F.lit(0.0), part)).otherwise(0.0)


def length(geom: Column) -> Column:
    """Length of lines, perimeter of areas, 0 for points."""
    return F.aggregate(F.flatten(geom["parts"]), F.lit(0.0), lambda s, r: s + ring_length(r))


def kind(geom: Column) -> Column:
    """The kind's name."""
    return geom["kind"]


def is_empty(geom: Column) -> Column:
    """No geometry or no vertex."""
    return geom.isNull() | (F.size(vertices(geom)) <= 0)


def rank(geom: Column) -> Column:
    """0 points, 1 lines, 2 areas, -1 unknown."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), geom["kind"]), F.lit(-1))


def promoted(geom: Column) -> Column:
    """Single kinds as their multi kind, for a multi layer."""
    k = geom["kind"]
    return F.struct(F.when(k.isin("Point", "LineString", "Polygon"), F.concat(F.lit("Multi"), k)).otherwise(k).alias("kind"), geom["parts"].alias("parts"))


def is_box(geom: str = "geom") -> Column:
    """Whether the area in a column is one rectangle along the axes, told by its five vertices."""
    ring = f"get(get({geom}.parts, 0), 0)"
    at_corner = " AND ".join(f"v.{a} IN (array_min({ring}.{a}), array_max({ring}.{a}))" for a in "xy")
    along = f"forall(sequence(1, 4), k -> (try_element_at({ring}, k).x = try_element_at({ring}, k + 1).x) <> (try_element_at({ring}, k).y = try_element_at({ring}, k + 1).y))"
    around = f"get({ring}, 0) = get({ring}, 4) AND get({ring}, 0) <> get({ring}, 2) AND get({ring}, 1) <> get({ring}, 3)"
    return F.expr(f"coalesce({geom}.kind IN ('Polygon', 'MultiPolygon') AND size({geom}.parts) = 1 AND size(get({geom}.parts, 0)) = 1 AND size({ring}) = 5 AND forall({ring}, v -> {at_corner}) AND {along} AND {around}, false)")


def box_area(xmin: str, ymin: str, xmax: str, ymax: str) -> Column:
    """A MultiPolygon of one rectangle from SQL expressions of its sides."""
    ring = ", ".join(f"named_struct('x', CAST({x} AS DOUBLE), 'y', CAST({y} AS DOUBLE))" for x, y in ((xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)))
    return F.expr(f"named_struct('kind', 'MultiPolygon', 'parts', array(array(array({ring}))))")


def contains_point(geom: Column, x: Column, y: Column) -> Column:
    """Whether an area holds a point, by the crossing number over all rings: holes fall out; a point on a left or lower edge is inside."""

    def crosses(ring: Column) -> Column:
        def step(s: Column, k: Column) -> Column:
            a, b = F.element_at(ring, k), F.element_at(ring, k + 1)
            hit = ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])
            return s + hit.cast("int")

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1))), F.lit(0), lambda s, k: F.when(F.size(ring) > 1, step(s, k)).otherwise(s))

    return F.aggregate(F.flatten(geom["parts"]), F.lit(0), lambda s, r: s + crosses(r)) % 2 == 1


def to_geojson(geom: Column) -> Column:
    """A GeoJSON geometry as text."""
    pts = lambda r: F.transform(r, lambda v: F.array(v["x"], v["y"]))
    rings = lambda p: F.transform(p, pts)
    p = geom["parts"]
    nested = {
        "Point": F.to_json(pts(F.flatten(p)[0])), "MultiPoint": F.to_json(pts(F.flatten(F.flatten(p)))), "LineString": F.to_json(pts(F.flatten(p)[0])),
        "MultiLineString": F.to_json(F.transform(F.flatten(p), pts)), "Polygon": F.to_json(rings(p[0])), "MultiPolygon": F.to_json(F.transform(p, rings)),
    }
    text = None
    for name, value in nested.items():
        if name == "Point":
            value = F.regexp_replace(value, r"^\[(.*)\]$", "$1")
        text = F.when(geom["kind"] == name, value) if text is None else text.when(geom["kind"] == name, value)
    return F.concat(F.lit('{"type":"'), geom["kind"], F.lit('","coordinates":'), text, F.lit("}"))


def from_geojson(text: Column) -> Column:
    """The geometry of a GeoJSON text; null where its kind is unknown."""
    xy = lambda a: vertex(a[0], a[1])
    kind_of = F.get_json_object(text, "$.type")
    coords = F.get_json_object(text, "$.coordinates")
    read = lambda depth: F.from_json(coords, "array<" * depth + "double" + ">" * depth)
    ring = lambda r: F.transform(r, xy)
    parts = (
        F.when(kind_of == "Point", F.array(F.array(F.array(xy(read(1))))))
        .when(kind_of == "MultiPoint", F.transform(read(2), lambda v: F.array(F.array(xy(v)))))
        .when(kind_of == "LineString", F.array(F.array(ring(read(2)))))
        .when(kind_of == "MultiLineString", F.transform(read(3), lambda r: F.array(ring(r))))
        .when(kind_of == "Polygon", F.array(F.transform(read(3), ring)))
        .when(kind_of == "MultiPolygon", F.transform(read(4), lambda p: F.transform(p, ring)))
    )
    return F.when(parts.isNotNull(), F.struct(kind_of.alias("kind"), parts.alias("parts")))
