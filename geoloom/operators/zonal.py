"""Class statistics of zones over prioritised rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.graph import checkpointed, small_join
from geoloom.operators.project import is_geographic, reproject_features, transform
from geoloom.operators.vector import near_pairs, rasterize


def parse_class_map(spark, text: str) -> DataFrame:
    """``(class_value, class_name)`` from a JSON object of whole numbers to names; it must not be empty."""
    one = spark.createDataFrame([(text,)], "t string").select(F.explode(F.from_json("t", "map<string,string>")).alias("k", "class_name"))
    out = one.where(F.col("k").rlike("^[0-9]+$")).select(F.col("k").cast("int").alias("class_value"), "class_name")
    if not out.limit(1).count():
        raise ValueError("the class map has no class")
    return out


def target_grid(catalog: DataFrame) -> DataFrame:
    """The catalog row of the grid with the smallest pixel; ties go to the first source."""
    size = F.struct(F.abs(F.col("pixel_width") * F.col("pixel_height")).alias("area"), F.col("source_order").alias("k"))
    return catalog.agg(F.min_by(F.struct("raster_id", "pixel_width", "pixel_height", "source_order"), size).alias("m")).select("m.*")


def target_srs(srids: list[int], target: int | None = None) -> int:
    """The CRS all projected rasters agree on; geographic rasters alone need ``target``, projected ones that differ conflict."""
    if target:
        return target
    projected = {s for s in srids if not is_geographic(s)}
    if len(projected) > 1:
        raise ValueError(f"rasters have different projected CRS: {sorted(projected)}")
    if not projected:
        raise ValueError("rasters are geographic: target_epsg is required")
    return projected.pop()


def resolved(cells: DataFrame, pixels: DataFrame, classes: DataFrame, by: list[str]) -> DataFrame:
    """``(by.., row, col, class_value, class_name)``: for each zone pixel the first raster's value that is neither NoData nor unmapped.

    cells: zone pixels ``(row, col)`` and pixels: ``(row, col, priority, value, nodata)``, with
    the columns of ``by`` that each has.  One join, in which pixels don't move if the
    cells are few, and one pre-aggregated ``min_by``.
    """
    shared = [c for c in by if c in pixels.columns and c in cells.columns]
    mapped = pixels.where("value is not null and (nodata is null or value <> nodata)").withColumn("class_value", F.rint("value").cast("int")).join(F.broadcast(classes) if _small(classes) else classes, "class_value")
    both = small_join(mapped, cells.select(*[c for c in by if c in cells.columns], "row", "col"), [*shared, "row", "col"])
    best = both.groupBy(*by, "row", "col").agg(F.min_by(F.struct("class_value", "class_name"), "priority").alias("m"))
    return best.select(*by, "row", "col", "m.class_value", "m.class_name")


def _small(classes: DataFrame, most: int = 100_000) -> bool:
    return classes.limit(most + 1).count() <= most


def feature_stats(zones: DataFrame, found: DataFrame, pixel_area: float, srs: str, area_unit: str = "m2", by: tuple[str, ...] = ("fid",)) -> DataFrame:
    """One record for each zone and class: pixels, area and share of the zone's counted pixels.

    Class 0 is never counted.  A zone with nothing gives one empty record of class 0.
    """
    key = list(by)
    counted = found.where("class_value <> 0").groupBy(*key, "class_value", "class_name").agg(F.count("*").alias("pixel_count"))
    whole = F.sum("pixel_count").over(Window.partitionBy(*key))
    counted = counted.withColumn("ratio", F.col("pixel_count") / whole)
    out = zones.select(*key, "fname").join(counted, key, "left")
    zero = lambda c, v: F.coalesce(c, F.lit(v))
    return out.select(*[F.col(c) for c in key[:-1]], F.col(key[-1]).cast("string").alias("feature_id"), F.col("fname").alias("feature_name"), zero("class_value", 0).alias("class_value"), zero("class_name", "").alias("class_name"), zero("pixel_count", 0).alias("pixel_count"), (zero("pixel_count", 0) * pixel_area).alias("area"), zero("ratio", 0.0).alias("ratio"), F.lit(srs).alias("actual_srs"), F.lit(area_unit).alias("area_unit"))


def with_summary(records: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The records and one more for each class over all zones, its ratio by area."""
    key = list(by)
    rows = records.groupBy(*key, "class_value", "class_name").agg(F.sum("pixel_count").alias("pixel_count"), F.sum("area").alias("area"), F.first("actual_srs").alias("actual_srs"), F.first("area_unit").alias("area_unit"))
    total = F.sum("area").over(Window.partitionBy(*key) if key else Window.partitionBy(F.lit(1)))
    rows = rows.withColumn("ratio", F.when(total > 0, F.col("area") / total).otherwise(0.0))
    return records.unionByName(rows.select(*key, F.lit("__summary__").alias("feature_id"), F.lit("__summary__").alias("feature_name"), "class_value", "class_name", "pixel_count", "area", "ratio", "actual_srs", "area_unit"))


def class_raster(found: DataFrame, order: str = "fid", by: tuple[str, ...] = ()) -> DataFrame:
    """``(by.., row, col, value)``: the resolved classes of all zones; a later zone's class overwrites, 0 never does."""
    return found.where("class_value <> 0").groupBy(*by, "row", "col").agg(F.max_by("class_value", order).alias("value"))


GRID = ("ox", "px", "oy", "py", "width", "height")


def grids_in(catalog: DataFrame, target: int) -> DataFrame:
    """The rasters of a catalog, each with the bounds and the pixel size it would have in the target CRS.

    A raster in another CRS keeps the number of pixels along its diagonal, as its
    corners and the middles of its sides are transformed.
    """
    rows = None
    places = [(a / 2, b / 2) for a in (0, 1, 2) for b in (0, 1, 2)]
    for srid in sorted(r[0] for r in catalog.select("srid").distinct().collect()):
        own = catalog.where(F.col("srid") == srid)
        at = [transform(F.col("ox") + F.col("px") * F.col("width") * a, F.col("oy") + F.col("py") * F.col("height") * b, srid, target) for a, b in places]
        xs, ys = ([p[k] for p in at] for k in (0, 1))
        own = own.withColumns({"xmin": F.least(*xs), "xmax": F.greatest(*xs), "ymin": F.least(*ys), "ymax": F.greatest(*ys)})
        across = F.hypot(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")) / F.hypot(F.col("width").cast("double"), F.col("height").cast("double"))
        same = F.lit(srid == target)
        own = own.withColumns({"pixel_width": F.when(same, F.abs("px")).otherwise(across), "pixel_height": F.when(same, F.abs("py")).otherwise(across)})
        rows = own if rows is None else rows.unionByName(own)
    return rows


def stats_over_rasters(zones: DataFrame, zone_srid: int, catalog: DataFrame, pixels: DataFrame, classes: DataFrame, target: int | None = None) -> DataFrame:
    """Records of :func:`feature_stats`, with their summary, over prioritised rasters of any grid and CRS.

    zones: ``(fid, fname, geom)``; catalog: ``(raster_id, ox, px, oy, py, width, height,
    srid, priority, nodata)``, a row for each raster, however many; pixels:
    ``(raster_id, row, col, value)``.  All is brought to one CRS (:func:`target_srs`) and
    the grid of the raster with the smallest pixels there, ties to the first priority.
    Zones become cells of that grid; each cell's centre is looked up in every raster
    that holds it (a join of boxes, then the pixel's place), by the nearest pixel, and
    the first raster whose value is mapped decides.  Cells, not rasters, move.
    """
    catalog = checkpointed(catalog)
    srids = sorted(r[0] for r in catalog.select("srid").distinct().collect())
    target = target_srs(srids, target)
    best = grids_in(catalog, target).orderBy(F.col("pixel_width") * F.col("pixel_height"), "priority", "raster_id").first()
    gt = (best["xmin"], best["pixel_width"], 0.0, best["ymax"], 0.0, -best["pixel_height"])
    shapes = reproject_features(zones, zone_srid, target)
    cells = rasterize(shapes, gt).select("fid", "row", "col")
    cells = checkpointed(cells.withColumns({"_x": F.lit(gt[0]) + (F.col("col") + 0.5) * gt[1], "_y": F.lit(gt[3]) + (F.col("row") + 0.5) * gt[5]}))
    # cells are few rows, but each meets all rasters over it, so they are dealt to as many tasks as that may need
    tasks = min(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + (cells.count() * catalog.count() >> 20))
    cells = cells.repartition(tasks, "row", "col")
    found = None
    for srid in srids:
        own = catalog.where(F.col("srid") == srid).select(*[F.col(c).cast("double").alias(c) for c in GRID], F.col("raster_id").cast("long").alias("raster_id"), F.col("priority").cast("long").alias("priority"), F.col("nodata").cast("double").alias("nodata"))
        ends = [[F.col(o), F.col(o) + F.col(p) * F.col(n)] for o, p, n in (("ox", "px", "width"), ("oy", "py", "height"))]
        # the box is a little wider than the raster, so that rounding leaves no cell out; the pixel's place decides
        wide = [F.abs(F.col(p)) for p in ("px", "py")]
        own = own.withColumns({name: f(*e) + sign * w for name, f, e, sign, w in (("xmin", F.least, ends[0], -1, wide[0]), ("ymin", F.least, ends[1], -1, wide[1]), ("xmax", F.greatest, ends[0], 1, wide[0]), ("ymax", F.greatest, ends[1], 1, wide[1]))})
        x, y = transform(F.col("_x"), F.col("_y"), target, srid)
        placed = cells.select(F.struct("fid", "row", "col").alias("cell"), x.alias("xmin"), y.alias("ymin"), x.alias("xmax"), y.alias("ymax"))
        side = own.agg(F.avg(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")))).first()[0]
        pairs = near_pairs(placed, own, "cell", "raster_id", side, keep_right=(*GRID, "priority", "nodata"))
        at = lambda v, o, p: F.floor((F.col(v) - F.col(f"b_{o}")) / F.col(f"b_{p}"))
        one = pairs.withColumns({"_r": at("a_ymin", "oy", "py"), "_c": at("a_xmin", "ox", "px")}).where("_r >= 0 and _r < b_height and _c >= 0 and _c < b_width")
        one = one.select("a_id.fid", "a_id.row", "a_id.col", F.col("b_id").alias("raster_id"), F.col("b_priority").alias("priority"), F.col("b_nodata").alias("nodata"), F.col("_r").cast("int").alias("_r"), F.col("_c").cast("int").alias("_c"))
        found = one if found is None else found.unionByName(one)
    source = pixels.select("raster_id", F.col("row").alias("_r"), F.col("col").alias("_c"), "value")
    read = small_join(source, found, ["raster_id", "_r", "_c"])
    mapped = small_join(read.where("value is not null and (nodata is null or value <> nodata)").withColumn("class_value", F.rint("value").cast("int")), classes, ["class_value"])
    first = mapped.groupBy("fid", "row", "col").agg(F.min_by(F.struct("class_value", "class_name"), F.struct("priority", "raster_id")).alias("m"))
    records = feature_stats(shapes, first.select("fid", "row", "col", "m.class_value", "m.class_name"), abs(gt[1] * gt[5]), f"EPSG:{target}")
    return with_summary(records)
