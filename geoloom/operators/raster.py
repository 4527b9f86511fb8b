"""Per-pixel operators and aggregates over pixel tables ``(raster_id, band, row, col, value)``."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.params import in_range, one_of
from geoloom.operators.graph import small_join

KEY = ["raster_id", "band"]
PLACE = ["raster_id", "band", "row", "col"]
THRESHOLDS = ("binary", "binary_inv", "truncate", "tozero", "otsu")


def with_nodata(pixels: DataFrame, nodata: float | None) -> DataFrame:
    """Pixels with the NoData value read as null."""
    return pixels if nodata is None else pixels.withColumn("value", F.nullif(F.col("value"), F.lit(float(nodata))))


def band_stats(pixels: DataFrame, nodata: float | None = None) -> DataFrame:
    """Count, minimum, maximum, mean and population deviation of each band; NoData doesn't count."""
    v = with_nodata(pixels, nodata)
    return v.groupBy(*KEY).agg(F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("stddev"))


def histogram(pixels: DataFrame, bins: int = 256, nodata: float | None = None) -> DataFrame:
    """``(raster_id, band, bin, center, count)``: equal bins over the data's range, the maximum in the last; empty bins count 0.

    A flat band has no range and gives no rows.
    """
    in_range("bins", bins, 1)
    v = with_nodata(pixels, nodata).where("value is not null")
    ends = v.groupBy(*KEY).agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("hi > lo")
    width = (F.col("hi") - F.col("lo")) / bins
    got = v.join(ends, KEY).withColumn("bin", F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")).groupBy(*KEY, "bin").agg(F.count("*").alias("count"))
    every = ends.select(*KEY, "lo", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(got, [*KEY, "bin"], "left").select(*KEY, "bin", (F.col("lo") + (F.col("bin") + 0.5) * F.col("w")).alias("center"), F.coalesce("count", F.lit(0)).alias("count"))


def histogram_edges(pixels: DataFrame, bins: int = 256, nodata: float | None = None) -> DataFrame:
    """``(raster_id, band, bin, lo, hi, count)`` with the bins' edges; a flat band is widened by one."""
    in_range("bins", bins, 1)
    v = with_nodata(pixels, nodata).where("value is not null")
    ends = v.groupBy(*KEY).agg(F.min("value").alias("least"), F.max("value").alias("most")).withColumn("most", F.when(F.col("most") > F.col("least"), F.col("most")).otherwise(F.col("least") + 1))
    width = (F.col("most") - F.col("least")) / bins
    got = v.join(ends, KEY).withColumn("bin", F.least(F.floor((F.col("value") - F.col("least")) / width), F.lit(bins - 1)).cast("int")).groupBy(*KEY, "bin").agg(F.count("*").alias("count"))
    every = ends.select(*KEY, "least", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    edge = lambda k: F.col("least") + (F.col("bin") + k) * F.col("w")
    return every.join(got, [*KEY, "bin"], "left").select(*KEY, "bin", edge(0).alias("lo"), edge(1).alias("hi"), F.coalesce("count", F.lit(0)).alias("count"))


_SYMBOL = re.compile(r"\s*(?:(B[1-9][0-9]*)|([0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)|([-+*/()]))")


def band_expression(text: str) -> tuple[Column, set[int]]:
    """A column from ``B1 .. Bn``, numbers, ``+ - * /`` and brackets, and the bands it names; a divisor under 1e-15 gives 0."""
    symbols, at = [], 0
    while text[at:].strip():
        m = _SYMBOL.match(text, at)
        if not m:
            raise ValueError(f"band expression not understood at {text[at:]!r}")
        symbols.append(m.group().strip())
        at = m.end()
    bands: set[int] = set()

    def term(sum_level: bool) -> Column:
        left = term(False) if sum_level else factor()
        while symbols and symbols[0] in ("+-" if sum_level else "*/"):
            op = symbols.pop(0)
            right = term(False) if sum_level else factor()
            left = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.when(F.abs(b) < 1e-15, F.lit(0.0)).otherwise(a / b)}[op](left, right)
        return left

    def factor() -> Column:
        if not symbols:
            raise ValueError("band expression ends early")
        s = symbols.pop(0)
        if s == "-":
            return -factor()
        if s == "(":
            inner = term(True)
            if not symbols or symbols.pop(0) != ")":
                raise ValueError("a bracket is not closed")
            return inner
        if s[0] == "B":
            bands.add(int(s[1:]))
            return F.col(f"b{int(s[1:])}")
        if s in "+*/)":
            raise ValueError(f"misplaced {s!r}")
        return F.lit(float(s))

    out = term(True)
    if symbols:
        raise ValueError(f"left over: {symbols}")
    return out, bands


def by_band(pixels: DataFrame, bands: list[int]) -> DataFrame:
    """One row for each place with the columns ``b<n>`` of the bands (null where a band lacks the place)."""
    values = [F.max(F.when(F.col("band") == b, F.col("value"))).alias(f"b{b}") for b in bands]
    return pixels.where(F.col("band").isin(bands)).groupBy("raster_id", "row", "col").agg(*values)


def band_math(pixels: DataFrame, expression: str) -> DataFrame:
    """``(raster_id, row, col, value)`` of a band expression."""
    value, bands = band_expression(expression)
    return by_band(pixels, sorted(bands) or [1]).select("raster_id", "row", "col", value.alias("value"))


def ndvi(pixels: DataFrame, red_band: int = 3, nir_band: int = 4) -> DataFrame:
    """``(raster_id, row, col, value)``: (nir - red) / (nir + red + 1e-10)."""
    in_range("red_band", red_band, 1)
    in_range("nir_band", nir_band, 1)
    red, nir = F.col(f"b{red_band}"), F.col(f"b{nir_band}")
    return by_band(pixels, sorted({red_band, nir_band})).select("raster_id", "row", "col", ((nir - red) / (nir + red + 1e-10)).alias("value"))


def ends(pixels: DataFrame) -> DataFrame:
    """Each pixel with its band's minimum ``lo``, maximum ``hi`` and size ``h``, ``w``: a row a band, joined back."""
    return small_join(pixels, pixels.groupBy(*KEY).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), (F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w")), KEY)


def stretched(pixels: DataFrame, sized: bool = False) -> DataFrame:
    """Values stretched to whole 0..255 by the band's range, halves to even; a flat band gives 0.  With ``sized``, the raster's ``h`` and ``w`` follow."""
    span = F.col("hi") - F.col("lo")
    return ends(pixels).withColumn("value", F.when(span < 1e-10, F.lit(0.0)).otherwise(F.rint((F.col("value") - F.col("lo")) * 255 / span))).select(*PLACE, "value", *(["h", "w"] if sized else []))


def otsu(levels: DataFrame) -> DataFrame:
    """``(raster_id, band, threshold)``: the 8-bit level that parts each band with the greatest between-class variance; ties go to the lowest."""
    hist = levels.groupBy(*KEY, F.col("value").cast("int").alias("t")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*KEY).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*KEY)
    nt = F.col("n") * F.col("t")
    h = hist.select(*KEY, "t", F.sum("n").over(upto).alias("w0"), F.sum(nt).over(upto).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(nt).over(whole).alias("s"))
    m0, m1 = F.col("s0") / F.col("w0"), (F.col("s") - F.col("s0")) / F.nullif(F.col("w") - F.col("w0"), F.lit(0))
    variance = F.coalesce(F.col("w0") * (F.col("w") - F.col("w0")) * (m0 - m1) * (m0 - m1), F.lit(0.0))
    return h.groupBy(*KEY).agg(F.max_by("t", F.struct(F.round(variance, 3), -F.col("t"))).alias("threshold"))


def threshold(pixels: DataFrame, method: str = "otsu", threshold_value: float = 128, max_value: float = 255, stretch: bool = True) -> DataFrame:
    """Thresholded pixels; as set, values are first stretched to 0..255."""
    one_of("method", method, THRESHOLDS)
    v = stretched(pixels) if stretch else pixels.select(*PLACE, "value")
    value, t, full, zero = F.col("value"), F.lit(float(threshold_value)), F.lit(float(max_value)), F.lit(0.0)
    if method == "otsu":
        v, t = small_join(v, otsu(v), KEY), F.col("threshold")
    out = {"binary": F.when(value > t, full).otherwise(zero), "binary_inv": F.when(value > t, zero).otherwise(full), "truncate": F.least(value, t), "tozero": F.when(value > t, value).otherwise(zero)}
    return v.select(*PLACE, out.get(method, out["binary"]).alias("value"))


def enhance(pixels: DataFrame, method: str = "normalize", gamma: float = 1.0) -> DataFrame:
    """Contrast: ``normalize`` to 0..1, ``log`` of the value clamped at 0, ``gamma`` power, or ``equalize`` of the 8-bit histogram."""
    one_of("method", method, ("normalize", "log", "gamma", "equalize"))
    in_range("gamma", gamma, 0, open_low=True)
    if method == "equalize":
        return equalized(pixels)
    v = pixels.withColumn("value", F.log1p(F.greatest(F.col("value"), F.lit(0.0)))) if method == "log" else pixels
    span = F.col("hi") - F.col("lo")
    unit = F.when(span < 1e-10, F.lit(0.0)).otherwise((F.col("value") - F.col("lo")) / span)
    return ends(v).select(*PLACE, (F.pow(unit, F.lit(1 / gamma)) if method == "gamma" else unit).alias("value"))


def equalized(pixels: DataFrame) -> DataFrame:
    """Histogram equalisation of the stretched band, over 255: the cumulative count is scaled from the first level's to all."""
    v = stretched(pixels)
    hist = v.groupBy(*KEY, "value").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*KEY).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lut = hist.select(*KEY, "value", F.sum("n").over(upto).alias("cdf"), F.sum("n").over(Window.partitionBy(*KEY)).alias("all"), F.first("n").over(upto).alias("base"))
    level = F.when(F.col("all") == F.col("base"), F.col("value")).otherwise(F.rint((F.col("cdf") - F.col("base")) * 255 / (F.col("all") - F.col("base"))))
    return small_join(v, lut.select(*KEY, "value", (level / 255).alias("out")), [*KEY, "value"]).select(*PLACE, F.col("out").alias("value"))


# Fixed: anchor colours of each map at even steps from 0 to 255.
COLORMAPS = {
    "jet": ((0, 0, 128), (0, 0, 255), (0, 255, 255), (255, 255, 0), (255, 0, 0), (128, 0, 0)),
    "hot": ((0, 0, 0), (255, 0, 0), (255, 255, 0), (255, 255, 255)),
    "cool": ((0, 255, 255), (255, 0, 255)),
    "spring": ((255, 0, 255), (255, 255, 0)),
    "summer": ((0, 128, 102), (255, 255, 102)),
    "autumn": ((255, 0, 0), (255, 255, 0)),
    "winter": ((0, 0, 255), (0, 255, 128)),
    "bone": ((0, 0, 0), (84, 84, 116), (167, 199, 199), (255, 255, 255)),
    "gray": ((0, 0, 0), (255, 255, 255)),
    "rainbow": ((255, 0, 0), (255, 255, 0), (0, 255, 0), (0, 0, 255), (170, 0, 255)),
    "ocean": ((0, 128, 0), (0, 0, 85), (0, 128, 170), (255, 255, 255)),
    "viridis": ((68, 1, 84), (59, 82, 139), (33, 145, 140), (94, 201, 98), (253, 231, 37)),
}


def colormap(pixels: DataFrame, cmap: str = "jet") -> DataFrame:
    """``(raster_id, band, row, col, r, g, b)``: the stretched value looked up in a map interpolated between its anchors; flat bands give no rows."""
    anchors = COLORMAPS[one_of("cmap", cmap, COLORMAPS)]
    steps = len(anchors) - 1
    at = F.col("value") * steps / 255
    k = F.least(F.floor(at), F.lit(steps - 1)).cast("int")
    table = [F.array(*[F.lit(float(a[c])) for a in anchors]) for c in range(3)]
    channel = [F.rint(F.element_at(t, k + 1) + (F.element_at(t, k + 2) - F.element_at(t, k + 1)) * (at - k)).cast("int") for t in table]
    flat = pixels.groupBy(*KEY).agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("hi - lo >= 1e-10").select(*KEY)
    return stretched(pixels).join(flat, KEY, "left_semi").select(*PLACE, *[c.alias(n) for c, n in zip(channel, "rgb", strict=True)])


def aligned(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pixels of two rasters side by side as ``before`` and ``after``; a place that one lacks is an error where it is read."""
    a, b = before.select("raster_id", "row", "col", F.col("value").alias("before")), after.select("raster_id", "row", "col", F.col("value").alias("after"))
    both = a.join(b, ["raster_id", "row", "col"], "full_outer")
    return both.where(F.when(F.col("before").isNull() | F.col("after").isNull(), F.raise_error(F.lit("Image sizes do not match")).isNull()).otherwise(F.lit(True)))


def change(before: DataFrame, after: DataFrame, method: str = "differencing") -> DataFrame:
    """``(raster_id, row, col, value)``: absolute difference, absolute log ratio, or distance of the pair from its mean (pcd)."""
    one_of("method", method, ("differencing", "ratio", "pcd"))
    x, y = F.col("before"), F.col("after")
    m = (x + y) / 2
    value = {"differencing": F.abs(x - y), "ratio": F.abs(F.ln((y + 1e-10) / (x + 1e-10))), "pcd": F.sqrt((x - m) * (x - m) + (y - m) * (y - m))}[method]
    return aligned(before, after).select("raster_id", "row", "col", value.alias("value"))


def change_summary(changes: DataFrame, threshold_value: float | None = None) -> DataFrame:
    """``(raster_id, threshold, changed, total, ratio)``: without a threshold, mean plus population deviation."""
    auto = changes.groupBy("raster_id").agg((F.avg("value") + F.stddev_pop("value")).alias("threshold")) if threshold_value is None else None
    v = small_join(changes, auto, ["raster_id"]) if auto is not None else changes.withColumn("threshold", F.lit(float(threshold_value)))
    return v.groupBy("raster_id").agg(F.first("threshold").alias("threshold"), F.sum((F.col("value") > F.col("threshold")).cast("long")).alias("changed"), F.count("*").alias("total")).withColumn("ratio", F.col("changed") / F.col("total"))


def _cubic(t: np.ndarray) -> np.ndarray:
    """The cubic kernel of a scaled image, with the fixed slope -0.75 at one pixel."""
    t = np.abs(t)
    return np.where(t < 1, 1.25 * t * t * t - 2.25 * t * t + 1, np.where(t < 2, -0.75 * t * t * t + 3.75 * t * t - 6 * t + 3, 0.0))


def _scaled_way(first: int, n: int, own: int, other: int, low: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of m places from ``low`` of a side of ``own`` pixels for n places from ``first`` of one of ``other``, and whether they are among the four neighbours (n x m)."""
    t = (first + np.arange(n) + 0.5) * own / other - 0.5
    weight, near = np.zeros((n, m)), np.zeros((n, m))
    for d in range(-1, 3):
        k = np.floor(t) + d
        at = np.clip(k, 0, own - 1).astype(np.int64) - low
        on = np.flatnonzero((at >= 0) & (at < m))
        np.add.at(weight, (on, at[on]), _cubic(t - k)[on])
        near[on, at[on]] = 1.0
    return weight, near


def onto_grid(pixels: DataFrame, grid: DataFrame, tile: int = 256) -> DataFrame:
    """Pixels scaled to the size of each raster's ``grid`` pixels: as they are where the sizes agree, else by a cubic kernel, the edge's pixels standing for those beyond it.

    Only rasters whose sizes differ are resampled.  A pixel is sent to the tiles of the
    grid that it weighs in, one shuffle, and a tile weighs its 16 neighbours for each
    of its pixels; those that the grid lacks are left out by a join.
    """
    size = lambda t, h, w: t.groupBy("raster_id").agg((F.max("row") + 1).alias(h), (F.max("col") + 1).alias(w))
    sizes = size(pixels, "_h", "_w").join(size(grid, "_gh", "_gw"), "raster_id").withColumn("_same", (F.col("_h") == F.col("_gh")) & (F.col("_w") == F.col("_gw")))
    told = small_join(pixels, sizes, ["raster_id"])
    same = told.where("_same").select(*PLACE, "value")

    def span(c: str, own: str, other: str) -> Column:
        """Tiles with a place whose neighbours a pixel is among; the edge's pixels stand for all beyond."""
        ratio = F.col(other) / F.col(own)
        low = F.greatest(F.floor(((F.col(c) - 2) * ratio - 2) / tile), F.lit(0))
        return F.explode(F.sequence(low, F.greatest(low, F.least(F.floor(((F.col(c) + 3) * ratio + 2) / tile), F.floor((F.col(other) - 1) / tile)))))

    def scale(table: pa.Table) -> pa.Table:
        row, col, value = (table.column(c).combine_chunks() for c in ("row", "col", "value"))
        held = value.is_valid().to_numpy(zero_copy_only=False)
        row, col, value = row.to_numpy(), col.to_numpy(), value.to_numpy(zero_copy_only=False).astype(float)
        y0, x0, h, w, gh, gw = (table.column(c)[0].as_py() * k for c, k in (("ty", tile), ("tx", tile), ("_h", 1), ("_w", 1), ("_gh", 1), ("_gw", 1)))
        top, left = int(row.min()), int(col.min())
        v, there, known = np.zeros((3, int(row.max()) - top + 1, int(col.max()) - left + 1))
        finite = held & np.isfinite(value)
        v[row - top, col - left] = np.where(finite, value, 0.0)
        there[row - top, col - left] = 1.0
        known[row - top, col - left] = held
        down, rows = _scaled_way(y0, min(tile, gh - y0), h, gh, top, v.shape[0])
        across, cols = _scaled_way(x0, min(tile, gw - x0), w, gw, left, v.shape[1])
        total, some, found = down @ v @ across.T, rows @ known @ cols.T, rows @ there @ cols.T
        for k in np.flatnonzero(held & ~finite):
            y, x = row[k] - top, col[k] - left
            with np.errstate(invalid="ignore"):
                total = np.where(np.outer(rows[:, y], cols[:, x]) > 0, total + np.outer(down[:, y], across[:, x]) * value[k], total)
        r, c = np.nonzero(found > 0.5)
        first = pa.array(np.zeros(len(r), np.int64))
        return pa.table({**{k: table.column(k).combine_chunks().take(first) for k in ("raster_id", "band")}, "row": (r + y0).astype(np.int32), "col": (c + x0).astype(np.int32), "value": pa.array(total[r, c], mask=some[r, c] < 0.5)})

    types = dict(pixels.dtypes)
    sent = told.where("not _same").withColumn("ty", span("row", "_h", "_gh")).withColumn("tx", span("col", "_w", "_gw"))
    scaled = sent.groupBy("raster_id", "band", "ty", "tx").applyInArrow(scale, f"raster_id {types['raster_id']}, band {types['band']}, row int, col int, value double")
    return same.unionByName(scaled.hint("merge").join(grid.select("raster_id", "row", "col"), ["raster_id", "row", "col"], "left_semi").select(*PLACE, "value"))


def pansharpen(multi: DataFrame, pan: DataFrame, bands: list[int], method: str = "brovey") -> DataFrame:
    """``(raster_id, band, row, col, value)`` of the multi-band pixels sharpened by ``pan``, on its grid (:func:`onto_grid`).

    ``brovey``: band over the bands' mean times pan; ``simple_mean``: mean with pan;
    ``ihs``: the first three bands' value channel is replaced by pan stretched to
    0..255, hue and saturation stay and further bands pass through.
    """
    one_of("method", method, ("brovey", "simple_mean", "ihs"))
    if len(bands) < (3 if method == "ihs" else 2 if method == "brovey" else 1):
        raise ValueError(f"{method} needs more bands")
    multi = onto_grid(multi.where(F.col("band").isin(bands)), pan)
    wide = by_band(multi, bands)
    p = stretched(pan.withColumn("band", F.lit(1))).select("raster_id", "row", "col", F.col("value").alias("pan")) if method == "ihs" else pan.select("raster_id", "row", "col", F.col("value").alias("pan"))
    both = wide.join(p, ["raster_id", "row", "col"])
    mean = sum((F.col(f"b{b}") for b in bands), F.lit(0.0)) / len(bands)
    if method == "brovey":
        out = {b: F.col(f"b{b}") / (mean + 1e-10) * F.col("pan") for b in bands}
    elif method == "simple_mean":
        out = {b: (F.col(f"b{b}") + F.col("pan")) / 2 for b in bands}
    else:
        value = F.greatest(*[F.col(f"b{b}") for b in bands[:3]])
        scale = F.when(value > 0, F.col("pan") / value)
        out = {b: F.coalesce(F.col(f"b{b}") * scale, F.col("pan")) if k < 3 else F.col(f"b{b}") for k, b in enumerate(bands)}
    every = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), v.alias("value")) for b, v in out.items()])).alias("p")
    return both.select("raster_id", "row", "col", every).select("raster_id", "p.band", "row", "col", "p.value")


def raster_info(pixels: DataFrame, nodata: float | None = None, gt: tuple[float, ...] = (0.0, 1.0, 0.0, 64.0, 0.0, -1.0), srid: int | None = None, scale: float = 1.0, offset: float = 0.0, band_types: dict[int, str] | None = None, colors: dict[int, str] | None = None, overviews: DataFrame | None = None) -> DataFrame:
    """One row for each band: size, origin, extent, sample type, colour, number of overviews, NoData, scale, offset, CRS and statistics.

    band_types and colors: those of bands that are not stored as the value column is
    (``{1: "Byte"}``), or that have a colour (``{1: "Red"}``; others are Undefined).
    overviews: pixels of overviews, told apart by a column ``level``.
    """
    size = pixels.groupBy(*KEY).agg((F.max("col") + 1).cast("int").alias("width"), (F.max("row") + 1).cast("int").alias("height"))
    ox, px, _, oy, _, py = gt
    out = size.join(band_stats(pixels, nodata), KEY)
    counted = overviews.groupBy(*KEY).agg(F.count_distinct("level").cast("int").alias("overviews")) if overviews is not None else None
    out = out.join(counted, KEY, "left") if counted is not None else out.withColumn("overviews", F.lit(0))
    own = lambda named, other: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in named.items() for x in kv]), F.col("band").cast("int")), F.lit(other)) if named else F.lit(other)
    told = {"nodata": None if nodata is None else float(nodata), "value_scale": float(scale), "value_offset": float(offset), "srid": srid}
    types = {"nodata": "double", "value_scale": "double", "value_offset": "double", "srid": "int"}
    return out.select(
        *KEY, "width", "height", F.lit(ox).alias("xmin"), (F.lit(oy) + F.col("height") * py).alias("ymin"), (F.lit(ox) + F.col("width") * px).alias("xmax"), F.lit(oy).alias("ymax"),
        own(band_types, dict(pixels.dtypes)["value"]).alias("dtype"), own(colors, "Undefined").alias("color"), F.coalesce("overviews", F.lit(0)).alias("overviews"),
        *[F.lit(v).cast(types[n]).alias(n) for n, v in told.items()], "n", "min", "max", "mean", "stddev",
    )


def set_nodata(catalog: DataFrame, nodata: float, band: int = 0) -> DataFrame:
    """The catalog with a NoData value set for one band, or for all if ``band`` is 0 or less."""
    return catalog.withColumn("nodata", F.when(F.lit(band <= 0) | (F.col("band") == band), F.lit(float(nodata))).otherwise(F.col("nodata")))


def assign_srs(catalog: DataFrame, srid: int) -> DataFrame:
    """The catalog with another CRS label; nothing is resampled."""
    return catalog.withColumn("srid", F.lit(int(srid)))


def clahe(pixels: DataFrame, clip_limit: float = 2.0, grid: int = 8) -> DataFrame:
    """Contrast-limited equalisation of the stretched band, over 255.

    The raster is cut into ``grid`` x ``grid`` tiles.  A tile's 256-bin histogram is
    clipped, its excess spread over all bins, and its running sum makes a table; a
    pixel blends the tables of the four nearest tiles.  Histograms and tables are
    bounded rows, joined back on tile and level.
    """
    in_range("clip_limit", clip_limit, 0, open_low=True)
    in_range("grid", grid, 1)
    size = pixels.groupBy(*KEY).agg(F.ceil((F.max("row") + 1) / grid).cast("int").alias("th"), F.ceil((F.max("col") + 1) / grid).cast("int").alias("tw"))
    v = small_join(stretched(pixels), size, KEY).withColumn("level", F.col("value").cast("int"))
    tile = [*KEY, "ty", "tx"]
    hist = v.groupBy(*KEY, F.floor(F.col("row") / F.col("th")).cast("int").alias("ty"), F.floor(F.col("col") / F.col("tw")).cast("int").alias("tx"), "level").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*tile)
    limit = F.greatest(F.lit(1), F.floor(F.sum("n").over(whole) * clip_limit / 256))
    held = hist.withColumns({"area": F.sum("n").over(whole), "kept": F.least("n", limit)})
    excess = held.groupBy(*tile).agg(F.sum(F.col("n") - F.col("kept")).alias("excess"), F.max("area").alias("area"))
    bins = excess.select(*tile, "excess", "area", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("level")).join(held.select(*tile, "level", "kept"), [*tile, "level"], "left")
    rest = F.col("excess") % 256
    step = F.greatest(F.lit(1), F.floor(F.lit(256) / F.greatest(rest, F.lit(1))))
    extra = F.when((rest > 0) & (F.col("level") % step == 0) & (F.floor(F.col("level") / step) < rest), 1).otherwise(0)
    full = F.coalesce("kept", F.lit(0)) + F.floor(F.col("excess") / 256) + extra
    upto = Window.partitionBy(*tile).orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lut = bins.withColumn("full", full).select(*tile, "level", F.least(F.lit(255.0), F.rint(F.sum("full").over(upto) * 255 / F.col("area"))).alias("out"))
    fy, fx = F.col("row") / F.col("th") - 0.5, F.col("col") / F.col("tw") - 0.5
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("q")
    near = v.select(*PLACE, "level", fy.alias("fy"), fx.alias("fx"), F.lit(grid).alias("g"), corner)
    side = lambda f, k: F.greatest(F.lit(0), F.least(F.col("g") - 1, F.floor(f) + F.col(f"q.{k}"))).cast("int")
    share = lambda f, k: F.when(F.col(f"q.{k}") == 1, F.col(f) - F.floor(f)).otherwise(1 - F.col(f) + F.floor(f))
    near = near.select(*PLACE, "level", side("fy", "i").alias("ty"), side("fx", "j").alias("tx"), (share("fy", "i") * share("fx", "j")).alias("w"))
    blended = near.join(lut, [*tile, "level"]).groupBy(*PLACE).agg((F.sum(F.col("w") * F.col("out")) / F.sum("w")).alias("value"))
    return blended.select(*PLACE, (F.rint(F.round("value", 6)) / 255).alias("value"))
