"""Neighbourhood operators: numpy kernels over tiles that carry a border of their neighbours.

A pixel goes to every tile whose border reaches it, so one shuffle brings a tile's
window together; tiles are bounded, however large the raster is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions.params import in_range, kernel, one_of
from geoloom.operators.graph import small_join
from geoloom.operators.raster import PLACE, stretched

BORDERS = {"reflect101": {"mode": "reflect"}, "replicate": {"mode": "edge"}, "low": {"mode": "constant", "constant_values": -np.inf}, "high": {"mode": "constant", "constant_values": np.inf}}
TILE = 256


def tiles(pixels: DataFrame, halo: int, tile: int = TILE) -> DataFrame:
    """Pixels with the tile (ty, tx) they are sent to and the raster's size (h, w), which the table may have already."""

    def span(c: str, n: str):
        low = F.greatest(F.floor((F.col(c) - halo) / tile), F.lit(0))
        high = F.least(F.floor((F.col(c) + halo) / tile), F.floor((F.col(n) - 1) / tile))
        return F.explode(F.sequence(low.cast("int"), high.cast("int")))

    if "h" in pixels.columns:
        sent = pixels.select(*PLACE, "value", "h", "w")
    else:
        sent = small_join(pixels.select(*PLACE, "value"), pixels.groupBy("raster_id", "band").agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w")), ["raster_id", "band"])
    return sent.withColumn("ty", span("row", "h")).withColumn("tx", span("col", "w"))


def tile_apply(pixels: DataFrame, work: Callable[[np.ndarray], np.ndarray], halo: int, border: str = "reflect101", tile: int = TILE) -> DataFrame:
    """Pixels after ``work``, which maps a tile with ``halo`` more cells on every side to the tile; NaN is dropped."""
    pad = BORDERS[border]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx, h, w = (int(pdf[c].iat[0]) for c in ("ty", "tx", "h", "w"))
        y0, x0 = ty * tile, tx * tile
        y1, x1 = min(y0 + tile, h), min(x0 + tile, w)
        top, left, bottom, right = max(y0 - halo, 0), max(x0 - halo, 0), min(y1 + halo, h), min(x1 + halo, w)
        grid = np.full((bottom - top, right - left), np.nan)
        grid[pdf["row"].to_numpy() - top, pdf["col"].to_numpy() - left] = pdf["value"].to_numpy()
        grid = np.pad(grid, ((halo - (y0 - top), halo - (bottom - y1)), (halo - (x0 - left), halo - (right - x1))), **pad)
        out = work(grid)
        y, x = np.nonzero(~np.isnan(out))
        return pd.DataFrame({"raster_id": pdf["raster_id"].iat[0], "band": pdf["band"].iat[0], "row": y + y0, "col": x + x0, "value": out[y, x]})

    return tiles(pixels, halo, tile).groupBy("raster_id", "band", "ty", "tx").applyInPandas(run, "raster_id long, band int, row int, col int, value double")


def gaussian_weights(size: int, sigma: float) -> np.ndarray:
    """A normalised one-dimensional Gaussian; sigma of 0 or less follows from the size."""
    if sigma <= 0:
        sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - (size - 1) / 2
    w = np.exp(-(x**2) / (2 * sigma * sigma))
    return w / w.sum()


def separable(grid: np.ndarray, down: np.ndarray, across: np.ndarray) -> np.ndarray:
    """Correlation with the outer product of two odd kernels; the result is smaller by their halves."""
    half = sliding_window_view(grid, len(across), axis=1) @ across
    return sliding_window_view(half, len(down), axis=0) @ down


def filtered(pixels: DataFrame, method: str = "gaussian", kernel_size: int = 5, sigma: float = 1.5, tile: int = TILE) -> DataFrame:
    """Smoothing and morphology; all but ``gaussian`` work on the stretched band and give it over 255.

    Borders: reflected for gaussian and bilateral, replicated for median, ignored by morphology.
    """
    one_of("method", method, ("gaussian", "median", "bilateral", "morph_erode", "morph_dilate", "morph_open", "morph_close"))
    k = kernel(kernel_size)
    half = k // 2
    if method == "gaussian":
        w = gaussian_weights(k, sigma)
        return tile_apply(pixels, lambda g: separable(g, w, w), half, tile=tile)
    v = stretched(pixels, sized=True)
    if method == "median":
        return tile_apply(v, lambda g: np.median(sliding_window_view(g, (k, k)).reshape(g.shape[0] - 2 * half, g.shape[1] - 2 * half, -1), axis=2) / 255, half, "replicate", tile)
    if method == "bilateral":
        return tile_apply(v, lambda g: bilateral(g, half) / 255, half, tile=tile)
    steps = {"morph_erode": "e", "morph_dilate": "d", "morph_open": "ed", "morph_close": "de"}[method]
    nothing = {"e": np.inf, "d": -np.inf}  # what a place off the raster counts as

    def work(g: np.ndarray) -> np.ndarray:
        off = np.isinf(g)
        for step in steps:
            g = extreme(np.where(off, nothing[step], g), k, step)
            off = off[half:-half, half:-half]
        return g / 255

    return tile_apply(v, work, half * len(steps), "high", tile)


def extreme(grid: np.ndarray, k: int, step: str) -> np.ndarray:
    """Least ('e') or greatest of each k x k window, one axis after the other."""
    pick = np.min if step == "e" else np.max
    return pick(sliding_window_view(pick(sliding_window_view(grid, k, axis=1), axis=-1), k, axis=0), axis=-1)


def bilateral(grid: np.ndarray, half: int, sigma: float = 75.0) -> np.ndarray:
    """Weighted mean over a disc, by distance and by difference of 8-bit value, rounded to whole values."""
    h, w = grid.shape[0] - 2 * half, grid.shape[1] - 2 * half
    core = grid[half : half + h, half : half + w]
    total, weight = np.zeros((h, w)), np.zeros((h, w))
    for dy in range(-half, half + 1):
        for dx in range(-half, half + 1):
            if dy * dy + dx * dx <= half * half:
                v = grid[half + dy : half + dy + h, half + dx : half + dx + w]
                a = np.exp(-(dy * dy + dx * dx) / (2 * sigma**2) - (v - core) ** 2 / (2 * sigma**2))
                total, weight = total + a * v, weight + a
    return np.rint(total / weight)


def adaptive_threshold(pixels: DataFrame, method: str = "mean", max_value: float = 255, size: int = 11, offset: float = 2, tile: int = TILE) -> DataFrame:
    """``max_value`` where the stretched value exceeds its neighbourhood's rounded mean (plain or Gaussian) less ``offset``, else 0."""
    one_of("method", method, ("mean", "gaussian"))
    half = kernel(size) // 2
    w = np.full(size, 1 / size) if method == "mean" else gaussian_weights(size, 0)

    def work(g: np.ndarray) -> np.ndarray:
        core = g[half:-half, half:-half]
        return np.where(core > np.rint(np.round(separable(g, w, w), 9)) - offset, float(max_value), 0.0)

    return tile_apply(stretched(pixels, sized=True), work, half, "replicate", tile)


# Fixed: one-dimensional kernels of a derivative order, and the smoothing across it.
DERIVATIVE = {0: (1.0, 2.0, 1.0), 1: (-1.0, 0.0, 1.0), 2: (1.0, -2.0, 1.0)}
SCHARR = {0: (3.0, 10.0, 3.0), 1: (-1.0, 0.0, 1.0)}


def edges(pixels: DataFrame, method: str = "sobel", dx: int = 1, dy: int = 1, tile: int = TILE) -> DataFrame:
    """Absolute edge response of the stretched band, cut at 255, over 255.

    ``sobel`` derives dx times across and dy times down (0 to 2, both 0: dx = 1);
    ``scharr`` once across if dx > 0, else once down; ``laplacian`` sums the diagonal neighbours.
    """
    one_of("method", method, ("sobel", "scharr", "laplacian"))
    in_range("dx", dx, 0, 2)
    in_range("dy", dy, 0, 2)
    if method == "laplacian":
        work = lambda g: 2 * (g[:-2, :-2] + g[:-2, 2:] + g[2:, :-2] + g[2:, 2:]) - 8 * g[1:-1, 1:-1]
    else:
        if method == "scharr":
            dx, dy = (1, 0) if dx > 0 else (0, 1)
        dx = 1 if dx == dy == 0 else dx
        table = SCHARR if method == "scharr" else DERIVATIVE
        down, across = np.array(table[dy]), np.array(table[dx])
        work = lambda g: separable(g, down, across)
    return tile_apply(stretched(pixels, sized=True), lambda g: np.minimum(np.abs(work(g)), 255) / 255, 1, tile=tile)


def window_sums(g: np.ndarray, h: int, w: int) -> np.ndarray:
    """The sum of each h x w window of a grid, from its integral image."""
    total = np.zeros((g.shape[0] + 1, g.shape[1] + 1))
    np.cumsum(np.cumsum(g, axis=0), axis=1, out=total[1:, 1:])
    return total[h:, w:] - total[:-h, w:] - total[h:, :-w] + total[:-h, :-w]


def correlated(g: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The sum of products of a template with each window of a grid, by one transform of both; whole numbers stay whole."""
    size = g.shape
    out = np.fft.irfft2(np.fft.rfft2(g) * np.conj(np.fft.rfft2(t, size)), size)[: size[0] - t.shape[0] + 1, : size[1] - t.shape[1] + 1]
    return np.rint(out) if (g == np.rint(g)).all() and (t == np.rint(t)).all() else out


def template_scores(pixels: DataFrame, template: np.ndarray, method: str = "ccoeff_normed", tile: int = TILE) -> DataFrame:
    """Match score of a stretched template at every place it fits, named by its top left pixel.

    The template is a driver-side array of any size.  Tiles overlap by it and are at
    least twice as wide; within each, products come from one Fourier transform and
    sums from integral images, so the work hardly grows with the template.
    """
    one_of("method", method, ("sqdiff", "sqdiff_normed", "ccorr", "ccorr_normed", "ccoeff", "ccoeff_normed"))
    in_range("template cells", template.size, 1)
    t = template.astype(float)
    t = np.zeros_like(t) if np.ptp(t) < 1e-10 else np.rint((t - t.min()) * 255 / np.ptp(t))
    th, tw = t.shape
    halo = max(th, tw) - 1
    n = t.size

    def work(g: np.ndarray) -> np.ndarray:
        g = g[halo:, halo:]  # a window begins at its pixel
        h, w = g.shape[0] - halo, g.shape[1] - halo
        g = g[: h + th - 1, : w + tw - 1]
        off = ~np.isfinite(g)
        g = np.where(off, 0.0, g)
        cross, sums, squares = correlated(g, t), window_sums(g, th, tw), window_sums(g * g, th, tw)
        if off.any():
            cross = np.where(window_sums(off.astype(float), th, tw) > 0.5, np.nan, cross)
        if method.startswith("sqdiff"):
            out = squares - 2 * cross + (t**2).sum()
        elif method.startswith("ccorr"):
            out = cross
        else:
            out = cross - sums * t.sum() / n
            squares = squares - sums**2 / n
        if method.endswith("_normed"):
            tt = ((t - t.mean()) ** 2).sum() if method.startswith("ccoeff") else (t**2).sum()
            norm = np.sqrt(np.maximum(squares, 0) * tt)
            flat = 1.0 if method.startswith("sqdiff") else 0.0
            out = np.where(np.isnan(cross), np.nan, np.where(norm > 1e-9, out / np.where(norm > 1e-9, norm, 1), flat))
        return out

    return tile_apply(stretched(pixels, sized=True), work, halo, "high", max(tile, 2 * halo))


def best_match(scores: DataFrame, method: str) -> DataFrame:
    """``(raster_id, row, col, value)`` of the best place of each raster: least for sqdiff, else greatest; ties go to the first place."""
    place = F.struct(F.round(F.col("value") * (1 if method.startswith("sqdiff") else -1), 9).alias("s"), "row", "col", "value")
    return scores.groupBy("raster_id").agg(F.min(place).alias("m")).select("raster_id", "m.row", "m.col", "m.value")


def corner_response(pixels: DataFrame, method: str = "harris", k: float = 0.04, tile: int = TILE) -> DataFrame:
    """Corner response of the stretched band: Sobel gradients (over 2040), summed over 2 x 2 blocks, then ``harris`` or the lesser eigenvalue (``shi_tomasi``)."""
    one_of("method", method, ("harris", "shi_tomasi"))
    smooth, slope = np.array(DERIVATIVE[0]), np.array(DERIVATIVE[1])

    def work(g: np.ndarray) -> np.ndarray:
        gx, gy = separable(g, smooth, slope) / 2040, separable(g, slope, smooth) / 2040
        xx, xy, yy = (sum(p[a : p.shape[0] - 1 + a, b : p.shape[1] - 1 + b] for a in (0, 1) for b in (0, 1))[:-1, :-1] for p in (gx * gx, gx * gy, gy * gy))
        if method == "harris":
            return xx * yy - xy * xy - k * (xx + yy) ** 2
        return (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy**2)

    return tile_apply(stretched(pixels, sized=True), work, 2, tile=tile)
