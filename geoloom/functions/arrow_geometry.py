"""Geometry columns of Arrow batches as numpy rings, and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

VERTEX = pa.struct([("x", pa.float64()), ("y", pa.float64())])
ARROW = pa.struct([("kind", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(VERTEX))))])
Parts = list[list[np.ndarray]]


def parts_of(column: pa.Array) -> list[Parts]:
    """Parts of rings (n x 2) of each geometry; a null geometry has none."""
    _, parts = column.flatten()
    rings, vertices = parts.values, parts.values.values
    x, y = vertices.values.flatten()
    xy = np.stack([x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)], 1)
    a, b, c = (v.offsets.to_numpy() for v in (parts, rings, vertices))
    known = parts.is_valid().to_numpy(zero_copy_only=False)
    return [[[xy[c[r] : c[r + 1]] for r in range(b[p], b[p + 1])] for p in range(a[k], a[k + 1])] if known[k] else [] for k in range(len(column))]


def lists_of(column: pa.Array) -> list[list[Parts]]:
    """The same for a column of arrays of geometries."""
    flat, at = parts_of(column.values), column.offsets.to_numpy()
    return [flat[i:j] for i, j in zip(at, at[1:], strict=False)]


def geometries(kind: str, shapes: list[Parts]) -> pa.Array:
    """A geometry column of one kind from parts of rings."""
    rings = [r for s in shapes for p in s for r in p]
    xy = np.concatenate(rings) if rings else np.empty((0, 2))
    ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    vertices = pa.StructArray.from_arrays([pa.array(xy[:, 0].astype(float)), pa.array(xy[:, 1].astype(float))], fields=list(VERTEX))
    level = pa.ListArray.from_arrays(ends([len(r) for r in rings]), vertices)
    level = pa.ListArray.from_arrays(ends([len(p) for s in shapes for p in s]), level)
    level = pa.ListArray.from_arrays(ends([len(s) for s in shapes]), level)
    return pa.StructArray.from_arrays([pa.array([kind] * len(shapes), pa.string()), level], fields=list(ARROW))
