"""A packed R-tree over boxes as numpy arrays, asked for whole batches of boxes at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from geoloom.functions.covering import ragged


class PackedTree:
    """Boxes (n x 4: left, bottom, right, top) packed by sort-tile-recursion, ``fan`` in each node."""

    def __init__(self, boxes: np.ndarray, fan: int = 16):
        self.order = self._tiled(boxes, fan)
        self.fan, self.levels = fan, [boxes[self.order]]
        while len(self.levels[-1]) > fan:
            under = self.levels[-1]
            starts = np.arange(0, len(under), fan)
            self.levels.append(np.hstack([np.minimum.reduceat(under[:, :2], starts), np.maximum.reduceat(under[:, 2:], starts)]))

    @staticmethod
    def _tiled(boxes: np.ndarray, fan: int) -> np.ndarray:
        """Boxes by columns of about equal number from left to right, from bottom to top in each, so that a run of ``fan`` is a compact node."""
        middle = boxes[:, :2] + boxes[:, 2:]
        across = max(1, int(np.ceil(np.sqrt(len(boxes) / fan))))
        column = np.empty(len(boxes), np.int64)
        column[np.argsort(middle[:, 0], kind="stable")] = np.arange(len(boxes)) * across // max(1, len(boxes))
        return np.lexsort((middle[:, 1], column))

    def meeting(self, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, j) of all asked boxes i and held boxes j that share a point, i ascending."""
        found = [(np.empty(0, np.int64), np.empty(0, np.int64)), *self.runs(boxes)]
        return tuple(np.concatenate(side) for side in zip(*found, strict=True))

    def runs(self, boxes: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of :meth:`meeting` in runs, so that no more than about ``most`` are held at a time, however many boxes meet."""
        top = len(self.levels[-1])
        return self._under(boxes, len(self.levels) - 1, np.repeat(np.arange(len(boxes)), top), np.tile(np.arange(top), len(boxes)), max(1, most // self.fan))

    def _under(self, boxes: np.ndarray, k: int, i: np.ndarray, j: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        a, b = boxes[i], self.levels[k][j]
        met = (a[:, 0] <= b[:, 2]) & (b[:, 0] <= a[:, 2]) & (a[:, 1] <= b[:, 3]) & (b[:, 1] <= a[:, 3])
        i, j = i[met], j[met]
        if not k:
            yield i, self.order[j]
            return
        for n in range(0, len(i), step):
            p, q = i[n : n + step], j[n : n + step]
            size = np.minimum(self.fan, len(self.levels[k - 1]) - q * self.fan)
            yield from self._under(boxes, k - 1, np.repeat(p, size), ragged(q * self.fan, size), step)
