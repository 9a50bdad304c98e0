"""One forest as NumPy arrays: parents as row numbers, levels, folds along lineages and over clades."""

from __future__ import annotations

from functools import cached_property

import numpy as np

#: name -> (ufunc, identity) of the folds.
FOLDS = {
    "sum": (np.add, 0),
    "prod": (np.multiply, 1),
    "max": (np.maximum, -np.inf),
    "min": (np.minimum, np.inf),
}


class Forest:
    """``ids`` and ``ancestors`` in row order; a root is its own ancestor."""

    def __init__(self, ids: np.ndarray, ancestors: np.ndarray):
        self.ids, self.n = ids, len(ids)
        rows = np.arange(self.n)
        if np.array_equal(ids, rows):
            self.parent = ancestors.astype(np.intp)
        else:
            order = np.argsort(ids, kind="stable")
            at = np.minimum(np.searchsorted(ids, ancestors, sorter=order), max(self.n - 1, 0))
            self.parent = order[at] if self.n else rows
        if self.n and not (0 <= self.parent.min() and self.parent.max() < self.n and np.array_equal(ids[self.parent], ancestors)):
            raise ValueError("an ancestor_id is no id of its tree")
        self.is_root = self.parent == rows

    @cached_property
    def _climb(self) -> tuple[np.ndarray, np.ndarray]:
        """Depth and root of each row, by pointer doubling."""
        jump, depth = self.parent.copy(), (~self.is_root).astype(np.int64)
        for _ in range(64):
            further = jump[jump]
            if np.array_equal(further, jump):
                if not self.is_root[jump].all():
                    raise ValueError("a lineage has no root")
                return depth, jump
            depth = depth + depth[jump]
            jump = further
        raise ValueError("a lineage has no root")

    @property
    def depth(self) -> np.ndarray:
        return self._climb[0]

    @property
    def root(self) -> np.ndarray:
        return self._climb[1]

    @cached_property
    def levels(self) -> list[np.ndarray]:
        """Rows by depth, roots first; within a level in row order."""
        if not self.n:
            return []
        order = np.argsort(self.depth, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1)

    @cached_property
    def num_children(self) -> np.ndarray:
        return np.bincount(self.parent[~self.is_root], minlength=self.n)

    def up(self, values: np.ndarray, fold: str) -> np.ndarray:
        """Fold over each row's clade, itself included."""
        ufunc, out = FOLDS[fold][0], values.copy()
        for rows in reversed(self.levels[1:]):
            ufunc.at(out, self.parent[rows], out[rows])
        return out

    def down(self, values: np.ndarray, fold: str) -> np.ndarray:
        """Fold from the root to each row, both included."""
        ufunc, out = FOLDS[fold][0], values.copy()
        for rows in self.levels[1:]:
            out[rows] = ufunc(out[self.parent[rows]], out[rows])
        return out

    def nearest(self, marked: np.ndarray) -> np.ndarray:
        """Row of the nearest marked row on the way to the root, itself included; -1 if there is none."""
        out = np.where(marked, np.arange(self.n), -1)
        for rows in self.levels[1:]:
            out[rows] = np.where(out[rows] < 0, out[self.parent[rows]], out[rows])
        return out

    @cached_property
    def children(self) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and rows of children, by id."""
        rows = np.flatnonzero(~self.is_root)
        rows = rows[np.lexsort((self.ids[rows], self.parent[rows]))]
        return np.concatenate(([0], np.cumsum(self.num_children))), rows

    def children_of(self, row: int) -> np.ndarray:
        offsets, rows = self.children
        return rows[offsets[row] : offsets[row + 1]]
