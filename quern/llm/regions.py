"""Sets of shingles that meet in one task: links between all within a Jaccard distance, by pivots, regions and windows."""

from __future__ import annotations

import numpy as np

from quern.llm.simhash import merge

#: Regions of up to so many sets are compared pair by pair.
LEAF = 48


class Region:
    """Sets, and which of them are known to be linked: roots[i] is the smallest member of i's component."""

    def __init__(self, sets: list[np.ndarray], percent: float):
        self.percent, self.n = percent, np.array([len(s) for s in sets], np.int64)
        known = np.unique(np.concatenate(sets)) if sets else np.empty(0, np.uint64)
        self.parts = [np.searchsorted(known, s).astype(np.int32) for s in sets]
        self.held, self.roots = np.zeros(len(known), bool), np.arange(len(sets))

    def shared(self, x: int, ys: np.ndarray) -> np.ndarray:
        """How many shingles x shares with each of ys."""
        self.held[self.parts[x]] = True
        before = np.concatenate([[0], np.cumsum(self.held[np.concatenate([self.parts[y] for y in ys])])])
        self.held[self.parts[x]] = False
        ends = np.cumsum(self.n[ys])
        return before[ends] - before[ends - self.n[ys]]

    def near(self, x: int, ys: np.ndarray, shared: np.ndarray) -> np.ndarray:
        return (100 + self.percent) * shared >= self.percent * (self.n[x] + self.n[ys])

    def met(self, x: int, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of x to ys, and which are within the radius; those are linked."""
        shared = self.shared(x, ys)
        near = self.near(x, ys, shared)
        merge(self.roots, np.full(near.sum(), x), ys[near])
        return 1 - shared / (self.n[x] + self.n[ys] - shared), near

    def compare(self, members: np.ndarray) -> None:
        """Every pair that is not linked yet and whose sizes agree."""
        for k, x in enumerate(members):
            y = members[k + 1 :]
            y = y[(self.roots[y] != self.roots[x]) & (np.minimum(self.n[y], self.n[x]) * 100 >= self.percent * np.maximum(self.n[y], self.n[x]))]
            if len(y):
                self.met(x, y)

    def join(self, members: np.ndarray) -> None:
        """Links all pairs within the radius: by regions of pivots far from each other, parted again while that helps."""
        if len(members) <= LEAF:
            return self.compare(members)
        pivot, far = members[0], []
        while len(far) < 8:
            far.append(self.met(pivot, members)[0])
            if (self.roots[members] == self.roots[members[0]]).all():
                return None
            pivot = members[np.min(far, axis=0).argmax()]
        inside = windows(np.array(far), self.percent)
        if inside.sum(axis=1).max() > 0.7 * len(members) or inside.sum() > 2.5 * len(members):
            return self.compare(members)  # texts about as far from each other as the windows are wide
        for row in inside:
            if row.any():
                self.join(members[row])


def windows(far: np.ndarray, percent: float) -> np.ndarray:
    """Which members (columns) belong to the region of each pivot (rows) or to its window, by their distances."""
    return far <= far.min(axis=0) + 2 * (1 - percent / 100) + 1e-9
