"""The two steps that are sequential by definition, as kernels over one drawing: greedy clustering and bounded cycle search."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np

MAX_LENGTH, MAX_LOOPS, MAX_STEPS = 20, 2000, 3_000_000


def _key(*at: float) -> tuple:
    return tuple(round(v, 2) for v in at)


class Joints:
    """Greedy clustering of points in the order they come.

    A point whose rounded coordinates were met goes to the same joint. Another joins the first joint whose running mean
    lies within the tolerance, looked for in the 3 x 3 cells around it, column by column; if there is none it founds one.
    """

    def __init__(self, tolerance: float):
        self.tolerance, self.cell = tolerance, max(tolerance, 1e-6)
        self.x: list[float] = []
        self.y: list[float] = []
        self.n: list[int] = []
        self.known = {}  # joint of a rounded point
        self.cells = defaultdict(list)  # joints whose mean lies in a cell

    def _cell(self, x, y):
        """Column and row of the grid."""
        return tuple(math.floor(v / self.cell) for v in (x, y))

    def _mean(self, j: int) -> tuple[float, float]:
        return self.x[j] / self.n[j], self.y[j] / self.n[j]

    def _near(self, x: float, y: float, u: int, v: int) -> int:
        for cell in ((u + i, v + k) for i in (-1, 0, 1) for k in (-1, 0, 1)):
            for j in self.cells.get(cell, ()):
                mx, my = self._mean(j)
                if math.hypot(x - mx, y - my) <= self.tolerance:
                    return j
        return -1

    def add(self, x: float, y: float) -> int:
        key = _key(x, y)
        if (j := self.known.get(key)) is not None:
            return j
        home = self._cell(x, y)
        j = self._near(x, y, *home)
        if j < 0:
            j = len(self.n)
            self.x.append(x)
            self.y.append(y)
            self.n.append(1)
            self.cells[home].append(j)
        else:
            before = self._cell(*self._mean(j))
            self.x[j] += x
            self.y[j] += y
            self.n[j] += 1
            after = self._cell(*self._mean(j))
            if before != after:
                self.cells[before].remove(j)
                self.cells[after].append(j)
        self.known[key] = j
        return j

    def centres(self) -> list[tuple[float, float]]:
        return [(round(a / n, 2), round(b / n, 2)) for a, b, n in zip(self.x, self.y, self.n)]


def cluster(points: np.ndarray, tolerance: float) -> tuple:
    """(centre of each joint, joint of each rounded point) of an (n, 2) array of endpoints in order."""
    joints = Joints(tolerance)
    for x, y in points.tolist():
        joints.add(x, y)
    return joints.centres(), joints.known


def anchored(points: np.ndarray, tolerance: float) -> tuple:
    """As ``cluster``, but a joint stays at its first point, so that no member is further than the tolerance from it."""
    cell, where, known, at = max(tolerance, 1e-6), defaultdict(list), {}, []
    for x, y in points.tolist():
        key = _key(x, y)
        if key in known:
            continue
        u, v = math.floor(x / cell), math.floor(y / cell)
        near = [
            j for i in (-1, 0, 1) for k in (-1, 0, 1)
            for j in where.get((u + i, v + k), ()) if math.hypot(x - at[j][0], y - at[j][1]) <= tolerance
        ]
        if near:
            known[key] = min(near)
        else:
            known[key] = len(at)
            where[u, v].append(len(at))
            at.append((x, y))
    return [(round(x, 2), round(y, 2)) for x, y in at], known


def cycles(links: list[list[int]], max_length: int = MAX_LENGTH, max_loops: int = MAX_LOOPS, max_steps: int = MAX_STEPS, by: str = "nodes"):
    """(cycles in the order they are found, whether a bound ended the search).

    Depth first from each node, by a last-in-first-out list of partial paths that only visits higher nodes. ``by`` "nodes"
    keeps one cycle for each set of nodes, "cycle" one for each cyclic order. Paths are short tuples.
    """
    found: list[list[int]] = []
    steps = 0
    for start, near in enumerate(links):
        seen: set = set()  # cycles of different starts differ in their least node
        stack = [(start,)] if near else []
        while stack:
            steps += 1
            if steps > max_steps:
                return found, True
            path = stack.pop()
            if len(path) > max_length:
                continue
            for nbr in links[path[-1]]:
                if nbr == start and len(path) >= 3:
                    key = frozenset(path) if by == "nodes" else min(path, (start, *path[:0:-1]))
                    if key not in seen:
                        seen.add(key)
                        found.append(list(path))
                        if len(found) >= max_loops:
                            return found, True
                elif nbr > start and nbr not in path:
                    stack.append((*path, nbr))
    return found, False
