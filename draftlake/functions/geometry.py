"""Column functions of plane geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALIGNMENTS = ("horizontal", "vertical", "diagonal")


def alignment(sx: Column, sy: Column, ex: Column, ey: Column, tol: Column) -> Column:
    """Vertical is tested first, so that a segment without length is vertical."""
    return F.when(F.abs(sx - ex) < tol, "vertical").when(F.abs(sy - ey) < tol, "horizontal").otherwise("diagonal")


def alignment_for_display(sx: Column, sy: Column, ex: Column, ey: Column, tol: float = 0.5) -> Column:
    """The rule of callers who bring segments without alignment: one extent below the tolerance and the other not."""
    dx, dy = F.abs(ex - sx), F.abs(ey - sy)
    return F.when((dy < tol) & (dx >= tol), "horizontal").when((dx < tol) & (dy >= tol), "vertical").otherwise("diagonal")


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def dominant(h: Column, v: Column, d: Column) -> Column:
    """The commonest alignment; of equal ones horizontal, then vertical; null if there is none."""
    return F.when(h + v + d == 0, F.lit(None)).when((h >= v) & (h >= d), "horizontal").when(v >= d, "vertical").otherwise("diagonal")


def crossings(px: Column, py: Column, ring: Column) -> Column:
    """Edges of a ring (array of {x, y}) that a ray from the point to the right crosses; half-open in y."""
    n = F.size(ring)
    edges = F.arrays_zip(ring.alias("p"), F.concat(F.slice(ring, n, 1), F.slice(ring, 1, n - 1)).alias("q"))

    def crosses(e: Column) -> Column:
        x, y, u, v = e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"]
        return ((y > py) != (v > py)) & (px < F.try_divide((u - x) * (py - y), v - y) + x)

    return F.size(F.filter(edges, crosses))
