"""Pass 3: boxes and alignments of layers, and what lies in which loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import ALIGNMENTS, crossings
from ..functions.rounding import round_exact
from .extraction import Layers


def layer_boxes(t: Layers) -> DataFrame:
    """(drawing_id, layer, layer_ord, min_x, min_y, max_x, max_y) of layers with an entity; arcs count as full circles."""
    base = ["drawing_id", "layer", "layer_ord"]
    parts = [
        t.segments.select(
            *base, F.least("sx", "ex").alias("x0"), F.greatest("sx", "ex").alias("x1"), F.least("sy", "ey").alias("y0"),
            F.greatest("sy", "ey").alias("y1")
        ),
        t.circles.select(
            *base,
            *(
                f(F.col(c) - F.col("radius"), F.col(c) + F.col("radius")).alias(n)
                for c, f, n in (("cx", F.least, "x0"), ("cx", F.greatest, "x1"), ("cy", F.least, "y0"), ("cy", F.greatest, "y1"))
            )
        ),
        t.texts.select(*base, F.col("tx").alias("x0"), F.col("tx").alias("x1"), F.col("ty").alias("y0"), F.col("ty").alias("y1")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    g = rows.groupBy(*base).agg(
        F.min("x0").alias("min_x"), F.min("y0").alias("min_y"), F.max("x1").alias("max_x"), F.max("y1").alias("max_y")
    )
    return g.select(*base, *(round_exact(F.col(c), 2).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")))


def alignment_summary(segments: DataFrame) -> DataFrame:
    """(drawing_id, layer, layer_ord, horizontal, vertical, diagonal) of layers with segments; none given is diagonal."""
    a = F.coalesce("alignment", F.lit("diagonal"))
    return segments.groupBy("drawing_id", "layer", "layer_ord").agg(*(F.count_if(a == k).alias(k) for k in ALIGNMENTS))


#: Cells of a box at most; a larger box is covered by larger cells.
CELLS = 16


def contained(points: DataFrame, loops: DataFrame, x: str, y: str) -> DataFrame:
    """Each of ``points`` with (loop_ord) of each loop that holds it: by cells, then by boxes, then by the parity of crossings.

    Decided are the different places of points in the different rings of each drawing, once each; the points and loops that
    share them are joined to what is found, so that repeated ones cost no more than the rows they give. Cells have sides of
    powers of two. A ring is entered in the cells that its box meets, of the size that makes these ``CELLS`` at most; a place
    looks into one cell of each size that its drawing has rings of. So a place meets the rings near it and not all of its
    drawing, and nested loops each claim it. Joins are of sorted sides, as the size of stored tables doesn't tell what their
    rows take in memory.
    """
    pad = 1e-6
    corners = ["min_x", "min_y", "max_x", "max_y"]
    rings = loops.groupBy("drawing_id", *corners, "ring").agg(F.min("loop_ord").alias("_ring"))
    same = loops.select("drawing_id", "loop_ord", *corners, "ring").join(
        rings.hint("merge"), ["drawing_id", *corners, "ring"]
    ).select("drawing_id", "_ring", "loop_ord")
    box = rings.select(
        "drawing_id", "_ring", "ring", (F.col("min_x") - pad).alias("x0"), (F.col("min_y") - pad).alias("y0"),
        (F.col("max_x") + pad).alias("x1"), (F.col("max_y") + pad).alias("y1")
    )
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    box = box.withColumn("level", F.ceil(F.log2(side * (2.0 / (CELLS**0.5)))).cast("int"))  # two cells of half a box, and one for where it lies
    size = F.pow(F.lit(2.0), F.col("level"))
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    entered = box.withColumn("u", span("x0", "x1")).withColumn("v", span("y0", "y1"))
    levels = F.broadcast(box.select("level").distinct())  # one row for each power of two among the sizes of loops: some dozens
    keys = ["drawing_id", "level", "u", "v"]
    places = points.select("drawing_id", F.col(x).alias("_x"), F.col(y).alias("_y")).distinct()
    probe = places.join(levels).withColumns({"u": F.floor(F.col("_x") / size), "v": F.floor(F.col("_y") / size)})
    inside = (F.col("_x") >= F.col("x0")) & (F.col("_x") <= F.col("x1")) & (F.col("_y") >= F.col("y0")) & (F.col("_y") <= F.col("y1"))
    odd = crossings(F.col("_x"), F.col("_y"), F.col("ring")) % 2 == 1
    held = probe.join(entered.hint("merge"), keys).where(inside).where(odd).select("drawing_id", "_x", "_y", "_ring")
    at = points.withColumns({"_x": F.col(x), "_y": F.col(y)})
    found = at.join(held.hint("merge"), ["drawing_id", "_x", "_y"]).select(*points.columns, "_ring")
    return found.join(same.hint("shuffle_hash"), ["drawing_id", "_ring"]).select(*points.columns, "loop_ord")
