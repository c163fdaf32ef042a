"""Pass 2: joints, the graph of segments, closed loops and their measures."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import round_exact
from . import kernels

TOLERANCE = 1.0


class Topology(NamedTuple):
    nodes: DataFrame
    point_nodes: DataFrame
    edges: DataFrame
    links: DataFrame
    loops: DataFrame
    truncated: DataFrame


def _first_points(segments: DataFrame) -> DataFrame:
    """(drawing_id, kx, ky, at, x, y): a row for each rounded end of segments: its first appearance and the exact point it was then.

    ``at`` is the order of the walk over all layers. It is packed into one number, 32 bits for the layer, 31 within and one for
    the end, so that equal points are met by a hash aggregate; only different ones are rounded.
    """
    order = F.shiftleft(F.col("layer_ord").cast("bigint"), 32) + F.shiftleft(F.col("line_ord").cast("bigint"), 1)
    ends = F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("sx").alias("x"), F.col("sy").alias("y")),
                             F.struct(F.lit(1).alias("e"), F.col("ex").alias("x"), F.col("ey").alias("y"))))
    points = segments.select("drawing_id", order.alias("o"), ends.alias("p")).select(
        "drawing_id", (F.col("o") + F.col("p.e")).alias("at"), "p.x", "p.y"
    )
    exact = points.groupBy("drawing_id", "x", "y").agg(F.min("at").alias("at"))
    keyed = exact.select("*", round_exact(F.col("x"), 2).alias("kx"), round_exact(F.col("y"), 2).alias("ky"))
    at = F.struct(
        F.shiftright("at", 32).cast("int").alias("layer_ord"), F.shiftright("at", 1).bitwiseAND((1 << 31) - 1).cast("int").alias("line_ord"),
        F.col("at").bitwiseAND(1).cast("int").alias("e")
    )
    first = keyed.groupBy("drawing_id", "kx", "ky").agg(F.min(F.struct("at", "x", "y")).alias("f"))
    return first.select("drawing_id", "kx", "ky", "f.*").withColumn("at", at)


def crowded(first: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(drawing_id) of the drawings in which two different points are within the tolerance.

    A grid join: each point looks into the nine cells around it, so that nothing is compared across the drawing.
    """
    cell = max(tolerance, 1e-6)
    cells = first.select("drawing_id", "kx", "ky", "x", "y", F.floor(F.col("x") / cell).alias("u"), F.floor(F.col("y") / cell).alias("v"))
    around = F.explode(
        F.array(*(F.struct((F.col("u") + i).alias("u"), (F.col("v") + k).alias("v")) for i in (-1, 0, 1) for k in (-1, 0, 1)))
    )
    probe = cells.select(
        "drawing_id", F.col("kx").alias("px"), F.col("ky").alias("py"), F.col("x").alias("qx"), F.col("y").alias("qy"), around.alias("c")
    ).select("*", "c.u", "c.v")
    near = (F.col("x") - F.col("qx")) ** 2 + (F.col("y") - F.col("qy")) ** 2 <= (tolerance * (1 + 1e-9)) ** 2
    other = (F.col("kx") != F.col("px")) | (F.col("ky") != F.col("py"))
    return cells.join(probe, ["drawing_id", "u", "v"]).where(other & near).select("drawing_id").distinct()


def joints(segments: DataFrame, tolerance: float = TOLERANCE, method: str = "greedy", keep=None) -> tuple[DataFrame, DataFrame]:
    """(nodes, point_nodes): (drawing_id, node_id, x, y) and (drawing_id, kx, ky, node_id).

    In a drawing without two different points within the tolerance each point is a joint: these are grouped and numbered by
    a window in the JVM. The others go through a kernel, a drawing at a time: the greedy rule depends on the order of all
    points before. ``method`` "anchor" keeps joints at their first point. ``keep`` may store the points and the joints, which
    are read several times.
    """
    keep = keep or (lambda df: df)
    kind = segments.schema["drawing_id"].dataType.simpleString()
    first = keep(_first_points(segments))
    dense = keep(crowded(first, tolerance))
    number = F.row_number().over(Window.partitionBy("drawing_id").orderBy("at")) - 1
    plain = first.join(dense, "drawing_id", "left_anti").select(
        "drawing_id", "kx", "ky", number.alias("node_id"), round_exact(F.col("x"), 2).alias("x"), round_exact(F.col("y"), 2).alias("y")
    )
    group = kernels.cluster if method == "greedy" else kernels.anchored

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b", "c"])
        centres, known = group(pdf[["x", "y"]].to_numpy(), tolerance)
        return pd.DataFrame(
            [(pdf["drawing_id"].iloc[0], kx, ky, j, *centres[j]) for (kx, ky), j in known.items()],
            columns=["drawing_id", "kx", "ky", "node_id", "x", "y"]
        )

    # a point that was met before changes nothing, so that the kernel sees first appearances only
    walk = first.join(dense, "drawing_id", "left_semi").select(
        "drawing_id", F.col("at.layer_ord").alias("a"), F.col("at.line_ord").alias("b"), F.col("at.e").alias("c"), "x", "y"
    )
    merged = walk.groupBy("drawing_id").applyInPandas(run, f"drawing_id {kind}, kx double, ky double, node_id int, x double, y double")
    both = keep(plain.unionByName(merged))
    return both.select("drawing_id", "node_id", "x", "y").distinct(), both.select(
        "drawing_id", (F.col("kx") + 0.0).alias("kx"), (F.col("ky") + 0.0).alias("ky"), "node_id"
    )


def graph_edges(segments: DataFrame, point_nodes: DataFrame) -> DataFrame:
    """(drawing_id, layer, layer_ord, line_ord, from_node, to_node): segments between different joints, parallel ones each."""
    key = lambda c: round_exact(F.col(c), 2) + 0.0
    keyed = segments.select(
        "drawing_id", "layer", "layer_ord", "line_ord", key("sx").alias("sx"), key("sy").alias("sy"), key("ex").alias("ex"),
        key("ey").alias("ey")
    )
    a = point_nodes.select("drawing_id", F.col("kx").alias("sx"), F.col("ky").alias("sy"), F.col("node_id").alias("from_node"))
    b = point_nodes.select("drawing_id", F.col("kx").alias("ex"), F.col("ky").alias("ey"), F.col("node_id").alias("to_node"))
    joined = keyed.join(a, ["drawing_id", "sx", "sy"]).join(b, ["drawing_id", "ex", "ey"])
    return joined.where("from_node <> to_node").select("drawing_id", "layer", "layer_ord", "line_ord", "from_node", "to_node")


def adjacency(edges: DataFrame) -> DataFrame:
    """(drawing_id, node_id, nbr_ord, nbr): the distinct neighbours of each joint, in the order in which edges bring them."""
    at = F.shiftleft(F.col("layer_ord").cast("bigint"), 32) + F.col("line_ord")  # a number, so that links are met by a hash aggregate
    e = edges.select("drawing_id", at.alias("at"), "from_node", "to_node")
    both = e.select("drawing_id", "at", F.col("from_node").alias("node_id"), F.col("to_node").alias("nbr")).unionByName(
        e.select("drawing_id", "at", F.col("to_node").alias("node_id"), F.col("from_node").alias("nbr"))
    )
    once = both.groupBy("drawing_id", "node_id", "nbr").agg(F.min("at").alias("at"))
    return once.select(
        "drawing_id", "node_id", F.row_number().over(Window.partitionBy("drawing_id", "node_id").orderBy("at")).alias("nbr_ord"), "nbr"
    )


def degree_distribution(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(drawing_id, degree, n): how many joints have so many distinct neighbours; joints without any count as 0."""
    per = nodes.select("drawing_id", "node_id", F.lit(0).alias("d")).unionByName(links.select("drawing_id", "node_id", F.lit(1).alias("d")))
    return per.groupBy("drawing_id", "node_id").agg(F.sum("d").alias("degree")).groupBy("drawing_id", "degree").agg(F.count("*").alias("n"))


def detect_loops(
    links: DataFrame, max_length: int = kernels.MAX_LENGTH, max_loops: int = kernels.MAX_LOOPS, max_steps: int = kernels.MAX_STEPS,
    by: str = "nodes", keep=None
) -> tuple[DataFrame, DataFrame]:
    """(loops, truncated): (drawing_id, found_ord, node_ids) and (drawing_id, truncated), a kernel run for each drawing.

    The search and its bounds are sequential over a drawing, so drawings are the unit of parallelism. Drawings whose joints
    have no links have no row.
    """
    kind = links.schema["drawing_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        top = int(pdf[["node_id", "nbr"]].to_numpy().max())
        near = [[] for _ in range(top + 1)]
        for node, nbr in pdf.sort_values(["node_id", "nbr_ord"])[["node_id", "nbr"]].itertuples(index=False):
            near[node].append(nbr)
        found, cut = kernels.cycles(near, max_length, max_loops, max_steps, by)
        drawing = pdf["drawing_id"].iloc[0]
        return pd.DataFrame(
            [(drawing, k, ids, cut) for k, ids in enumerate(found)] + [(drawing, -1, [], cut)],
            columns=["drawing_id", "found_ord", "node_ids", "truncated"]
        )

    rows = links.groupBy("drawing_id").applyInPandas(run, f"drawing_id {kind}, found_ord int, node_ids array<int>, truncated boolean")
    rows = keep(rows) if keep else rows
    return rows.where("found_ord >= 0").drop("truncated"), rows.where("found_ord = -1").select("drawing_id", "truncated")


def detect_loops_sql(links: DataFrame, max_length: int = kernels.MAX_LENGTH) -> DataFrame:
    """(drawing_id, node_ids): the loops of ``detect_loops`` without bounds on their number, by a recursive query.

    For small graphs: all simple paths are enumerated. Of the cycles of one set of nodes the least path is taken.
    """
    links.createOrReplaceTempView("draftlake_links")
    found = links.sparkSession.sql(
        f"""WITH RECURSIVE walk (drawing_id, path) AS (
            SELECT DISTINCT drawing_id, array(node_id) FROM draftlake_links
            UNION ALL
            SELECT w.drawing_id, concat(w.path, array(a.nbr)) FROM walk w JOIN draftlake_links a ON a.drawing_id = w.drawing_id AND a.node_id = element_at(w.path, -1)
            WHERE a.nbr > w.path[0] AND NOT array_contains(w.path, a.nbr) AND size(w.path) < {max_length})
        SELECT w.drawing_id, w.path FROM walk w JOIN draftlake_links a ON a.drawing_id = w.drawing_id AND a.node_id = element_at(w.path, -1) AND a.nbr = w.path[0] WHERE size(w.path) >= 3"""
    )
    return found.groupBy(
        "drawing_id", F.array_sort("path").alias("members")
    ).agg(F.min("path").alias("node_ids")).select("drawing_id", "node_ids")


def loop_metadata(loops: DataFrame, nodes: DataFrame) -> DataFrame:
    """``loops`` with loop_ord, num_segments, area, centroid and bounding box; the largest area is loop 1.

    The corner coordinates come by an equi-join on (drawing, node); area and the rest are aggregates over an array of points.
    """
    corners = loops.select(
        "drawing_id", "found_ord", "node_ids", F.posexplode("node_ids").alias("k", "node_id")
    ).join(nodes, ["drawing_id", "node_id"])
    ring = corners.groupBy("drawing_id", "found_ord").agg(
        F.first("node_ids").alias("node_ids"), F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias("r")
    )
    n = F.size("r")
    ahead = F.concat(F.slice("r", 2, n - 1), F.slice("r", 1, 1))
    twice = F.aggregate(
        F.arrays_zip(F.col("r").alias("p"), ahead.alias("q")), F.lit(0.0), lambda a,
        e: a + e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]
    )
    total = lambda axis: F.aggregate("r", F.lit(0.0), lambda a, p: a + p[axis])
    fold = lambda f, axis: round_exact(f(F.transform("r", lambda p: p[axis])), 2)
    m = ring.where(n >= 3).select(
        "drawing_id", "found_ord", "node_ids", n.alias("num_segments"), round_exact(F.abs(twice) / 2, 2).alias("area"),
        round_exact(total("x") / n, 2).alias("cx"), round_exact(total("y") / n, 2).alias("cy"),
        fold(F.array_min, "x").alias("min_x"), fold(F.array_min, "y").alias("min_y"), fold(F.array_max, "x").alias("max_x"),
        fold(F.array_max, "y").alias("max_y"),
        F.transform("r", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"),
    )
    return m.withColumn("loop_ord", F.row_number().over(Window.partitionBy("drawing_id").orderBy(F.desc("area"), "found_ord")))


def loop_boundary_layers(loops: DataFrame, edges: DataFrame) -> DataFrame:
    """(drawing_id, loop_ord, layer): the layers that segments along each loop lie on."""
    ahead = F.concat(F.slice("node_ids", 2, F.size("node_ids") - 1), F.slice("node_ids", 1, 1))
    sides = loops.select(
        "drawing_id", "loop_ord", F.explode(F.arrays_zip(F.col("node_ids").alias("u"), ahead.alias("v"))).alias("e")
    ).select("drawing_id", "loop_ord", F.least("e.u", "e.v").alias("u"), F.greatest("e.u", "e.v").alias("v"))
    flat = edges.select("drawing_id", "layer", F.least("from_node", "to_node").alias("u"), F.greatest("from_node", "to_node").alias("v"))
    return sides.join(flat, ["drawing_id", "u", "v"]).select("drawing_id", "loop_ord", "layer").distinct()


def analyse(segments: DataFrame, tolerance: float = TOLERANCE, keep=None, **bounds) -> Topology:
    """All of pass 2; ``keep`` may store a table that several later steps read."""
    keep = keep or (lambda df: df)
    nodes, points = joints(segments, tolerance, keep=keep)
    edges = keep(graph_edges(segments, points))
    links = keep(adjacency(edges))
    loops, cut = detect_loops(links, keep=keep, **bounds)
    return Topology(nodes, points, edges, links, keep(loop_metadata(loops, nodes)), cut)
