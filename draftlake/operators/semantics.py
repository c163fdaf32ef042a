"""Pass 4: statistics of layers, texts anchored to geometry, entities assigned to rooms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import is_room_layer
from ..functions.geometry import distance, dominant
from ..functions.rounding import round_exact
from ..plans.store import kept
from .extraction import Layers

SAMPLE, LEAST_RADIUS, DEFAULT_RADIUS = 100, 50.0, 500.0
#: Sides of the squares of the local searches for the nearest, in drawing units, each for what the one before left.
CELLS = (1.0, 8.0, 64.0, 512.0, 4096.0)


def layer_statistics(t: Layers) -> DataFrame:
    """One row for each layer, empty ones too: counts, total length and dominant alignment. One shuffle."""
    base = ["drawing_id", "layer", "layer_ord"]
    zero = F.lit(0)
    a = F.coalesce("alignment", F.lit("diagonal"))
    flags = lambda **k: [k.get(n, zero).cast("bigint").alias(n) for n in ("c", "x", "h", "v", "d", "n")]
    rows = (
        t.segments.select(
            *base, distance(F.col("sx"), F.col("sy"), F.col("ex"), F.col("ey")).alias("len"),
            *flags(h=(a == "horizontal").cast("int"), v=(a == "vertical").cast("int"), d=(a == "diagonal").cast("int"), n=F.lit(1))
        )
        .unionByName(t.circles.select(*base, F.lit(0.0).alias("len"), *flags(c=F.lit(1))))
        .unionByName(t.texts.select(*base, F.lit(0.0).alias("len"), *flags(x=F.lit(1))))
        .unionByName(t.layers.select(*base, F.lit(0.0).alias("len"), *flags()))
    )
    g = rows.groupBy(*base).agg(
        F.sum("n").alias("line_count"), F.sum("c").alias("circle_arc_count"), F.sum("x").alias("text_count"), F.sum("len").alias("len"),
        F.sum("h").alias("h"), F.sum("v").alias("v"), F.sum("d").alias("d")
    )
    return g.select(
        *base, "line_count", "circle_arc_count", "text_count", round_exact(F.col("len"), 2).alias("total_line_length"),
        dominant(F.col("h"), F.col("v"), F.col("d")).alias("dominant_alignment")
    )


def anchor_points(t: Layers) -> DataFrame:
    """(drawing_id, ord, gx, gy, glayer, gtype): middles of segments and centres of circles, the first in the walk at each place.

    ``ord`` is the order of the walk, 32 bits for the layer, one for the kind and 31 within, so that places are found by a hash
    aggregate over numbers alone; the layer's name comes from ``t.layers`` afterwards.
    """
    place = lambda k, i: (F.shiftleft(F.col("layer_ord").cast("bigint"), 32) + F.lit(k << 31) + F.col(i)).alias("ord")
    lines = t.segments.select(
        "drawing_id", place(0, "line_ord"), ((F.col("sx") + F.col("ex")) / 2).alias("gx"), ((F.col("sy") + F.col("ey")) / 2).alias("gy")
    )
    circles = t.circles.select("drawing_id", place(1, "circle_ord"), F.col("cx").alias("gx"), F.col("cy").alias("gy"))
    first = lines.unionByName(circles).groupBy("drawing_id", "gx", "gy").agg(F.min("ord").alias("ord"))
    names = t.layers.select("drawing_id", F.col("layer_ord").alias("_l"), F.col("layer").alias("glayer")).distinct()
    kind = F.when(F.shiftright("ord", 31).bitwiseAND(1) == 0, "line_midpoint").otherwise("circle_arc_center").alias("gtype")
    return first.withColumn("_l", F.shiftright("ord", 32)).join(names, ["drawing_id", "_l"]).select(
        "drawing_id", "ord", "gx", "gy", "glayer", kind
    )


def nearest(
    queries: DataFrame, refs: DataFrame, key: list[str], qx: str, qy: str, rx: str, ry: str, ord: str, cells: tuple[float, ...] = CELLS,
    keep=None
) -> DataFrame:
    """Each of ``queries`` (unique in drawing_id and ``key``) with the columns of its nearest reference and ``d``.

    The exact nearest of the same drawing, the first in ``ord`` of equally near ones. What is searched are the different places
    of queries and references, once each, however many lie at one. Each place looks into the nine cells around it: a hit within
    the cell size is the nearest of all. What finds none looks into larger cells, which hold few references where small ones hold
    none. What is further from all than the largest goes through the filled cells of its drawing, large ones first, and follows
    those alone that may hold the nearest. All are equi-joins of sorted sides, as the size of stored tables doesn't tell what
    their rows take in memory. ``keep`` stores what each search finds and leaves, by default ``plans.store.kept``.
    """
    keep = keep or kept
    ids = ["drawing_id", "_x", "_y"]
    cols = [c for c in refs.columns if c != "drawing_id"]
    at = lambda c, cell: F.floor(F.col(c) / cell)
    spots = keep(
        refs.where(F.col(rx).isNotNull() & F.col(ry).isNotNull()).groupBy("drawing_id", F.col(rx).alias("_rx"), F.col(ry).alias("_ry")).agg(
            F.min(F.struct(F.col(ord).alias("_o"), *cols)).alias("_r")
        )
    )
    dx, dy = F.col("_x") - F.col("_rx"), F.col("_y") - F.col("_ry")
    least = F.min(F.struct("_d", "_r")).alias("_n")
    rest, found = keep(queries.select("drawing_id", F.col(qx).alias("_x"), F.col(qy).alias("_y")).distinct()), []
    for cell in cells:
        gridded = spots.select("*", at("_rx", cell).alias("_u"), at("_ry", cell).alias("_v"))
        around = F.explode(
            F.array(
                *(F.struct((at("_x", cell) + i).alias("u"), (at("_y", cell) + k).alias("v")) for i in (-1, 0, 1) for k in (-1, 0, 1))
            )
        )
        probe = rest.select(*ids, around.alias("_c")).select(*ids, F.col("_c.u").alias("_u"), F.col("_c.v").alias("_v"))
        pairs = probe.join(gridded.hint("merge"), ["drawing_id", "_u", "_v"]).withColumn("_d", dx * dx + dy * dy)
        found.append(keep(pairs.where(F.col("_d") <= cell * cell).groupBy(*ids).agg(least)))
        rest = keep(rest.join(found[-1].select(*ids).hint("merge"), ids, "left_anti"))
    near, inside = rest, []
    for k, cell in enumerate(cells[:1:-1] or cells[-1:]):
        known = [f"_{c}{i}" for i in range(k) for c in "uv"]
        inside += [at("_rx", cell).alias(f"_u{k}"), at("_ry", cell).alias(f"_v{k}")]
        filled = spots.select("drawing_id", *inside).distinct()
        low, high = F.lit(0.0), F.lit(0.0)
        for x, u in (("_x", f"_u{k}"), ("_y", f"_v{k}")):
            before, after = F.col(u) * cell - F.col(x), F.col(x) - (F.col(u) + 1) * cell
            low += F.pow(F.greatest(before, after, F.lit(0.0)), F.lit(2.0))
            high += F.pow(F.greatest(-before, -after), F.lit(2.0))
        reach = near.join(filled.hint("merge"), ["drawing_id", *known]).withColumns({"_low": low, "_high": high})
        reach = reach.withColumn("_most", F.min("_high").over(Window.partitionBy(*ids)))
        near = reach.where(F.col("_low") <= F.col("_most") * (1 + 1e-9)).drop("_low", "_high", "_most")
    far = near.join(spots.select("*", *inside).hint("merge"), ["drawing_id", *known, f"_u{k}", f"_v{k}"]).withColumn("_d", dx * dx + dy * dy)
    places = far.groupBy(*ids).agg(least)
    for x in found:
        places = places.unionByName(x)
    joined = queries.withColumns({"_x": F.col(qx), "_y": F.col(qy)}).join(places.hint("merge"), ids)
    return joined.select(*queries.columns, F.sqrt("_n._d").alias("d"), *(F.col(f"_n._r.{c}").alias(c) for c in cols))


def text_neighbours(t: Layers, keep=None) -> DataFrame:
    """Each text with its nearest anchor point; the base of the radius and of the anchors, computed once."""
    return nearest(
        t.texts.select("drawing_id", "layer", "layer_ord", "text_ord", "tx", "ty", "text"), anchor_points(t), ["layer_ord", "text_ord"],
        "tx", "ty", "gx", "gy", "ord", keep=keep
    )


def anchor_radius(t: Layers, near: DataFrame) -> DataFrame:
    """(drawing_id, radius): twice the upper median of the first 100 texts' distances, 50 at least; 500 without texts or geometry."""
    order = Window.partitionBy("drawing_id").orderBy("layer_ord", "text_ord")
    first = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE)
    med = first.groupBy("drawing_id").agg(F.array_sort(F.collect_list("d")).alias("ds")).select(
        "drawing_id", F.element_at("ds", (F.floor(F.size("ds") / 2) + 1).cast("int")).alias("m")
    )
    radius = round_exact(F.greatest(F.col("m") * 2, F.lit(LEAST_RADIUS)), 1)
    drawings = t.layers.select("drawing_id").distinct()
    return drawings.join(med, "drawing_id", "left").select(
        "drawing_id", F.when(F.col("m").isNull(), F.lit(DEFAULT_RADIUS)).otherwise(radius).alias("radius")
    )


def text_anchors(near: DataFrame, radius: DataFrame | float) -> DataFrame:
    """Texts within the radius of their nearest anchor point, which is inclusive."""
    if isinstance(radius, DataFrame):
        j, limit = near.join(radius, "drawing_id"), F.col("radius")
    else:
        j, limit = near, F.lit(float(radius))
    return j.where(F.col("d") <= limit).select(
        "drawing_id", "layer_ord", "text_ord", "text", "tx", "ty", F.col("layer").alias("text_layer"),
        F.col("gtype").alias("nearest_entity_type"), round_exact(F.col("gx"), 2).alias("nearest_x"),
        round_exact(F.col("gy"), 2).alias("nearest_y"),
        F.col("glayer").alias("nearest_entity_layer"), round_exact(F.col("d"), 2).alias("distance"),
    )


def unanchored_texts(t: Layers, anchors: DataFrame) -> DataFrame:
    return t.texts.join(anchors.select("drawing_id", "layer_ord", "text_ord"), ["drawing_id", "layer_ord", "text_ord"], "left_anti")


def room_labels(texts: DataFrame) -> DataFrame:
    """(drawing_id, room_ord, label, x, y): the texts on layers whose name tells of labels, in the order of the walk."""
    rooms = texts.where(is_room_layer(F.col("layer")))
    return rooms.select(
        "drawing_id", F.row_number().over(Window.partitionBy("drawing_id").orderBy("layer_ord", "text_ord")).alias("room_ord"),
        F.col("text").alias("label"), F.col("tx").alias("x"), F.col("ty").alias("y")
    )


def room_members(t: Layers, rooms: DataFrame, blocks: DataFrame | None = None, keep=None) -> DataFrame:
    """(drawing_id, room_ord, layer_ord, kind_ord, item_ord, handle, type, layer): each entity with its nearest room label."""
    name = F.coalesce("handle", "id", F.lit("?")).alias("handle")
    row = lambda k, kind, i, x, y, h=name: [
        "drawing_id", "layer", "layer_ord", F.lit(k).alias("kind_ord"), F.col(i).alias("item_ord"), x.alias("px"), y.alias("py"), h,
        F.lit(kind).alias("type")
    ]
    rows = (
        t.segments.select(*row(0, "line", "line_ord", (F.col("sx") + F.col("ex")) / 2, (F.col("sy") + F.col("ey")) / 2))
        .unionByName(t.circles.select(*row(1, "circle_arc", "circle_ord", F.col("cx"), F.col("cy"))))
        .unionByName(t.texts.select(*row(2, "text", "text_ord", F.col("tx"), F.col("ty"))))
    )
    if blocks is not None:
        rows = rows.unionByName(
            blocks.select(*row(3, "block", "block_ord", F.col("bx"), F.col("by"), F.coalesce("handle", F.lit("?")).alias("handle")))
        )
    refs = rooms.select("drawing_id", "room_ord", F.col("x").alias("rx"), F.col("y").alias("ry"))
    found = nearest(rows, refs, ["layer_ord", "kind_ord", "item_ord"], "px", "py", "rx", "ry", "room_ord", keep=keep)
    return found.select("drawing_id", "room_ord", "layer_ord", "kind_ord", "item_ord", "handle", "type", "layer")
