"""Pass 1: bounds, normalisation, and the segments, circles and texts of each drawing."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import discipline
from ..functions.geometry import alignment
from ..functions.rounding import round_by, round_exact
from ..functions.text import content

#: Landscape sheets in mm: name, width, height, in the order that decides between equal fits.
SHEETS = tuple(
    (n, int(w), int(h)) for n, w, h in (x.split() for x in ("A0 1189 841", "A1 841 594", "A2 594 420", "A3 420 297", "A4 297 210"))
)
SCALES = tuple(int(x) for x in "1 5 10 20 25 50 100 200 500".split())
FIT = 0.15
BLOCK_TYPES = tuple("LINE CIRCLE ARC TEXT MTEXT".split())


class Layers(NamedTuple):
    """The tables of pass 1: what all later passes take."""

    layers: DataFrame
    segments: DataFrame
    circles: DataFrame
    texts: DataFrame


# bounds


def _let(values: dict[str, Column], body) -> Column:
    """``body`` of a struct of named values, each of which is computed once."""
    return F.element_at(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), body), 1)


def _arc_box(cx: Column, cy: Column, r: Column, a: Column, b: Column) -> Column:
    """{x0, y0, x1, y1} of an arc from angle a to b, anticlockwise, in degrees."""

    def box(e: Column) -> Column:
        holds = lambda q: F.pmod(F.lit(float(q)) - e["a"], F.lit(360.0)) <= F.when(e["span"] == 0, 360.0).otherwise(e["span"])
        xs, ys = [e["cx"] + e["r"] * F.cos(F.radians(e[t])) for t in "ab"], [e["cy"] + e["r"] * F.sin(F.radians(e[t])) for t in "ab"]
        return F.struct(
            F.when(holds(180), e["cx"] - e["r"]).otherwise(F.least(*xs)).alias("x0"),
            F.when(holds(270), e["cy"] - e["r"]).otherwise(F.least(*ys)).alias("y0"),
            F.when(holds(0), e["cx"] + e["r"]).otherwise(F.greatest(*xs)).alias("x1"),
            F.when(holds(90), e["cy"] + e["r"]).otherwise(F.greatest(*ys)).alias("y1"),
        )

    return _let({"cx": cx, "cy": cy, "r": r, "a": a, "b": b, "span": F.pmod(b - a, F.lit(360.0))}, box)


def _edge_box(e: Column) -> Column:
    """{x0, y0, x1, y1} of a polyline edge {p, q, b}; b is its bulge, the tangent of a quarter of the arc's angle."""

    def bent(m: Column) -> Column:
        cx, cy = (m["px"] + m["qx"]) / 2 - m["k"] * (m["qy"] - m["py"]), (m["py"] + m["qy"]) / 2 + m["k"] * (m["qx"] - m["px"])

        def of_centre(c: Column) -> Column:
            a, b = F.degrees(F.atan2(c["py"] - c["cy"], c["px"] - c["cx"])), F.degrees(F.atan2(c["qy"] - c["cy"], c["qx"] - c["cx"]))
            return _arc_box(
                c["cx"], c["cy"], F.hypot(c["px"] - c["cx"], c["py"] - c["cy"]), F.when(c["b"] > 0, a).otherwise(b),
                F.when(c["b"] > 0, b).otherwise(a)
            )

        return _let({"cx": cx, "cy": cy, **{k: m[k] for k in ("px", "py", "qx", "qy", "b")}}, of_centre)

    p, q = e["p"], e["q"]
    flat = F.struct(
        F.least(p["x"], q["x"]).alias("x0"), F.least(p["y"], q["y"]).alias("y0"), F.greatest(p["x"], q["x"]).alias("x1"),
        F.greatest(p["y"], q["y"]).alias("y1")
    )
    arc = _let(
        {
            "px": p["x"], "py": p["y"], "qx": q["x"], "qy": q["y"], "b": e["b"],
            "k": F.try_divide(F.lit(1.0) - e["b"] * e["b"], F.lit(4.0) * e["b"])
        },
        bent
    )
    return F.when(F.coalesce(e["b"], F.lit(0.0)) == 0, flat).otherwise(arc)


def _each(items: Column, field: str) -> Column:
    return F.transform(items, lambda v: v[field])


def entity_boxes(entities: DataFrame) -> DataFrame:
    """``entities`` with its bounding box min_x .. max_y, null where an entity has no extent of its own.

    Circles and arcs by their quadrants, polylines with their bulges, text by its height and length (0.6 of the height a
    character), all others by their points. Block references have none of their own: ``bounds`` places the members of blocks.
    """
    p = F.col("pts")
    first = F.try_element_at(p, F.lit(1))
    cx, cy, r = first["x"], first["y"], F.abs(F.col("radius"))
    circle, arc = F.col("dxftype") == "CIRCLE", F.col("dxftype") == "ARC"
    text = F.col("dxftype").isin("TEXT", "MTEXT") & F.col("text").isNotNull()
    n = F.size(p)
    following = F.concat(F.slice(p, 2, F.greatest(n - 1, F.lit(0))), F.when(F.col("closed"), F.slice(p, 1, 1)).otherwise(F.slice(p, 1, 0)))
    edges = F.filter(
        F.arrays_zip(p.alias("p"), following.alias("q"), F.coalesce("bulges", F.expr("array(0D)")).alias("b")),
        lambda e: e["p"].isNotNull() & e["q"].isNotNull()
    )
    bent = (F.col("dxftype") == "LWPOLYLINE") & F.exists(F.coalesce("bulges", F.expr("array(0D)")), lambda b: b != 0) & (n >= 2)
    entities = entities.withColumns(
        {
            "_arc": F.when(arc, _arc_box(cx, cy, r, F.col("start_angle"), F.col("end_angle"))),
            "_edges": F.when(bent, F.transform(edges, _edge_box))
        }
    )
    wide = F.coalesce("height", F.lit(0.0)) * F.length("text") * 0.6
    high = F.coalesce("height", F.lit(0.0))
    out = []
    for k, (axis, least) in enumerate((("x", True), ("y", True), ("x", False), ("y", False))):
        fold = F.array_min if least else F.array_max
        points = fold(_each(p, axis))
        ring = cx if axis == "x" else cy
        extra = F.lit(0.0) if least else (wide if axis == "x" else high)
        name = ("x0", "y0", "x1", "y1")[k]
        box = F.when(circle, ring - r if least else ring + r).when(arc, F.col(f"_arc.{name}")).when(text, ring + extra).when(
            bent, fold(_each(F.col("_edges"), name))
        ).when(F.col("dxftype") != "INSERT", points)
        out.append(F.when(F.col("error").isNull(), box).alias(("min_x", "min_y", "max_x", "max_y")[k]))
    return entities.select("*", *out).drop("_arc", "_edges")


def drawing_bounds(boxes: DataFrame) -> DataFrame:
    """(drawing_id, min_x, min_y, max_x, max_y, skipped): the union of the boxes of each drawing.

    A row with an ``error`` counts as skipped. A drawing without any box has null bounds; nothing is raised.
    """
    return boxes.groupBy("drawing_id").agg(
        F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"),
        F.count("error").alias("skipped")
    )


#: Blocks inside blocks that are followed at most: more can only be a reference of a block to itself.
NESTED = 64
_AFFINE = ("a", "b", "c", "d", "e", "f")


def placements(entities: DataFrame, keep=None) -> DataFrame:
    """(drawing_id, block, a .. f): where each block lies in model space, by references from it and from other blocks.

    A point (x, y) of the block is at (a x + c y + e, b x + d y + f). Levels of nesting are followed until there is none;
    ``keep`` may store each.
    """
    keep = keep or (lambda df: df)
    base = entities.where("block IS NOT NULL").groupBy("drawing_id", F.col("block").alias("into")).agg(
        F.first("block_x", True).alias("bx"), F.first("block_y", True).alias("by")
    )
    angle = F.radians(F.coalesce("rotation", F.lit(0.0)))
    x, y = F.coalesce("xscale", F.lit(1.0)), F.coalesce("yscale", F.lit(1.0))
    at = F.try_element_at("pts", F.lit(1))
    refs = entities.where("dxftype = 'INSERT' AND error IS NULL").select(
        "drawing_id", "block", "paperspace", F.col("block_name").alias("into"), (F.cos(angle) * x).alias("a"),
        (F.sin(angle) * x).alias("b"), (-F.sin(angle) * y).alias("c"), (F.cos(angle) * y).alias("d"), at["x"].alias("x"), at["y"].alias("y")
    )
    bx, by = F.coalesce("bx", F.lit(0.0)), F.coalesce("by", F.lit(0.0))
    refs = refs.join(base, ["drawing_id", "into"]).withColumns(
        {"e": F.col("x") - F.col("a") * bx - F.col("c") * by, "f": F.col("y") - F.col("b") * bx - F.col("d") * by}
    )
    inner = keep(
        refs.where("block IS NOT NULL").select(
            "drawing_id", F.col("block").alias("within"), "into", *(F.col(k).alias(f"i{k}") for k in _AFFINE)
        )
    )
    now = refs.where("block IS NULL AND paperspace = 0").select("drawing_id", F.col("into").alias("block"), *_AFFINE)
    every, more = now, not inner.isEmpty()
    col = F.col
    for _ in range(NESTED):
        if not more:
            break
        joined = now.join(inner, (now["drawing_id"] == inner["drawing_id"]) & (now["block"] == inner["within"])).drop(inner["drawing_id"])
        linear = {"na": ("a", "c", "ia", "ib"), "nb": ("b", "d", "ia", "ib"), "nc": ("a", "c", "ic", "id"), "nd": ("b", "d", "ic", "id")}
        moved = {k: col(p) * col(u) + col(q) * col(v) for k, (p, q, u, v) in linear.items()}
        moved |= {
            "ne": col("a") * col("ie") + col("c") * col("if") + col("e"), "nf": col("b") * col("ie") + col("d") * col("if") + col("f")
        }
        now = keep(joined.select("drawing_id", col("into").alias("block"), *(v.alias(k[1]) for k, v in moved.items())))
        more = not now.isEmpty()
        every = every.unionByName(now)
    return every


def _placed_boxes(members: DataFrame) -> DataFrame:
    """(drawing_id, min_x .. max_y) of members of blocks with their own boxes and where they are placed.

    Points, circles and arcs exactly, whatever the transformation; texts and bent polylines by the corners of their boxes.
    """
    col = F.col
    kind, first, r = col("dxftype"), F.try_element_at("pts", F.lit(1)), F.abs(col("radius"))
    x = lambda p: col("a") * p["x"] + col("c") * p["y"] + col("e")
    y = lambda p: col("b") * p["x"] + col("d") * p["y"] + col("f")
    corners = F.array(*(F.struct(col(u).alias("x"), col(v).alias("y")) for u in ("min_x", "max_x") for v in ("min_y", "max_y")))
    start, end = col("start_angle"), col("end_angle")
    span = F.pmod(end - start, F.lit(360.0))
    holds = lambda q: F.pmod(q - start, F.lit(360.0)) <= F.when(span == 0, 360.0).otherwise(span)
    boxed = kind.isin("TEXT", "MTEXT") | ((kind == "LWPOLYLINE") & F.exists(F.coalesce("bulges", F.expr("array(0D)")), lambda b: b != 0))
    points = F.when(boxed, corners).otherwise(col("pts"))
    out = []
    for axis, put, (p, q) in (("x", x, ("a", "c")), ("y", y, ("b", "d"))):
        centre, reach = put(first), r * F.hypot(col(p), col(q))
        top = F.degrees(F.atan2(col(q), col(p)))  # the angle at which the arc is furthest in this direction
        ends = [centre + r * (col(p) * F.cos(F.radians(t)) + col(q) * F.sin(F.radians(t))) for t in (start, end)]
        low = F.when(kind == "CIRCLE", centre - reach).when(
            kind == "ARC", F.when(holds(top + 180), centre - reach).otherwise(F.least(*ends))
        ).otherwise(F.array_min(F.transform(points, put)))
        high = F.when(kind == "CIRCLE", centre + reach).when(
            kind == "ARC", F.when(holds(top), centre + reach).otherwise(F.greatest(*ends))
        ).otherwise(F.array_max(F.transform(points, put)))
        out += [low.alias(f"min_{axis}"), high.alias(f"max_{axis}")]
    return members.where("min_x IS NOT NULL").select("drawing_id", *out)


def bounds(entities: DataFrame, keep=None) -> DataFrame:
    """Bounds of the model space of each drawing, with the members of its blocks, and of blocks in blocks, where they are placed."""
    boxed = entity_boxes(entities)
    own = boxed.where("block IS NULL AND paperspace = 0").select("drawing_id", "error", "min_x", "min_y", "max_x", "max_y")
    members = boxed.where("block IS NOT NULL AND dxftype <> 'INSERT'").join(placements(entities, keep), ["drawing_id", "block"])
    return drawing_bounds(own.unionByName(_placed_boxes(members).withColumn("error", F.lit(None).cast("string"))))


# normalisation


def paper_fit(extents: DataFrame) -> DataFrame:
    """``extents`` (width, height) with paper_size, paper_scale, expected_w, expected_h and fit_error of the best sheet.

    All 45 sheets and scales are literals of one expression: no join. The least mean relative error below 15 % wins, the
    first of equal ones.
    """
    w, h = F.greatest("width", "height"), F.least("width", "height")
    fits = []
    for k, (name, pw, ph) in enumerate(SHEETS):
        for j, scale in enumerate(SCALES):
            ew, eh = float(pw * scale), float(ph * scale)
            err = (F.abs(w - ew) / ew + F.abs(h - eh) / eh) / 2
            fits.append(
                F.struct(
                    err.alias("err"), F.lit(k * len(SCALES) + j).alias("ord"), F.lit(name).alias("name"), F.lit(scale).alias("scale"),
                    F.lit(pw * scale).alias("ew"), F.lit(ph * scale).alias("eh")
                )
            )
    best = extents.withColumn("_fit", F.array_min(F.array(*fits)))
    ok = F.col("_fit.err") < FIT
    take = lambda c: F.when(ok, c)
    return best.select(
        *extents.columns, take(F.col("_fit.name")).alias("paper_size"), take(F.col("_fit.scale")).alias("paper_scale"),
        take(F.col("_fit.ew")).alias("expected_w"), take(F.col("_fit.eh")).alias("expected_h"),
        take(round_exact(F.col("_fit.err") * 100, 1)).alias("fit_error"),
    )


def normalisation(bounds: DataFrame) -> DataFrame:
    """One row a drawing: centre, scaled width and height, scale_factor, rounding, and the paper that fits.

    Extents over 5000 that fit a paper are divided by its scale; those over 50000 without one so that the larger is 1000.
    Scaled drawings whose corners are on average within 0.3 of integers are rounded to integers, others to one decimal.
    """
    sized = bounds.where("min_x IS NOT NULL").withColumns(
        {
            "center_x": (F.col("min_x") + F.col("max_x")) / 2, "center_y": (F.col("min_y") + F.col("max_y")) / 2,
            "width": F.col("max_x") - F.col("min_x"), "height": F.col("max_y") - F.col("min_y")
        }
    )
    fit = paper_fit(sized)
    most = F.greatest("width", "height")
    fit = fit.withColumn(
        "scale_factor",
        F.when(
            F.col("paper_size").isNotNull() & (most > 5000), F.col("paper_scale").cast("double")
        ).when(F.col("paper_size").isNull() & (most > 50000), most / 1000.0).otherwise(1.0)
    )
    s = F.col("scale_factor")
    corner = [
        (F.col(v) - F.col(c)) / s for v, c in (("min_x", "center_x"), ("max_x", "center_x"), ("min_y", "center_y"), ("max_y", "center_y"))
    ]
    off = [F.abs(x - F.rint(x)) for x in corner]
    fine = (s > 1) & ((off[0] + off[1] + off[2] + off[3]) / 4 < 0.3)
    return fit.select(
        "drawing_id", "center_x", "center_y", (F.col("width") / s).alias("width"), (F.col("height") / s).alias("height"), "scale_factor",
        F.when(fine, 0).otherwise(1).alias("rounding"),
        "paper_size", "paper_scale", "expected_w", "expected_h", "fit_error",
    )


# primitives


def primitives(entities: DataFrame) -> DataFrame:
    """One row for each segment, circle, arc and text, in drawing units, and a 'touch' row for a layer without any.

    Columns: drawing_id, seq, sub, layer, handle, kind, dxftype, x1, y1, x2, y2, radius, start_angle, end_angle, text, loose.
    Polylines give the segments between their points (not the closing one), solids their outline, block references the
    lines, circles, arcs and texts of their block, scaled by xscale and moved, on the layer of the reference; ``loose``
    marks segments of solids and blocks. Other types give nothing.
    """
    model = entities.where("block IS NULL AND paperspace = 0 AND error IS NULL")
    at = lambda k, p="pts": F.try_element_at(p, F.lit(k))
    none = F.lit(None).cast("double")
    own = model.where(F.col("dxftype").isin(*BLOCK_TYPES)).withColumns(
        {"sub": F.lit(0).cast("bigint"), "loose": F.lit(False), "dx": F.lit(0.0), "dy": F.lit(0.0), "k": F.lit(1.0)}
    )
    inside = entities.where(F.col("block").isNotNull() & F.col("dxftype").isin(*BLOCK_TYPES) & F.col("error").isNull())
    refs = model.where("dxftype = 'INSERT'").select(
        "drawing_id", F.col("seq").alias("seq0"), F.col("layer").alias("layer0"), F.col("block_name").alias("block"),
        at(1)["x"].alias("dx"), at(1)["y"].alias("dy"), F.coalesce("xscale", F.lit(1.0)).alias("k")
    )
    placed = inside.join(refs, ["drawing_id", "block"]).withColumns(
        {"sub": F.col("seq"), "seq": F.col("seq0"), "layer": F.col("layer0"), "handle": F.lit(None).cast("string"), "loose": F.lit(True)}
    )
    cols = [
        "drawing_id", "seq", "sub", "layer", "handle", "dxftype", "pts", "radius", "start_angle", "end_angle", "text", "loose", "dx", "dy",
        "k"
    ]
    simple = own.select(cols).unionByName(placed.select(cols))
    line, round_ = F.col("dxftype") == "LINE", F.col("dxftype").isin("CIRCLE", "ARC")
    k, dx, dy = F.col("k"), F.col("dx"), F.col("dy")
    simple = simple.select(
        "drawing_id", "seq", "sub", "layer", "handle", F.when(line, "line").when(round_, "circle").otherwise("text").alias("kind"),
        "dxftype",
        (at(1)["x"] * k + dx).alias("x1"), (at(1)["y"] * k + dy).alias("y1"), F.when(line, at(2)["x"] * k + dx).alias("x2"),
        F.when(line, at(2)["y"] * k + dy).alias("y2"),
        F.when(round_, F.col("radius") * k).alias("radius"), F.when(F.col("dxftype") == "ARC", F.col("start_angle")).alias("start_angle"),
        F.when(F.col("dxftype") == "ARC", F.col("end_angle")).alias("end_angle"),
        F.when(~line & ~round_, F.coalesce("text", F.lit(""))).alias("text"), "loose",
    ).where("x1 IS NOT NULL")
    n = F.size("pts")
    poly = model.where("dxftype = 'LWPOLYLINE'").withColumn(
        "e",
        F.explode_outer(
            F.when(
                n >= 2,
                F.transform(
                    F.sequence(F.lit(1), n - 1),
                    lambda i: F.struct(i.alias("i"), F.element_at("pts", i).alias("p"), F.element_at("pts", i + 1).alias("q"))
                )
            )
        )
    )
    solid = model.where("dxftype = 'SOLID'").withColumn(
        "e",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), n),
                lambda i: F.struct(i.alias("i"), F.element_at("pts", i).alias("p"), F.element_at("pts", i % n + 1).alias("q"))
            )
        )
    )
    edges = [
        d.select(
            "drawing_id", "seq", F.coalesce(F.col("e.i"), F.lit(0)).cast("bigint").alias("sub"), "layer", "handle",
            F.when(F.col("e").isNull(), "touch").otherwise("line").alias("kind"), "dxftype",
            F.col("e.p.x").alias("x1"), F.col("e.p.y").alias("y1"), F.col("e.q.x").alias("x2"), F.col("e.q.y").alias("y2"),
            none.alias("radius"), none.alias("start_angle"), none.alias("end_angle"), F.lit(None).cast("string").alias("text"),
            F.lit(loose).alias("loose"),
        )
        for d, loose in ((poly, False), (solid.where(n > 0), True))
    ]
    return simple.unionByName(edges[0]).unionByName(edges[1])


def normalised(prims: DataFrame, norm: DataFrame) -> DataFrame:
    """``primitives`` in normalised, rounded coordinates, with ``alignment`` and ``rounding``.

    Solid edges whose ends fall together go. Segments of solids and blocks have an alignment tolerance of 0.5, others of 0.1
    divided by the scale if that is over 1.
    """
    j = prims.join(norm.select("drawing_id", "center_x", "center_y", "scale_factor", "rounding"), "drawing_id")
    s, d = F.col("scale_factor"), F.col("rounding")
    put = lambda v, c: round_by((F.col(v) - F.col(c)) / s, d)
    j = j.withColumns(
        {
            "x1": put("x1", "center_x"), "y1": put("y1", "center_y"), "x2": put("x2", "center_x"), "y2": put("y2", "center_y"),
            "radius": round_by(F.col("radius") / s, d)
        }
    )
    j = j.withColumns(
        {
            "start_angle": round_exact(F.col("start_angle"), 1), "end_angle": round_exact(F.col("end_angle"), 1),
            "text": F.when(F.col("kind") == "text", content(F.col("dxftype"), F.col("text")))
        }
    )
    tol = F.when(F.col("loose"), 0.5).when(s > 1, F.lit(0.1) / s).otherwise(0.1)
    j = j.withColumn("alignment", F.when(F.col("kind") == "line", alignment(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), tol)))
    return j.where("dxftype <> 'SOLID' OR x1 <> x2 OR y1 <> y2").drop("center_x", "center_y", "scale_factor")


def layer_table(rows: DataFrame) -> DataFrame:
    """(drawing_id, layer, layer_ord): layers numbered from 1 in the order in which a drawing first uses them."""
    first = rows.groupBy("drawing_id", "layer").agg(F.min(F.struct("seq", "sub")).alias("at"))
    return first.select(
        "drawing_id", "layer", F.row_number().over(Window.partitionBy("drawing_id").orderBy("at", "layer")).alias("layer_ord")
    )


def straighten(segments: DataFrame) -> DataFrame:
    """Segments within 15 % of vertical or horizontal and longer than 3 snap to the middle. Row-local."""
    dx, dy = F.abs(F.col("ex") - F.col("sx")), F.abs(F.col("ey") - F.col("sy"))
    up = (dy > 3) & (dx > 0) & (F.try_divide(dx, dy) < 0.15)
    flat = ~up & (dx > 3) & (dy > 0) & (F.try_divide(dy, dx) < 0.15)
    mx, my = round_by((F.col("sx") + F.col("ex")) / 2, F.col("rounding")), round_by((F.col("sy") + F.col("ey")) / 2, F.col("rounding"))
    pick = lambda cond, mid, old: F.when(cond, mid).otherwise(F.col(old))
    return segments.withColumns(
        {
            "sx": pick(up, mx, "sx"), "ex": pick(up, mx, "ex"), "sy": pick(flat, my, "sy"), "ey": pick(flat, my, "ey"),
            "alignment": F.when(up, "vertical").when(flat, "horizontal").otherwise(F.col("alignment"))
        }
    )


def equalise(segments: DataFrame) -> DataFrame:
    """Verticals of one band of 20 units of y that are nearly evenly spaced get even spacing.

    At least three; mean spacing of at least 1; standard deviation over 0.5 and below 30 % of the mean. Two windows over the
    verticals alone, partitioned by drawing and band.
    """
    vertical = segments.where("alignment = 'vertical'").withColumn("band", F.floor(F.rint((F.col("sy") + F.col("ey")) / 2) / 20))
    order = Window.partitionBy("drawing_id", "band").orderBy("sx", "layer_ord", "line_ord")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = vertical.withColumns(
        {
            "gap": F.col("sx") - F.lag("sx").over(order), "i": F.row_number().over(order) - 1, "n": F.count("*").over(whole),
            "x0": F.first("sx").over(whole)
        }
    )
    v = v.withColumns({"mean": F.avg("gap").over(whole), "std": F.stddev_pop("gap").over(whole)})
    even = F.coalesce((F.col("n") >= 3) & (F.col("mean") >= 1) & (F.try_divide("std", "mean") < 0.3) & (F.col("std") > 0.5), F.lit(False))
    x = F.when(even, round_by(F.col("x0") + F.col("i") * F.col("mean"), F.col("rounding"))).otherwise(F.col("sx"))
    moved = v.withColumn("ex", F.when(even, x).otherwise(F.col("ex"))).withColumn("sx", x)
    return moved.select(segments.columns).unionByName(segments.where("alignment IS NULL OR alignment <> 'vertical'"))


def extract(entities: DataFrame, norm: DataFrame, keep=None) -> Layers:
    """All tables of pass 1, straightened and equalised; ``keep`` may store the primitives that all four are made of."""
    rows = normalised(primitives(entities), norm)
    return tables(keep(rows) if keep else rows)


def tables(rows: DataFrame) -> Layers:
    """``normalised`` primitives as tables with ordinals within layers."""
    layers = layer_table(rows)
    keyed = rows.where("kind <> 'touch'").join(layers, ["drawing_id", "layer"])
    within = Window.partitionBy("drawing_id", "layer").orderBy("seq", "sub")
    number = F.row_number().over(within)
    base = ["drawing_id", "layer", "layer_ord"]
    blank = F.lit(None).cast("string").alias("id")
    lines = keyed.where("kind = 'line'").select(
        *base, number.alias("line_ord"), F.col("x1").alias("sx"), F.col("y1").alias("sy"), F.col("x2").alias("ex"), F.col("y2").alias("ey"),
        "alignment", "handle", blank, "rounding"
    )
    circles = keyed.where("kind = 'circle'").select(
        *base, number.alias("circle_ord"), F.col("x1").alias("cx"), F.col("y1").alias("cy"), "radius",
        F.when(F.col("dxftype") == "ARC", F.array("start_angle", "end_angle")).alias("angles"), "handle", blank
    )
    texts = keyed.where("kind = 'text'").select(
        *base, number.alias("text_ord"), F.col("x1").alias("tx"), F.col("y1").alias("ty"), "text", "handle", blank
    )
    return Layers(layers, equalise(straighten(lines)), circles, texts)


def entity_counts(entities: DataFrame) -> DataFrame:
    """(drawing_id, dxftype, n): what extraction meets: model-space types, the members of blocks it explodes, the rest as 'skipped'."""
    known = (*BLOCK_TYPES, "LWPOLYLINE", "INSERT", "SOLID")
    model = entities.where("block IS NULL AND paperspace = 0 AND error IS NULL")
    own = model.select("drawing_id", F.when(F.col("dxftype").isin(*known), F.col("dxftype")).otherwise("skipped").alias("dxftype"))
    inside = entities.where(F.col("block").isNotNull() & F.col("dxftype").isin(*BLOCK_TYPES)).select(
        "drawing_id", F.col("block").alias("block_name"), F.col("dxftype").alias("t")
    )
    exploded = model.where("dxftype = 'INSERT'").join(inside, ["drawing_id", "block_name"]).select(
        "drawing_id", F.col("t").alias("dxftype")
    )
    return own.unionByName(exploded).groupBy("drawing_id", "dxftype").agg(F.count("*").alias("n"))


def drawing_types(t: Layers) -> DataFrame:
    """(drawing_id, drawing_type): the discipline of most entities by layer name, if it has at least 30 % of all."""
    parts = [d.select("drawing_id", "layer", "layer_ord", F.lit(1).alias("n")) for d in (t.segments, t.circles, t.texts)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(
        t.layers.select("drawing_id", "layer", "layer_ord", F.lit(0).alias("n"))
    )
    per = rows.groupBy("drawing_id", "layer", "layer_ord").agg(F.sum("n").alias("n")).withColumn("kind", discipline(F.col("layer")))
    by = per.groupBy("drawing_id", "kind").agg(F.sum("n").alias("n"), F.min("layer_ord").alias("first"))
    top = by.groupBy("drawing_id").agg(
        F.sum("n").alias("total"),
        F.max(F.when(F.col("kind").isNotNull(), F.struct("n", (-F.col("first")).alias("f"), "kind"))).alias("top")
    )
    ok = F.col("top").isNotNull() & (F.col("total") > 0) & (F.try_divide(F.col("top.n"), F.col("total")) >= 0.3)
    return top.select("drawing_id", F.when(ok, F.col("top.kind")).otherwise("generic").alias("drawing_type"))


