"""Pass 5: ids, and the report of each drawing as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import ALIGNMENTS, distance
from ..functions.rendering import coordinate, numbered, one_decimal, shortest, whole
from ..functions.rounding import round_exact
from .extraction import Layers

SHOWN_SHAPES, SHOWN_LINES = 20, 30
TITLES = dict(
    x.split("=")
    for x in "electrical=ELECTRICAL SCHEMATIC|architectural=ARCHITECTURAL LAYOUT|mechanical=MECHANICAL DRAWING|structural=STRUCTURAL DRAWING".split("|")
)


def assign_ids(t: Layers) -> Layers:
    """Segments, circles and texts numbered through each drawing: L_001, C_001, T_001."""
    w = lambda o: Window.partitionBy("drawing_id").orderBy("layer_ord", o)
    mark = lambda d, p, o: d.withColumn("id", numbered(p, F.row_number().over(w(o))))
    return t._replace(
        segments=mark(t.segments, "L", "line_ord"), circles=mark(t.circles, "C", "circle_ord"), texts=mark(t.texts, "T", "text_ord")
    )


def loop_ids(loops: DataFrame) -> DataFrame:
    return loops.withColumn("id", numbered("LOOP", F.col("loop_ord")))


def size_classes(loops: DataFrame) -> DataFrame:
    """``loops`` with ``large``: at least 1 % of the drawing's largest area, and at least 1."""
    limit = F.greatest(F.max("area").over(Window.partitionBy("drawing_id")) * 0.01, F.lit(1.0))
    return loops.withColumn("large", F.col("area") >= limit)


def small_shapes(classed: DataFrame, shown: int = SHOWN_SHAPES) -> DataFrame:
    """The first ``shown`` small loops of each drawing, with their number ``k`` and how many there are."""
    w = Window.partitionBy("drawing_id").orderBy("loop_ord")
    small = classed.where("NOT large").withColumn("k", F.row_number().over(w)).withColumn(
        "total", F.count("*").over(Window.partitionBy("drawing_id"))
    )
    return small.where(F.col("k") <= shown)


def layer_order(stats: DataFrame) -> DataFrame:
    """(drawing_id, layer, report_ord): layers without segments first, then by number of texts."""
    w = Window.partitionBy("drawing_id").orderBy((F.col("line_count") != 0).cast("int"), F.desc("text_count"), "layer_ord")
    return stats.select("drawing_id", "layer", F.row_number().over(w).alias("report_ord"))


def first_lines(segments: DataFrame, shown: int = SHOWN_LINES) -> DataFrame:
    """The first ``shown`` segments of each layer with their length to one decimal; a rank filter that Spark pushes below the window."""
    w = Window.partitionBy("drawing_id", "layer").orderBy("line_ord")
    return segments.withColumn("k", F.row_number().over(w)).where(F.col("k") <= shown).withColumn(
        "length", round_exact(distance(F.col("sx"), F.col("sy"), F.col("ex"), F.col("ey")), 1)
    )


def metadata(norm: DataFrame, types: DataFrame) -> DataFrame:
    """One row a drawing: file name, type, dimensions, transform, paper."""
    scaled = F.col("scale_factor") > 1
    s = whole(F.col("scale_factor"))
    dims = lambda c: F.when(F.col("rounding") == 0, round_exact(F.col(c), 0)).otherwise(round_exact(F.col(c), 1))
    return norm.join(types, "drawing_id").select(
        "drawing_id", F.element_at(F.split(F.col("drawing_id").cast("string"), "/"), -1).alias("filename"), "drawing_type",
        dims("width").alias("width"), dims("height").alias("height"),
        F.when(scaled, "mm (paper-space)").otherwise("drawing units").alias("units"),
        F.when(scaled, F.concat(F.lit("translate_to_origin + scale÷"), s)).otherwise("translate_to_origin").alias("transform"),
        round_exact(-F.col("center_x"), 2).alias("offset_x"), round_exact(-F.col("center_y"), 2).alias("offset_y"), "scale_factor",
        "rounding",
        F.concat(
            F.lit("Coordinates translated to center at (0,0)"),
            F.when(scaled, F.concat(F.lit(" and divided by "), s, F.lit(" to paper-space mm"))).otherwise(""), F.lit(". Rounded to "),
            F.col("rounding").cast("string"), F.lit(" decimal places.")
        ).alias("description"),
        "paper_size", "paper_scale", "expected_w", "expected_h", "fit_error",
    )


def _rows(df: DataFrame, section: int, *lines: tuple) -> DataFrame:
    """(drawing_id, section, k0 .. k3, line): the lines of each row, given as (keys, line); a null line is left out."""
    items = []
    for keys, line in lines:
        k = [F.lit(x) if isinstance(x, int) else F.col(x) for x in keys] + [F.lit(0)] * (4 - len(keys))
        items.append(
            F.struct(
                *(x.cast("bigint").alias(f"k{i}") for i, x in enumerate(k)), (F.lit(line) if isinstance(line, str) else line).alias("line")
            )
        )
    return df.select("drawing_id", F.lit(section).alias("section"), F.inline(F.filter(F.array(*items), lambda x: x["line"].isNotNull())))


def report_lines(
    meta: DataFrame, t: Layers, classed: DataFrame, texts_in: DataFrame, symbols_in: DataFrame, stats: DataFrame, boxes: DataFrame,
    nodes: DataFrame, edges: DataFrame, degrees: DataFrame
) -> DataFrame:
    """All lines of all reports with their places: (drawing_id, section, k0 .. k3, line). Each table gives its lines at once."""
    cat = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p))
    col, string = F.col, lambda c: F.col(c).cast("string")
    info = meta.select("drawing_id", "drawing_type", "rounding", "paper_scale")
    electrical = col("drawing_type") == "electrical"
    c = lambda x: coordinate(col(x), col("rounding"))
    xy = lambda x, y: cat("(", c(x), ", ", c(y), ")")
    pt = lambda x, y: cat("(", shortest(col(x)), ", ", shortest(col(y)), ")")

    title = F.create_map(*(F.lit(x) for kv in TITLES.items() for x in kv))[col("drawing_type")]
    paper = col("paper_size").isNotNull()
    head = [
        cat("# ", F.coalesce(title, F.lit("CAD DRAWING")), ": ", col("filename")), "", "## DRAWING INFORMATION",
        cat("- Extents: ", whole(col("width")), " x ", whole(col("height")), " drawing units"),
        F.when(paper, cat("- Paper Size: ", col("paper_size"), " (landscape)")), F.when(paper, cat("- Scale: 1:", string("paper_scale"))),
        F.when(paper, cat("- Real-world extent: ", string("expected_w"), "mm x ", string("expected_h"), "mm on paper")),
        cat("- Drawing Type: ", col("drawing_type")),
        F.when(col("scale_factor") > 1, cat("- Scale Applied: /", whole(col("scale_factor")), " (coordinates in paper-space mm)")),
        cat("- Origin Offset: ", pt("offset_x", "offset_y")), "",
    ]
    out = [_rows(meta, 0, *(((k,), line) for k, line in enumerate(head)))]

    loops = classed.drop("id").join(info, "drawing_id").withColumn("id", numbered("LOOP", col("loop_ord")))
    metric = (col("drawing_type") == "architectural") & (col("paper_scale") > 1)
    area = F.when(
        metric, cat("~", one_decimal(col("area") * (col("paper_scale") * col("paper_scale")) / 1_000_000), " m2")
    ).otherwise(cat(whole(col("area")), " sq units"))
    region = [
        ((2, "loop_ord", 0), cat("### Region [", col("id"), "] (", string("num_segments"), " segments, ", area, ")")),
        ((2, "loop_ord", 1), cat("- Centroid: ", pt("cx", "cy"))),
        ((2, "loop_ord", 2), cat("- BBox: ", pt("min_x", "min_y"), " to ", pt("max_x", "max_y"))), ((2, "loop_ord", 5), ""),
    ]
    out.append(_rows(loops.where("large"), 1, *region))
    of_big = loops.where("large").select("drawing_id", "loop_ord", "rounding")
    place = lambda o: F.row_number().over(Window.partitionBy("drawing_id", "loop_ord").orderBy("layer_ord", o))
    out.append(
        _rows(
            texts_in.join(of_big, ["drawing_id", "loop_ord"]).withColumn("i", place("text_ord")), 1,
            ((2, "loop_ord", 3, "i"), cat('- Label: "', col("text"), '" at ', xy("tx", "ty")))
        )
    )
    out.append(
        _rows(
            symbols_in.join(of_big, ["drawing_id", "loop_ord"]).withColumn("i", place("circle_ord")), 1,
            ((2, "loop_ord", 4, "i"), cat("- Symbol: R=", c("radius"), " at ", xy("cx", "cy")))
        )
    )
    out.append(
        _rows(small_shapes(loops), 2, ((3, "k"), cat("- [", col("id"), "] at ", pt("cx", "cy"), ", ", string("num_segments"), " sides")))
    )

    order = layer_order(stats)
    named = stats.join(order, ["drawing_id", "layer"]).join(
        boxes.drop("layer_ord"), ["drawing_id", "layer"], "left"
    ).join(info, "drawing_id")
    kinds = t.segments.groupBy("drawing_id", "layer").agg(
        *(F.count_if(F.coalesce("alignment", F.lit("diagonal")) == a).alias(a) for a in ALIGNMENTS)
    )
    named = named.join(kinds, ["drawing_id", "layer"], "left")
    brief = col("drawing_type").isin("electrical", "generic") & (col("line_count") > SHOWN_LINES)
    parts = F.concat_ws(", ", *(F.when(col(a) > 0, cat(f"{a}: ", string(a))) for a in sorted(ALIGNMENTS)))
    texts = t.texts.join(order, ["drawing_id", "layer"]).join(info, "drawing_id")
    out.append(
        _rows(
            named.where("text_count > 0"), 3,
            ((2, "report_ord", 0), cat("### Layer: ", col("layer"), " (", string("text_count"), " labels)")), ((2, "report_ord", 2), "")
        )
    )
    out.append(
        _rows(
            texts, 3,
            ((2, "report_ord", 1, "text_ord"), cat('- "', col("text"), '" at ', xy("tx", "ty"), " [", F.coalesce("id", F.lit("?")), "]"))
        )
    )
    geometry = [
        ((2, "report_ord", 0), cat("### Layer: ", col("layer"))),
        (
            (2, "report_ord", 1),
            cat(
                "- ", string("line_count"), " lines (", whole(col("total_line_length")), " units total), ", string("circle_arc_count"),
                " arcs/circles, ", string("text_count"), " text"
            )
        ),
        ((2, "report_ord", 2), cat("- Dominant direction: ", F.coalesce("dominant_alignment", F.lit("None")))),
        ((2, "report_ord", 3), F.when(col("min_x").isNotNull(), cat("- BBox: ", xy("min_x", "min_y"), " to ", xy("max_x", "max_y")))),
        ((2, "report_ord", 4), F.when(brief, cat("- Line directions: ", parts))),
        (
            (2, "report_ord", 6),
            F.when(
                ~brief & (col("line_count") > SHOWN_LINES), cat("  * ... and ", (col("line_count") - SHOWN_LINES).cast("string"), " more")
            )
        ),
        ((2, "report_ord", 7), ""),
    ]
    drawn = named.where("line_count > 0 OR circle_arc_count > 0")
    out.append(_rows(drawn, 4, *geometry))
    listed = first_lines(t.segments.drop("rounding")).join(
        drawn.where(~brief).select("drawing_id", "layer", "report_ord", "rounding"), ["drawing_id", "layer"]
    )
    shown = cat(
        "  * (", c("sx"), ",", c("sy"), ") to (", c("ex"), ",", c("ey"), ") | ",
        F.upper(F.substring(F.coalesce("alignment", F.lit("diagonal")), 1, 1)), " | L=", shortest(col("length")), " [",
        F.coalesce("id", F.lit("?")), "]"
    )
    out.append(_rows(listed, 4, ((2, "report_ord", 5, "k"), shown)))

    degree = degrees.groupBy("drawing_id").agg(F.array_sort(F.collect_list(F.struct("degree", "n"))).alias("d"))
    totals = (
        info.join(
            nodes.groupBy("drawing_id").agg(F.count("*").alias("nodes")), "drawing_id", "left"
        ).join(edges.groupBy("drawing_id").agg(F.count("*").alias("edges")), "drawing_id", "left")
        .join(
            classed.groupBy("drawing_id").agg(F.count("*").alias("loops"), F.count_if("large").alias("big")), "drawing_id", "left"
        ).na.fill(0).join(degree, "drawing_id", "left").withColumn("small", col("loops") - col("big"))
    )
    some = col("small") > 0
    title = F.when(
        electrical, cat("(", string("small"), " small closed shapes detected — likely device outlines)")
    ).otherwise(cat("(", string("small"), " detected)"))
    out.append(
        _rows(
            totals, 1, ((0,), F.when(col("big") > 0, F.when(electrical, "## ENCLOSURES & PANELS").otherwise("## ROOMS & BOUNDARIES"))),
            ((1,), F.when(col("big") > 0, ""))
        )
    )
    out.append(
        _rows(
            totals.where(some), 2, ((0,), F.when(electrical, "## DEVICE SYMBOLS").otherwise("## SMALL CLOSED SHAPES")), ((1,), title),
            ((2,), ""),
            ((4,), F.when(col("small") > SHOWN_SHAPES, cat("- ... and ", (col("small") - SHOWN_SHAPES).cast("string"), " more"))),
            ((5,), "")
        )
    )
    out.append(_rows(totals, 3, ((0,), "## ANNOTATIONS"), ((1,), "")))
    out.append(_rows(totals, 4, ((0,), "## GEOMETRY SUMMARY"), ((1,), "")))
    spread = F.array_join(F.transform("d", lambda x: cat("deg-", x["degree"].cast("string"), ": ", x["n"].cast("string"))), ", ")
    out.append(
        _rows(
            totals, 5, ((0,), "## TOPOLOGY"), ((1,), cat("- Nodes: ", string("nodes"))), ((2,), cat("- Edges: ", string("edges"))),
            ((3,), cat("- Closed Loops: ", string("loops"), " (", string("big"), " large, ", string("small"), " small)")),
            ((4,), F.when(F.size("d") > 0, cat("- Degree Distribution: ", spread))), ((5,), "")
        )
    )
    union = out[0]
    for d in out[1:]:
        union = union.unionByName(d)
    return union


def markdown(lines: DataFrame) -> DataFrame:
    """(drawing_id, markdown): the lines of each report in order."""
    keys = ["section", "k0", "k1", "k2", "k3"]
    g = lines.groupBy("drawing_id").agg(F.array_sort(F.collect_list(F.struct(*keys, "line"))).alias("ls"))
    return g.select("drawing_id", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("markdown"))
