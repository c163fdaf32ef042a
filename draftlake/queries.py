"""The registered queries over the fixture drawings, and the same as SQL for DuckDB.

Each query returns flat columns. Its SQL is written on its own, from what the operator means: it shares the fixture texts and
the rounding expression with the engine, nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.classify import DISCIPLINES, FURNITURE, shape
from .functions.rounding import sql_round
from .oracle_report import MARKDOWN, REPORT
from .operators import extraction as E
from .operators import furniture, payload, semantics, spatial, topology
from .plans.analysis import analyse, analyse_tables
from .plans.documents import json_documents
from .plans.store import kept
from .sources import fixtures as X
from .sources.dxf import parse_files

Query = Callable[[SparkSession, str], DataFrame]


def big(df: DataFrame) -> DataFrame:
    """Integers as bigint, as DuckDB's casts in the SQL have them."""
    return df.select(*(F.col(c).cast("bigint").alias(c) if k in ("int", "smallint", "tinyint") else F.col(c) for c, k in df.dtypes))


# pass 1


def _bounds(spark: SparkSession, d: str) -> DataFrame:
    return E.bounds(X.entities(spark, d), kept)


def _norm(spark: SparkSession, d: str) -> DataFrame:
    return E.normalisation(_bounds(spark, d))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    entities = X.entities(spark, d)
    return E.normalised(E.primitives(entities), E.normalisation(E.bounds(entities, kept)))


def _sheet_sizes(spark: SparkSession, d: str) -> DataFrame:
    return X.tables_sql(spark, d, SHEETS)


def paper_size(spark: SparkSession, d: str) -> DataFrame:
    return big(E.paper_fit(_sheet_sizes(spark, d)))


def normalization(spark: SparkSession, d: str) -> DataFrame:
    return big(_norm(spark, d))


def drawing_bounds(spark: SparkSession, d: str) -> DataFrame:
    return big(_bounds(spark, d))


def _only(kind: str, cols: list[str], types: tuple[str, ...]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        r = _rows(spark, d).where(F.col("dxftype").isin(*types) & (F.col("kind") == kind))
        return big(r.select(*cols))

    return run


LINE = ["drawing_id", "seq", "sub", "layer", "x1", "y1", "x2", "y2", "alignment"]
ROUND = ["drawing_id", "seq", "sub", "layer", "x1", "y1", "radius", "start_angle", "end_angle"]
TEXT = ["drawing_id", "seq", "sub", "layer", "x1", "y1", "text"]


def block_explode(spark: SparkSession, d: str) -> DataFrame:
    r = _rows(spark, d).where("loose AND dxftype <> 'SOLID' OR (kind <> 'line' AND sub > 0)")
    return big(
        r.select(
            "drawing_id", "seq", "sub", "layer", "kind", "x1", "y1", "x2", "y2", "radius", "start_angle", "end_angle", "text", "alignment"
        )
    )


def entity_dispatch_counts(spark: SparkSession, d: str) -> DataFrame:
    return E.entity_counts(X.entities(spark, d))


def drawing_type(spark: SparkSession, d: str) -> DataFrame:
    return E.drawing_types(X.tables(spark, d))


def _leaning(spark: SparkSession, d: str) -> DataFrame:
    return X.tables_sql(spark, d, LEANING)


def straighten(spark: SparkSession, d: str) -> DataFrame:
    return big(E.straighten(_leaning(spark, d)))


def equalize_spacing(spark: SparkSession, d: str) -> DataFrame:
    return big(E.equalise(X.tables_sql(spark, d, UNEVEN)))


def metadata(spark: SparkSession, d: str) -> DataFrame:
    norm = _norm(spark, d)
    return big(payload.metadata(norm, norm.select("drawing_id", F.lit("generic").alias("drawing_type"))))


# pass 2


def cluster_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = topology.joints(X.tables(spark, d).segments, keep=kept)
    return big(nodes)


def merge_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Joints of points of which up to three lie within the tolerance of each other: the greedy kernel's part."""
    return big(topology.joints(kept(X.jittered(spark, d)), keep=kept)[0])


def loops_truncated(spark: SparkSession, d: str) -> DataFrame:
    """A search that ends at three loops: how many it has, and whether it says so."""
    t = topology.analyse(kept(X.lattice(spark, d)), keep=kept, max_loops=3)
    found = t.loops.groupBy("drawing_id").agg(F.count("*").alias("n"))
    return big(t.truncated.join(found, "drawing_id", "left").select("drawing_id", "truncated", F.coalesce("n", F.lit(0)).alias("n")))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    s = kept(X.tables(spark, d).segments)
    return big(topology.graph_edges(s, topology.joints(s, keep=kept)[1]))


def degree_distribution(spark: SparkSession, d: str) -> DataFrame:
    s = kept(X.tables(spark, d).segments)
    nodes, points = topology.joints(s, keep=kept)
    return big(topology.degree_distribution(nodes, topology.adjacency(topology.graph_edges(s, points))))


def _lattice_loops(spark: SparkSession, d: str) -> topology.Topology:
    return topology.analyse(kept(X.lattice(spark, d)), keep=kept)


def detect_loops(spark: SparkSession, d: str) -> DataFrame:
    loops = _lattice_loops(spark, d).loops
    return loops.select(
        F.col("drawing_id").cast("bigint"),
        F.array_join(F.transform(F.array_sort("node_ids"), lambda x: x.cast("string")), ",").alias("members")
    )


def loop_metadata(spark: SparkSession, d: str) -> DataFrame:
    m = _lattice_loops(spark, d).loops
    members = F.array_join(F.transform(F.array_sort("node_ids"), lambda x: x.cast("string")), ",").alias("members")
    return big(
        m.where("num_segments <= 4").select("drawing_id", members, "num_segments", "area", "cx", "cy", "min_x", "min_y", "max_x", "max_y")
    )


def loop_boundary_layers(spark: SparkSession, d: str) -> DataFrame:
    t = _lattice_loops(spark, d)
    four = t.loops.where("num_segments <= 4")
    members = F.array_join(F.transform(F.array_sort("node_ids"), lambda x: x.cast("string")), ",").alias("members")
    return big(
        topology.loop_boundary_layers(four, t.edges).join(
            four.select("drawing_id", "loop_ord", members), ["drawing_id", "loop_ord"]
        ).select("drawing_id", "members", "layer")
    )


def detect_loops_recursive(spark: SparkSession, d: str) -> DataFrame:
    """The recursive form on some of the smaller lattices."""
    s = X.lattice(spark, d).where("drawing_id % 2 = 1 AND drawing_id < 10")
    found = topology.detect_loops_sql(kept(topology.adjacency(topology.graph_edges(s, topology.joints(s)[1]))), 8)
    return found.select(
        F.col("drawing_id").cast("bigint"),
        F.array_join(F.transform(F.array_sort("node_ids"), lambda x: x.cast("string")), ",").alias("members")
    )


# pass 3


def layer_bboxes(spark: SparkSession, d: str) -> DataFrame:
    return big(spatial.layer_boxes(X.tables(spark, d)))


def alignment_summary(spark: SparkSession, d: str) -> DataFrame:
    return big(spatial.alignment_summary(X.tables(spark, d).segments))


def _boxes_as_loops(spark: SparkSession, d: str) -> DataFrame:
    return X.tables_sql(spark, d, RINGS).withColumn(
        "ring", F.array(*(F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in range(1, 5)))
    ).withColumns(
        {
            "min_x": F.least("x1", "x2", "x3", "x4"), "max_x": F.greatest("x1", "x2", "x3", "x4"), "min_y": F.least("y1", "y2", "y3", "y4"),
            "max_y": F.greatest("y1", "y2", "y3", "y4")
        }
    )


def containment_text(spark: SparkSession, d: str) -> DataFrame:
    return big(
        spatial.contained(
            X.tables(spark, d).texts.select("drawing_id", "layer_ord", "text_ord", "tx", "ty", "text"), _boxes_as_loops(spark, d), "tx",
            "ty"
        ).select("drawing_id", "loop_ord", "layer_ord", "text_ord", "text")
    )


def containment_symbols(spark: SparkSession, d: str) -> DataFrame:
    return big(
        spatial.contained(
            X.tables(spark, d).circles.select("drawing_id", "layer_ord", "circle_ord", "cx", "cy", "radius"), _boxes_as_loops(spark, d),
            "cx", "cy"
        ).select("drawing_id", "loop_ord", "layer_ord", "circle_ord", "radius")
    )


# pass 4


def layer_statistics(spark: SparkSession, d: str) -> DataFrame:
    return big(semantics.layer_statistics(X.tables(spark, d)))


def _anchors(spark: SparkSession, d: str) -> tuple:
    t = E.Layers(*map(kept, X.tables(spark, d)))
    near = kept(semantics.text_neighbours(t, kept))
    radius = semantics.anchor_radius(t, near)
    return t, radius, semantics.text_anchors(near, radius)


def text_anchors(spark: SparkSession, d: str) -> DataFrame:
    return big(_anchors(spark, d)[2])


def unanchored_texts(spark: SparkSession, d: str) -> DataFrame:
    t, _, anchors = _anchors(spark, d)
    return big(semantics.unanchored_texts(t, anchors).select("drawing_id", "layer_ord", "text_ord", "text"))


def anchor_radius(spark: SparkSession, d: str) -> DataFrame:
    return _anchors(spark, d)[1]


def room_labels(spark: SparkSession, d: str) -> DataFrame:
    return big(semantics.room_labels(X.tables(spark, d).texts))


def room_assignment(spark: SparkSession, d: str) -> DataFrame:
    t = E.Layers(*map(kept, payload.assign_ids(X.tables(spark, d))))
    return big(semantics.room_members(t, kept(semantics.room_labels(t.texts)), keep=kept).drop("kind_ord"))


# pass 5


def entity_ids(spark: SparkSession, d: str) -> DataFrame:
    t = payload.assign_ids(X.tables(spark, d))
    parts = [
        df.select("drawing_id", "layer", F.col(o).cast("bigint").alias("ord"), "id")
        for df, o in ((t.segments, "line_ord"), (t.circles, "circle_ord"), (t.texts, "text_ord"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _areas(spark: SparkSession, d: str) -> DataFrame:
    return payload.size_classes(X.tables_sql(spark, d, AREAS))


def loop_size_class(spark: SparkSession, d: str) -> DataFrame:
    return big(_areas(spark, d))


def small_shapes_top20(spark: SparkSession, d: str) -> DataFrame:
    return big(payload.small_shapes(_areas(spark, d)).select("drawing_id", "loop_ord", "area", "k", "total"))


def layer_report_order(spark: SparkSession, d: str) -> DataFrame:
    return big(payload.layer_order(semantics.layer_statistics(X.tables(spark, d))))


def geometry_top30(spark: SparkSession, d: str) -> DataFrame:
    return big(payload.first_lines(X.tables(spark, d).segments).select("drawing_id", "layer", "line_ord", "k", "length"))


def furniture_by_name(spark: SparkSession, d: str) -> DataFrame:
    return furniture.detect_furniture(X.instances(spark, d)).select("drawing_id", "category", "block_name", "handle", "layer", "method")


def furniture_by_shape(spark: SparkSession, d: str) -> DataFrame:
    return X.instances(spark, d).select("drawing_id", "handle", "w", "h", shape(F.col("w"), F.col("h")).alias("category"))


def _plans(spark: SparkSession, d: str):
    """Whole analyses of the rectangles, with the texts and circles of drawings of the same number."""
    t = X.tables(spark, d)
    s = kept(X.tables_sql(spark, d, X.SIDES))
    small = s.select("drawing_id").distinct()
    cut = lambda df, mark: kept(
        df.join(small, "drawing_id", "left_semi").withColumns(
            {"layer_ord": F.col("layer_ord") + 10, "layer": F.concat(F.lit(mark), "layer"), "drawing_id": F.col("drawing_id").cast("int")}
        )
    )
    lines = s.withColumns({"handle": F.lit(None).cast("string"), "id": F.lit(None).cast("string")})
    circles, texts = cut(t.circles, "C-"), cut(t.texts, "T-")
    layers = lines.select("drawing_id", "layer", "layer_ord").union(
        circles.select("drawing_id", "layer", "layer_ord")
    ).union(texts.select("drawing_id", "layer", "layer_ord")).distinct()
    tables = E.Layers(layers, lines, circles, texts)
    norm = E.normalisation(X.tables_sql(spark, d, X.EXTENTS))
    return analyse_tables(tables, payload.metadata(norm, E.drawing_types(tables)), keep=kept)


def markdown_payload(spark: SparkSession, d: str) -> DataFrame:
    return _plans(spark, d).markdown().select(F.col("drawing_id").cast("bigint"), "markdown")


def json_payload(spark: SparkSession, d: str) -> DataFrame:
    """What the JSON documents hold, read back from them."""
    at = lambda path: F.get_json_object("json", f"$.{path}")
    layer = "struct<lines:array<string>,circles_arcs:array<string>,text_annotations:array<string>>"
    items = lambda k: F.aggregate(F.map_values("layers"), F.lit(0).cast("bigint"), lambda a, x: a + F.size(x[k])).alias(k)
    docs = json_documents(_plans(spark, d)).withColumn("layers", F.from_json(at("layers"), f"map<string,{layer}>"))
    return docs.select(
        F.col("drawing_id").cast("bigint"), at("metadata.filename").alias("filename"), at("metadata.drawing_type").alias("drawing_type"),
        at("metadata.transform.scale_factor").cast("double").alias("scale_factor"),
        at("metadata.transform.rounding_precision").cast("bigint").alias("rounding"),
        at("metadata.paper_info.paper_size").alias("paper_size"), F.size("layers").cast("bigint").alias("n_layers"), items("lines"),
        items("circles_arcs"), items("text_annotations"),
        at("topology.nodes.count").cast("bigint").alias("nodes"), at("topology.edges.count").cast("bigint").alias("edges"),
        F.json_array_length(at("topology.loops")).cast("bigint").alias("n_loops"), at("topology.loops_truncated").alias("truncated"),
        at("topology.loops[0].id").alias("first_id"), at("topology.loops[0].area").cast("double").alias("first_area"),
        F.json_array_length(at("topology.loops[0].contained_text")).cast("bigint").alias("first_texts"),
        F.json_array_length(at("topology.loops[0].contained_symbols")).cast("bigint").alias("first_symbols"),
        at("semantics.anchor_radius_used").cast("double").alias("radius"),
        F.json_array_length(at("semantics.text_anchors")).cast("bigint").alias("anchors"),
        F.json_array_length(at("semantics.rooms")).cast("bigint").alias("rooms"),
    )


def full_analysis(spark: SparkSession, d: str) -> DataFrame:
    """All passes from entities on: what each layer of each drawing comes to."""
    a = analyse(
        X.entities(spark, d).where("drawing_id < 8 AND seq % 3 = 0 OR block IS NOT NULL AND drawing_id < 8"), keep=kept, max_loops=50,
        max_steps=20_000
    )
    return big(a.statistics.join(a.boxes.drop("layer_ord"), ["drawing_id", "layer"], "left"))


def dxf_source(spark: SparkSession, d: str) -> DataFrame:
    """The lattices written as files' content and read back."""
    tag = lambda code, value: F.concat(F.lit(f"{code}\n"), value, F.lit("\n"))
    one = F.concat(
        F.lit("0\nLINE\n"), tag(8, F.col("layer")),
        *(tag(code, F.col(c).cast("string")) for code, c in ((10, "sx"), (20, "sy"), (11, "ex"), (21, "ey")))
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("layer_ord", "line_ord", one.alias("t")))), lambda x: x["t"]), "")
    text = F.concat(F.lit("0\nSECTION\n2\nENTITIES\n"), body, F.lit("0\nENDSEC\n0\nEOF\n"))
    files = X.lattice(spark, d).groupBy(F.col("drawing_id").cast("string").alias("path")).agg(F.encode(text, "UTF-8").alias("content"))
    at = lambda k, c: F.element_at("pts", k)[c]
    return parse_files(files).select(
        "drawing_id", "seq", "dxftype", "layer", at(1, "x").alias("sx"), at(1, "y").alias("sy"), at(2, "x").alias("ex"),
        at(2, "y").alias("ey")
    )


QUERIES: dict[str, Query] = {
    "dxf_source": dxf_source,
    "layer_statistics": layer_statistics, "layer_bboxes": layer_bboxes, "alignment_summary": alignment_summary,
    "drawing_type": drawing_type, "paper_size": paper_size, "drawing_bounds": drawing_bounds, "normalization": normalization,
    "line_alignment": _only("line", LINE, ("LINE",)), "polyline_segments": _only("line", LINE, ("LWPOLYLINE",)),
    "solid_outline": _only("line", LINE, ("SOLID",)), "circle_arc_extract": _only("circle", ROUND, ("CIRCLE", "ARC")),
    "text_extract": _only("text", TEXT, ("TEXT", "MTEXT")),
    "entity_dispatch_counts": entity_dispatch_counts, "block_explode": block_explode, "straighten": straighten,
    "equalize_spacing": equalize_spacing, "metadata": metadata,
    "cluster_nodes": cluster_nodes, "merge_nodes": merge_nodes, "loops_truncated": loops_truncated, "graph_edges": graph_edges,
    "degree_distribution": degree_distribution, "detect_loops": detect_loops, "detect_loops_recursive": detect_loops_recursive,
    "loop_metadata": loop_metadata, "loop_boundary_layers": loop_boundary_layers,
    "containment_text": containment_text, "containment_symbols": containment_symbols, "text_anchors": text_anchors,
    "unanchored_texts": unanchored_texts, "anchor_radius": anchor_radius, "room_labels": room_labels, "room_assignment": room_assignment,
    "entity_ids": entity_ids, "loop_size_class": loop_size_class, "small_shapes_top20": small_shapes_top20,
    "layer_report_order": layer_report_order, "geometry_top30": geometry_top30,
    "furniture_by_name": furniture_by_name, "furniture_by_shape": furniture_by_shape, "markdown_payload": markdown_payload,
    "json_payload": json_payload, "full_analysis": full_analysis,
}


# fixtures of single operators

SHEETS = (
    "SELECT p_partkey, CAST(200 + p_partkey * 37 % 1300 AS DOUBLE) * CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 50 "
    "ELSE 333 END AS width, CAST(150 + p_size * 19 % 900 AS DOUBLE) * CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 50 "
    "ELSE 333 END AS height FROM part"
)
LEANING = (
    "SELECT o_orderkey AS id, CAST(o_orderkey % 2 AS INT) AS rounding, CAST(o_custkey % 100 AS DOUBLE) AS sx, CAST(o_custkey % 90 AS "
    "DOUBLE) AS sy, CAST(o_custkey % 100 + o_orderkey % 13 AS DOUBLE) AS ex, CAST(o_custkey % 90 + o_orderkey % 17 * 3 AS DOUBLE) AS "
    "ey, 'diagonal' AS alignment FROM orders"
)
UNEVEN = (
    "SELECT o_custkey % 41 AS drawing_id, CAST(o_custkey % 41 % 2 AS INT) AS rounding, CAST(1 AS INT) AS layer_ord, "
    "CAST(row_number() OVER (PARTITION BY o_custkey % 41 ORDER BY o_orderkey) AS INT) AS line_ord, "
    "CAST(10 * (row_number() OVER (PARTITION BY o_custkey % 41, o_orderkey % 5 ORDER BY o_orderkey)) + o_orderkey % 7 % (1 + "
    "o_custkey % 41 % 4) AS DOUBLE) AS sx, CAST(o_orderkey % 5 * 40 - 60 AS DOUBLE) AS sy, "
    "CAST(10 * (row_number() OVER (PARTITION BY o_custkey % 41, o_orderkey % 5 ORDER BY o_orderkey)) + o_orderkey % 7 % (1 + "
    "o_custkey % 41 % 4) AS DOUBLE) AS ex, CAST(o_orderkey % 5 * 40 - 51 AS DOUBLE) AS ey, "
    "CASE WHEN o_orderkey % 11 = 0 THEN 'diagonal' ELSE 'vertical' END AS alignment FROM orders WHERE o_orderkey % 5 < 4 OR "
    "o_orderkey < 300"
)
RINGS = (
    "SELECT s_suppkey * 7 % 97 AS drawing_id, CAST(s_suppkey AS INT) AS loop_ord, CAST(10 * (s_suppkey % 20) AS DOUBLE) AS x1, CAST(10 "
    "* (s_nationkey % 7) AS DOUBLE) AS y1, CAST(10 * (s_suppkey % 20) + 300 AS DOUBLE) AS x2, CAST(10 * (s_nationkey % 7) + 20 AS "
    "DOUBLE) AS y2, CAST(10 * (s_suppkey % 20) + 260 AS DOUBLE) AS x3, CAST(10 * (s_nationkey % 7) + 200 AS DOUBLE) AS y3, CAST(10 * "
    "(s_suppkey % 20) + 60 * (s_suppkey % 3) AS DOUBLE) AS x4, CAST(10 * (s_nationkey % 7) + 150 AS DOUBLE) AS y4 FROM supplier"
)
AREAS = (
    "SELECT o_custkey % 53 AS drawing_id, CAST(row_number() OVER (PARTITION BY o_custkey % 53 ORDER BY o_orderkey) AS INT) AS "
    "loop_ord, CAST((o_orderkey % 97) * (o_orderkey % 97) * CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END + o_orderkey % 90 AS "
    "DOUBLE) AS area FROM orders"
)


# SQL

D = X._D
_PARTS: dict[str, str] = {
    "flat": X.FLAT, "members": X.MEMBERS, "segments": X.SEGMENTS, "circles": X.CIRCLES, "texts": X.TEXTS, "layers": X.LAYERS,
    "lattice": X.LATTICE, "instances": X.INSTANCES, "sheets": SHEETS, "leaning": LEANING, "uneven": UNEVEN, "rings": RINGS, "areas": AREAS
}


def _sql(body: str, *parts: str, recursive: bool = False, **more: str) -> str:
    ctes = [f"{p} AS ({_PARTS[p]})" for p in parts] + [f"{k} AS ({v})" for k, v in more.items()]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + body


def _by(digits: str, x: str) -> str:
    return f"CASE WHEN {digits} = 0 THEN {sql_round(x, 0)} ELSE {sql_round(x, 1)} END"


# blocks are small and near the middle, arcs are inside: neither reaches the bounds of its drawing
_BOUNDS = (
    "SELECT drawing_id, least(min(CASE WHEN npts >= 1 THEN x1 - coalesce(radius, 0) END) FILTER (WHERE dxftype <> 'ARC'), min(CASE "
    "WHEN npts >= 2 THEN x2 END), min(CASE WHEN npts >= 3 THEN x3 END), min(CASE WHEN npts >= 4 THEN x4 END)) AS min_x, least(min(CASE "
    "WHEN npts >= 1 THEN y1 - coalesce(radius, 0) END) FILTER (WHERE dxftype <> 'ARC'), min(CASE WHEN npts >= 2 THEN y2 END), min(CASE "
    "WHEN npts >= 3 THEN y3 END), min(CASE WHEN npts >= 4 THEN y4 END)) AS min_y, greatest(max(CASE WHEN npts >= 1 THEN x1 + "
    "coalesce(radius, 0) END) FILTER (WHERE dxftype <> 'ARC'), max(CASE WHEN npts >= 2 THEN x2 END), max(CASE WHEN npts >= 3 THEN x3 "
    "END), max(CASE WHEN npts >= 4 THEN x4 END)) AS max_x, greatest(max(CASE WHEN npts >= 1 THEN y1 + coalesce(radius, 0) END) FILTER "
    "(WHERE dxftype <> 'ARC'), max(CASE WHEN npts >= 2 THEN y2 END), max(CASE WHEN npts >= 3 THEN y3 END), max(CASE WHEN npts >= 4 "
    "THEN y4 END)) AS max_y, CAST(0 AS BIGINT) AS skipped FROM flat WHERE dxftype <> 'INSERT' GROUP BY drawing_id"
)
_PAPERS = "SELECT * FROM (VALUES " + ", ".join(
    f"({k}, '{n}', {w}, {h})" for k, (n, w, h) in enumerate(E.SHEETS)
) + ") p(po, name, pw, ph) CROSS JOIN (VALUES " + ", ".join(f"({k}, {s})" for k, s in enumerate(E.SCALES)) + ") s(so, scale)"
_ERR = (
    "(abs(greatest(width, height) - pw * scale) / CAST(pw * scale AS DOUBLE) + abs(least(width, height) - ph * scale) / CAST(ph * "
    "scale AS DOUBLE)) / 2"
)
_FIT = (
    "SELECT {0}, name, scale, pw * scale AS ew, ph * scale AS eh, err * 100 AS pct FROM (SELECT *, row_number() OVER (PARTITION BY {0} "
    "ORDER BY err, po, so) AS k FROM (SELECT {1}.*, papers.*, "
) + _ERR + " AS err FROM {1} CROSS JOIN papers) c WHERE err < " + D(0.15) + ") q WHERE k = 1"
_FITTED = (
    "name AS paper_size, CAST(scale AS BIGINT) AS paper_scale, CAST(ew AS BIGINT) AS expected_w, CAST(eh AS BIGINT) AS expected_h, "
    f"{sql_round('pct', 1)} AS fit_error"
)
_SIZED = (
    "SELECT *, (min_x + max_x) / 2 AS center_x, (min_y + max_y) / 2 AS center_y, max_x - min_x AS width, max_y - min_y AS height FROM "
    "bounds"
)
_SCALED = (
    "SELECT sized.*, fit.name, fit.scale, fit.ew, fit.eh, fit.pct, CASE WHEN fit.name IS NOT NULL AND greatest(width, height) > 5000 "
    f"THEN CAST(fit.scale AS DOUBLE) WHEN fit.name IS NULL AND greatest(width, height) > 50000 THEN greatest(width, height) / {D(1000)} "
    f"ELSE {D(1)} END AS scale_factor FROM sized LEFT JOIN fit ON fit.drawing_id = sized.drawing_id"
)
_OFF = " + ".join(
    f"abs(({v} - {c}) / scale_factor - round_even(({v} - {c}) / scale_factor, 0))"
    for v, c in (("min_x", "center_x"), ("max_x", "center_x"), ("min_y", "center_y"), ("max_y", "center_y"))
)
_NORM = (
    "SELECT drawing_id, center_x, center_y, width / scale_factor AS width, height / scale_factor AS height, scale_factor, CAST(CASE "
    f"WHEN scale_factor > 1 AND ({_OFF}) / 4 < {D(0.3)} THEN 0 ELSE 1 END AS BIGINT) AS rounding, {_FITTED} FROM scaled"
)
NORM = {"bounds": _BOUNDS, "papers": _PAPERS, "sized": _SIZED, "fit": _FIT.format("drawing_id", "sized"), "scaled": _SCALED, "norm": _NORM}
_MOVED = (
    "SELECT {0}, (x1 - center_x) / scale_factor AS u1, (y1 - center_y) / scale_factor AS v1, (x2 - center_x) / scale_factor AS u2, (y2 "
    "- center_y) / scale_factor AS v2, radius / scale_factor AS rr, a1, a2, text, loose, norm.rounding, scale_factor FROM raw JOIN "
    "norm ON norm.drawing_id = raw.drawing_id"
)
_ROUNDED = "SELECT * EXCLUDE (u1, v1, u2, v2, rr, a1, a2), " + ", ".join(
    f"{_by('rounding', a)} AS {b}" for a, b in (("u1", "x1"), ("v1", "y1"), ("u2", "x2"), ("v2", "y2"), ("rr", "radius"))
) + f", {sql_round('a1', 1)} AS start_angle, {sql_round('a2', 1)} AS end_angle FROM moved"
_ALIGN = f"CASE WHEN abs(x1 - x2) < tol THEN 'vertical' WHEN abs(y1 - y2) < tol THEN 'horizontal' ELSE 'diagonal' END"
_TOL = f"CASE WHEN loose THEN {D(0.5)} WHEN scale_factor > 1 THEN {D(0.1)} / scale_factor ELSE {D(0.1)} END"


def _extracted(raw: str, cols: str, where: str = "", parts: tuple[str, ...] = ("flat",)) -> str:
    names = "raw.drawing_id, raw.seq, raw.sub, raw.layer, raw.kind"
    body = f"SELECT {cols} FROM (SELECT *, {_ALIGN} AS alignment FROM (SELECT *, {_TOL} AS tol FROM rounded) t) r {where}"
    return _sql(body, *parts, **NORM, raw=raw, moved=_MOVED.format(names), rounded=_ROUNDED)


def _edge(i: int, j: int, extra: str) -> str:
    return (
        f"SELECT drawing_id, seq, CAST({i} AS BIGINT) AS sub, layer, 'line' AS kind, x{i} AS x1, y{i} AS y1, x{j} AS x2, y{j} AS y2, "
        "CAST(NULL AS DOUBLE) AS radius, CAST(NULL AS DOUBLE) AS a1, CAST(NULL AS DOUBLE) AS a2, CAST(NULL AS VARCHAR) AS text, "
        f"{extra} FROM flat"
    )


_OWN = (
    "SELECT drawing_id, seq, CAST(0 AS BIGINT) AS sub, layer, '{0}' AS kind, x1, y1, x2, y2, radius, a1, a2, text, false AS loose FROM "
    "flat WHERE dxftype IN ({1})"
)
_PLAIN = "trim(regexp_replace(regexp_replace(regexp_replace(text, '[{}]', '', 'g'), '\\\\H[^;]*;', '', 'g'), '\\\\P', ' ', 'g'))"
_LINE, _ROUND, _TEXT = ", ".join(LINE), ", ".join(ROUND), f"drawing_id, seq, sub, layer, x1, y1, {_PLAIN} AS text"
_POLY = " UNION ALL ".join(f"{_edge(i, i + 1, 'false AS loose')} WHERE dxftype = 'LWPOLYLINE' AND npts >= {i + 1}" for i in (1, 2, 3))
_SOLID = " UNION ALL ".join(
    [
        *(f"{_edge(i, i + 1, 'true AS loose')} WHERE dxftype = 'SOLID' AND npts >= {i + 1}" for i in (1, 2, 3)),
        *(f"{_edge(n, 1, 'true AS loose')} WHERE dxftype = 'SOLID' AND npts = {n}" for n in (3, 4))
    ]
)
_BLOCK = (
    "SELECT f.drawing_id, f.seq, CAST(m.seq AS BIGINT) AS sub, f.layer, CASE WHEN m.dxftype = 'LINE' THEN 'line' WHEN m.dxftype = "
    "'TEXT' THEN 'text' ELSE 'circle' END AS kind, m.x1 * coalesce(f.xscale, 1) + f.x1 AS x1, m.y1 * coalesce(f.xscale, 1) + f.y1 AS "
    "y1, CASE WHEN m.dxftype = 'LINE' THEN m.x2 * coalesce(f.xscale, 1) + f.x1 END AS x2, CASE WHEN m.dxftype = 'LINE' THEN m.y2 * "
    "coalesce(f.xscale, 1) + f.y1 END AS y2, CASE WHEN m.dxftype IN ('CIRCLE', 'ARC') THEN m.radius * coalesce(f.xscale, 1) END AS "
    "radius, m.a1, m.a2, m.text, true AS loose FROM flat f JOIN members m ON m.drawing_id = f.drawing_id AND m.block = f.block_name "
    "WHERE f.dxftype = 'INSERT' AND m.dxftype <> 'SOLID'"
)

_DISCIPLINE = "CASE " + " ".join(
    f"WHEN regexp_matches(upper(layer), '^{letter}[-_]|{word}') THEN '{name}'" for name, letter, word in DISCIPLINES
) + " END"
_ALL = (
    "SELECT drawing_id, layer, layer_ord, 1 AS n FROM segments UNION ALL SELECT drawing_id, layer, layer_ord, 1 FROM circles UNION ALL "
    "SELECT drawing_id, layer, layer_ord, 1 FROM texts"
)
_ENDS = (
    "SELECT drawing_id, layer_ord, line_ord, 0 AS e, sx AS x, sy AS y FROM {0} UNION ALL SELECT drawing_id, layer_ord, line_ord, 1, "
    "ex, ey FROM {0}"
)
# the fixtures are on a grid of tens, on which different points are never within the tolerance
_NODES = (
    "SELECT drawing_id, x, y, row_number() OVER (PARTITION BY drawing_id ORDER BY met) - 1 AS node_id FROM (SELECT drawing_id, x, y, "
    "min((layer_ord, line_ord, e)) AS met FROM ends GROUP BY drawing_id, x, y) g"
)
_EDGES = (
    "SELECT s.drawing_id, s.layer, s.layer_ord, s.line_ord, a.node_id AS from_node, b.node_id AS to_node FROM {0} s JOIN nodes a ON "
    "a.drawing_id = s.drawing_id AND a.x = s.sx AND a.y = s.sy JOIN nodes b ON b.drawing_id = s.drawing_id AND b.x = s.ex AND b.y = "
    "s.ey WHERE a.node_id <> b.node_id"
)
_LINKS = (
    "SELECT DISTINCT drawing_id, u, v FROM (SELECT drawing_id, from_node AS u, to_node AS v FROM edges UNION ALL SELECT drawing_id, "
    "to_node, from_node FROM edges) x"
)
_WALK = (
    "SELECT DISTINCT drawing_id, [u] AS path FROM links UNION ALL SELECT w.drawing_id, list_append(w.path, l.v) FROM walk w JOIN links "
    "l ON l.drawing_id = w.drawing_id AND l.u = w.path[len(w.path)] WHERE l.v > w.path[1] AND NOT list_contains(w.path, l.v) AND "
    "len(w.path) < 20"
)
_CYCLES = (
    "SELECT w.drawing_id, w.path, list_sort(w.path) AS m FROM walk w JOIN links l ON l.drawing_id = w.drawing_id AND l.u = "
    "w.path[len(w.path)] AND l.v = w.path[1] WHERE len(w.path) >= 3"
)
_GRAPH = {
    "ends": _ENDS.format("lattice"), "nodes": _NODES, "edges": _EDGES.format("lattice"), "links": _LINKS, "walk": _WALK, "cycles": _CYCLES
}
_MEMBERS = "array_to_string(m, ',') AS members"
# loops of up to four joints have one area only, whichever way round the joints were found
_RING = "SELECT drawing_id, m, min(path) AS path FROM cycles WHERE len(path) <= 4 GROUP BY drawing_id, m"
_SIDES = (
    "SELECT drawing_id, m, i, path[i] AS u, path[CASE WHEN i = len(path) THEN 1 ELSE i + 1 END] AS v, len(path) AS n FROM (SELECT *, "
    "unnest(range(1, len(path) + 1)) AS i FROM ring) r"
)

_REFS = f"SELECT drawing_id, layer_ord, 0 AS k, line_ord AS i, (sx + ex) / 2 AS gx, (sy + ey) / 2 AS gy, layer AS glayer, 'line_midpoint' AS gtype FROM segments UNION ALL SELECT drawing_id, layer_ord, 1, circle_ord, cx, cy, layer, 'circle_arc_center' FROM circles"
_NEAR = (
    "SELECT t.drawing_id, t.layer, t.layer_ord, t.text_ord, t.text, t.tx, t.ty, min_by(struct_pack(d2 := (t.tx - r.gx) * (t.tx - r.gx) "
    "+ (t.ty - r.gy) * (t.ty - r.gy), gx := r.gx, gy := r.gy, glayer := r.glayer, gtype := r.gtype), ((t.tx - r.gx) * (t.tx - r.gx) + "
    "(t.ty - r.gy) * (t.ty - r.gy), r.layer_ord, r.k, r.i)) AS b FROM texts t JOIN refs r ON r.drawing_id = t.drawing_id GROUP BY ALL"
)
_RADIUS = (
    f"SELECT l.drawing_id, CASE WHEN m IS NULL THEN {D(500)} ELSE greatest(m * 2, {D(50)}) END AS raw FROM (SELECT DISTINCT drawing_id "
    "FROM layers) l LEFT JOIN (SELECT drawing_id, list_sort(list(sqrt(b.d2)))[count(*) // 2 + 1] AS m FROM (SELECT *, row_number() "
    "OVER (PARTITION BY drawing_id ORDER BY layer_ord, text_ord) AS q FROM near) z WHERE q <= 100 GROUP BY drawing_id) n ON "
    "n.drawing_id = l.drawing_id"
)
_REACH = f"SELECT drawing_id, {sql_round('raw', 1)} AS radius FROM radius0"
_ANCHORED = {
    "refs": _REFS, "near": _NEAR, "radius0": _RADIUS, "reach": _REACH,
    "flatnear": "SELECT near.*, b.gx AS gx, b.gy AS gy, b.glayer AS glayer, b.gtype AS gtype, sqrt(b.d2) AS d, radius FROM near JOIN reach ON "
        "reach.drawing_id = near.drawing_id"
}
_T = ("segments", "circles", "texts", "layers")
_ROOMS = (
    "SELECT drawing_id, row_number() OVER (PARTITION BY drawing_id ORDER BY layer_ord, text_ord) AS room_ord, text AS label, tx AS x, "
    "ty AS y FROM texts WHERE regexp_matches(layer, '(?i)TEXT|ANNO|ROOM|NAME|LABEL')"
)
_ID = "concat('{0}_', CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END)"
_NUMBERED = lambda t, o, p, cols: (
    f"SELECT {cols}, {_ID.format(p)} AS id FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY layer_ord, {o}) AS n "
    f"FROM {t}) q"
)
_ITEMS = " UNION ALL ".join(
    (
        _NUMBERED(
            "segments", "line_ord", "L",
            "drawing_id, layer, layer_ord, 0 AS k, line_ord AS item_ord, (sx + ex) / 2 AS px, (sy + ey) / 2 AS py, handle, 'line' AS type"
        ),
        _NUMBERED("circles", "circle_ord", "C", "drawing_id, layer, layer_ord, 1, circle_ord, cx, cy, handle, 'circle_arc'"),
        _NUMBERED("texts", "text_ord", "T", "drawing_id, layer, layer_ord, 2, text_ord, tx, ty, handle, 'text'")
    )
)
_STATS = (
    "SELECT l.drawing_id, l.layer, CAST(l.layer_ord AS BIGINT) AS layer_ord, coalesce(s.n, 0) AS line_count, coalesce(c.n, 0) AS "
    "circle_arc_count, coalesce(t.n, 0) AS text_count, coalesce(s.len, 0) AS len, coalesce(s.h, 0) AS h, coalesce(s.v, 0) AS v, "
    "coalesce(s.g, 0) AS g FROM layers l "
    "LEFT JOIN (SELECT drawing_id, layer, count(*) AS n, sum(sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy))) AS len, count(*) "
    "FILTER (WHERE alignment = 'horizontal') AS h, count(*) FILTER (WHERE alignment = 'vertical') AS v, count(*) FILTER (WHERE "
    "alignment = 'diagonal') AS g FROM segments GROUP BY ALL) s ON s.drawing_id = l.drawing_id AND s.layer = l.layer "
    "LEFT JOIN (SELECT drawing_id, layer, count(*) AS n FROM circles GROUP BY ALL) c ON c.drawing_id = l.drawing_id AND c.layer = "
    "l.layer LEFT JOIN (SELECT drawing_id, layer, count(*) AS n FROM texts GROUP BY ALL) t ON t.drawing_id = l.drawing_id AND "
    "t.layer = l.layer"
)


_META = (
        f"SELECT drawing_id, CAST(drawing_id AS VARCHAR) AS filename, 'generic' AS drawing_type, {_by('rounding', 'width')} AS "
        f"width, {_by('rounding', 'height')} AS height, CASE WHEN scale_factor > 1 THEN 'mm (paper-space)' ELSE 'drawing units' END "
        "AS units, "
        "concat('translate_to_origin', CASE WHEN scale_factor > 1 THEN concat(' + scale÷', "
        f"CAST(CAST({sql_round('scale_factor', 0)} AS BIGINT) AS VARCHAR)) ELSE '' END) AS transform, {sql_round('ox', 2)} AS "
        f"offset_x, {sql_round('oy', 2)} AS offset_y, scale_factor, rounding, "
        "concat('Coordinates translated to center at (0,0)', CASE WHEN scale_factor > 1 THEN concat(' and divided by ', "
        f"CAST(CAST({sql_round('scale_factor', 0)} AS BIGINT) AS VARCHAR), ' to paper-space mm') ELSE '' END, '. Rounded to ', "
        "CAST(rounding AS VARCHAR), ' decimal places.') AS description, paper_size, paper_scale, expected_w, expected_h, fit_error "
        "FROM (SELECT *, -center_x AS ox, -center_y AS oy FROM norm) q"
)
_TYPES = (
    "SELECT t.drawing_id, coalesce(max(CASE WHEN k = 1 AND n >= CAST('0.3' AS DOUBLE) * total THEN kind END), 'generic') AS "
    "drawing_type FROM totals t LEFT JOIN ranked r ON r.drawing_id = t.drawing_id GROUP BY t.drawing_id"
)
_TYPED = {
    "every": _ALL, "totals": "SELECT drawing_id, count(*) AS total FROM every GROUP BY drawing_id",
    "ranked": f"SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY n DESC, first) AS k FROM (SELECT drawing_id, {_DISCIPLINE} AS "
        "kind, count(*) AS n, min(layer_ord) AS first FROM every GROUP BY ALL) g WHERE kind IS NOT NULL",
}
_BOXES = (
    "SELECT drawing_id, layer, CAST(layer_ord AS BIGINT) AS layer_ord, min(x0) AS min_x, min(y0) AS min_y, max(x1) AS max_x, max(y1) "
    "AS max_y FROM (SELECT drawing_id, layer, layer_ord, least(sx, ex) AS x0, least(sy, ey) AS y0, greatest(sx, ex) AS x1, "
    "greatest(sy, ey) AS y1 FROM segments UNION ALL SELECT drawing_id, layer, layer_ord, cx - radius, cy - radius, cx + radius, cy + "
    "radius FROM circles UNION ALL SELECT drawing_id, layer, layer_ord, tx, ty, tx, ty FROM texts) u GROUP BY ALL"
)
_CUT = lambda t, o, mark: (
    f"SELECT *, {_ID.format(mark)} AS id FROM (SELECT t.* REPLACE (concat('{mark}-', t.layer) AS layer, t.layer_ord + 10 AS layer_ord), "
    f"row_number() OVER (PARTITION BY t.drawing_id ORDER BY t.layer_ord, t.{o}) AS n FROM ({_PARTS[t]}) t WHERE t.drawing_id IN (SELECT "
    "n_nationkey FROM nation)) q"
)
_DRAWN = (
    "(SELECT DISTINCT drawing_id, layer, layer_ord FROM segments UNION SELECT DISTINCT drawing_id, layer, layer_ord FROM circles UNION "
    "SELECT DISTINCT drawing_id, layer, layer_ord FROM texts)"
)
#: The drawings of rectangles with all that their reports tell; loops, joints and edges follow from how they are made.
_PLANNED = {
    "rectangles": X.RECTANGLES,
    "segments": f"SELECT *, {_ID.format('L')} AS id FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY layer_ord, line_ord) AS "
        f"n FROM ({X.SIDES}) s) q",
    "circles": _CUT("circles", "circle_ord", "C"), "texts": _CUT("texts", "text_ord", "T"), "layers": f"SELECT * FROM {_DRAWN} u", **_TYPED,
    "types": _TYPES,
    "bounds": X.EXTENTS, "papers": _PAPERS, "sized": _SIZED, "fit": _FIT.format("drawing_id", "sized"), "scaled": _SCALED, "norm": _NORM,
    "meta0": _META, "meta": "SELECT q.* REPLACE (t.drawing_type AS drawing_type) FROM meta0 q JOIN types t USING (drawing_id)",
    "stats": _STATS, "boxes": _BOXES,
    "graph": "SELECT drawing_id, 4 * count(*) AS nodes, 4 * count(*) AS edges, concat('deg-2: ', 4 * count(*)) AS degrees FROM rectangles "
        "GROUP BY drawing_id",
    "loops": f"SELECT *, area >= greatest({D(0.01)} * max(area) OVER (PARTITION BY drawing_id), {D(1)}) AS large FROM (SELECT drawing_id, "
        "row_number() OVER (PARTITION BY drawing_id ORDER BY w * h DESC, i) AS loop_ord, 4 AS num_segments, CAST(w * h AS DOUBLE) AS "
        f"area, x + w / {D(2)} AS cx, y + h / {D(2)} AS cy, CAST(x AS DOUBLE) AS min_x, CAST(y AS DOUBLE) AS min_y, CAST(x + w AS "
        "DOUBLE) AS max_x, CAST(y + h AS DOUBLE) AS max_y FROM rectangles) r",
}


_UP, _FLAT = "(dy > 3 AND dx > 0 AND dx / dy < CAST('0.15' AS DOUBLE))", "(NOT (dy > 3 AND dx > 0 AND dx / dy < CAST('0.15' AS DOUBLE)) AND dx > 3 AND dy > 0 AND dy / dx < CAST('0.15' AS DOUBLE))"
_SNAP = "CASE WHEN {0} THEN {1} ELSE {2} END"
_STRAIGHT = (
    f"SELECT * EXCLUDE (dx, dy, mx, my) REPLACE ({_SNAP.format(_UP, _by('rounding', 'mx'), 'sx')} AS sx, "
    f"{_SNAP.format(_FLAT, _by('rounding', 'my'), 'sy')} AS sy, {_SNAP.format(_UP, _by('rounding', 'mx'), 'ex')} AS ex, "
    f"{_SNAP.format(_FLAT, _by('rounding', 'my'), 'ey')} AS ey, "
    f"CASE WHEN {_UP} THEN 'vertical' WHEN {_FLAT} THEN 'horizontal' ELSE alignment END AS alignment) FROM (SELECT *, abs(ex - sx) "
    f"AS dx, abs(ey - sy) AS dy, (sx + ex) / 2 AS mx, (sy + ey) / 2 AS my FROM {{0}}) l"
)
_SPACED = {
    "gaps": "SELECT *, floor(round_even((sy + ey) / 2, 0) / 20) AS band, row_number() OVER w - 1 AS i, sx - lag(sx) OVER w AS gap FROM {0} "
        "WHERE alignment = 'vertical' WINDOW w AS (PARTITION BY drawing_id, floor(round_even((sy + ey) / 2, 0) / 20) ORDER BY sx, "
        "layer_ord, line_ord)",
    "spread": "SELECT drawing_id, band, count(*) AS n, min(sx) AS x0, avg(gap) AS mean, stddev_pop(gap) AS std FROM gaps GROUP BY ALL",
    "evened": f"SELECT g.*, x0 + i * mean AS nx, coalesce(n >= 3 AND mean >= 1 AND std / mean < {D(0.3)} AND std > {D(0.5)}, false) AS even "
        "FROM gaps g JOIN spread s ON s.drawing_id = g.drawing_id AND s.band = g.band",
}
#: All of pass 1 over a part of the drawings with all kinds of entities.
_KINDS = [
    (_OWN.format("line", "'LINE'"), "false"), (_OWN.format("circle", "'CIRCLE', 'ARC'"), "false"),
    (_OWN.format("text", "'TEXT', 'MTEXT'"), "false"), (_POLY, "false"), (_SOLID, "true"), (_BLOCK, "false"),
    (
        "SELECT drawing_id, seq, CAST(0 AS BIGINT) AS sub, layer, 'touch' AS kind, x1, y1, x2, y2, radius, a1, a2, text, false AS "
        "loose FROM flat WHERE dxftype = 'LWPOLYLINE' AND npts < 2",
        "false"
    )
]
_ANALYSED = {
    "flat": f"SELECT * FROM ({X.FLAT}) f WHERE drawing_id < 8 AND seq % 3 = 0",
    "members": f"SELECT * FROM ({X.MEMBERS}) m WHERE drawing_id < 8", **NORM,
    "raw": " UNION ALL ".join(f"SELECT *, {solid} AS solid FROM ({sql}) k{i}" for i, (sql, solid) in enumerate(_KINDS)),
    "moved": _MOVED.format("raw.drawing_id, raw.seq, raw.sub, raw.layer, raw.kind, raw.solid"), "rounded": _ROUNDED,
    "rows": f"SELECT *, {_ALIGN} AS alignment FROM (SELECT *, {_TOL} AS tol FROM rounded) t WHERE NOT solid OR x1 <> x2 OR y1 <> y2",
    "layers": "SELECT drawing_id, layer, CAST(row_number() OVER (PARTITION BY drawing_id ORDER BY met, layer) AS BIGINT) AS layer_ord FROM "
        "(SELECT drawing_id, layer, min((seq, sub)) AS met FROM rows GROUP BY drawing_id, layer) g",
    "lines": "SELECT r.drawing_id, r.layer, l.layer_ord, row_number() OVER (PARTITION BY r.drawing_id, r.layer ORDER BY seq, sub) AS "
        "line_ord, x1 AS sx, y1 AS sy, x2 AS ex, y2 AS ey, alignment, rounding FROM rows r JOIN layers l ON l.drawing_id = "
        "r.drawing_id AND l.layer = r.layer WHERE kind = 'line'",
    "straight": _STRAIGHT.format("lines"), "gaps": _SPACED["gaps"].format("straight"), "spread": _SPACED["spread"],
    "evened": _SPACED["evened"],
    "segments": f"SELECT drawing_id, layer, layer_ord, line_ord, CASE WHEN even THEN {_by('rounding', 'nx')} ELSE sx END AS sx, sy, CASE WHEN "
        f"even THEN {_by('rounding', 'nx')} ELSE ex END AS ex, ey, alignment FROM evened UNION ALL SELECT drawing_id, layer, layer_ord, "
        "line_ord, sx, sy, ex, ey, alignment FROM straight WHERE alignment <> 'vertical'",
    "circles": "SELECT r.drawing_id, r.layer, l.layer_ord, x1 AS cx, y1 AS cy, radius FROM rows r JOIN layers l ON l.drawing_id = "
        "r.drawing_id AND l.layer = r.layer WHERE kind = 'circle'",
    "texts": "SELECT r.drawing_id, r.layer, l.layer_ord, x1 AS tx, y1 AS ty FROM rows r JOIN layers l ON l.drawing_id = r.drawing_id AND "
        "l.layer = r.layer WHERE kind = 'text'",
    "stats": _STATS,
    "boxes": "SELECT * REPLACE (" + ", ".join(
        f"{sql_round(c, 2)} AS {c}" for c in ("min_x", "min_y", "max_x", "max_y")
    ) + f") FROM ({_BOXES}) b",
}


def _within(points: str, ordinal: str, x: str, y: str, keep: str) -> str:
    sides = " UNION ALL ".join(
        f"SELECT drawing_id, loop_ord, x{i} AS xi, y{i} AS yi, x{j} AS xj, y{j} AS yj FROM rings"
        for i, j in ((1, 4), (2, 1), (3, 2), (4, 3))
    )
    return _sql(
        f"SELECT p.drawing_id, CAST(loop_ord AS BIGINT) AS loop_ord, CAST(layer_ord AS BIGINT) AS layer_ord, CAST({ordinal} AS "
        f"BIGINT) AS {ordinal}, p.{keep} FROM {points} p JOIN sides s ON s.drawing_id = p.drawing_id "
        f"WHERE (yi > p.{y}) <> (yj > p.{y}) AND p.{x} < (xj - xi) * (p.{y} - yi) / (yj - yi) + xi GROUP BY ALL HAVING count(*) % 2 = 1",
        points, "rings", sides=sides,
    )


ORACLE: dict[str, str] = {
    "dxf_source": _sql(
        "SELECT CAST(drawing_id AS VARCHAR) AS drawing_id, row_number() OVER (PARTITION BY drawing_id ORDER BY layer_ord, "
        "line_ord) AS seq, 'LINE' AS dxftype, layer, sx, sy, ex, ey FROM lattice",
        "lattice"
    ),
    "paper_size": _sql(
        f"SELECT s.*, {_FITTED} FROM sheets s LEFT JOIN fit ON fit.p_partkey = s.p_partkey", "sheets", papers=_PAPERS,
        fit=_FIT.format("p_partkey", "sheets")
    ),
    "drawing_bounds": _sql("SELECT * FROM bounds", "flat", bounds=_BOUNDS),
    "normalization": _sql("SELECT * FROM norm", "flat", **NORM),
    "line_alignment": _extracted(_OWN.format("line", "'LINE'"), _LINE),
    "polyline_segments": _extracted(_POLY, _LINE),
    "solid_outline": _extracted(_SOLID, _LINE, "WHERE x1 <> x2 OR y1 <> y2"),
    "circle_arc_extract": "",
    "text_extract": "",
    "block_explode": _extracted(
        _BLOCK,
        "drawing_id, seq, sub, layer, kind, x1, y1, x2, y2, radius, start_angle, end_angle, CASE WHEN kind = 'text' THEN text END "
        "AS text, CASE WHEN kind = 'line' THEN alignment END AS alignment",
        parts=("flat", "members")
    ),
    "entity_dispatch_counts": _sql(
        "SELECT drawing_id, dxftype, count(*) AS n FROM (SELECT drawing_id, CASE WHEN dxftype = 'HATCH' THEN 'skipped' ELSE "
        "dxftype END AS dxftype FROM flat UNION ALL SELECT f.drawing_id, m.dxftype FROM flat f JOIN members m ON m.drawing_id = "
        "f.drawing_id AND m.block = f.block_name WHERE f.dxftype = 'INSERT' AND m.dxftype <> 'SOLID') u GROUP BY ALL",
        "flat", "members"
    ),
    "straighten": _sql(f"SELECT * REPLACE (CAST(rounding AS BIGINT) AS rounding) FROM ({_STRAIGHT.format('leaning')}) l", "leaning"),
    "equalize_spacing": _sql(
        "SELECT drawing_id, CAST(rounding AS BIGINT) AS rounding, CAST(layer_ord AS BIGINT) AS layer_ord, CAST(line_ord AS BIGINT) "
        f"AS line_ord, CASE WHEN even THEN {_by('rounding', 'nx')} ELSE sx END AS sx, sy, CASE WHEN even THEN "
        f"{_by('rounding', 'nx')} ELSE ex END AS ex, ey, alignment FROM evened "
        "UNION ALL SELECT drawing_id, rounding, layer_ord, line_ord, sx, sy, ex, ey, alignment FROM uneven WHERE alignment <> 'vertical'",
        "uneven", gaps=_SPACED["gaps"].format("uneven"), spread=_SPACED["spread"], evened=_SPACED["evened"],
    ),
    "metadata": _sql(_META, "flat", **NORM),
    "drawing_type": _sql(_TYPES, *_T, **_TYPED),
    "merge_nodes": _sql(
        f"SELECT drawing_id, row_number() OVER (PARTITION BY drawing_id ORDER BY met) - 1 AS node_id, {sql_round('mx', 2)} AS x, "
        f"{sql_round('my', 2)} AS y FROM (SELECT drawing_id, min(met) AS met, avg(x) AS mx, avg(y) AS my FROM (SELECT drawing_id, "
        "gx, gy, round(x, 2) AS kx, min(x) AS x, min(y) AS y, min((layer_ord, line_ord, e)) AS met FROM ends GROUP BY ALL) p GROUP "
        "BY drawing_id, gx, gy) g",
        jittered=X.JITTERED,
        ends="SELECT drawing_id, layer_ord, line_ord, 0 AS e, sx AS x, sy AS y, gx, gy FROM jittered UNION ALL SELECT drawing_id, "
            "layer_ord, line_ord, 1, ex, ey, hx, hy FROM jittered",
    ),
    "loops_truncated": _sql(
        "SELECT CAST(drawing_id AS BIGINT) AS drawing_id, count(*) >= 3 AS truncated, least(count(*), 3) AS n FROM (SELECT "
        "DISTINCT drawing_id, m FROM cycles) c GROUP BY drawing_id",
        "lattice", recursive=True, **_GRAPH
    ),
    "json_payload": _sql(
        "SELECT CAST(m.drawing_id AS BIGINT) AS drawing_id, filename, drawing_type, scale_factor, m.rounding, paper_size, "
        "s.n_layers, s.lines, s.circles_arcs, s.text_annotations, g.nodes, g.edges, l.n_loops, 'false' AS truncated, "
        "'LOOP_001' AS first_id, l.first_area, coalesce(t.n, 0) AS first_texts, coalesce(c.n, 0) AS first_symbols, r.radius, "
        "coalesce(a.n, 0) AS anchors, o.n AS rooms FROM meta m JOIN graph g USING (drawing_id) "
        "JOIN (SELECT drawing_id, count(*) AS n_layers, CAST(sum(line_count) AS BIGINT) AS lines, CAST(sum(circle_arc_count) AS "
        "BIGINT) AS circles_arcs, CAST(sum(text_count) AS BIGINT) AS text_annotations FROM stats GROUP BY drawing_id) s USING "
        "(drawing_id) "
        "JOIN (SELECT drawing_id, count(*) AS n_loops, max(area) AS first_area FROM loops GROUP BY drawing_id) l USING "
        "(drawing_id) JOIN reach r USING (drawing_id) LEFT JOIN (SELECT drawing_id, count(*) AS n FROM labels WHERE loop_ord = 1 "
        "GROUP BY drawing_id) t USING (drawing_id) "
        "LEFT JOIN (SELECT drawing_id, count(*) AS n FROM symbols WHERE loop_ord = 1 GROUP BY drawing_id) c USING (drawing_id) "
        "LEFT JOIN (SELECT drawing_id, count(*) AS n FROM flatnear WHERE d <= radius GROUP BY drawing_id) a USING (drawing_id) "
        "LEFT JOIN (SELECT drawing_id, count(*) AS n FROM rooms GROUP BY drawing_id) o USING (drawing_id)",
        **_PLANNED, **{k: v for k, v in REPORT.items() if k in ("regions", "labels", "symbols")}, **_ANCHORED, rooms=_ROOMS,
    ),
    "full_analysis": _sql(
        f"SELECT s.drawing_id, s.layer, s.layer_ord, line_count, circle_arc_count, text_count, {sql_round('len', 2)} AS "
        "total_line_length, CASE WHEN h + v + g = 0 THEN NULL WHEN h >= v AND h >= g THEN 'horizontal' WHEN v >= g THEN 'vertical' "
        "ELSE 'diagonal' END AS dominant_alignment, min_x, min_y, max_x, max_y FROM (SELECT * REPLACE (CAST(len AS DOUBLE) AS len) "
        "FROM stats) s LEFT JOIN boxes b ON b.drawing_id = s.drawing_id AND b.layer = s.layer",
        **_ANALYSED,
    ),
    "markdown_payload": _sql(f"SELECT CAST(drawing_id AS BIGINT) AS drawing_id, markdown FROM ({MARKDOWN}) m", **_PLANNED, **REPORT),
    "cluster_nodes": _sql("SELECT drawing_id, node_id, x, y FROM nodes", "segments", ends=_ENDS.format("segments"), nodes=_NODES),
    "graph_edges": _sql(
        "SELECT drawing_id, layer, CAST(layer_ord AS BIGINT) AS layer_ord, CAST(line_ord AS BIGINT) AS line_ord, from_node, "
        "to_node FROM edges",
        "segments", ends=_ENDS.format("segments"), nodes=_NODES, edges=_EDGES.format("segments")
    ),
    "degree_distribution": _sql(
        "SELECT drawing_id, degree, count(*) AS n FROM (SELECT n.drawing_id, n.node_id, count(l.v) AS degree FROM nodes n LEFT "
        "JOIN links l ON l.drawing_id = n.drawing_id AND l.u = n.node_id GROUP BY ALL) d GROUP BY ALL",
        "segments", ends=_ENDS.format("segments"), nodes=_NODES, edges=_EDGES.format("segments"), links=_LINKS
    ),
    "detect_loops": _sql(
        f"SELECT DISTINCT CAST(drawing_id AS BIGINT) AS drawing_id, {_MEMBERS} FROM cycles", "lattice", recursive=True, **_GRAPH
    ),
    "detect_loops_recursive": _sql(
        f"SELECT DISTINCT CAST(drawing_id AS BIGINT) AS drawing_id, {_MEMBERS} FROM cycles WHERE drawing_id % 2 = 1 AND drawing_id < 10",
        "lattice", recursive=True, **_GRAPH
    ),
    "loop_metadata": _sql(
        f"SELECT CAST(drawing_id AS BIGINT) AS drawing_id, {_MEMBERS}, n AS num_segments, {sql_round('area', 2)} AS area, "
        f"{sql_round('mx', 2)} AS cx, {sql_round('my', 2)} AS cy, min_x, min_y, max_x, max_y FROM measured",
        "lattice", recursive=True, **_GRAPH, ring=_RING, sides=_SIDES,
        measured="SELECT s.drawing_id, m, s.n, abs(sum(a.x * b.y - b.x * a.y)) / 2 AS area, sum(a.x) / s.n AS mx, sum(a.y) / s.n AS my, "
            "min(a.x) AS min_x, min(a.y) AS min_y, max(a.x) AS max_x, max(a.y) AS max_y FROM sides s JOIN nodes a ON a.drawing_id = "
            "s.drawing_id AND a.node_id = s.u JOIN nodes b ON b.drawing_id = s.drawing_id AND b.node_id = s.v GROUP BY s.drawing_id, "
            "m, s.n",
    ),
    "loop_boundary_layers": _sql(
        f"SELECT DISTINCT CAST(s.drawing_id AS BIGINT) AS drawing_id, {_MEMBERS}, e.layer FROM sides s JOIN edges e ON e.drawing_id "
        "= s.drawing_id AND ((e.from_node = s.u AND e.to_node = s.v) OR (e.from_node = s.v AND e.to_node = s.u))",
        "lattice", recursive=True, **_GRAPH, ring=_RING, sides=_SIDES
    ),
    "layer_bboxes": _sql(_BOXES, *_T),
    "alignment_summary": _sql(
        "SELECT drawing_id, layer, CAST(layer_ord AS BIGINT) AS layer_ord, count(*) FILTER (WHERE alignment = 'horizontal') AS "
        "horizontal, count(*) FILTER (WHERE alignment = 'vertical') AS vertical, count(*) FILTER (WHERE alignment = 'diagonal') AS "
        "diagonal FROM segments GROUP BY ALL",
        "segments"
    ),
    "containment_text": _within("texts", "text_ord", "tx", "ty", "text"),
    "containment_symbols": _within("circles", "circle_ord", "cx", "cy", "radius"),
    "layer_statistics": _sql(
        f"SELECT drawing_id, layer, layer_ord, line_count, circle_arc_count, text_count, {sql_round('len', 2)} AS "
        "total_line_length, CASE WHEN h + v + g = 0 THEN NULL WHEN h >= v AND h >= g THEN 'horizontal' WHEN v >= g THEN 'vertical' "
        "ELSE 'diagonal' END AS dominant_alignment FROM (SELECT * REPLACE (CAST(len AS DOUBLE) AS len) FROM stats) q",
        *_T, stats=_STATS
    ),
    "text_anchors": _sql(
        "SELECT drawing_id, CAST(layer_ord AS BIGINT) AS layer_ord, CAST(text_ord AS BIGINT) AS text_ord, text, tx, ty, layer AS "
        f"text_layer, gtype AS nearest_entity_type, {sql_round('gx', 2)} AS nearest_x, {sql_round('gy', 2)} AS nearest_y, glayer AS "
        f"nearest_entity_layer, {sql_round('d', 2)} AS distance FROM flatnear WHERE d <= radius",
        *_T, **_ANCHORED
    ),
    "unanchored_texts": _sql(
        "SELECT t.drawing_id, CAST(t.layer_ord AS BIGINT) AS layer_ord, CAST(t.text_ord AS BIGINT) AS text_ord, t.text FROM texts "
        "t LEFT JOIN (SELECT * FROM flatnear WHERE d <= radius) f ON f.drawing_id = t.drawing_id AND f.layer_ord = t.layer_ord AND "
        "f.text_ord = t.text_ord WHERE f.drawing_id IS NULL",
        *_T, **_ANCHORED
    ),
    "anchor_radius": _sql("SELECT drawing_id, radius FROM reach", *_T, **_ANCHORED),
    "room_labels": _sql(_ROOMS, "texts"),
    "room_assignment": _sql(
        "SELECT i.drawing_id, min_by(r.room_ord, ((px - x) * (px - x) + (py - y) * (py - y), r.room_ord)) AS room_ord, "
        "CAST(layer_ord AS BIGINT) AS layer_ord, CAST(item_ord AS BIGINT) AS item_ord, coalesce(handle, id) AS handle, type, layer "
        "FROM items i JOIN rooms r ON r.drawing_id = i.drawing_id GROUP BY i.drawing_id, layer_ord, k, item_ord, handle, id, type, "
        "layer",
        *_T, items=_ITEMS, rooms=_ROOMS
    ),
    "entity_ids": _sql(
        " UNION ALL ".join(
            _NUMBERED(t, o, p, f"drawing_id, layer, CAST({o} AS BIGINT) AS ord")
            for t, o, p in (("segments", "line_ord", "L"), ("circles", "circle_ord", "C"), ("texts", "text_ord", "T"))
        ),
        *_T
    ),
    "loop_size_class": _sql(
        "SELECT drawing_id, CAST(loop_ord AS BIGINT) AS loop_ord, area, area >= greatest(max(area) OVER (PARTITION BY drawing_id) "
        f"* {D(0.01)}, {D(1)}) AS large FROM areas",
        "areas"
    ),
    "small_shapes_top20": _sql(
        "SELECT drawing_id, CAST(loop_ord AS BIGINT) AS loop_ord, area, k, total FROM (SELECT *, row_number() OVER (PARTITION BY "
        "drawing_id ORDER BY loop_ord) AS k, count(*) OVER (PARTITION BY drawing_id) AS total FROM classed WHERE NOT large) q "
        "WHERE k <= 20",
        "areas", classed=f"SELECT *, area >= greatest(max(area) OVER (PARTITION BY drawing_id) * {D(0.01)}, {D(1)}) AS large FROM areas"
    ),
    "layer_report_order": _sql(
        "SELECT drawing_id, layer, row_number() OVER (PARTITION BY drawing_id ORDER BY CASE WHEN line_count = 0 THEN 0 ELSE 1 END, "
        "text_count DESC, layer_ord) AS report_ord FROM stats",
        *_T, stats=_STATS
    ),
    "geometry_top30": _sql(
        f"SELECT drawing_id, layer, CAST(line_ord AS BIGINT) AS line_ord, CAST(line_ord AS BIGINT) AS k, {sql_round('len', 1)} AS "
        "length FROM (SELECT *, sqrt((sx - ex) * (sx - ex) + (sy - ey) * (sy - ey)) AS len FROM segments) q WHERE line_ord <= 30",
        "segments"
    ),
    "furniture_by_name": _sql(
        "SELECT * FROM (SELECT drawing_id, CASE WHEN upper(block_name) LIKE '*%' OR starts_with(upper(block_name), 'A$C') THEN "
        "NULL " + " ".join(
            f"WHEN regexp_matches(upper(block_name), '{w}') THEN '{c}'" for c, w in FURNITURE.items()
        ) + " END AS category, coalesce(block_name, '') AS block_name, handle, coalesce(layer, '') AS layer, 'block_name' AS method "
            "FROM instances) q WHERE category IS NOT NULL",
        "instances"
    ),
    "furniture_by_shape": _sql(
        "SELECT drawing_id, handle, w, h, CASE WHEN w * h > 300000 AND w * h < 3000000 THEN CASE WHEN r < 1.5 THEN 'table' WHEN r "
        "< 3 THEN 'desk' ELSE 'sofa' END WHEN w * h > 100000 AND w * h < 600000 THEN CASE WHEN r < 1.5 THEN 'chair' ELSE 'sink' "
        f"END END AS category FROM (SELECT *, greatest(w, h) / greatest(least(w, h), {D(1e-6)}) AS r FROM instances) q",
        "instances"
    ),
}
_WITH_BLOCKS = lambda own, types: f"{own} UNION ALL SELECT * FROM ({_BLOCK}) b WHERE kind = '{types}'"
ORACLE["circle_arc_extract"] = _extracted(
    _WITH_BLOCKS(_OWN.format("circle", "'CIRCLE', 'ARC'"), "circle"), _ROUND, parts=("flat", "members")
)
ORACLE["text_extract"] = _extracted(_WITH_BLOCKS(_OWN.format("text", "'TEXT', 'MTEXT'"), "text"), _TEXT, parts=("flat", "members"))
ORACLE["line_alignment"] = _extracted(_WITH_BLOCKS(_OWN.format("line", "'LINE'"), "line"), _LINE, parts=("flat", "members"))
