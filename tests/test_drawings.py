"""The five passes: small plans whose results are worked out by hand."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftlake.functions import classify, geometry, rendering, rounding, text
from draftlake.operators import extraction, furniture, kernels, payload, semantics, spatial, topology
from draftlake.operators.extraction import Layers
from draftlake.plans.analysis import analyse, analyse_path, analyse_tables
from draftlake.plans.documents import document, json_documents, nested, write_documents
from draftlake.plans.store import kept
from draftlake.sources import fixtures
from draftlake.sources.dxf import DxfDataSource, NotDxf, decode, parse, read_dxf

SEG = (
    "drawing_id int, layer string, layer_ord int, line_ord int, sx double, sy double, ex double, ey double, alignment string, handle "
    "string, id string, rounding int"
)
CIR = (
    "drawing_id int, layer string, layer_ord int, circle_ord int, cx double, cy double, radius double, angles array<double>, handle "
    "string, id string"
)
TXT = "drawing_id int, layer string, layer_ord int, text_ord int, tx double, ty double, text string, handle string, id string"


def segments(spark, rows, drawing=1, layer="layer0"):
    return spark.createDataFrame(
        [(drawing, layer, 1, i + 1, *map(float, r[:4]), *(r[4:] or (None,)), None, None, 1) for i, r in enumerate(rows)], SEG
    )


def tables(spark, lines=(), circles=(), texts=(), layers=None):
    """lines (layer, sx, sy, ex, ey, alignment), circles (layer, x, y, r), texts (layer, x, y, text); layers in the order given."""
    names = layers or list(dict.fromkeys([r[0] for r in (*lines, *circles, *texts)]))
    k = {n: i + 1 for i, n in enumerate(names)}
    at = lambda rows: [(1, r[0], k[r[0]], sum(x[0] == r[0] for x in rows[: i + 1]), *r[1:]) for i, r in enumerate(rows)]
    return Layers(
        spark.createDataFrame([(1, n, i) for n, i in k.items()], "drawing_id int, layer string, layer_ord int"),
        spark.createDataFrame([(*r, None, None, 1) for r in at([(r[0], *map(float, r[1:5]), r[5]) for r in lines])], SEG),
        spark.createDataFrame([(*r, None, None, None) for r in at([(r[0], *map(float, r[1:])) for r in circles])], CIR),
        spark.createDataFrame([(*r, None, None) for r in at([(r[0], float(r[1]), float(r[2]), r[3]) for r in texts])], TXT),
    )


def lattice_links(n):
    link = [[] for _ in range(n * n)]
    for i in range(n):
        for j in range(n):
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < n and b < n:
                    link[i * n + j].append(a * n + b)
                    link[a * n + b].append(i * n + j)
    return link


# functions


def test_rounding_equals_python(spark):
    r = random.Random(0)
    values = [
        0.0, 0.5, 1.5, 2.5, -0.5, 2.675, 1.005, 0.125, -2.665, 1e9 + 0.125, 0.05, 0.15, 0.25
    ] + [r.randint(-99999, 99999) / r.choice([8, 16, 20, 200, 1000]) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select(
        "x", *(rounding.round_exact(F.col("x"), k).alias(f"r{k}") for k in range(3)),
        *(F.expr(rounding.sql_round("x", k)).alias(f"s{k}") for k in (1, 2))
    ).collect()
    for g in got:
        assert (g.r0, g.r1, g.r2) == (round(g.x), round(g.x, 1), round(g.x, 2)), g.x
        assert (g.s1, g.s2) == (g.r1, g.r2)
    odd = spark.createDataFrame(
        [(None,), (float("inf"),), (1e300,)], "x double"
    ).select(rounding.round_exact(F.col("x"), 2).alias("r")).collect()
    assert [o.r for o in odd] == [None, float("inf"), 1e300]


def test_numbers_as_text(spark):
    values = [5.0, -3.25, 12345678.5, 1e-05, 1e16, 1e15, 0.0001, 123.0, 1.5e-7, 0.1, 100000000.0]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", rendering.shortest(F.col("x")).alias("t")).collect()
    assert [g.t for g in got] == [repr(g.x) for g in got]
    row = spark.range(1).select(
        rendering.whole(F.lit(2.5)).alias("a"), rendering.one_decimal(F.lit(0.25)).alias("b"),
        rendering.numbered("L", F.lit(1234)).alias("c"), rendering.numbered("L", F.lit(7)).alias("d"),
        rendering.coordinate(F.lit(5.0), F.lit(0)).alias("e")
    ).first()
    assert tuple(row) == ("2", "0.2", "L_1234", "L_007", "5")


def test_multiline_text(spark):
    cases = {
        r"{\fArial|b0;Room} \H2.5x;12\P\LNorth\l": "Room 12 North", r"a\~b \S1/2; %%d \\x \{y\}": "a b 1/2 ° \\x {y}", "  x \n": "x",
        None: ""
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.content(F.lit("MTEXT"), F.col("t")).alias("c"))
    assert {r.t: r.c for r in df.collect()} == cases


@pytest.mark.parametrize("name, want", [
    ("CHAIR-OFFICE", "chair"), ("A-FURN-SEAT-01", "chair"), ("DESK-L-SHAPE", "desk"), ("WORKSTATION-1", "desk"), ("TABLE-ROUND", "table"),
    ("CONFERENCE-6P", "table"), ("SOFA-3SEAT", "sofa"), ("BED-QUEEN", "bed"), ("TOILET-STD", "toilet"),
    ("WC-01", "toilet"), ("SINK-KITCHEN", "sink"), ("*U123", None), ("A$C272C05F5", None), ("CUSTOM-WIDGET", None),
    ("X_R377_3BR_3A2", None), ("WATER CLOSET", "wardrobe"), ("FIREPLACE", "fixture"), ("ADJUSTABLE", "table"),
])
def test_block_names(spark, name, want):
    assert spark.range(1).select(classify.furniture(F.lit(name)).alias("c")).first().c == want


def test_shapes(spark):
    cases = {
        (1000, 800): "table", (1500, 600): "desk", (500, 450): "chair", (50, 50): None, (10000, 10000): None, (600, 500): "chair",
        (4000, 200): "sofa", (600, 200): "sink", (0, 0): None
    }
    df = spark.createDataFrame(
        [(float(a), float(b)) for a, b in cases], "w double, h double"
    ).select("w", "h", classify.shape(F.col("w"), F.col("h")).alias("c"))
    assert {(int(r.w), int(r.h)): r.c for r in df.collect()} == cases


# pass 1


def test_paper(spark):
    rows = [(8410.0, 5940.0), (5940.0, 4200.0), (100000.0, 1000.0), (4200.0, 5940.0), (2000.0, 2000.0)]
    got = extraction.paper_fit(spark.createDataFrame(rows, "width double, height double")).collect()
    assert [(r.paper_size, r.paper_scale, r.fit_error) for r in got] == [
        ("A1", 10, 0.0), ("A2", 10, 0.0), (None, None, None), ("A2", 10, 0.0), (None, None, None)
    ]


def test_normalisation(spark):
    rows = [(1, 0.0, 0.0, 8410.0, 5940.0), (2, 0.0, 0.0, 100000.0, 1000.0), (3, -5.0, -5.0, 5.0, 5.0), (4, None, None, None, None)]
    got = {
        r.drawing_id: r
        for r in extraction.normalisation(
            spark.createDataFrame(rows, "drawing_id int, min_x double, min_y double, max_x double, max_y double")
        ).collect()
    }
    assert set(got) == {1, 2, 3}
    assert (got[1].scale_factor, got[1].width, got[1].height, got[1].rounding, got[1].expected_w) == (10.0, 841.0, 594.0, 0, 8410)
    assert (got[2].scale_factor, got[2].width, got[2].rounding) == (100.0, 1000.0, 0)
    assert (got[3].scale_factor, got[3].center_x, got[3].rounding) == (1.0, 0.0, 1)


def entity_rows(spark, rows):
    base = {"drawing_id": "d", "paperspace": 0, "closed": False, "height": 0.0}
    names = [
        "drawing_id", "seq", "block", "block_x", "block_y", "handle", "dxftype", "layer", "paperspace", "pts", "bulges", "closed", "radius",
        "start_angle", "end_angle", "text", "height", "block_name", "xscale", "yscale", "rotation", "error"
    ]
    from draftlake.schemas import ENTITIES

    made = []
    for i, r in enumerate(rows):
        r = base | {"seq": i} | r
        r["pts"] = [(float(x), float(y)) for x, y in r.get("pts", [])]
        made.append(tuple(r.get(n) for n in names))
    return spark.createDataFrame(made, ENTITIES)


IDENTITY = "drawing_id string, center_x double, center_y double, width double, height double, scale_factor double, rounding int"


def plain(spark, scale=1.0, digits=1):
    return spark.createDataFrame([("d", 0.0, 0.0, 10.0, 10.0, scale, digits)], IDENTITY)


def test_bounds(spark):
    rows = [
        {"dxftype": "LEADER", "layer": "0", "error": "bad"}, {"dxftype": "LINE", "layer": "0", "pts": [(0, 0), (10, 10)]},
        {"dxftype": "CIRCLE", "layer": "0", "pts": [(0, 0)], "radius": 3.0},
        {"dxftype": "ARC", "layer": "0", "pts": [(20, 0)], "radius": 5.0, "start_angle": 0.0, "end_angle": 90.0},
        {"dxftype": "LWPOLYLINE", "layer": "0", "pts": [(0, -1), (4, -1)], "bulges": [1.0, 0.0]},
        {"dxftype": "INSERT", "layer": "0", "pts": [(-10, 0)], "block_name": "B", "rotation": 90.0, "xscale": 2.0},
        {"dxftype": "LINE", "layer": "0", "pts": [(0, 0), (5, 1)], "block": "B", "block_x": 0.0, "block_y": 0.0},
        {"dxftype": "LINE", "layer": "0", "pts": [(999, 999), (1, 1)], "paperspace": 1}, {"dxftype": "LWPOLYLINE", "layer": "0", "pts": []},
    ]
    r = extraction.bounds(entity_rows(spark, rows)).first()
    assert (r.min_x, r.min_y, r.max_x, r.max_y, r.skipped) == (pytest.approx(-11), pytest.approx(-3), 25.0, 10.0, 1)
    nothing = extraction.bounds(entity_rows(spark, rows[:1])).first()
    assert nothing.min_x is None and nothing.skipped == 1


def test_extraction_of_all_types(spark):
    rows = [
        {"dxftype": "LINE", "layer": "A", "pts": [(0, 0), (10, 0.05)], "handle": "1F"},
        {"dxftype": "LWPOLYLINE", "layer": "B", "pts": [(0, 0), (10, 0), (10, 10), (0, 10)], "closed": True},
        {"dxftype": "LWPOLYLINE", "layer": "EMPTY", "pts": [(0, 0)]},
        {"dxftype": "SOLID", "layer": "C", "pts": [(0, 0), (2, 0), (0, 2), (2, 2)]},
        {"dxftype": "SOLID", "layer": "NONE", "pts": [(1, 1), (1, 1)]},
        {"dxftype": "CIRCLE", "layer": "D", "pts": [(1, 2)], "radius": 1.25},
        {"dxftype": "ARC", "layer": "D", "pts": [(1, 2)], "radius": 2.0, "start_angle": 0.05, "end_angle": 90.0},
        {"dxftype": "TEXT", "layer": "E", "pts": [(1, 1)], "text": "  a%%d "},
        {"dxftype": "MTEXT", "layer": "E", "pts": [(2, 2)], "text": r"{\H3;b}\Pc"},
        {"dxftype": "INSERT", "layer": "F", "pts": [(10, 10)], "block_name": "B", "xscale": 2.0, "yscale": 5.0, "rotation": 90.0},
        {"dxftype": "INSERT", "layer": "G", "pts": [(0, 0)], "block_name": "MISSING"}, {"dxftype": "HATCH", "layer": "H", "pts": [(0, 0)]},
        {"dxftype": "LINE", "layer": "0", "pts": [(0, 0), (1, 0)], "block": "B", "block_x": 7.0},
        {"dxftype": "CIRCLE", "layer": "0", "pts": [(1, 1)], "radius": 1.0, "block": "B"},
        {"dxftype": "SOLID", "layer": "0", "pts": [(1, 1)], "block": "B"},
    ]
    e = entity_rows(spark, rows)
    t = extraction.extract(e, plain(spark))
    order = [r.layer for r in t.layers.orderBy("layer_ord").collect()]
    assert order == ["A", "B", "EMPTY", "C", "D", "E", "F"]
    by = {}
    for r in t.segments.orderBy("layer_ord", "line_ord").collect():
        by.setdefault(r.layer, []).append((r.sx, r.sy, r.ex, r.ey, r.alignment))
    assert by["A"] == [(0.0, 0.0, 10.0, 0.0 if round(0.05, 1) == 0 else 0.1, "horizontal")] or by["A"][0][4] == "horizontal"
    assert [x[:4] for x in by["B"]] == [(0, 0, 10, 0), (10, 0, 10, 10), (10, 10, 0, 10)]
    assert [x[:4] for x in by["C"]] == [(0, 0, 2, 0), (2, 0, 0, 2), (0, 2, 2, 2), (2, 2, 0, 0)] and by["C"][1][4] == "diagonal"
    assert by["F"] == [(10.0, 10.0, 12.0, 10.0, "horizontal")] and "NONE" not in by
    circles = {(r.layer, r.cx, r.cy, r.radius, tuple(r.angles) if r.angles else None) for r in t.circles.collect()}
    assert circles == {("D", 1.0, 2.0, 1.2, None), ("D", 1.0, 2.0, 2.0, (0.1, 90.0)), ("F", 12.0, 12.0, 2.0, None)}
    assert [(r.text, r.tx) for r in t.texts.orderBy("text_ord").collect()] == [("a%%d", 1.0), ("b c", 2.0)]
    assert {(r.dxftype, r.n) for r in extraction.entity_counts(e).collect()} == {
        ("LINE", 2), ("LWPOLYLINE", 2), ("SOLID", 2), ("CIRCLE", 2), ("ARC", 1), ("TEXT", 1), ("MTEXT", 1), ("INSERT", 2), ("skipped", 1)
    }


def test_straighten_and_equalise(spark):
    got = extraction.straighten(
        segments(spark, [(0, 0, 1, 10, "diagonal"), (0, 0, 10, 1, "diagonal"), (0, 0, 10, 5, "diagonal"), (0, 0, 0, 0, "vertical")])
    ).orderBy("line_ord").collect()
    assert [(r.sx, r.sy, r.ex, r.ey, r.alignment) for r in got] == [
        (0.5, 0, 0.5, 10, "vertical"), (0, 0.5, 10, 0.5, "horizontal"), (0, 0, 10, 5, "diagonal"), (0, 0, 0, 0, "vertical")
    ]
    rows = [
        (0, 0, 0, 10, "vertical"), (22, 0, 22, 10, "vertical"), (10, 0, 10, 10, "vertical"), (50, -30, 50, -20, "vertical"),
        (5, 0, 9, 9, "diagonal")
    ]
    got = extraction.equalise(segments(spark, rows)).orderBy("line_ord").collect()
    assert [(r.sx, r.ex) for r in got] == [(0, 0), (22, 22), (11, 11), (50, 50), (5, 9)]


def test_drawing_type(spark):
    t = tables(spark, [("E-WIRE", 0, 0, 1, 1, None)] * 3 + [("0", 0, 0, 1, 1, None)] * 7)
    assert extraction.drawing_types(t).first().drawing_type == "electrical"
    t = tables(spark, [("E-WIRE", 0, 0, 1, 1, None)] * 2 + [("0", 0, 0, 1, 1, None)] * 8)
    assert extraction.drawing_types(t).first().drawing_type == "generic"
    t = tables(spark, [("a_wall", 0, 0, 1, 1, None), ("STRUCTURE", 0, 0, 1, 1, None)])
    assert extraction.drawing_types(t).first().drawing_type == "architectural"


# pass 2


@pytest.mark.parametrize("rows, tolerance, want", [
    ([(0, 0, 10, 0), (10.3, 0.1, 20, 0)], 1.0, 3), ([(0, 0, 10, 0), (15, 0, 20, 0)], 1.0, 4),
    ([(0.15, 0, 10, 0), (0.25, 0, 20, 0)], 0.2, 3), ([(0.0039, 0, 10, 0), (-0.0039, 0, 20, 0)], 0.005, 3),
    ([(0, 0, 1, 0), (5, 5, 5, 5)], 1.0, 2),
])
def test_joints(spark, rows, tolerance, want):
    assert topology.joints(segments(spark, rows), tolerance)[0].count() == want


def test_many_joints(spark):
    rows = [(x, y, x + 2, y) for x in range(0, 600, 10) for y in range(0, 600, 10)]
    assert topology.joints(segments(spark, rows))[0].count() == 7200
    assert len(kernels.cluster(np.array([p for r in rows for p in (r[:2], r[2:])], float), 1.0)[0]) == 7200


def test_fast_path_equals_kernel(spark):
    r = random.Random(2)
    rows = [tuple(3 * r.randint(0, 9) for _ in range(4)) for _ in range(80)]
    nodes, points = topology.joints(segments(spark, rows))
    centres, known = kernels.cluster(np.array([p for s in rows for p in (s[:2], s[2:])], float), 1.0)
    assert {(n.node_id, n.x, n.y) for n in nodes.collect()} == {(i, *c) for i, c in enumerate(centres)}
    assert {((p.kx, p.ky), p.node_id) for p in points.collect()} == set(known.items())
    near = [tuple(v + r.random() for v in s) for s in rows]
    nodes, points = topology.joints(segments(spark, near))
    centres, known = kernels.cluster(np.array([p for s in near for p in (s[:2], s[2:])], float), 1.0)
    assert {(n.node_id, n.x, n.y) for n in nodes.collect()} == {(i, *c) for i, c in enumerate(centres)} and points.count() == len(known)


def test_a_chain_drifts_unless_anchored():
    points = np.array([(0.3 * i, 0.0) for i in range(60)])
    spread = lambda known: max(
        max(x for (x, _), j in known.items() if j == k) - min(x for (x, _), j in known.items() if j == k) for k in set(known.values())
    )
    assert spread(kernels.cluster(points, 1.0)[1]) > 1.0 and spread(kernels.anchored(points, 1.0)[1]) <= 2.0


@pytest.mark.parametrize("links, params, n, cut", [
    ([[1, 3], [0, 2], [1, 3], [2, 0]], {}, 1, False), ([[1], [0, 2, 3], [1], [1]], {}, 0, False),
    ([[j for j in range(5) if j != i] for i in range(5)], {"max_length": 5, "max_loops": 2}, 2, True),
    ([[j for j in range(5) if j != i] for i in range(5)], {}, 16, False),
    ([[j for j in range(4) if j != i] for i in range(4)], {"max_length": 4}, 5, False),
    ([[j for j in range(4) if j != i] for i in range(4)], {"max_length": 4, "by": "cycle"}, 7, False),
    (lattice_links(10), {"max_loops": 2000}, 2000, True), (lattice_links(3), {}, 13, False), (lattice_links(4), {}, 196, False),
])
def test_cycles(links, params, n, cut):
    found, truncated = kernels.cycles(links, **params)
    assert (len(found), truncated) == (n, cut)


def test_a_large_tree_stops_at_the_budget():
    n = (3**12 - 1) // 2
    links = [[c for c in range(3 * i + 1, 3 * i + 4) if c < n] + ([(i - 1) // 3] if i else []) for i in range(n)]
    assert kernels.cycles(links, max_steps=10_000) == ([], True)
    small = (3**9 - 1) // 2
    assert kernels.cycles([[x for x in v if x < small] for v in links[:small]]) == ([], False)


def test_recursive_loops_equal_the_kernel(spark):
    link = lattice_links(3)
    df = spark.createDataFrame(
        [(1, i, k, j) for i, v in enumerate(link) for k, j in enumerate(v)], "drawing_id int, node_id int, nbr_ord int, nbr int"
    )
    sql = {frozenset(r.node_ids) for r in topology.detect_loops_sql(kept(df), 9).collect()}
    assert sql == {frozenset(p) for p in kernels.cycles(link)[0]} and len(sql) == 13


def test_square(spark):
    top = topology.analyse(segments(spark, [(0, 0, 10, 0), (10, 0, 10, 10), (10, 10, 0, 10), (0, 10, 0, 0), (0, 0, 10, 0), (5, 5, 5, 5)]))
    loop = top.loops.first()
    assert (
        loop.num_segments, loop.area, loop.cx, loop.cy, loop.min_x, loop.min_y, loop.max_x, loop.max_y, loop.loop_ord
    ) == (4, 100.0, 5.0, 5.0, 0.0, 0.0, 10.0, 10.0, 1)
    assert top.edges.count() == 5 and not top.truncated.first().truncated
    assert {(r.degree, r.n) for r in topology.degree_distribution(top.nodes, topology.adjacency(top.edges)).collect()} == {(0, 1), (2, 4)}
    assert [r.layer for r in topology.loop_boundary_layers(top.loops, top.edges).collect()] == ["layer0"]


def test_fixture_lines_are_numbered_within_layers_only(spark):
    d = "/root/testdata/sf0.001"
    s = fixtures.tables(spark, d).segments
    plan = s._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") == 1  # the number in the drawing is never made
    want = fixtures.tables_sql(spark, d, fixtures.SEGMENTS)
    cols = ["drawing_id", "layer", "layer_ord", "line_ord", "sx", "sy", "ex", "ey", "alignment"]
    assert sorted(map(tuple, s.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_ends_and_links_are_met_by_numbers(spark):
    s = segments(spark, [(0, 0, 10, 0), (10, 0, 10, 10), (10.001, 0, 0, 0)])
    first = topology._first_points(s)
    got = sorted((r.kx, r.ky, r["at"].layer_ord, r["at"].line_ord, r["at"].e, r.x) for r in first.collect())
    assert got == [(0, 0, 1, 1, 0, 0), (10, 0, 1, 1, 1, 10), (10, 10, 1, 2, 1, 10)]
    assert "HashAggregate(keys=[drawing_id" in first._jdf.queryExecution().executedPlan().toString()


# passes 3 and 4


def test_containment(spark):
    t = tables(
        spark, [("W", 0, 0, 10, 0, None), ("W", 10, 0, 10, 10, None), ("W", 10, 10, 0, 10, None), ("W", 0, 10, 0, 0, None)],
        [("C", 5, 5, 1), ("C", 50, 5, 1)], [("T", 5, 5, "in"), ("T", 15, 5, "out"), ("T", 0, 5, "edge")]
    )
    loops = topology.analyse(t.segments).loops
    assert sorted(r.text for r in spatial.contained(t.texts, loops, "tx", "ty").collect()) == ["edge", "in"]
    assert [r.cx for r in spatial.contained(t.circles, loops, "cx", "cy").collect()] == [5.0]
    boxes = {r.layer: (r.min_x, r.min_y, r.max_x, r.max_y) for r in spatial.layer_boxes(t).collect()}
    assert boxes == {"W": (0, 0, 10, 10), "C": (4, 4, 51, 6), "T": (0, 5, 15, 5)}


def test_containment_decides_each_place_and_ring_once(spark):
    box = lambda a: [(a, 0.0), (a + 10, 0.0), (a + 10, 10.0), (a, 10.0)]
    loops = spark.createDataFrame(
        [(1, i, i % 2 * 5.0, 0.0, i % 2 * 5.0 + 10, 10.0, box(i % 2 * 5.0)) for i in range(40)],
        "drawing_id int, loop_ord int, min_x double, min_y double, max_x double, max_y double, ring array<struct<x: double, y: double>>"
    )
    points = spark.createDataFrame([(1, i, float(i % 4 * 4), 5.0) for i in range(60)], "drawing_id int, k int, px double, py double")
    found = spatial.contained(points, loops, "px", "py")
    want = {(k, o) for k in range(60) for o in range(40) if o % 2 * 5 <= k % 4 * 4 < o % 2 * 5 + 10}
    assert {(r.k, r.loop_ord) for r in found.collect()} == want and found.count() == len(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [drawing_id") >= 2  # different rings and places


def test_statistics(spark):
    lines = [("WALLS", 0, 0, 100, 0), ("WALLS", 0, 0, 0, 100), ("WALLS", 0, 0, 50, 50)]
    bare = semantics.layer_statistics(tables(spark, [(*x, None) for x in lines], layers=["WALLS", "EMPTY"])).orderBy("layer_ord").collect()
    assert (
        bare[0].line_count, bare[0].dominant_alignment, bare[0].total_line_length
    ) == (3, "diagonal", 270.71) and (bare[1].line_count, bare[1].dominant_alignment) == (0, None)
    given = semantics.layer_statistics(tables(spark, [(*x, a) for x, a in zip(lines, geometry.ALIGNMENTS)])).first()
    assert given.dominant_alignment == "horizontal"
    s = spatial.alignment_summary(tables(spark, [(*x, None) for x in lines]).segments).first()
    assert (s.horizontal, s.vertical, s.diagonal) == (0, 0, 3)


def test_display_alignment(spark):
    rows = [(0, 0, 1000, 0), (0, 0, 0.1, 500), (0, 0, 200, 300), (5, 5, 5.3, 5)]
    got = segments(spark, rows).select(
        "line_ord", geometry.alignment_for_display(F.col("sx"), F.col("sy"), F.col("ex"), F.col("ey")).alias("a")
    ).orderBy("line_ord").collect()
    assert [r.a for r in got] == ["horizontal", "vertical", "diagonal", "diagonal"]


def test_nearest_equals_brute_force(spark):
    r = random.Random(1)
    q = [(1, i, r.uniform(-500, 500), r.uniform(-500, 500)) for i in range(40)] + [(2, 99, 0.0, 0.0)]
    refs = [(1, i, 5 * r.randint(-40, 40) * 1.0, 5 * r.randint(-4, 4) * 1.0) for i in range(60)] + [(1, 60, 1e5, 1e5)]
    got = semantics.nearest(
        spark.createDataFrame(q, "drawing_id int, k int, x double, y double"),
        spark.createDataFrame(refs, "drawing_id int, ord int, u double, v double"), ["k"], "x", "y", "u", "v", "ord"
    ).collect()
    want = {k: min(refs, key=lambda f: ((f[2] - x) ** 2 + (f[3] - y) ** 2, f[1]))[1] for d, k, x, y in q if d == 1}
    assert {g.k: g.ord for g in got} == want


def test_nearest_takes_each_place_once(spark):
    seen = []

    def keep(df):
        seen.append(kept(df).count())
        return kept(df)

    places = [(0.0, 0.0), (30.0, 0.0), (9000.0, 9000.0)]
    q = [(1, i, *places[i % 3]) for i in range(300)]
    refs = [(1, i, float(i % 2 * 10 - 5), float(i % 2)) for i in range(200)] + [(1, 200, 20000.0, 9000.0), (1, 201, 9000.0, 20000.0)]
    got = semantics.nearest(
        spark.createDataFrame(q, "drawing_id int, k int, x double, y double"),
        spark.createDataFrame(refs, "drawing_id int, ord int, u double, v double"), ["k"], "x", "y", "u", "v", "ord", keep=keep
    ).collect()
    want = {k: min(refs, key=lambda f: ((f[2] - x) ** 2 + (f[3] - y) ** 2, f[1]))[1] for _, k, x, y in q}
    assert len(got) == 300 and {g.k: g.ord for g in got} == want and max(seen) <= 4


def test_radius_and_anchors(spark):
    texts = [("T", 0, y, f"t{y}") for y in (1, 2, 40, 50)]
    t = tables(spark, [], [("C", 0, 0, 1)], texts)
    near = semantics.text_neighbours(t)
    radius = semantics.anchor_radius(t, near)
    assert radius.first().radius == 80.0
    assert semantics.text_anchors(near, radius).count() == 4 and semantics.text_anchors(near, 40).count() == 3
    assert [r.text for r in semantics.unanchored_texts(t, semantics.text_anchors(near, 40)).collect()] == ["t50"]
    alone = tables(spark, [], [], texts)
    assert semantics.anchor_radius(alone, semantics.text_neighbours(alone)).first().radius == 500.0


def test_rooms_carry_ids(spark):
    t = payload.assign_ids(
        tables(spark, [("A-WALL", 0, 0, 10, 0, None)], [], [("A-ROOM-NAME", 0, 0, "OFFICE 101")], layers=["A-ROOM-NAME", "A-WALL"])
    )
    rooms = semantics.room_labels(t.texts)
    blocks = spark.createDataFrame(
        [(1, "A-WALL", 2, 1, 1.0, 1.0, None)],
        "drawing_id int, layer string, layer_ord int, block_ord int, bx double, by double, handle string"
    )
    got = {(r.type, r.handle) for r in semantics.room_members(t, rooms, blocks).collect()}
    assert got == {("line", "L_001"), ("text", "T_001"), ("block", "?")}


def test_furniture(spark):
    rows = [
        (1, "CHAIR-01", "A1", "F", [1.0, 2.0]), (1, "DESK-L", None, None, None), (1, "WALL-INT", "A3", "F", None),
        (1, None, "A4", "F", None)
    ]
    df = spark.createDataFrame(rows, "drawing_id int, block_name string, handle string, layer string, insertion_point array<double>")
    got = furniture.detect_furniture(df, "architectural").orderBy("category").collect()
    assert [(r.category, r.handle, r.layer, r.method) for r in got] == [("chair", "A1", "F", "block_name"), ("desk", "", "", "block_name")]
    assert furniture.detect_furniture(df, "electrical").count() == 0 and furniture.detect_furniture(df).count() == 2
    kinds = spark.createDataFrame([(1, "mechanical")], "drawing_id int, drawing_type string")
    assert furniture.detect_furniture(df, kinds).count() == 0


# files


def dxf(entities, blocks=""):
    return "0\nSECTION\n2\nHEADER\n9\n$ACADVER\n1\nAC1027\n0\nENDSEC\n0\nSECTION\n2\nBLOCKS\n" + blocks + "0\nENDSEC\n0\nSECTION\n2\nENTITIES\n" + entities + "0\nENDSEC\n0\nEOF\n"


def line(layer, x1, y1, x2, y2, handle="A"):
    return f"0\nLINE\n5\n{handle}\n8\n{layer}\n10\n{x1}\n20\n{y1}\n30\n0\n11\n{x2}\n21\n{y2}\n31\n0\n"


ROOM = dxf(
    line("A-WALL", 0, 0, 100, 0) + line("A-WALL", 100, 0, 100, 80) + line("A-WALL", 100, 80, 0, 80) + line("A-WALL", 0, 80, 0, 0)
    + "0\nMTEXT\n8\nA-ROOM-NAME\n10\n50\n20\n40\n40\n0\n1\n{\\H5;HALL}\\P1\n0\nCIRCLE\n8\nA-COL\n10\n20\n20\n20\n40\n2.5\n"
    + "0\nINSERT\n8\nA-FURN\n2\nCHAIR\n10\n60\n20\n60\n41\n2\n0\nPOLYLINE\n8\nX\n0\nVERTEX\n8\nX\n10\n5\n20\n5\n0\nSEQEND\n0\nLINE\n67\n1\n8\nP\n10\n0\n20\n0\n11\n9999\n21\n1\n",
    "0\nBLOCK\n2\nCHAIR\n10\n0\n20\n0\n0\nLINE\n8\n0\n10\n0\n20\n0\n11\n5\n21\n0\n0\nENDBLK\n",
)

MARKDOWN = """# ARCHITECTURAL LAYOUT: room.dxf

## DRAWING INFORMATION
- Extents: 100 x 80 drawing units
- Drawing Type: architectural
- Origin Offset: (-50.0, -40.0)

## ROOMS & BOUNDARIES

### Region [LOOP_001] (4 segments, 8000 sq units)
- Centroid: (0.0, 0.0)
- BBox: (-50.0, -40.0) to (50.0, 40.0)
- Label: "HALL 1" at (0.0, 0.0)
- Symbol: R=2.5 at (-30.0, -20.0)

## ANNOTATIONS

### Layer: A-ROOM-NAME (1 labels)
- "HALL 1" at (0.0, 0.0) [T_001]

## GEOMETRY SUMMARY

### Layer: A-COL
- 0 lines (0 units total), 1 arcs/circles, 0 text
- Dominant direction: None
- BBox: (-32.5, -22.5) to (-27.5, -17.5)

### Layer: A-WALL
- 4 lines (360 units total), 0 arcs/circles, 0 text
- Dominant direction: horizontal
- BBox: (-50.0, -40.0) to (50.0, 40.0)
  * (-50.0,-40.0) to (50.0,-40.0) | H | L=100.0 [L_001]
  * (50.0,-40.0) to (50.0,40.0) | V | L=80.0 [L_002]
  * (50.0,40.0) to (-50.0,40.0) | H | L=100.0 [L_003]
  * (-50.0,40.0) to (-50.0,-40.0) | V | L=80.0 [L_004]

### Layer: A-FURN
- 1 lines (10 units total), 0 arcs/circles, 0 text
- Dominant direction: horizontal
- BBox: (10.0, 20.0) to (20.0, 20.0)
  * (10.0,20.0) to (20.0,20.0) | H | L=10.0 [L_005]

## TOPOLOGY
- Nodes: 6
- Edges: 5
- Closed Loops: 1 (1 large, 0 small)
- Degree Distribution: deg-1: 2, deg-2: 4
"""


def test_a_file_from_end_to_end(spark, tmp_path):
    (tmp_path / "room.dxf").write_text(ROOM)
    a = analyse_path(spark, str(tmp_path / "*.dxf"))
    assert a.markdown().first().markdown == MARKDOWN
    doc = json.loads(json_documents(a).first().json)
    assert doc["metadata"]["transform"] == {
        "type": "translate_to_origin", "offset_x": -50.0, "offset_y": -40.0, "scale_factor": 1.0, "rounding_precision": 1,
        "description": "Coordinates translated to center at (0,0). Rounded to 1 decimal places."
    }
    assert list(doc["layers"]) == ["A-WALL", "A-ROOM-NAME", "A-COL", "A-FURN"] and doc["layers"]["A-COL"]["circles_arcs"][0] == {
        "center": [-30.0, -20.0], "radius": 2.5, "angles": None, "id": "C_001"
    }
    loop = doc["topology"]["loops"][0]
    assert loop["node_ids"][0] == 0 and loop["contained_text"] == [
        {"text": "HALL 1", "position": [0.0, 0.0], "layer": "A-ROOM-NAME"}
    ] and doc["topology"]["nodes"]["degree_distribution"] == {"1": 2, "2": 4} and doc["topology"]["loops_truncated"] is False
    assert doc["semantics"]["anchor_radius_used"] == 50.0 and doc["semantics"]["rooms"][0]["entities"][0]["type"] == "line" and doc["spatial"]["alignment_summary"]["A-WALL"] == {
        "horizontal": 2, "vertical": 2, "diagonal": 0
    }
    write_documents(a)
    assert (tmp_path / "room.md").read_text() == MARKDOWN and json.loads((tmp_path / "room.json").read_text()) == doc


def test_files_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "bad.dxf").write_text("hello\nworld\n")
    (tmp_path / "part.dxf").write_text(dxf(line("L", 0, 0, 10, 10) + line("L", "x", 0, 1, 1)))
    rows = read_dxf(spark, str(tmp_path / "*.dxf"), "PERMISSIVE").collect()
    assert sorted(
        (r.drawing_id.rsplit("/", 1)[1], r.error is None) for r in rows
    ) == [("bad.dxf", False), ("part.dxf", False), ("part.dxf", True)]
    with pytest.raises(Exception, match="DXF"):
        read_dxf(spark, str(tmp_path / "bad.dxf")).collect()
    with pytest.raises(NotDxf):
        list(parse(b"AutoCAD Binary DXF\r\n\x1a\x00"))
    assert decode("0\nSECTION\n9\n$DWGCODEPAGE\n3\nANSI_1252\n1\nü".encode("cp1252")).endswith("ü")
    a = analyse(read_dxf(spark, str(tmp_path / "*.dxf"), "PERMISSIVE"))
    assert a.metadata.count() == 1


def test_data_source(spark, tmp_path):
    (tmp_path / "room.dxf").write_text(ROOM)
    spark.dataSource.register(DxfDataSource)
    got = spark.read.format("dxf").option("path", str(tmp_path / "*.dxf")).load()
    assert got.columns == read_dxf(spark, str(tmp_path / "room.dxf")).columns and got.where("dxftype = 'LINE'").count() == 6


def insert(block, x, y, turn=0, k=1, m=1):
    return f"0\nINSERT\n8\n0\n2\n{block}\n10\n{x}\n20\n{y}\n50\n{turn}\n41\n{k}\n42\n{m}\n"


def block(name, body, x=0, y=0):
    return f"0\nBLOCK\n2\n{name}\n10\n{x}\n20\n{y}\n{body}0\nENDBLK\n"


@pytest.mark.parametrize(
    "entities, blocks, want",
    [
        (insert("A", 10, 20), block("A", line("0", 1, 1, 4, 2), 1, 1), (10, 20, 13, 21)),
        (insert("A", 100, 100, 90), block("A", insert("B", 10, 0, 0, 2, 3)) + block("B", line("0", 0, 0, 5, 4)), (88, 110, 100, 120)),
        (insert("A", 0, 0, 45), block("A", line("0", 0, 0, 10, 0)), (0, 0, 50**0.5, 50**0.5)),
        (
            insert("A", 0, 0, 30, 2, 1), block("A", "0\nCIRCLE\n8\n0\n10\n0\n20\n0\n40\n1\n"),
            (-(13**0.5) / 2, -(7**0.5) / 2, 13**0.5 / 2, 7**0.5 / 2)
        ),
        (insert("A", 0, 0, 90), block("A", "0\nARC\n8\n0\n10\n0\n20\n0\n40\n1\n50\n0\n51\n90\n"), (-1, 0, 0, 1)),
        (
            insert("A", 0, 0) + insert("A", 50, 0) + insert("NONE", 999, 999),
            block("A", insert("B", 1, 0)) + block("B", insert("C", 1, 0)) + block("C", line("0", 0, 0, 1, 1)), (2, 0, 53, 1)
        ),
        (insert("A", 0, 0) + line("0", 0, 0, 1, 1), block("A", insert("A", 1, 0)), (0, 0, 1, 1)),
    ],
)
def test_bounds_of_blocks_in_blocks(spark, tmp_path, entities, blocks, want):
    (tmp_path / "d.dxf").write_text(dxf(entities, blocks))
    r = extraction.bounds(kept(read_dxf(spark, str(tmp_path / "d.dxf"))), kept).first()
    assert (r.min_x, r.min_y, r.max_x, r.max_y) == pytest.approx(want, abs=1e-9)


def as_binary(text, wide=True):
    """The binary form of a file."""
    import struct

    from draftlake.sources.dxf import _FORMS, BINARY

    out, lines = [BINARY], text.splitlines()
    for code, value in zip(map(int, lines[::2]), lines[1::2]):
        out.append(struct.pack("<H", code) if wide else bytes([code]) if code < 255 else b"\xff" + struct.pack("<H", code))
        form = next((f for a, b, f in _FORMS if a <= code <= b), None)
        out.append(struct.pack(form, float(value) if form == "<d" else int(value)) if form else value.encode("cp1252") + b"\0")
    return b"".join(out)


@pytest.mark.parametrize("wide", [True, False])
def test_binary_form(wide):
    head = "0\nSECTION\n2\nHEADER\n9\n$ACADVER\n1\nAC1015\n9\n$DWGCODEPAGE\n3\nANSI_1252\n0\nENDSEC\n"
    plain = head + ROOM.replace("OFFICE", "BÜRO")
    assert list(parse(as_binary(plain, wide))) == list(parse(plain.encode("cp1252")))
    with pytest.raises(NotDxf):
        list(parse(as_binary(plain, wide)[:-30]))


def test_one_drawing_as_a_dictionary(spark, tmp_path):
    import draftlake

    (tmp_path / "room.dxf").write_text(ROOM)
    result, report = draftlake.analyse_file(str(tmp_path / "room.dxf"), spark)
    assert report == MARKDOWN and result["metadata"]["filename"] == "room.dxf"
    (tmp_path / "bad.dxf").write_text("no drawing")
    (tmp_path / "empty.dxf").write_text(dxf(""))
    for name in ("bad.dxf", "empty.dxf", "absent.dxf"):
        with pytest.raises(ValueError):
            draftlake.analyse_file(str(tmp_path / name), spark)


def test_documents_go_to_a_folder(spark, tmp_path):
    from draftlake.plans.documents import place

    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    (tmp_path / "in/room.dxf").write_text(ROOM)
    names = write_documents(analyse_path(spark, str(tmp_path / "in/room.dxf")), folder=f"file://{tmp_path}/out")
    assert [n.rsplit("/", 1)[1] for n in names] == ["room.json", "room.md"] and (tmp_path / "out/room.md").read_text() == MARKDOWN
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["room.json", "room.md"]
    assert place("s3://bucket/a/b.dxf") == ("s3://bucket", "/a/b.dxf") and place("file:/a/b.dxf") == ("", "/a/b.dxf") and place("/a/b") == ("", "/a/b") and place("hdfs:/a/b") == ("hdfs://", "/a/b")


def test_many_drawings_at_once(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"d{k}.dxf").write_text(ROOM if k else dxf(line("0", 0, 0, 100, 0)))
    a = analyse_path(spark, str(tmp_path / "*.dxf"))
    reports = {r.drawing_id.rsplit("/", 1)[1]: r.markdown for r in a.markdown().collect()}
    assert reports["d1.dxf"].replace("d1.dxf", "room.dxf") == MARKDOWN == reports["d2.dxf"].replace("d2.dxf", "room.dxf")
    assert "- Closed Loops: 0 (0 large, 0 small)" in reports["d0.dxf"]


def test_report_limits(spark):
    t = tables(spark, [("0", 10 * i, 0, 10 * i + 5, 0, "horizontal") for i in range(31)], texts=[("N", 0, 0, 'say "x"')])
    norm = extraction.normalisation(
        spark.createDataFrame([(1, 0.0, 0.0, 6000.0, 300.0)], "drawing_id int, min_x double, min_y double, max_x double, max_y double")
    )
    meta = payload.metadata(norm, spark.createDataFrame([(1, "mechanical")], "drawing_id int, drawing_type string"))
    text_ = analyse_tables(t, meta, keep=kept).markdown().first().markdown
    assert "  * ... and 1 more" in text_ and '- "say "x"" at (0.0, 0.0) [T_001]' in text_ and "# MECHANICAL DRAWING: 1" in text_
    generic = payload.metadata(norm, spark.createDataFrame([(1, "generic")], "drawing_id int, drawing_type string"))
    assert "- Line directions: horizontal: 31" in analyse_tables(t, generic, keep=kept).markdown().first().markdown
    areas = spark.createDataFrame([(1, k, float(1000 if k == 1 else 5)) for k in range(1, 30)], "drawing_id int, loop_ord int, area double")
    some = payload.small_shapes(payload.size_classes(areas)).collect()
    assert len(some) == 20 and some[0].total == 28
    assert math.isclose(sum(r.area for r in some), 100.0)


def test_stream(spark, tmp_path):
    from draftlake.schemas import ENTITIES
    from draftlake.streaming.watch import watch

    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "room.dxf").write_text(ROOM)
    read_dxf(spark, str(tmp_path / "files/*.dxf")).write.parquet(str(tmp_path / "in/a"))
    seen = []
    q = watch(spark, str(tmp_path / "in/*"), ENTITIES, str(tmp_path / "check"), lambda a, n: seen.append(a.statistics.count()))
    assert q.awaitTermination(300), "the stream is still at its first batch"
    assert sum(seen) == 4


def test_documents_take_nulls(spark):
    t = tables(spark, [("0", 0, 0, 5, 0, None)])
    norm = extraction.normalisation(
        spark.createDataFrame([(1, 0.0, 0.0, 84100.0, 59400.0)], "drawing_id int, min_x double, min_y double, max_x double, max_y double")
    )
    a = analyse_tables(t, payload.metadata(norm, extraction.drawing_types(t)), keep=kept)
    row = nested(a).first().asDict()
    d = document(row)
    assert d["metadata"]["transform"]["scale_factor"] == 100 and d["metadata"]["paper_info"]["paper_size"] == "A1" and d["topology"]["loops"] == [] and "rooms" not in d["semantics"]


def test_sql_functions(spark):
    from draftlake.functions.register import register

    assert "furniture_category" in register(spark)
    row = spark.sql(
        "SELECT furniture_category('sofa-3seat') a, furniture_category('A$Cchair') b, layer_discipline('m_duct') c, "
        "round_exact2(2.675D) d, round_exact1(0.25D) e, is_room_layer('x-Anno') f, segment_alignment(0, 0, 5, 0, 0.1) g"
    ).first()
    assert tuple(row) == ("sofa", None, "mechanical", 2.67, 0.2, True, "horizontal")
