"""Drawings made from the sales tables by integer arithmetic, so that any engine makes the same ones.

The SQL texts here run in Spark and in DuckDB alike. ``FLAT`` is a collection of 97 drawings with all kinds of entities, a row
each; ``SEGMENTS``, ``CIRCLES`` and ``TEXTS`` are tables of pass 1 on a grid of tens; ``LATTICE`` are small lattices for loops.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.extraction import Layers
from ..plans.store import kept

DRAWINGS = 97
SALES = "lineitem|orders|customer|part|supplier|nation|region"
_D = "CAST('{}' AS DOUBLE)".format
_LAYER = (
    "CASE ({0}) % 7 WHEN 0 THEN 'A-WALL' WHEN 1 THEN 'E-WIRE' WHEN 2 THEN 'S-BEAM' WHEN 3 THEN 'M_DUCT' WHEN 4 THEN 'A-ANNO-TEXT' WHEN "
    "5 THEN 'ELEC-PANEL' ELSE '0' END"
).format
#: Units of a drawing's coordinates: some are too large and get scaled.
_UNIT = f"CASE d % 3 WHEN 0 THEN {_D(1)} WHEN 1 THEN {_D(20)} ELSE {_D(150)} END"


def _part(
    src: int, table: str, kind: str, key: str, keys: str, layer: str, npts: str, xy: list[str], radius="NULL", a1="NULL", a2="NULL",
    text="NULL", block_name="NULL", xscale="NULL", where="1 = 1"
) -> str:
    xy = xy + ["NULL"] * (8 - len(xy))
    num = lambda v, n: f"CAST({v} AS DOUBLE) AS {n}"
    names = [f"{c}{i}" for i in range(1, 5) for c in "xy"]
    return (
        f"SELECT ({key}) % {DRAWINGS} AS d, {src} AS src, {keys}, {kind} AS dxftype, {layer} AS layer, {npts} AS npts, "
        f"{', '.join(num(v, n) for v, n in zip(xy, names))}, "
        f"{num(radius, 'radius')}, {num(a1, 'a1')}, {num(a2, 'a2')}, CAST({text} AS VARCHAR(99)) AS text, CAST({block_name} AS "
        f"VARCHAR(99)) AS block_name, {num(xscale, 'xscale')} FROM {table} WHERE {where}"
    )


def _one(key: str) -> str:
    return f"{key} AS k1, 0 AS k2, 0 AS k3, 0 AS k4, {_D(0)} AS k5"


_PX, _PY = f"(10 * (l_partkey % 50) + {_D(0.25)} * (l_suppkey % 4))", f"(10 * (l_suppkey % 40) + {_D(0.25)} * (l_partkey % 4))"
_DX = "CASE l_linenumber % 4 WHEN 1 THEN 10 * (1 + l_orderkey % 5) WHEN 3 THEN 10 * (1 + l_orderkey % 3) ELSE 0 END"
_DY = "CASE l_linenumber % 4 WHEN 2 THEN 10 * (1 + l_orderkey % 5) WHEN 3 THEN l_orderkey % 2 + 10 * (l_partkey % 2) ELSE 0 END"
_CX, _CY = f"(40 + 10 * (o_custkey % 31) + {_D(0.05)} * (o_orderkey % 3))", "(40 + 10 * (o_orderkey % 21))"
_TX, _TY = f"(20 + 7 * (c_custkey % 60) + {_D(0.15)})", "(20 + 5 * (c_nationkey % 60))"
_PARTS = [
    _part(
        1, "lineitem", "'LINE'", "l_orderkey", "l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4, l_quantity AS k5",
        _LAYER("l_orderkey + l_linenumber"), "2", [_PX, _PY, f"{_PX} + {_DX}", f"{_PY} + {_DY}"]
    ),
    _part(
        2, "orders", "CASE WHEN o_orderkey % 3 = 0 THEN 'ARC' ELSE 'CIRCLE' END", "o_orderkey", _one("o_orderkey"), _LAYER("o_custkey"),
        "1", [_CX, _CY], radius=f"1 + (o_custkey % 9) + {_D(0.35)}",
        a1=f"CASE WHEN o_orderkey % 3 = 0 THEN (o_custkey % 360) + {_D(0.25)} END",
        a2="CASE WHEN o_orderkey % 3 = 0 THEN (o_custkey * 7) % 360 END"
    ),
    _part(
        3, "customer", "CASE WHEN c_custkey % 4 = 0 THEN 'MTEXT' ELSE 'TEXT' END", "c_custkey", _one("c_custkey"),
        "CASE WHEN c_nationkey % 2 = 0 THEN 'A-ROOM-NAME' ELSE 'E-NOTES' END", "1", [_TX, _TY],
        text="CASE WHEN c_custkey % 4 = 0 THEN concat('{', chr(92), 'H2.5;', c_mktsegment, chr(92), 'P', c_name, '} ') ELSE concat('  "
            "', c_name, ' ') END"
    ),
    _part(
        4, "part", "'LWPOLYLINE'", "p_partkey", _one("p_partkey"), _LAYER("p_size + 2"), "p_size % 5",
        [
            "10 * (p_partkey % 37) + 5", "10 * (p_size % 23) + 5", "10 * (p_partkey % 37) + 45", "10 * (p_size % 23) + 5",
            "10 * (p_partkey % 37) + 45", "10 * (p_size % 23) + 35", "10 * (p_partkey % 37) + 46", "10 * (p_size % 23) + 90"
        ]
    ),
    _part(
        5, "supplier", "'SOLID'", "s_suppkey", _one("s_suppkey"), _LAYER("s_nationkey"), "3 + s_suppkey % 2",
        [
            "10 * (s_suppkey % 31)", "10 * (s_nationkey % 31)", "10 * (s_suppkey % 31) + 20", "10 * (s_nationkey % 31)",
            "10 * (s_suppkey % 31) + 20 * (s_suppkey % 3)", "10 * (s_nationkey % 31) + 10 * (s_suppkey % 3)", "10 * (s_suppkey % 31)",
            "10 * (s_nationkey % 31) + 10"
        ]
    ),
    _part(
        6, "supplier", "'INSERT'", "s_suppkey * 3", _one("s_suppkey"), _LAYER("s_suppkey + 1"), "1",
        ["100 + 10 * (s_suppkey % 17)", "100 + 10 * (s_nationkey % 13)"], block_name="concat('B', s_suppkey % 6)",
        xscale="CASE s_suppkey % 4 WHEN 0 THEN 2 WHEN 1 THEN -1 WHEN 2 THEN 1 END"
    ),
    _part(7, "nation", "'HATCH'", "n_nationkey", _one("n_nationkey"), "'A-PATTERN'", "1", ["200", "200"]),
]
_FACTOR = ", ".join(f"{c}{i} * unit AS {c}{i}" for i in range(1, 5) for c in "xy")
#: Model space of all drawings.
FLAT = (
    "SELECT d AS drawing_id, row_number() OVER (PARTITION BY d ORDER BY src, k1, k2, k3, k4, k5) AS seq, dxftype, layer, npts, "
    f"{_FACTOR}, radius * unit AS radius, a1, a2, text, block_name, xscale "
    f"FROM (SELECT *, {_UNIT} AS unit FROM ({' UNION ALL '.join(_PARTS)}) p) u"
)
#: Members of the blocks B0 to B4, of each drawing: a line, a circle or arc, a text; B5 doesn't exist.
MEMBERS = (
    "SELECT dr.d AS drawing_id, concat('B', r_regionkey) AS block, i AS seq, CASE i WHEN 1 THEN 'LINE' WHEN 2 THEN CASE WHEN "
    "r_regionkey % 2 = 0 THEN 'CIRCLE' ELSE 'ARC' END WHEN 3 THEN 'TEXT' ELSE 'SOLID' END AS dxftype, "
    f"CASE WHEN i = 1 THEN 2 ELSE 1 END AS npts, {_D(1)} * r_regionkey AS x1, {_D(2)} AS y1, {_D(3)} + r_regionkey + i AS x2, "
    f"{_D(2.25)} + r_regionkey AS y2, {_D(1.5)} + r_regionkey AS radius, "
    f"CASE WHEN i = 2 AND r_regionkey % 2 = 1 THEN {_D(10.25)} END AS a1, CASE WHEN i = 2 AND r_regionkey % 2 = 1 THEN {_D(200)} "
    "END AS a2, CASE WHEN i = 3 THEN r_name END AS text "
    "FROM region CROSS JOIN (SELECT 1 AS i UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) n CROSS JOIN (SELECT DISTINCT "
    f"l_orderkey % {DRAWINGS} AS d FROM lineitem) dr"
)

_G = (
    "l_orderkey % 97 AS drawing_id, row_number() OVER (PARTITION BY l_orderkey % 97 ORDER BY l_orderkey, l_linenumber, l_partkey, "
    "l_suppkey, l_quantity) AS seq"
)
_SX, _SY = "10 * (l_partkey % 50)", "10 * (l_suppkey % 40)"
_EX, _EY = f"{_SX} + CASE l_linenumber % 3 WHEN 1 THEN 0 ELSE 10 * (1 + l_orderkey % 5) END", f"{_SY} + CASE l_linenumber % 3 WHEN 0 THEN 0 ELSE 10 * (1 + l_partkey % 4) END"
_RAW_SEGMENTS = (
    f"SELECT {_G}, {_LAYER('l_orderkey + l_linenumber')} AS layer, CAST({_SX} AS DOUBLE) AS sx, CAST({_SY} AS DOUBLE) AS sy, "
    f"CAST({_EX} AS DOUBLE) AS ex, CAST({_EY} AS DOUBLE) AS ey, "
    "CASE l_linenumber % 3 WHEN 0 THEN 'horizontal' WHEN 1 THEN 'vertical' ELSE 'diagonal' END AS alignment, CAST(NULL AS "
    "VARCHAR(9)) AS handle FROM lineitem"
)
_RAW_CIRCLES = (
    f"SELECT o_orderkey % 97 AS drawing_id, 1000000000 + o_orderkey AS seq, {_LAYER('o_custkey + 3')} AS layer, CAST(10 * (o_custkey % "
    "53) + 3 AS DOUBLE) AS cx, CAST(10 * (o_orderkey % 41) + 4 AS DOUBLE) AS cy, CAST(1 + o_custkey % 9 AS DOUBLE) AS radius, CASE "
    "WHEN o_orderkey % 5 = 0 THEN concat('H', o_orderkey) END AS handle FROM orders"
)
_RAW_TEXTS = (
    "SELECT c_custkey % 97 AS drawing_id, 2000000000 + c_custkey AS seq, CASE c_nationkey % 3 WHEN 0 THEN 'A-ROOM-NAME' WHEN 1 THEN "
    "'NOTES' ELSE 'e-Label' END AS layer, CAST(10 * (c_custkey % 59) + 2 AS DOUBLE) AS tx, CAST(10 * (c_nationkey % 25) * CASE WHEN "
    "c_custkey % 50 = 0 THEN 90 ELSE 1 END + 6 AS DOUBLE) AS ty, concat(c_mktsegment, ' ', c_custkey) AS text, CAST(NULL AS "
    "VARCHAR(9)) AS handle FROM customer"
)
LAYERS = (
    "SELECT drawing_id, layer, CAST(row_number() OVER (PARTITION BY drawing_id ORDER BY first_seq, layer) AS INT) AS layer_ord "
    "FROM (SELECT drawing_id, layer, min(seq) AS first_seq FROM ("
    f"SELECT drawing_id, layer, seq FROM ({_RAW_SEGMENTS}) a UNION ALL SELECT drawing_id, layer, seq FROM ({_RAW_CIRCLES}) b UNION "
    f"ALL SELECT drawing_id, layer, seq FROM ({_RAW_TEXTS}) c) u GROUP BY drawing_id, layer) g"
)


def _table(raw: str, name: str, layers: str = f"({LAYERS})") -> str:
    return (
        f"SELECT r.*, l.layer_ord, CAST(row_number() OVER (PARTITION BY r.drawing_id, r.layer ORDER BY r.seq) AS INT) AS {name}_ord "
        f"FROM ({raw}) r JOIN {layers} l ON l.drawing_id = r.drawing_id AND l.layer = r.layer"
    )


SEGMENTS, CIRCLES, TEXTS = _table(_RAW_SEGMENTS, "line"), _table(_RAW_CIRCLES, "circle"), _table(_RAW_TEXTS, "text")
#: Sides of the squares of a 2 x 2 or 1 x 3 lattice of each nation, 10 to 40 long, with diagonals and doubled sides in some; in a plan of its own each.
_CELL = (
    "(SELECT n_nationkey AS n, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 3 END AS w, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END "
    "AS h, 10 + n_nationkey % 4 * 10 AS s FROM nation) c"
)
_INTS = "(SELECT 0 AS {0} UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) tab_{0}".format
LATTICE = (
    "SELECT drawing_id, CASE WHEN k = 0 THEN 'A-WALL' ELSE 'E-WIRE' END AS layer, CAST(k + 1 AS INT) AS layer_ord, "
    "CAST(row_number() OVER (PARTITION BY drawing_id, k ORDER BY i, j) AS INT) AS line_ord, "
    "CAST(i * s AS DOUBLE) AS sx, CAST(j * s AS DOUBLE) AS sy, CAST((i + a) * s AS DOUBLE) AS ex, CAST((j + b) * s AS DOUBLE) AS "
    "ey, CASE WHEN a = 1 AND b = 1 THEN 'diagonal' WHEN a = 1 THEN 'horizontal' ELSE 'vertical' END AS alignment FROM ("
    f"SELECT n AS drawing_id, 0 AS k, i, j, 1 AS a, 0 AS b, s FROM {_CELL} CROSS JOIN {_INTS('i')} CROSS JOIN {_INTS('j')} WHERE i "
    "< w AND j <= h "
    f"UNION ALL SELECT n, 1, i, j, 0, 1, s FROM {_CELL} CROSS JOIN {_INTS('i')} CROSS JOIN {_INTS('j')} WHERE i <= w AND j < h "
    f"UNION ALL SELECT n, 2, i, j, 1, 1, s FROM {_CELL} CROSS JOIN {_INTS('i')} CROSS JOIN {_INTS('j')} WHERE i = 0 AND j = 0 AND n "
    "% 5 = 1) u"
)
_SIX = "(SELECT 0 AS {0} UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) six_{0}".format
_ROOM = "310 + 60 * (i % 6) - CASE WHEN i = 0 THEN 310 ELSE 0 END"
#: Rectangles of each nation that touch none other: a large one, some of middle size, and small ones, up to 36.
RECTANGLES = (
    "SELECT n_nationkey AS drawing_id, i, CASE n_nationkey % 4 WHEN 0 THEN 'A-WALL' WHEN 1 THEN 'E-WIRE' WHEN 2 THEN 'M-DUCT' ELSE "
    "'0' END AS layer, "
    f"{_ROOM} AS x, 10 * (i - i % 6) AS y, CASE WHEN i = 0 THEN 300 WHEN i % 3 = 1 THEN 40 ELSE 10 + i % 5 END AS w, CASE WHEN i = "
    "0 THEN 200 WHEN i % 3 = 1 THEN 30 ELSE 10 + n_nationkey % 3 END AS h "
    f"FROM (SELECT n_nationkey, 6 * a + b AS i FROM nation CROSS JOIN {_SIX('a')} CROSS JOIN {_SIX('b')}) c WHERE i < CASE "
    "n_nationkey % 3 WHEN 0 THEN 36 WHEN 1 THEN 4 ELSE 9 END"
)
#: Their sides, as segments of one layer each.
SIDES = (
    "SELECT drawing_id, layer, CAST(1 AS INT) AS layer_ord, CAST(4 * i + e + 1 AS INT) AS line_ord, CAST(CASE WHEN e IN (1, 2) "
    "THEN x + w ELSE x END AS DOUBLE) AS sx, CAST(CASE WHEN e IN (2, 3) THEN y + h ELSE y END AS DOUBLE) AS sy, "
    "CAST(CASE WHEN e IN (0, 1) THEN x + w ELSE x END AS DOUBLE) AS ex, CAST(CASE WHEN e IN (1, 2) THEN y + h ELSE y END AS "
    "DOUBLE) AS ey, CASE WHEN e % 2 = 0 THEN 'horizontal' ELSE 'vertical' END AS alignment "
    f"FROM ({RECTANGLES}) r CROSS JOIN {_INTS('e')}"
)
#: ``SEGMENTS`` with ends moved by up to (0.6, 0.2): up to three different points lie around each point of the grid.
JITTERED = (
    "SELECT drawing_id, layer, layer_ord, line_ord, sx + k * CAST('0.3' AS DOUBLE) AS sx, sy + k * CAST('0.1' AS DOUBLE) AS sy, ex "
    "+ j * CAST('0.3' AS DOUBLE) AS ex, ey + j * CAST('0.1' AS DOUBLE) AS ey, sx AS gx, sy AS gy, ex AS hx, ey AS hy "
    f"FROM (SELECT s.*, (layer_ord + line_ord) % 3 AS k, (layer_ord + 2 * line_ord) % 2 + line_ord % 2 AS j FROM ({SEGMENTS}) s) q"
)
#: The extents that these drawings are said to have: on paper as it is, on paper of another scale, on none.
EXTENTS = (
    f"SELECT n_nationkey AS drawing_id, {_D(0)} AS min_x, {_D(0)} AS min_y, CAST(CASE n_nationkey % 3 WHEN 0 THEN 420 WHEN 1 THEN 8410 "
    "ELSE 100000 END AS DOUBLE) AS max_x, CAST(CASE n_nationkey % 3 WHEN 0 THEN 297 WHEN 1 THEN 5940 ELSE 1001 END AS DOUBLE) AS max_y "
    "FROM nation"
)
_NAMES = "CHAIR-OFFICE,DESK-L,TABLE-ROUND,SOFA-3SEAT,BED-QUEEN,WC-01,WATER CLOSET,*U12,A$C27,CUSTOM,fridge-2,rack,HVAC-1,Bathtub,door".split(",")
INSTANCES = (
    f"SELECT p_partkey % {DRAWINGS} AS drawing_id, CASE p_partkey % {len(_NAMES) + 1} " + " ".join(
        f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)
    ) + " END AS block_name, "
    "concat('P', p_partkey) AS handle, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'A-FURN' END AS layer, CAST(p_size AS DOUBLE) AS "
    "ix, CAST(p_partkey AS DOUBLE) AS iy, CAST(p_size * 40 AS DOUBLE) AS w, CAST(200 + p_partkey % 13 * 100 AS DOUBLE) AS h FROM "
    "part"
)


def tables_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over the sales tables of a folder."""
    return spark.sql(re.sub(rf"\bFROM ({SALES})\b", lambda m: f"FROM parquet.`{sf_dir}/{m.group(1)}.parquet`", sql))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``FLAT`` and ``MEMBERS`` in the form of the entity table, made once."""
    flat = tables_sql(spark, sf_dir, FLAT)
    pts = F.slice(
        F.array(*(F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in range(1, 5))), F.lit(1), F.col("npts").cast("int")
    )
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    tail = [
        none("string", "error"), F.lit(0).alias("paperspace"), none("array<double>", "bulges"), F.lit(False).alias("closed"),
        F.lit(0.0).alias("height"), none("double", "yscale"), none("double", "rotation"), none("double", "block_x"),
        none("double", "block_y")
    ]
    cols = [
        "drawing_id", "seq", "dxftype", "layer", pts.alias("pts"), "radius", F.col("a1").alias("start_angle"),
        F.col("a2").alias("end_angle"), "text"
    ]
    model = flat.select(*cols, "block_name", "xscale", none("string", "block"), none("string", "handle"), *tail)
    members = tables_sql(spark, sf_dir, MEMBERS)
    inner_pts = F.slice(
        F.array(*(F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in (1, 2))), F.lit(1), F.col("npts").cast("int")
    )
    inner = members.withColumn("layer", F.lit("0")).select(
        "drawing_id", F.col("seq").cast("bigint").alias("seq"), "dxftype", "layer", inner_pts.alias("pts"), "radius",
        F.col("a1").alias("start_angle"), F.col("a2").alias("end_angle"), "text", none("string", "block_name"), none("double", "xscale"),
        "block", none("string", "handle"), *tail
    )
    return kept(model.unionByName(inner))


_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
#: ``_RAW_SEGMENTS`` with what they are ordered by in place of their number in the drawing.
_KEYED_SEGMENTS = _RAW_SEGMENTS.replace(_G, "l_orderkey % 97 AS drawing_id, " + ", ".join(f"{k} AS s{i}" for i, k in enumerate(_KEYS)))


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``LAYERS`` without numbering all segments of a drawing.

    Segments come before circles and texts, whose numbers start at 10^9, and the first of a layer is that of the least order
    and line, of which each pair has one layer: so hash aggregates over numbers tell the order.
    """
    order = F.col("s0").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.col("s1")
    rows = tables_sql(spark, sf_dir, _KEYED_SEGMENTS).select(
        "drawing_id", "layer", F.lit(0).alias("k"), order.cast("decimal(38,0)").alias("at")
    )
    for raw in (_RAW_CIRCLES, _RAW_TEXTS):
        rows = rows.unionByName(
            tables_sql(spark, sf_dir, raw).select("drawing_id", "layer", F.lit(1).alias("k"), F.col("seq").cast("decimal(38,0)").alias("at"))
        )
    first = rows.groupBy("drawing_id", "layer", "k").agg(F.min("at").alias("at")).groupBy("drawing_id", "layer").agg(
        F.min(F.struct("k", "at")).alias("at")
    )
    return first.select(
        "drawing_id", "layer", F.row_number().over(Window.partitionBy("drawing_id").orderBy("at", "layer")).alias("layer_ord")
    )


def _segments(view: str) -> str:
    """``SEGMENTS``, but for seq: lines are numbered within their layers by what seq is ordered by."""
    order = ", ".join(f"r.s{i}" for i in range(len(_KEYS)))
    return _table(_KEYED_SEGMENTS, "line", view).replace("ORDER BY r.seq", f"ORDER BY {order}")


def tables(spark: SparkSession, sf_dir: str) -> Layers:
    """The tables of pass 1; the layers, which all of them are joined with, are made once."""
    none, view = F.lit(None).cast("string"), "draftlake_fixture_layers"
    named = kept(layers(spark, sf_dir))
    named.createOrReplaceTempView(view)
    s = tables_sql(spark, sf_dir, _segments(view)).drop(*(f"s{i}" for i in range(len(_KEYS))))
    c, t = (
        tables_sql(spark, sf_dir, _table(raw, name, view)).drop("seq") for raw, name in ((_RAW_CIRCLES, "circle"), (_RAW_TEXTS, "text"))
    )
    s, c, t = (df.withColumn("id", none) for df in (s, c, t))
    return Layers(named, s.withColumn("rounding", F.lit(1)), c.withColumn("angles", F.lit(None).cast("array<double>")), t)


def jittered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``JITTERED`` over the segments of ``tables``."""
    view = "draftlake_fixture_segments"
    tables(spark, sf_dir).segments.createOrReplaceTempView(view)
    return tables_sql(spark, sf_dir, JITTERED.replace(f"({SEGMENTS})", view))


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables_sql(spark, sf_dir, LATTICE)


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables_sql(spark, sf_dir, INSTANCES).withColumn("insertion_point", F.array("ix", "iy"))
