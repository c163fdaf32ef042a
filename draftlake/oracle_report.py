"""The Markdown report of a drawing as one SQL query for DuckDB, line by line."""

from __future__ import annotations

from .functions.rounding import sql_round
from .operators.payload import SHOWN_LINES, SHOWN_SHAPES, TITLES

_WHOLE = "CAST(CAST(round_even({0}, 0) AS BIGINT) AS VARCHAR)".format
_SHORT = "CAST({0} AS VARCHAR)".format
_TITLE = "CASE drawing_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TITLES.items()) + " ELSE 'CAD DRAWING' END"
_METRIC = "drawing_type = 'architectural' AND paper_scale > 1"
_AREA = f"CASE WHEN {_METRIC} THEN concat('~', printf('%.1f', {sql_round('m2', 1)}), ' m2') ELSE concat({_WHOLE('area')}, ' sq units') END"
_BRIEF = f"(drawing_type IN ('electrical', 'generic') AND line_count > {SHOWN_LINES})"


def _c(x: str) -> str:
    return f"CASE WHEN rounding = 0 THEN {_WHOLE(x)} ELSE {_SHORT(x)} END"


def _xy(x: str, y: str) -> str:
    return f"concat('(', {_c(x)}, ', ', {_c(y)}, ')')"


def _pt(x: str, y: str) -> str:
    return f"concat('(', {_SHORT(x)}, ', ', {_SHORT(y)}, ')')"


def _lines(source: str, section: int, *lines: tuple[str, str], where: str = "true") -> str:
    """Selects of (drawing_id, section, k0 .. k3, line), one for each (keys, line)."""
    out = []
    for keys, line in lines:
        k = [x.strip() for x in keys.split(",")] + ["0"] * (4 - len(keys.split(",")))
        out.append(
            f"SELECT drawing_id, {section} AS section, {', '.join(f'CAST({x} AS BIGINT) AS k{i}' for i, x in enumerate(k))}, {line} "
            f"AS line FROM {source} WHERE {where}"
        )
    return " UNION ALL ".join(out)


_HEAD = [
    ("0", f"concat('# ', {_TITLE}, ': ', filename)"), ("1", "''"), ("2", "'## DRAWING INFORMATION'"),
    ("3", f"concat('- Extents: ', {_WHOLE('width')}, ' x ', {_WHOLE('height')}, ' drawing units')"),
    ("4", "CASE WHEN paper_size IS NOT NULL THEN concat('- Paper Size: ', paper_size, ' (landscape)') END"),
    ("5", "CASE WHEN paper_size IS NOT NULL THEN concat('- Scale: 1:', paper_scale) END"),
    ("6", "CASE WHEN paper_size IS NOT NULL THEN concat('- Real-world extent: ', expected_w, 'mm x ', expected_h, 'mm on paper') END"),
    ("7", "concat('- Drawing Type: ', drawing_type)"),
    (
        "8",
        f"CASE WHEN scale_factor > 1 THEN concat('- Scale Applied: /', {_WHOLE('scale_factor')}, ' (coordinates in paper-space mm)') END"
    ),
    ("9", f"concat('- Origin Offset: ', {_pt('offset_x', 'offset_y')})"), ("10", "''"),
]
_REGIONS = [
    ("2, loop_ord, 0", f"concat('### Region [', id, '] (', num_segments, ' segments, ', {_AREA}, ')')"),
    ("2, loop_ord, 1", f"concat('- Centroid: ', {_pt('cx', 'cy')})"),
    ("2, loop_ord, 2", f"concat('- BBox: ', {_pt('min_x', 'min_y')}, ' to ', {_pt('max_x', 'max_y')})"), ("2, loop_ord, 5", "''"),
]
_SPREAD = (
    "array_to_string(list_filter([CASE WHEN g > 0 THEN concat('diagonal: ', g) END, CASE WHEN h > 0 THEN concat('horizontal: ', h) "
    "END, CASE WHEN v > 0 THEN concat('vertical: ', v) END], lambda x: x IS NOT NULL), ', ')"
)
_GEOMETRY = [
    ("2, report_ord, 0", "concat('### Layer: ', layer)"),
    (
        "2, report_ord, 1",
        f"concat('- ', line_count, ' lines (', {_WHOLE('total')}, ' units total), ', circle_arc_count, ' arcs/circles, ', "
        "text_count, ' text')"
    ),
    ("2, report_ord, 2", "concat('- Dominant direction: ', coalesce(dominant, 'None'))"),
    (
        "2, report_ord, 3",
        f"CASE WHEN min_x IS NOT NULL THEN concat('- BBox: ', {_xy('min_x', 'min_y')}, ' to ', {_xy('max_x', 'max_y')}) END"
    ),
    ("2, report_ord, 4", f"CASE WHEN {_BRIEF} THEN concat('- Line directions: ', {_SPREAD}) END"),
    (
        "2, report_ord, 6",
        f"CASE WHEN NOT {_BRIEF} AND line_count > {SHOWN_LINES} THEN concat('  * ... and ', line_count - {SHOWN_LINES}, ' more') END"
    ),
    ("2, report_ord, 7", "''"),
]
_SEGMENT = (
    f"concat('  * (', {_c('sx')}, ',', {_c('sy')}, ') to (', {_c('ex')}, ',', {_c('ey')}, ') | ', upper(alignment[1]), ' | L=', "
    f"{_SHORT('length')}, ' [', id, ']')"
)

#: Tables that the report is made of: meta, segments, circles and texts with ids, loops, layer statistics ``stats``, boxes, graph.
REPORT = {
    "regions": "SELECT l.*, m.drawing_type, m.paper_scale, m.rounding, area * (paper_scale * paper_scale) / 1000000 AS m2, concat('LOOP_', "
        "lpad(CAST(loop_ord AS VARCHAR), 3, '0')) AS id FROM loops l JOIN meta m USING (drawing_id)",
    "labels": "SELECT *, row_number() OVER (PARTITION BY drawing_id, loop_ord ORDER BY layer_ord, text_ord) AS i FROM (SELECT r.drawing_id, "
        "r.loop_ord, r.rounding, t.layer_ord, t.text_ord, t.text, t.tx, t.ty FROM regions r JOIN texts t ON t.drawing_id = "
        "r.drawing_id AND t.tx >= r.min_x AND t.tx < r.max_x AND t.ty >= r.min_y AND t.ty < r.max_y WHERE large) q",
    "symbols": "SELECT *, row_number() OVER (PARTITION BY drawing_id, loop_ord ORDER BY layer_ord, circle_ord) AS i FROM (SELECT "
        "r.drawing_id, r.loop_ord, r.rounding, c.layer_ord, c.circle_ord, c.radius, c.cx, c.cy FROM regions r JOIN circles c ON "
        "c.drawing_id = r.drawing_id AND c.cx >= r.min_x AND c.cx < r.max_x AND c.cy >= r.min_y AND c.cy < r.max_y WHERE large) q",
    "smalls": "SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY loop_ord) AS k FROM regions WHERE NOT large",
    "named": f"SELECT s.*, m.drawing_type, m.rounding, b.min_x, b.min_y, b.max_x, b.max_y, {sql_round('s.len', 2)} AS total, CASE WHEN h + v "
        "+ g = 0 THEN NULL WHEN h >= v AND h >= g THEN 'horizontal' WHEN v >= g THEN 'vertical' ELSE 'diagonal' END AS dominant, "
        "row_number() OVER (PARTITION BY s.drawing_id ORDER BY CASE WHEN line_count = 0 THEN 0 ELSE 1 END, text_count DESC, "
        "s.layer_ord) AS report_ord FROM stats s JOIN meta m USING (drawing_id) LEFT JOIN boxes b ON b.drawing_id = s.drawing_id AND "
        "b.layer = s.layer",
    "noted": "SELECT t.*, n.report_ord, n.rounding FROM texts t JOIN named n ON n.drawing_id = t.drawing_id AND n.layer = t.layer",
    "drawn": f"SELECT s.*, n.report_ord, n.rounding, {sql_round('s.len', 1)} AS length FROM (SELECT *, sqrt((sx - ex) * (sx - ex) + (sy - "
        "ey) * (sy - ey)) AS len FROM segments) s JOIN named n ON n.drawing_id = s.drawing_id AND n.layer = s.layer WHERE line_ord <= "
        f"{SHOWN_LINES} AND NOT {_BRIEF}",
    "sums": "SELECT m.drawing_id, m.drawing_type, t.nodes, t.edges, t.degrees, l.loops, l.big, l.loops - l.big AS small FROM meta m JOIN "
        "graph t USING (drawing_id) JOIN (SELECT drawing_id, count(*) AS loops, count(*) FILTER (WHERE large) AS big FROM loops GROUP "
        "BY drawing_id) l USING (drawing_id)",
    "report": " UNION ALL ".join(
        [
            _lines("meta", 0, *_HEAD),
            _lines(
                "sums", 1, ("0", "CASE WHEN drawing_type = 'electrical' THEN '## ENCLOSURES & PANELS' ELSE '## ROOMS & BOUNDARIES' END"),
                ("1", "''"), where="big > 0"
            ),
            _lines("regions", 1, *_REGIONS, where="large"),
            _lines("labels", 1, ("2, loop_ord, 3, i", f"concat('- Label: \"', text, '\" at ', {_xy('tx', 'ty')})")),
            _lines("symbols", 1, ("2, loop_ord, 4, i", f"concat('- Symbol: R=', {_c('radius')}, ' at ', {_xy('cx', 'cy')})")),
            _lines(
                "sums", 2, ("0", "CASE WHEN drawing_type = 'electrical' THEN '## DEVICE SYMBOLS' ELSE '## SMALL CLOSED SHAPES' END"),
                (
                    "1",
                    "CASE WHEN drawing_type = 'electrical' THEN concat('(', small, ' small closed shapes detected — likely device "
                    "outlines)') ELSE concat('(', small, ' detected)') END"
                ),
                ("2", "''"), ("4", f"CASE WHEN small > {SHOWN_SHAPES} THEN concat('- ... and ', small - {SHOWN_SHAPES}, ' more') END"),
                ("5", "''"), where="small > 0"
            ),
            _lines(
                "smalls", 2, ("3, k", f"concat('- [', id, '] at ', {_pt('cx', 'cy')}, ', ', num_segments, ' sides')"),
                where=f"k <= {SHOWN_SHAPES}"
            ),
            _lines("meta", 3, ("0", "'## ANNOTATIONS'"), ("1", "''")),
            _lines(
                "named", 3, ("2, report_ord, 0", "concat('### Layer: ', layer, ' (', text_count, ' labels)')"), ("2, report_ord, 2", "''"),
                where="text_count > 0"
            ),
            _lines("noted", 3, ("2, report_ord, 1, text_ord", f"concat('- \"', text, '\" at ', {_xy('tx', 'ty')}, ' [', id, ']')")),
            _lines("meta", 4, ("0", "'## GEOMETRY SUMMARY'"), ("1", "''")),
            _lines("named", 4, *_GEOMETRY, where="line_count > 0 OR circle_arc_count > 0"),
            _lines("drawn", 4, ("2, report_ord, 5, line_ord", _SEGMENT)),
            _lines(
                "sums", 5, ("0", "'## TOPOLOGY'"), ("1", "concat('- Nodes: ', nodes)"), ("2", "concat('- Edges: ', edges)"),
                ("3", "concat('- Closed Loops: ', loops, ' (', big, ' large, ', small, ' small)')"),
                ("4", "concat('- Degree Distribution: ', degrees)"), ("5", "''")
            ),
        ]
    ),
}
MARKDOWN = (
    "SELECT drawing_id, string_agg(line, chr(10) ORDER BY section, k0, k1, k2, k3) AS markdown FROM report WHERE line IS NOT NULL "
    "GROUP BY drawing_id"
)
