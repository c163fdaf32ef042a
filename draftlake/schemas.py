"""Schemas of the tables that operators take and return. Every table is keyed by ``drawing_id``."""

from __future__ import annotations

POINT = "struct<x:double,y:double>"

#: What a drawing file holds, in file order. ``block`` is null for the entities of model space.
ENTITIES = (
    "drawing_id string, seq bigint, block string, block_x double, block_y double, handle string, dxftype string, layer string, "
    "paperspace int, "
    f"pts array<{POINT}>, bulges array<double>, closed boolean, radius double, start_angle double, end_angle double, text string, "
    "height double, "
    "block_name string, xscale double, yscale double, rotation double, error string"
)
SEGMENTS = (
    "drawing_id string, layer string, layer_ord int, line_ord int, sx double, sy double, ex double, ey double, alignment string, "
    "handle string, id string"
)
CIRCLES = (
    "drawing_id string, layer string, layer_ord int, circle_ord int, cx double, cy double, radius double, angles array<double>, handle "
    "string, id string"
)
TEXTS = "drawing_id string, layer string, layer_ord int, text_ord int, tx double, ty double, text string, handle string, id string"
LAYERS = "drawing_id string, layer string, layer_ord int"
BLOCKS = "drawing_id string, layer string, layer_ord int, block_ord int, bx double, by double, handle string"
BLOCK_INSTANCES = "drawing_id string, block_name string, handle string, layer string, insertion_point array<double>"
ADJACENCY = "drawing_id string, node_id int, nbr_ord int, nbr int"
