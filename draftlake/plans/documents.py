"""Sinks: the analysis of each drawing as a JSON document, and its report as Markdown."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .analysis import Analysis, analyse_path
from .store import Keeper

#: What a layer holds in a document.
ITEMS = "lines circles_arcs text_annotations".split()
PARAMETERS = {"clustering_tolerance": 1.0, "max_loop_length": 20, "max_total_loops": 2000, "max_dfs_steps": 3_000_000}


def _lists(df: DataFrame, name: str, order: list[str], cols: list[str]) -> DataFrame:
    item = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), *cols)
    return df.groupBy("drawing_id").agg(F.array_sort(F.collect_list(item)).alias(name))


def nested(a: Analysis) -> DataFrame:
    """One row a drawing, all its results in sorted arrays."""
    parts = [
        _lists(a.layers, "layers", ["layer_ord"], ["layer"]),
        _lists(a.segments, "segments", ["layer_ord", "line_ord"], ["layer", "sx", "sy", "ex", "ey", "alignment", "id", "handle"]),
        _lists(a.circles, "circles", ["layer_ord", "circle_ord"], ["layer", "cx", "cy", "radius", "angles", "id", "handle"]),
        _lists(a.texts, "texts", ["layer_ord", "text_ord"], ["layer", "tx", "ty", "text", "id", "handle"]),
        _lists(a.nodes, "nodes", ["node_id"], ["x", "y"]),
        a.edges.groupBy("drawing_id").agg(F.count("*").alias("edges")),
        _lists(a.degrees, "degrees", ["degree"], ["n"]),
        _lists(
            a.loops.drop("ring"), "loops", ["loop_ord"],
            ["loop_ord", "node_ids", "num_segments", "area", "cx", "cy", "min_x", "min_y", "max_x", "max_y", "id"]
        ),
        a.truncated,
        _lists(a.texts_in, "texts_in", ["loop_ord", "layer_ord", "text_ord"], ["loop_ord", "text", "tx", "ty", "layer"]),
        _lists(a.symbols_in, "symbols_in", ["loop_ord", "layer_ord", "circle_ord"], ["loop_ord", "cx", "cy", "radius", "layer"]),
        _lists(a.boxes, "boxes", ["layer_ord"], ["layer", "min_x", "min_y", "max_x", "max_y"]),
        _lists(a.alignments, "alignments", ["layer_ord"], ["layer", "horizontal", "vertical", "diagonal"]),
        _lists(
            a.statistics, "statistics", ["layer_ord"],
            ["layer", "line_count", "circle_arc_count", "text_count", "total_line_length", "dominant_alignment"]
        ),
        _lists(
            a.anchors, "anchors", ["layer_ord", "text_ord"],
            ["text", "tx", "ty", "text_layer", "nearest_entity_type", "nearest_x", "nearest_y", "nearest_entity_layer", "distance"]
        ),
        a.radius,
        _lists(a.rooms, "rooms", ["room_ord"], ["room_ord", "label", "x", "y"]),
        _lists(a.room_members, "room_members", ["room_ord", "layer_ord", "kind_ord", "item_ord"], ["room_ord", "handle", "type", "layer"]),
    ]
    out = a.metadata
    for p in parts:
        out = out.join(p, "drawing_id", "left")
    return out


def document(r: dict) -> dict:
    """The nested dictionary of a row of ``nested``. Coordinates rounded to no decimals are integers."""
    items = lambda k: [dict(x) if isinstance(x, dict) else x.asDict() for x in (r[k] if r[k] is not None else [])]
    num = (lambda v: int(v)) if r["rounding"] == 0 else float
    pt = lambda d, x, y: [num(d[x]), num(d[y])]
    named = lambda d: {"id": d["id"]} | ({"handle": d["handle"]} if d.get("handle") else {})
    layers: dict = {d["layer"]: {k: [] for k in ITEMS} for d in items("layers")}
    for d in items("segments"):
        layers[d["layer"]]["lines"].append({"start": pt(d, "sx", "sy"), "end": pt(d, "ex", "ey"), "alignment": d["alignment"]} | named(d))
    for d in items("circles"):
        layers[d["layer"]]["circles_arcs"].append(
            {
                "center": pt(d, "cx", "cy"), "radius": num(d["radius"]),
                "angles": None if d["angles"] is None else [float(v) for v in d["angles"]]
            } | named(d)
        )
    for d in items("texts"):
        layers[d["layer"]]["text_annotations"].append({"position": pt(d, "tx", "ty"), "text": d["text"]} | named(d))
    loops = [
        {
            "node_ids": [int(v) for v in d["node_ids"]], "num_segments": d["num_segments"], "area": d["area"],
            "centroid": [d["cx"], d["cy"]], "bbox": [d["min_x"], d["min_y"], d["max_x"], d["max_y"]], "id": d["id"], "contained_text": [],
            "contained_symbols": []
        }
        for d in items("loops")
    ]
    for d in items("texts_in"):
        loops[d["loop_ord"] - 1]["contained_text"].append({"text": d["text"], "position": pt(d, "tx", "ty"), "layer": d["layer"]})
    for d in items("symbols_in"):
        loops[d["loop_ord"] - 1]["contained_symbols"].append({"center": pt(d, "cx", "cy"), "radius": num(d["radius"]), "layer": d["layer"]})
    nodes = [[d["x"], d["y"]] for d in items("nodes")]
    scale = r["scale_factor"]
    meta = {
        "filename": r["filename"], "drawing_type": r["drawing_type"],
        "global_dimensions": {"width": r["width"], "height": r["height"], "units": r["units"]},
        "transform": {
            "type": r["transform"], "offset_x": r["offset_x"], "offset_y": r["offset_y"],
            "scale_factor": int(scale) if r["paper_size"] and scale > 1 else scale, "rounding_precision": r["rounding"],
            "description": r["description"]
        },
    }
    if r["paper_size"]:
        meta["paper_info"] = {
            "paper_size": r["paper_size"], "scale": int(r["paper_scale"]), "expected_extent": [int(r["expected_w"]), int(r["expected_h"])],
            "fit_error": r["fit_error"]
        }
    semantics = {
        "layer_statistics": {
            d["layer"]: {k: d[k] for k in ("line_count", "circle_arc_count", "text_count", "total_line_length", "dominant_alignment")}
            for d in items("statistics")
        },
        "text_anchors": [
            {
                "text": d["text"], "text_position": pt(d, "tx", "ty"), "text_layer": d["text_layer"],
                "nearest_entity_type": d["nearest_entity_type"], "nearest_point": [d["nearest_x"], d["nearest_y"]],
                "nearest_entity_layer": d["nearest_entity_layer"], "distance": d["distance"]
            }
            for d in items("anchors")
        ],
        "anchor_radius_used": r["radius"],
    }
    rooms = [{"label": d["label"], "position": pt(d, "x", "y"), "entities": []} for d in items("rooms")]
    for d in items("room_members"):
        rooms[d["room_ord"] - 1]["entities"].append({"handle": d["handle"], "type": d["type"], "layer": d["layer"]})
    if rooms:
        semantics["rooms"] = rooms
    return {
        "metadata": meta, "layers": layers,
        "topology": {
            "parameters": PARAMETERS,
            "nodes": dict(count=len(nodes), coordinates=nodes, degree_distribution={str(d["o0"]): d["n"] for d in items("degrees")}),
            "edges": {"count": int(r["edges"] or 0)}, "loops": loops, "loops_truncated": bool(r["truncated"])
        },
        "spatial": {
            "layer_bounding_boxes": {d["layer"]: [num(d[k]) for k in ("min_x", "min_y", "max_x", "max_y")] for d in items("boxes")},
            "alignment_summary": {d["layer"]: {k: d[k] for k in ("horizontal", "vertical", "diagonal")} for d in items("alignments")}
        },
        "semantics": semantics,
    }


def json_documents(a: Analysis) -> DataFrame:
    """(drawing_id, json): indented by two, other than ASCII escaped."""
    rows = nested(a)
    kind = rows.schema["drawing_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [json.dumps(document(_plain(r)), indent=2) for r in f.to_dict("records")]
            yield pd.DataFrame({"drawing_id": f["drawing_id"], "json": made})

    return rows.mapInPandas(run, f"drawing_id {kind}, json string")


def _plain(r: dict) -> dict:
    """Without what pandas makes of nulls and numbers."""
    out = {}
    for k, v in r.items():
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, float) and v != v:
            v = None
        out[k] = v
    out["rounding"] = int(out["rounding"])
    return out


def place(path: str) -> tuple[str, str]:
    """(scheme and host of a store, '' for files; path in it) of a path or URI."""
    m = re.match(r"([a-zA-Z][a-zA-Z0-9+.\-]*):(//[^/]*)?(/.*)$", path)
    if not m:
        return "", path
    scheme, host, rest = m.groups()
    return ("", rest) if scheme == "file" else (f"{scheme}:{host or '//'}", rest)


def write_documents(a: Analysis, folder: str | None = None) -> list[str]:
    """``name.json`` and ``name.md`` for each drawing, beside its file or in a folder; their names, in order.

    The executors write them, to a folder that they share or to a store that pyarrow's file systems know by the scheme (s3,
    gs, abfs, hdfs). A file is written under another name and then moved, so that a task that runs again leaves the same result.
    """
    both = json_documents(a).join(a.markdown(), "drawing_id")

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for f in frames:
            names = []
            for r in f.itertuples(index=False):
                name = str(r.drawing_id)
                base = name if folder is None else f"{folder.rstrip('/')}/{name.rsplit('/', 1)[-1]}"
                store, path = place(base)
                system = fs.FileSystem.from_uri(f"{store}{path}") if store else (fs.LocalFileSystem(), path)
                stem = os.path.splitext(system[1])[0]
                for suffix, text in ((".json", r.json), (".md", r.markdown)):
                    with system[0].open_output_stream(f"{stem}{suffix}.part") as out:
                        out.write(text.encode("utf-8"))
                    system[0].move(f"{stem}{suffix}.part", stem + suffix)
                    names.append(f"{store}{stem}{suffix}" if not store else f"{os.path.splitext(base)[0]}{suffix}")
            yield pd.DataFrame({"name": names})

    return sorted(r["name"] for r in both.mapInPandas(put, "name string").collect())  # two names a drawing


def analyse_file(path: str, spark: SparkSession | None = None, **params) -> tuple[dict, str]:
    """The results of one drawing as a dictionary, and its report as Markdown; ValueError if it can't be read or has no extent."""
    spark = spark or SparkSession.builder.appName("draftlake").getOrCreate()
    try:
        with Keeper(spark) as keep:
            a = analyse_path(spark, path, keep=keep, **params)
            found = json_documents(a).join(a.markdown(), "drawing_id").head(2)
    except Exception as e:
        text = str(e)
        if "PATH_NOT_FOUND" in text or "NotDxf" in text or "corrupted" in text:
            raise ValueError(f"Not a drawing that can be read: {path}") from e
        raise
    if len(found) != 1:
        raise ValueError(f"{'No bounding box: the drawing is empty' if not found else 'More than one drawing'}: {path}")
    return json.loads(found[0]["json"]), found[0]["markdown"]
