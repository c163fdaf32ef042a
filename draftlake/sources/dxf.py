"""Drawing exchange files (DXF, in text or binary form) as a table of entities."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import ENTITIES

#: Sub-entities that belong to the entity before them.
_PARTS = {"VERTEX", "SEQEND", "ATTRIB"}
_ENCODINGS = {"ANSI_932": "cp932", "ANSI_936": "gbk", "ANSI_949": "cp949", "ANSI_950": "big5", "DOS850": "cp850", "DOS437": "cp437"}
#: Names and types of the columns, in order.
FIELDS = tuple(tuple(f.strip().split(" ", 1)) for f in re.split(r",\s*(?![^<]*>)", ENTITIES))


class NotDxf(ValueError):
    pass


def codec(head: str) -> str:
    """The encoding of a file, by the version and code page that its head tells."""
    page = re.search(r"\$DWGCODEPAGE\s+3\s+(\S+)", head)
    version = re.search(r"\$ACADVER\s+1\s+AC(\d+)", head)
    if version and int(version.group(1)) >= 1021:
        return "utf-8"
    name = page.group(1).upper() if page else "ANSI_1252"
    return _ENCODINGS.get(name, name.replace("ANSI_", "cp")) if re.fullmatch(r"ANSI_\d+|DOS\d+", name) else "cp1252"


def decode(data: bytes) -> str:
    """The text of a file, by its byte order mark, version or code page."""
    if data.startswith(b"\xef\xbb\xbf"):
        return data[3:].decode("utf-8", "replace")
    return data.decode(codec(data[:8192].decode("latin-1")), "replace")


def tags(text: str) -> Iterator[tuple[int, str]]:
    """(group code, value) pairs; comments (999) are left out."""
    lines = text.splitlines()
    for k in range(0, len(lines) - 1, 2):
        try:
            code = int(lines[k])
        except ValueError:
            raise NotDxf(f"Invalid or corrupted DXF file: group code expected in line {k + 1}") from None
        if code != 999:
            yield code, lines[k + 1]


BINARY = b"AutoCAD Binary DXF\r\n\x1a\x00"
#: Ranges of group codes and the form of their values in binary files; all others are strings.
_FORMS = [
    (10, 59, "<d"), (60, 79, "<h"), (90, 99, "<i"), (110, 149, "<d"), (160, 169, "<q"), (170, 179, "<h"), (210, 239, "<d"),
    (270, 289, "<h"), (290, 299, "<B"),
    (370, 389, "<h"), (400, 409, "<h"), (420, 429, "<i"), (440, 449, "<i"), (450, 459, "<i"), (460, 469, "<d"), (1010, 1059, "<d"),
    (1060, 1070, "<h"), (1071, 1071, "<i"),
]


def binary_tags(data: bytes) -> Iterator[tuple[int, str]]:
    """(group code, value as text) pairs of the binary form; group codes have two bytes, in files before release 13 one."""
    at = len(BINARY)
    wide = data[at + 1 : at + 2] == b"\0"  # the first tag is 0 SECTION
    raw: list[tuple[int, str | bytes]] = []
    try:
        while at < len(data):
            if wide:
                (code,), at = struct.unpack_from("<H", data, at), at + 2
            else:
                code, at = data[at], at + 1
                if code == 255:
                    (code,), at = struct.unpack_from("<H", data, at), at + 2
            form = next((f for a, b, f in _FORMS if a <= code <= b), None)
            if form:
                raw.append((code, repr(struct.unpack_from(form, data, at)[0])))
                at += struct.calcsize(form)
            elif 310 <= code <= 319 or code == 1004:
                size = data[at]
                raw.append((code, data[at + 1 : at + 1 + size].hex()))
                at += 1 + size
            else:
                end = data.index(b"\0", at)
                raw.append((code, data[at:end]))
                at = end + 1
    except (ValueError, IndexError, struct.error):
        raise NotDxf("Invalid or corrupted DXF file: the binary form breaks off") from None
    told = [
        f"{v.decode('latin-1')}\n{c}\n{x.decode('latin-1')}\n"
        for (k, v), (c, x) in zip(raw[:400], raw[1:401]) if k == 9 and isinstance(x, bytes)
    ]
    name = codec("".join(told))
    for code, value in raw:
        if code != 999:
            yield code, value if isinstance(value, str) else value.decode(name, "replace")


def _entity(kind: str, found: list[tuple[int, str]]) -> dict:
    """The columns of one entity; what can't be read is told in ``error``."""
    out: dict = {"dxftype": kind, "layer": "0", "paperspace": 0}
    points: dict[int, list[float]] = {}
    xs: list[list[float]] = []
    bulges: list[float] = []
    texts: list[str] = []
    try:
        for code, value in found:
            if code == 8:
                out["layer"] = value.strip()
            elif code == 5:
                out["handle"] = value.strip()
            elif code == 67:
                out["paperspace"] = int(value)
            elif code == 2 and kind == "INSERT":
                out["block_name"] = value.strip()
            elif code in (1, 3) and kind in ("TEXT", "MTEXT"):
                texts.append(value)
            elif kind == "LWPOLYLINE" and code == 10:
                xs.append([float(value), 0.0])
                bulges.append(0.0)
            elif kind == "LWPOLYLINE" and code == 20 and xs:
                xs[-1][1] = float(value)
            elif kind == "LWPOLYLINE" and code == 42 and bulges:
                bulges[-1] = float(value)
            elif kind == "LWPOLYLINE" and code == 70:
                out["closed"] = bool(int(value) & 1)
            elif 10 <= code <= 18:
                points.setdefault(code - 10, [0.0, 0.0])[0] = float(value)
            elif 20 <= code <= 28:
                points.setdefault(code - 20, [0.0, 0.0])[1] = float(value)
            elif code == 40:
                out["height" if kind in ("TEXT", "MTEXT") else "radius"] = float(value)
            elif code == 50:
                out["rotation" if kind in ("INSERT", "TEXT", "MTEXT") else "start_angle"] = float(value)
            elif code == 51:
                out["end_angle"] = float(value)
            elif code == 41 and kind == "INSERT":
                out["xscale"] = float(value)
            elif code == 42 and kind == "INSERT":
                out["yscale"] = float(value)
    except ValueError as e:
        out["error"] = f"{kind}: {e}"
    if kind == "LWPOLYLINE":
        pts = xs
        out["bulges"] = bulges
    elif kind in ("CIRCLE", "ARC", "TEXT", "MTEXT", "INSERT"):
        pts = [points.get(0, [0.0, 0.0])]
    elif kind == "LINE":
        pts = [points.get(0, [0.0, 0.0]), points.get(1, [0.0, 0.0])]
    elif kind == "SOLID":
        pts = []
        for k in range(4):
            if k not in points:
                break
            pts.append(points[k])
    else:
        pts = [points[k] for k in sorted(points)]
    if kind in ("TEXT", "MTEXT"):
        out["text"] = "".join(texts)
    out["pts"] = [{"x": x, "y": y} for x, y in pts]
    if kind == "ARC":
        out.setdefault("start_angle", 0.0)
        out.setdefault("end_angle", 360.0)
    return out


def parse(data: bytes) -> Iterator[dict]:
    """The entities of the model and paper space, and of each block, in file order."""
    section, block, base, seen = "", None, [0.0, 0.0], False
    kind, found, seq = "", [], 0

    def close() -> Iterator[dict]:
        nonlocal block, base, section, seq
        if kind == "SECTION":
            section = next((v.strip() for c, v in found if c == 2), "")
        elif kind == "ENDSEC":
            section = ""
        elif kind == "BLOCK" and section == "BLOCKS":
            block = next((v.strip() for c, v in found if c == 2), "")
            at = {c: v for c, v in found if c in (10, 20)}
            base = [float(at.get(10, 0)), float(at.get(20, 0))]
        elif kind == "ENDBLK":
            block = None
        elif kind and kind not in _PARTS and kind != "EOF" and (section == "ENTITIES" or (section == "BLOCKS" and block is not None)):
            seq += 1
            yield _entity(kind, found) | {
                "seq": seq, "block": block if section == "BLOCKS" else None, "block_x": base[0] if section == "BLOCKS" else None,
                "block_y": base[1] if section == "BLOCKS" else None
            }

    for code, value in binary_tags(data) if data.startswith(BINARY) else tags(decode(data)):
        if code == 0:
            yield from close()
            kind, found = value.strip(), []
            seen |= kind == "SECTION"
        else:
            found.append((code, value))
    yield from close()
    if not seen:
        raise NotDxf("Not a DXF file: no section")


def _rows(drawing: str, data: bytes, mode: str) -> Iterator[dict]:
    try:
        got = [e | {"drawing_id": drawing} for e in parse(data)]
    except NotDxf as e:
        if mode == "FAILFAST":
            raise
        got = [{"drawing_id": drawing, "seq": 0, "paperspace": 0, "error": str(e)}]
    yield from got


def parse_files(files: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """The entities of files given as (path, content); ``drawing_id`` is the path. Files are the unit of parallelism."""
    arrow = _arrow_schema()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0), b.column(1)):
                rows = list(_rows(name.as_py(), data.as_py(), mode))
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[k : k + 10_000], arrow)

    return files.select("path", "content").mapInArrow(run, ENTITIES)


def read_dxf(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """The entities of all files that a path or glob names.

    ``mode`` FAILFAST raises at a file that can't be read, PERMISSIVE gives it one row with an ``error``. An entity that can't
    be read has an ``error`` in either mode.
    """
    return parse_files(spark.read.format("binaryFile").load(path), mode)


def _arrow_schema() -> pa.Schema:
    point = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    kinds = {
        "string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_(),
        "array<double>": pa.list_(pa.float64())
    }
    return pa.schema([(name, kinds.get(kind, point)) for name, kind in FIELDS])


class DxfDataSource(DataSource):
    """``spark.read.format("dxf").option("path", ...)``: the same rows for files of a mounted folder, one partition a file."""

    @classmethod
    def name(cls) -> str:
        return "dxf"

    def schema(self) -> str:
        return ENTITIES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options.get("path", ""), self.options.get("mode", "FAILFAST").upper())


class _Reader(DataSourceReader):
    def __init__(self, path: str, mode: str):
        self.path, self.mode = path, mode

    def partitions(self) -> list[InputPartition]:
        import glob

        return [InputPartition(p) for p in sorted(glob.glob(self.path))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            for row in _rows(partition.value, f.read(), self.mode):
                row["pts"] = [(p["x"], p["y"]) for p in row.get("pts", [])]
                yield tuple(row.get(name) for name, _ in FIELDS)
