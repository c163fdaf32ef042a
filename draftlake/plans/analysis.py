"""The five passes over a collection of drawings."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extraction, payload, semantics, spatial, topology
from ..operators.extraction import Layers
from ..sources.dxf import read_dxf
from .store import kept


Keep = Callable[[DataFrame], DataFrame]


class Analysis(NamedTuple):
    """All results, a row each of what they are about; lazy."""

    metadata: DataFrame
    layers: DataFrame
    segments: DataFrame
    circles: DataFrame
    texts: DataFrame
    nodes: DataFrame
    edges: DataFrame
    degrees: DataFrame
    loops: DataFrame
    truncated: DataFrame
    texts_in: DataFrame
    symbols_in: DataFrame
    boxes: DataFrame
    alignments: DataFrame
    statistics: DataFrame
    anchors: DataFrame
    radius: DataFrame
    rooms: DataFrame
    room_members: DataFrame

    @property
    def tables(self) -> Layers:
        return Layers(self.layers, self.segments, self.circles, self.texts)

    def save(self, path: str) -> Analysis:
        """All tables written below a path, and the analysis over them: later steps then share the work."""
        spark = self.layers.sparkSession
        for name, df in self._asdict().items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        return Analysis(**{name: spark.read.schema(df.schema).parquet(f"{path}/{name}") for name, df in self._asdict().items()})

    def markdown(self) -> DataFrame:
        """(drawing_id, markdown)."""
        return payload.markdown(
            payload.report_lines(
                self.metadata, self.tables, self.loops, self.texts_in, self.symbols_in, self.statistics, self.boxes, self.nodes, self.edges,
                self.degrees
            )
        )


def analyse_tables(
    t: Layers, metadata: DataFrame, tolerance: float = topology.TOLERANCE, radius: float | None = None, keep: Keep | None = None, **bounds
) -> Analysis:
    """Passes 2 to 5 over tables of pass 1; ids come before rooms, whose members carry them.

    ``keep`` stores what several results are made of, so that it is computed once: by default ``plans.store.kept``. With a
    function that returns its argument all stays lazy, but the plan multiplies with each reuse.
    """
    keep = keep or kept
    t = Layers(*map(keep, payload.assign_ids(t)))
    top = topology.analyse(t.segments, tolerance, keep, **bounds)
    near = keep(semantics.text_neighbours(t, keep))
    reach = keep(
        semantics.anchor_radius(t, near) if radius is None else t.layers.select("drawing_id").distinct().withColumn("radius", F.lit(float(radius)))
    )
    rooms = keep(semantics.room_labels(t.texts))
    loops = payload.size_classes(payload.loop_ids(top.loops))
    return Analysis(
        metadata=keep(metadata), layers=t.layers, segments=t.segments, circles=t.circles, texts=t.texts, nodes=top.nodes, edges=top.edges,
        degrees=topology.degree_distribution(top.nodes, top.links), loops=loops, truncated=top.truncated,
        texts_in=spatial.contained(t.texts, loops, "tx", "ty"), symbols_in=spatial.contained(t.circles, loops, "cx", "cy"),
        boxes=spatial.layer_boxes(t), alignments=spatial.alignment_summary(t.segments), statistics=keep(semantics.layer_statistics(t)),
        anchors=semantics.text_anchors(near, reach), radius=reach, rooms=rooms, room_members=semantics.room_members(t, rooms, keep=keep),
    )


def analyse(entities: DataFrame, bounds: DataFrame | None = None, keep: Keep | None = None, **params) -> Analysis:
    """All five passes over entities; ``bounds`` overrides the computed ones. A drawing without any extent has no rows."""
    keep = keep or kept
    norm = keep(extraction.normalisation(extraction.bounds(entities, keep) if bounds is None else bounds))
    t = Layers(*map(keep, extraction.extract(entities, norm, keep)))
    return analyse_tables(t, payload.metadata(norm, extraction.drawing_types(t)), keep=keep, **params)


def analyse_path(spark: SparkSession, path: str, mode: str = "FAILFAST", keep: Keep | None = None, **params) -> Analysis:
    """The analysis of all files that a path or glob names; what it is made of is kept in the shared folder."""
    keep = keep or kept
    return analyse(keep(read_dxf(spark, path, mode)), keep=keep, **params)
