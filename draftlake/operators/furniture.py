"""Furniture and fixtures among block references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import furniture

TYPES = ("architectural", "generic")


def detect_furniture(instances: DataFrame, drawing_type: DataFrame | str = "generic") -> DataFrame:
    """(drawing_id, category, block_name, handle, layer, insertion_point, method) of the references whose name tells a category.

    Only drawings of architectural or generic type have any. Missing names, handles and layers are empty strings.
    """
    if isinstance(drawing_type, DataFrame):
        rows = instances.join(drawing_type.where(F.col("drawing_type").isin(*TYPES)).select("drawing_id"), "drawing_id", "left_semi")
    else:
        rows = instances if drawing_type in TYPES else instances.where("false")
    name = F.coalesce("block_name", F.lit(""))
    found = rows.withColumn("category", furniture(name)).where("category IS NOT NULL")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return found.select(
        "drawing_id", "category", blank("block_name"), blank("handle"), blank("layer"), "insertion_point",
        F.lit("block_name").alias("method")
    )
