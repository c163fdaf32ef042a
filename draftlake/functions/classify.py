"""Keyword classification of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Category and the words that a block name of it contains; the first category with a hit wins.
FURNITURE = {
    "sofa": "SOFA|COUCH|LOVESEAT|SETTEE",
    "chair": "CHAIR|SEAT|STOOL|ARMCHAIR",
    "desk": "DESK|WORKSTATION|WORKSTN",
    "table": "TABLE|DINING|CONFERENCE|CONF",
    "bed": "BED|BUNK|COT|MATTRESS",
    "wardrobe": "WARDROBE|CLOSET|CABINET|ARMOIRE",
    "sink": "SINK|BASIN|LAVATORY|LAV",
    "toilet": "TOILET|WC|WATER CLOSET|URINAL",
    "bath": "BATH|BATHTUB|TUB|SHOWER",
    "appliance": "FRIDGE|REFRIGERATOR|OVEN|STOVE|WASHER|DRYER|DISHWASHER|MICROWAVE",
    "storage": "SHELF|BOOKCASE|BOOKSHELF|SHELVING|RACK",
    "fixture": "LIGHT|LAMP|FAN|AC|HVAC|RADIATOR",
}
#: Discipline, its layer prefix and the word it may contain, in the order of the test.
DISCIPLINES = (("electrical", "E", "ELEC"), ("architectural", "A", "ARCH"), ("mechanical", "M", "MECH"), ("structural", "S", "STRUCT"))
ROOM_LAYER = "(?i)TEXT|ANNO|ROOM|NAME|LABEL"


def furniture(name: Column) -> Column:
    """Category of a block name, null for unknown and for anonymous or dynamic blocks."""
    upper = F.upper(name)
    out = F.when(upper.startswith("*") | upper.startswith("A$C"), F.lit(None))
    for category, words in FURNITURE.items():
        out = out.when(upper.rlike(words), category)
    return out


def shape(width: Column, height: Column) -> Column:
    """Category by the size of a bounding box in mm, null if it fits none."""
    area = width * height
    aspect = F.greatest(width, height) / F.greatest(F.least(width, height), F.lit(1e-6))
    big, small = (area > 300_000) & (area < 3_000_000), (area > 100_000) & (area < 600_000)
    return (
        F.when(big & (aspect < 1.5), "table").when(big & (aspect < 3), "desk").when(big, "sofa")
        .when(small & (aspect < 1.5), "chair").when(small, "sink")
    )


def discipline(layer: Column) -> Column:
    upper = F.upper(layer)
    out = None
    for name, letter, word in DISCIPLINES:
        hit = upper.rlike(f"^{letter}[-_]|{word}")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def is_room_layer(layer: Column) -> Column:
    return layer.rlike(ROOM_LAYER)
