"""The scalar functions for SQL: temporary functions of the session, all of them SQL expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .classify import DISCIPLINES, FURNITURE, ROOM_LAYER
from .rounding import sql_round


def _case(name: str, tests: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {t} THEN '{v}'" for t, v in tests) + " END"


def register(spark: SparkSession) -> list[str]:
    """Creates them and returns their names."""
    words = [(f"rlike(upper(name), '{w}')", c) for c, w in FURNITURE.items()]
    kinds = [(f"rlike(upper(name), '^{letter}[-_]|{word}')", c) for c, letter, word in DISCIPLINES]
    made = {
        "round_exact1(x DOUBLE) RETURNS DOUBLE": sql_round("x", 1),
        "round_exact2(x DOUBLE) RETURNS DOUBLE": sql_round("x", 2),
        "furniture_category(name STRING) RETURNS STRING": f"CASE WHEN startswith(upper(name), '*') OR startswith(upper(name), 'A$C') THEN NULL ELSE {_case('name', words)} END",
        "layer_discipline(name STRING) RETURNS STRING": _case("name", kinds),
        "is_room_layer(name STRING) RETURNS BOOLEAN": f"rlike(name, '{ROOM_LAYER}')",
        "segment_alignment(sx DOUBLE, sy DOUBLE, ex DOUBLE, ey DOUBLE, tol DOUBLE) RETURNS STRING": "CASE WHEN abs(sx - ex) < tol THEN 'vertical' WHEN abs(sy - ey) < tol THEN 'horizontal' ELSE 'diagonal' END",
    }
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in made]
