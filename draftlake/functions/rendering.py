"""Numbers as text, as the reports show them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import round_exact


def whole(x: Column) -> Column:
    """No decimals, ties to even."""
    return F.format_string("%.0f", round_exact(x, 0))


def one_decimal(x: Column) -> Column:
    return F.format_string("%.1f", round_exact(x, 1))


def shortest(x: Column) -> Column:
    """The shortest decimal that reads back as ``x``, without exponent from 1e-4 to 1e16, with at least one decimal."""
    plain = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,10)").cast("string"), "0+$", ""), r"\.$", ".0")
    text = x.cast("string")
    lead = F.regexp_extract(text, r"^(-?[\d.]+)E(-?\d+)$", 1)
    power = F.regexp_extract(text, r"^(-?[\d.]+)E(-?\d+)$", 2).cast("int")
    scientific = F.concat(
        F.regexp_replace(lead, r"\.0$", ""), F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.lpad(F.abs(power).cast("string"), 2, "0")
    )
    return F.when(~text.contains("E"), text).when((F.abs(x) >= 1e-4) & (F.abs(x) < 1e16), plain).otherwise(scientific)


def coordinate(x: Column, digits: Column) -> Column:
    """A coordinate that was rounded to ``digits`` decimals: an integer for 0, else a decimal number."""
    return F.when(digits == 0, F.format_string("%.0f", x)).otherwise(shortest(x))


def numbered(prefix: str, n: Column) -> Column:
    """``L_007``: at least three digits, never cut."""
    return F.format_string(prefix + "_%03d", n)
