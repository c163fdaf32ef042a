"""Rounding of doubles as decided on their exact binary value, ties to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0


def round_exact(x: Column, digits: int) -> Column:
    """``x`` to 0, 1 or 2 decimals by its exact binary value: 2.675 gives 2.67, 0.125 gives 0.12.

    The error of the product x * 10**digits is computed without loss (Veltkamp's splitting) and decides apparent ties.
    Null gives null, NaN and the infinities themselves.
    """
    if digits == 0:
        return F.rint(x) + F.lit(0.0)
    m = float(10**digits)
    y = x * F.lit(m)
    big = x * F.lit(_SPLIT)
    hi = big - (big - x)
    err = (hi * F.lit(m) - y) + (x - hi) * F.lit(m)
    low = F.floor(y).cast("double")
    frac = y - low
    up = (frac > 0.5) | ((frac == 0.5) & ((err > 0) | ((err == 0) & (F.pmod(low, F.lit(2.0)) == 1.0))))
    return F.when(F.abs(x) < 1e13, (low + up.cast("double")) / F.lit(m) + F.lit(0.0)).otherwise(x)


def round_by(x: Column, digits: Column) -> Column:
    """``x`` to 0 decimals where ``digits`` is 0, else to 1."""
    return F.when(digits == 0, round_exact(x, 0)).otherwise(round_exact(x, 1))


def sql_round(x: str, digits: int) -> str:
    """The same as SQL text that Spark and DuckDB both run; ``x`` is a column name."""
    d = lambda v: f"CAST('{v}' AS DOUBLE)"
    if digits == 0:
        return f"(CASE WHEN abs({x} - floor({x})) = {d(0.5)} THEN {d(2)} * round({x} / {d(2)}) ELSE round({x}) END + {d(0)})"
    m = d(10**digits)
    hi = f"({d(_SPLIT)} * {x} - ({d(_SPLIT)} * {x} - {x}))"
    err = f"(({hi} * {m} - {x} * {m}) + ({x} - {hi}) * {m})"
    low = f"floor({x} * {m})"
    frac = f"({x} * {m} - {low})"
    odd = f"({low} - {d(2)} * floor({low} / {d(2)}) = {d(1)})"
    return (
        f"(({low} + CASE WHEN {frac} > {d(0.5)} OR ({frac} = {d(0.5)} AND ({err} > 0 OR ({err} = 0 AND {odd}))) THEN {d(1)} ELSE {d(0)} "
        f"END) / {m} + {d(0)})"
    )
