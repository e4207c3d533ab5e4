"""Column functions on band values, angles and coordinates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def to_linear(db: Column) -> Column:
    """Decibels to linear power."""
    return F.pow(F.lit(10.0), db / 10.0)


def to_db(power: Column) -> Column:
    """Linear power to decibels; NULL where it isn't positive."""
    return F.log10(power) * 10.0


def eastness(aspect: Column) -> Column:
    return F.sin(F.radians(aspect))


def northness(aspect: Column) -> Column:
    return F.cos(F.radians(aspect))


def wetness(sca: Column, slope: Column) -> Column:
    """ln(contributing area / tan slope); NULL on level ground."""
    return F.ln(F.try_divide(sca, F.when(slope > 0, F.tan(F.radians(slope)))))


def stream_power(sca: Column, slope: Column, least: float = 0.001) -> Column:
    return sca * F.tan(F.radians(F.greatest(slope, F.lit(least))))


def clip(low: float, value: Column, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def rounded(value: Column, digits: int = 6) -> Column:
    """Half-even rounding without negative zero, for comparisons."""
    return F.round(value, digits) + F.lit(0.0)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def grid_key(lon: Column, lat: Column, digits: int = 4) -> list[Column]:
    """Integer key of coordinates rounded half-even to ``digits`` decimals."""
    return [F.bround(c * 10**digits).cast("bigint") for c in (lon, lat)]
