"""Colour ramps: values in 0 to 1 as 0xRRGGBB integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rgb(red: Column, green: Column, blue: Column) -> Column:
    parts = [F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * 255).cast("int") for c in (red, green, blue)]
    return parts[0] * 65536 + parts[1] * 256 + parts[2]


def blue_white_red(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    t = (value - low) / (high - low)
    return rgb(F.when(t < 0.5, 2 * t).otherwise(1.0), F.when(t < 0.5, 2 * t).otherwise(2 - 2 * t), F.when(t < 0.5, 1.0).otherwise(2 - 2 * t))


def red_yellow_green(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    t = (value - low) / (high - low)
    return rgb(F.when(t < 0.5, 1.0).otherwise(2 - 2 * t), F.when(t < 0.5, 2 * t).otherwise(1.0), F.lit(0.0))


def from_text(name: Column) -> Column:
    """A repeatable colour for a name."""
    return F.pmod(F.xxhash64(name), F.lit(1 << 24)).cast("int")
