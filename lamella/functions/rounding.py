"""Integer pixel rules: half-up rounding and unsigned 16-bit saturation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UINT16_MAX = 65535


def half_up(x: Column) -> Column:
    """floor(x + 0.5), the rounding of every pixel contract."""
    return F.floor(x + F.lit(0.5)).cast("long")


def saturate(x: Column, top: int = UINT16_MAX) -> Column:
    return F.least(x, F.lit(top)).cast("long")


def mean_uint16(total: Column, count: Column) -> Column:
    """(sum + n/2) div n in integers, capped."""
    return saturate(F.floor((total + F.floor(count / 2)) / count))
