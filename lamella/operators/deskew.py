"""Deskew geometry as grouped projections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deskewed_row(y: Column, z: Column, pixel: float, step: float, angle: float, depth: int) -> Column:
    """Output row of raw row ``y`` in plane ``z`` after the shear and rotation.

    Rounds with floor(x + 0.5). The offset keeps the smallest row at zero.
    """
    rad = math.radians(angle)
    scale = step / pixel
    lowest = min(0.0, scale * (depth - 1))
    return F.floor(F.lit(math.cos(rad)) * y + F.lit(scale) * z - F.lit(lowest) + F.lit(0.5)).cast("int")


def deskewed_max(voxels: DataFrame, keys: list[str], pixel: float, step: float, angle: float, depth: int) -> DataFrame:
    """Max-Z projection of the deskewed volume without building the volume.

    One aggregate keyed by (keys, output row, x): partial maxima are combined on
    the map side, so the shuffle carries projection pixels, not voxels.
    """
    row = deskewed_row(F.col("y"), F.col("z"), pixel, step, angle, depth)
    return voxels.groupBy(*keys, row.alias("y_out"), "x").agg(F.max("v").alias("v"))


SIDES = ("whole", "left", "right")


def deskewed_max_of_sides(voxels: DataFrame, keys: list[str], pixel: float, step: float, angle: float, width: int, depth: int, sides: tuple[str, ...] = SIDES) -> DataFrame:
    """The same for sides of the camera image: ``keys, side, y_out, x, v``.

    The halves are (width + 1) // 2 columns wide, so an odd middle column is in both. The right half is
    mirrored, as all alignments expect it: its last column comes first. The whole image, its left and
    its right half leave one scan and one aggregate; a voxel is told once for each side that has it.
    """
    half = (width + 1) // 2
    x = F.col("x")
    inside = {"whole": F.lit(True), "left": x < half, "right": x >= width - half}
    column = {"whole": x, "left": x, "right": width - 1 - x}
    place = [F.when(inside[s], F.struct(F.lit(s).alias("side"), column[s].cast("long").alias("x"))) for s in sides]
    row = deskewed_row(F.col("y"), F.col("z"), pixel, step, angle, depth)
    each = voxels.select(*keys, row.alias("y_out"), "v", F.explode(F.array_compact(F.array(*place))).alias("p"))
    return each.groupBy(*keys, F.col("p.side").alias("side"), "y_out", F.col("p.x").alias("x")).agg(F.max("v").alias("v"))
