"""Slices of raw scans on any screen plane, without the deskewed volume, and the raw cells they read.

A part of a camera image (whole, left or right half) has a matrix from its raw voxels to the
screen. The screen is the plane z = 0 of its own coordinates; pixel (u, v) is sampled at the raw
position to which the inverse matrix takes (u, v, 0). Samples touch the nearest voxel or the eight
around; outside its part a scan is zero.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions import matrix as mx

MARGIN = 1e-6  # raw voxels by which cells are widened, so that a sample on their edge is never left out
TOP = 65535


@dataclass(frozen=True)
class Part:
    """Columns ``first`` to ``first + width - 1`` of a camera image, and the matrix from their voxels to the screen."""

    name: str
    first: int
    width: int
    to_screen: np.ndarray


def to_world(deskew: np.ndarray, width: int, pixel: float = 1.0, level: int = 1, mirror: bool = False, alignment: list[float] | None = None) -> np.ndarray:
    """Matrix from the voxels of a part to the world: level, deskew of voxel centres, mirror, alignment, pitch.

    ``alignment`` is a 2x3 matrix that acts on x and y of every plane; a mirror turns the part's ``width``.
    """
    m = mx.source_to_world(deskew, level)
    if mirror:
        m = np.array([[-1.0, 0, 0, width - 1], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]) @ m
    if alignment is not None:
        a, b, c, d, e, f = alignment
        m = np.array([[a, b, 0, c], [d, e, 0, f], [0, 0, 1, 0], [0, 0, 0, 1]]) @ m
    return mx.scale(pixel, pixel, pixel) @ m


def seen(part: Part, view: np.ndarray) -> Part:
    """The part, placed in the world, as a viewer sees it."""
    return replace(part, to_screen=view @ part.to_screen)


def facing(axis: str, at: float) -> np.ndarray:
    """Viewer of a plane across ``axis`` at a world coordinate: z shows x and y, y shows x and z, x shows z and y."""
    rows = {"z": ("x", "y", "z"), "y": ("x", "z", "y"), "x": ("z", "y", "x")}[axis]
    m = np.zeros((4, 4))
    for i, k in enumerate(rows):
        m[i, "xyz".index(k)] = 1
    m[2, 3], m[3, 3] = -at, 1
    return m


def _clip(polygon: np.ndarray, a: float, b: float, c: float) -> np.ndarray:
    """The part of a convex polygon where a u + b v + c is not negative."""
    if not len(polygon):
        return polygon
    side = polygon @ (a, b) + c
    out = []
    for p, q, f, g in zip(polygon, np.roll(polygon, -1, axis=0), side, np.roll(side, -1)):
        if f >= 0:
            out.append(p)
        if (f >= 0) != (g >= 0):
            out.append(p + f / (f - g) * (q - p))
    return np.array(out).reshape(-1, 2)


def plane_rows(part: Part, plane: int, extents: tuple[int, int, int], screen: tuple[int, int], linear: bool) -> tuple[int, int] | None:
    """First and last raw row of a plane that the screen reads through a part, if any."""
    inverse = np.linalg.inv(part.to_screen)
    reach = 1.0 if linear else 0.5
    u, v = screen
    shape = np.array([(0, 0), (u - 1, 0), (u - 1, v - 1), (0, v - 1)], float)
    bounds = [(0, -reach, part.width - 1 + reach), (1, -reach, extents[1] - 1 + reach), (2, plane - reach, plane + reach)]
    for axis, low, high in bounds:
        a, b, _, c = inverse[axis]
        shape = _clip(shape, a, b, c - low + MARGIN)
        shape = _clip(shape, -a, -b, high - c + MARGIN)
    if not len(shape):
        return None
    rows = shape @ inverse[1, :2] + inverse[1, 3]
    low, high = (0.0, 1.0) if linear else (0.5, 0.5)
    first, last = max(0, int(np.floor(rows.min() + low - MARGIN))), min(extents[1] - 1, int(np.floor(rows.max() + high + MARGIN)))
    return (first, last) if first <= last else None


def covered_cells(spark: SparkSession, parts: list[Part], extents: tuple[int, int, int], screen: tuple[int, int], rows_per_strip: int = 1, linear: bool = True) -> DataFrame:
    """``plane, strip``: the cells of full-width strips of raw rows that a screen reads through its parts.

    In every plane the pixels that read it are a convex polygon, the screen clipped by the half-planes
    of the part and of the plane; rows are affine in pixels, so their ends lie at corners. Never fewer
    cells than samples read. Planes are dealt to tasks.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for plane in pdf["id"]:
                for part in parts:
                    rows = plane_rows(part, int(plane), extents, screen, linear)
                    if rows is not None:
                        out.append((plane, rows[0] // rows_per_strip, rows[1] // rows_per_strip))
            yield pd.DataFrame(out, columns=["plane", "first", "last"])

    spans = spark.range(extents[2]).mapInPandas(run, "plane long, first long, last long")
    return spans.select("plane", F.explode(F.sequence("first", "last")).alias("strip")).distinct()


def read_cells(voxels: DataFrame, cells: DataFrame, rows_per_strip: int = 1) -> DataFrame:
    """The voxels of covered cells, a semi-join before anything else reads the scan."""
    wanted = cells.select(F.col("plane").alias("z"), F.col("strip").alias("_strip"))
    return voxels.withColumn("_strip", F.floor(F.col("y") / rows_per_strip)).join(wanted, ["z", "_strip"], "left_semi").select(*voxels.columns)


def _asked(spark: SparkSession, part: Part, extents: tuple[int, int, int], screen: tuple[int, int], linear: bool) -> DataFrame:
    """``part, u, v, sx, sy, sz, w``: the raw voxels that every pixel reads, with their weights."""
    inverse = np.linalg.inv(part.to_screen)
    pixels = spark.range(screen[0] * screen[1]).select(F.expr(f"id % {screen[0]}").alias("u"), F.expr(f"id div {screen[0]}").alias("v"))
    out, weight = pixels, F.lit(1.0)
    for k, row, n in zip("xyz", inverse, (part.width, *extents[1:])):
        p = F.round(float(row[0]) * F.col("u") + float(row[1]) * F.col("v") + float(row[3]), 9)
        if linear:
            near = F.array(*[F.struct(e.cast("long").alias("at"), (1 - F.abs(p - e)).alias("w")) for e in (F.floor(p), F.floor(p) + 1)])
        else:
            near = F.array(F.struct(F.floor(p + 0.5).cast("long").alias("at"), F.lit(1.0).alias("w")))
        out = out.withColumn(f"_{k}", F.explode(F.filter(near, lambda e: (e["w"] > 0) & e["at"].between(0, n - 1))))  # noqa: B023
        weight = weight * F.col(f"_{k}.w")
    return out.select(F.lit(part.name).alias("part"), "u", "v", (F.col("_x.at") + part.first).alias("x"), F.col("_y.at").alias("y"), F.col("_z.at").alias("z"), weight.alias("w"))


def screen_slice(
    voxels: DataFrame, parts: list[Part], extents: tuple[int, int, int], screen: tuple[int, int], rows_per_strip: int = 1, linear: bool = True
) -> DataFrame:
    """``t, c, part, u, v, value``: every pixel of the screen for every volume (t, c) and part; zero where a part is not met.

    ``extents`` are width, height and planes of the raw scan, ``screen`` the numbers of columns and rows.
    Values are clamped to 16 bits and rounded half up. Only covered cells of the scan are read; which voxels
    a pixel reads does not depend on the volume, so that table is made once and joined by place.
    """
    spark = voxels.sparkSession
    near = read_cells(voxels, covered_cells(spark, parts, extents, screen, rows_per_strip, linear), rows_per_strip)
    asked = _asked(spark, parts[0], extents, screen, linear)
    for part in parts[1:]:
        asked = asked.union(_asked(spark, part, extents, screen, linear))
    met = near.withColumnRenamed("v", "_value").join(asked, ["x", "y", "z"]).select("t", "c", "part", "u", "v", (F.col("w") * F.col("_value")).alias("value"))
    names = F.explode(F.array(*[F.lit(p.name) for p in parts]))
    empty = voxels.select("t", "c").distinct().withColumn("part", names).withColumn("u", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(screen[0] - 1).cast("long"))))
    empty = empty.withColumn("v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(screen[1] - 1).cast("long")))).withColumn("value", F.lit(0.0))
    value: Column = F.floor(F.least(F.greatest(F.sum("value"), F.lit(0.0)), F.lit(float(TOP))) + 0.5).cast("long")
    return met.union(empty).groupBy("t", "c", "part", "u", "v").agg(value.alias("value"))


def composed(slices: DataFrame) -> DataFrame:
    """``t, u, v, value``: parts and channels of a screen over each other, summed and clamped."""
    return slices.groupBy("t", "u", "v").agg(F.least(F.sum("value"), F.lit(TOP)).cast("long").alias("value"))
