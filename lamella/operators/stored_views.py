"""Views of stores that hold camera halves as channels, and channel operations on results.

A view has an operation, a choice of channels, a range of time points and a box in the coordinates
of the image it produces. The box is taken back through the operation to the rectangle of
each stored channel that it needs, so plain filters reach the scan and the other chunks stay closed.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.operators import project, resample
from lamella.operators.catalogue import placements

OPERATIONS = ("stored", "side_by_side", "flip", "flip_align_right", "flip_align_left")
SIX = "m00 double, m01 double, m02 double, m10 double, m11 double, m12 double"
MARGIN = 2  # pixels around a rectangle that is mapped back: one of the footprint, one of rounding


@dataclass(frozen=True)
class Output:
    """One channel of a view: where it is stored, whether it is mirrored, its matrix after that, and where its columns begin."""

    slot: int
    source: int
    flip: bool = False
    matrix: tuple[float, ...] | None = None
    offset: int = 0


def side(label: str) -> str:
    """left, right or whole, by the end of a channel's label."""
    found = re.search(r"-(left|right)$", label)
    return found[1] if found else "whole"


def seen_from_left(m: tuple[float, ...], width: int) -> tuple[float, ...]:
    """F M^-1 F with F the mirror of a half: the matrix that brings left onto right, seen in the mirrored left half."""
    mirror = np.array([[-1.0, 0, width - 1], [0, 1, 0], [0, 0, 1]])
    whole = np.array([[*m[:3]], [*m[3:]], [0, 0, 1]], float)
    out = mirror @ np.linalg.inv(whole) @ mirror
    return tuple(out[:2].ravel())


def outputs(
    spark: SparkSession, labels: list[str], chosen: list[int], operation: str, width: int, matrix: tuple[float, ...] | None = None,
    tagged: dict[str, tuple[float, ...]] | None = None, reference: str | None = None, flip_side: str = "right",
) -> list[Output]:
    """The channels of a view, in the order of ``chosen`` (numbers of stored channels with these labels).

    ``stored`` changes nothing; ``side_by_side`` puts the right half of an acquisition channel after its left one,
    also where only one of them is chosen; ``flip`` mirrors the halves of ``flip_side``. The two others mirror
    the right (left) halves and bring them onto the other side: by the bare ``matrix`` of right halves, or by a ``tagged`` set
    (label to matrix) with its ``reference``. ``width`` is that of a half.
    """
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation {operation}; known: {', '.join(OPERATIONS)}")
    if operation == "side_by_side" and any(side(labels[c]) != "whole" for c in chosen):
        base = [re.sub(r"-(left|right)$", "", x) for x in labels]
        wanted = list(dict.fromkeys(base[c] for c in chosen))
        return [Output(wanted.index(base[c]), c, offset=width if side(x) == "right" else 0) for c, x in enumerate(labels) if base[c] in wanted]
    if operation in ("stored", "side_by_side"):
        return [Output(i, c) for i, c in enumerate(chosen)]
    if operation == "flip":
        return [Output(i, c, side(labels[c]) == flip_side) for i, c in enumerate(chosen)]
    turned = "right" if operation == "flip_align_right" else "left"
    if tagged:
        known = spark.createDataFrame([(k, *map(float, m), k == reference) for k, m in tagged.items()], f"source string, {SIX}, is_reference boolean")
        sources = spark.createDataFrame([(labels[c], int((re.search(r"_Channel(\d+)", labels[c]) or [0, 0])[1]), side(labels[c])) for c in chosen], "source string, channel int, side string")
        placed = {r["source"]: r for r in placements(sources, known, turned == "left", width).collect()}  # a row a channel
        return [Output(i, c, placed[labels[c]]["mirror"], None if placed[labels[c]]["m00"] is None else tuple(placed[labels[c]])[2:8]) for i, c in enumerate(chosen)]
    own = matrix if matrix is None or turned == "right" else seen_from_left(matrix, width)
    return [Output(i, c, side(labels[c]) == turned, own if side(labels[c]) == turned else None) for i, c in enumerate(chosen)]


def _source_box(out: Output, box: tuple[int, ...], width: int, height: int) -> tuple[int, int, int, int] | None:
    """First and last x, first and last y of the stored plane that a box of the output reads, or None."""
    x0, x1, y0, y1 = box[:4]
    x0, x1 = x0 - out.offset, x1 - out.offset
    if out.matrix is not None:
        inverse = np.linalg.inv(np.array([out.matrix[:3], out.matrix[3:], (0, 0, 1)], float))
        corners = np.array([(x, y, 1) for x in (x0, x1) for y in (y0, y1)]) @ inverse[:2].T
        (x0, y0), (x1, y1) = (np.floor(corners.min(axis=0)) - MARGIN).astype(int), (np.ceil(corners.max(axis=0)) + MARGIN).astype(int)
    x0, x1, y0, y1 = max(x0, 0), min(x1, width - 1), max(y0, 0), min(y1, height - 1)
    if x0 > x1 or y0 > y1:
        return None
    return (width - 1 - x1, width - 1 - x0, y0, y1) if out.flip else (x0, x1, y0, y1)


def _made(rows: DataFrame, out: Output, width: int, height: int, box: tuple[int, ...] | None) -> DataFrame:
    """Stored voxels of one channel as voxels of its output."""
    if out.matrix is not None:
        done = resample.align_voxels(rows, list(out.matrix), width, height, out.flip, None if box is None else box[:4])
    else:
        x = width - 1 - F.col("x") if out.flip else F.col("x")
        done = rows.withColumn("x", x + out.offset)
    return done.withColumn("c", F.lit(out.slot).cast("long")).select(*[F.col(k).cast("long").alias(k) for k in ("t", "c", "z", "y", "x", "v")])


def stored_view(voxels: DataFrame | Callable[[], DataFrame], channels: list[Output], width: int, height: int, box: tuple[int, ...] | None = None, times: tuple[int, int] | None = None) -> DataFrame:
    """Voxels (t, c, z, y, x, v) of a view, c by slot; with a box (first and last x, y and z) numbered from its corner.

    ``voxels`` are a store's (c from 0), or what opens them: a pruned read is opened for each channel. Each channel
    filters the scan by its own rectangle, by the planes and times; a projection, which has lost an
    axis, takes no box.
    """
    opened = voxels if callable(voxels) else lambda: voxels
    parts = []
    for out in channels:
        own = opened().filter(F.col("c") == out.source)
        if times is not None:
            own = own.filter((F.col("t") >= times[0]) & (F.col("t") <= times[1]))
        if box is not None:
            own = own.filter((F.col("z") >= box[4]) & (F.col("z") <= box[5]))
            inside = _source_box(out, box, width, height)
            if inside is None and out.matrix is None:
                continue
            x0, x1, y0, y1 = inside or (0, 0, 0, 0)  # what lies outside all planes is zero
            own = own.filter((F.col("x") >= x0) & (F.col("x") <= x1) & (F.col("y") >= y0) & (F.col("y") <= y1))
        parts.append(_made(own, out, width, height, box))
    if not parts:
        return _made(opened().limit(0), Output(0, 0), width, height, None)
    whole = reduce(DataFrame.unionByName, parts)
    if box is None:
        return whole
    return whole.withColumns({k: F.col(k) - box[2 * i] for i, k in enumerate("xyz")})


def complete_times(voxels: DataFrame, channels: list[int]) -> DataFrame:
    """``t`` of the time points at which all these channels are there."""
    own = voxels.filter(F.col("c").isin(channels)).groupBy("t").agg(F.countDistinct("c").alias("n"))
    return own.filter(F.col("n") == len(set(channels))).select("t")


def channel_operation(volume: DataFrame, channels: list[Output], width: int, height: int) -> tuple[DataFrame, DataFrame]:
    """(volume, projections) of results after an operation, only of time points that all channels have.

    Projections are made anew from the aligned volume: those of the unaligned one, aligned as images, would differ
    wherever the alignment turns or shears.
    """
    times = complete_times(volume, [out.source for out in channels])
    done = stored_view(volume.join(times, "t", "left_semi"), channels, width, height)
    return done, project.six_projections(done)


def operated_projections(pixels: DataFrame, channels: list[Output], width: int, height: int) -> DataFrame:
    """Projections (view, t, c, h, w, v) of results that have no volume, after an operation.

    Only a Z projection holds the plane that the operation is defined in; views of other axes are left out.
    """
    own = pixels.filter(F.lower(F.substring("view", -1, 1)) == "z")
    times = own.filter(F.col("c").isin([out.source for out in channels])).groupBy("view", "t").agg(F.countDistinct("c").alias("n"))
    own = own.join(times.filter(F.col("n") == len({out.source for out in channels})), ["view", "t"], "left_semi")
    names = own.select("view").distinct().collect()  # the kinds of projections there are
    parts = []
    for r in names:
        flat = own.filter(F.col("view") == r["view"]).select("t", "c", F.lit(0).alias("z"), F.col("h").alias("y"), F.col("w").alias("x"), "v")
        done = stored_view(flat, channels, width, height)
        parts.append(done.select(F.lit(r["view"]).alias("view"), "t", "c", F.col("y").alias("h"), F.col("x").alias("w"), "v"))
    empty = pixels.limit(0).select("view", *[F.col(k).cast("long").alias(k) for k in ("t", "c", "h", "w", "v")])
    return reduce(DataFrame.unionByName, parts, empty)


def whole_box(width: int, height: int, depth: int, operation: str = "stored") -> tuple[int, ...]:
    """The box of all pixels of a view of halves ``width`` wide."""
    return (0, (2 * width if operation == "side_by_side" else width) - 1, 0, height - 1, 0, depth - 1)
