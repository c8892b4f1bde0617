"""Affine resampling: deskew by x-blocks, alignment per plane, virtual slices."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions import matrix as mx


def sample_bilinear(image: np.ndarray, x: np.ndarray, y: np.ndarray, method: str = "linear") -> np.ndarray:
    """Values at positions; zero outside [0, n-1] (both ends inside)."""
    h, w = image.shape
    inside = (x >= 0) & (x <= w - 1) & (y >= 0) & (y <= h - 1)
    if method == "nearest":
        xi, yi = np.clip(np.floor(x + 0.5).astype(int), 0, w - 1), np.clip(np.floor(y + 0.5).astype(int), 0, h - 1)
        return np.where(inside, image[yi, xi], 0)
    x0, y0 = np.clip(np.floor(x).astype(int), 0, w - 1), np.clip(np.floor(y).astype(int), 0, h - 1)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = x - x0, y - y0
    top = image[y0, x0] * (1 - fx) + image[y0, x1] * fx
    low = image[y1, x0] * (1 - fx) + image[y1, x1] * fx
    return np.where(inside, top * (1 - fy) + low * fy, 0)


def align_plane(image: np.ndarray, m: list[float], method: str = "linear", mirror: bool = False) -> np.ndarray:
    """A plane under a 2x3 matrix (source to target), mirrored first if asked; integer results are rounded half up."""
    if mirror:
        image = image[:, ::-1]
    a = np.array([[m[0], m[1], m[2]], [m[3], m[4], m[5]], [0, 0, 1]], float)
    inv = np.linalg.inv(a)
    y, x = np.mgrid[0 : image.shape[0], 0 : image.shape[1]].astype(float)
    # Guard against coordinates that leave the image by rounding alone.
    sx = np.round(inv[0, 0] * x + inv[0, 1] * y + inv[0, 2], 9)
    sy = np.round(inv[1, 0] * x + inv[1, 1] * y + inv[1, 2], 9)
    return np.floor(sample_bilinear(image, sx, sy, method) + 0.5)


def align_voxels(voxels: DataFrame, m: list[float], width: int, height: int, mirror: bool = False, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """The same alignment as a relation: each source voxel feeds the target pixels it can reach.

    A pixel's footprint under a near-rigid matrix is about two pixels wide: the rows it can reach are
    one short interval, and in each of them the columns are another, so a voxel becomes about
    five rows, in the JVM. Each voxel's own place is fed with nothing, so that pixels whose source lies
    outside come out as zero and projections of the result count them. With a ``box`` (first and last x, first and
    last y of the result) only its pixels are made, all of them for each plane that has a voxel.
    """
    x0, x1, y0, y1 = box or (0, width - 1, 0, height - 1)
    a = np.array([[m[0], m[1], m[2]], [m[3], m[4], m[5]], [0, 0, 1]], float)
    inv = np.linalg.inv(a)
    x = width - 1 - F.col("x") if mirror else F.col("x")
    src = voxels.select("t", "c", "z", F.col("y").alias("sy"), x.alias("sx"), "v")
    slack = 1e-6
    reach = float(np.abs(a[1, :2]).sum()) + slack
    centre = a[1, 0] * F.col("sx") + a[1, 1] * F.col("sy") + a[1, 2]
    low, high = F.greatest(F.ceil(centre - reach), F.lit(y0)), F.least(F.floor(centre + reach), F.lit(y1))
    fed = src.filter(low <= high).withColumn("y", F.explode(F.sequence(low, high)))
    # Columns x of that row with |inv[0] . (x, y, 1) - sx| < 1.
    middle = (F.col("sx") - inv[0, 1] * F.col("y") - inv[0, 2]) / inv[0, 0]
    half = abs(1 / inv[0, 0]) + slack
    first, last = F.greatest(F.ceil(middle - half), F.lit(x0)), F.least(F.floor(middle + half), F.lit(x1))
    fed = fed.filter(first <= last).withColumn("x", F.explode(F.sequence(first, last)))
    px = F.round(inv[0, 0] * F.col("x") + inv[0, 1] * F.col("y") + inv[0, 2], 9)
    py = F.round(inv[1, 0] * F.col("x") + inv[1, 1] * F.col("y") + inv[1, 2], 9)
    fed = fed.withColumns({"px": px, "py": py}).filter(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1))
    weight = F.greatest(1 - F.abs(F.col("px") - F.col("sx")), F.lit(0.0)) * F.greatest(1 - F.abs(F.col("py") - F.col("sy")), F.lit(0.0))
    fed = fed.withColumn("w", weight).filter("w > 0").select("t", "c", "z", "y", "x", (F.col("w") * F.col("v")).alias("v"))
    if box:
        own = src.select("t", "c", "z").distinct()
        for k, (a, b) in {"y": (y0, y1), "x": (x0, x1)}.items():
            own = own.withColumn(k, F.explode(F.sequence(F.lit(a).cast("long"), F.lit(b).cast("long"))))
        own = own.withColumn("v", F.lit(0.0))
    else:
        own = src.select("t", "c", "z", F.col("sy").alias("y"), F.col("sx").alias("x"), F.lit(0.0).alias("v"))
    return fed.union(own).groupBy("t", "c", "z", "y", "x").agg(F.floor(F.sum("v") + 0.5).cast("long").alias("v"))


def bounding(m: np.ndarray, extents: tuple[int, int, int]) -> tuple[np.ndarray, tuple[int, int, int]]:
    """The matrix moved so that the transformed box starts at zero, and the ceiled size (x, y, z) of that box."""
    corners = np.array([[x, y, z, 1] for x in (0, extents[0]) for y in (0, extents[1]) for z in (0, extents[2])], float) @ m.T
    low, high = corners[:, :3].min(axis=0), corners[:, :3].max(axis=0)
    return mx.translate(*-low) @ m, tuple(max(1, math.ceil(n - 1e-9)) for n in high - low)


def affine(voxels: DataFrame, m: np.ndarray, extents: tuple[int, int, int], size: tuple[int, int, int] | None = None) -> DataFrame:
    """Trilinear resampling of every (t, c) under any invertible matrix: dense, zero outside the source.

    Without ``size`` the output is the bounding box of the transformed extents. Which corners an output voxel reads does not
    depend on the volume, so the table of places and weights is made in Spark once and joined by place for all
    volumes: no group holds a volume. A matrix that leaves x unmixed is cheaper by ``deskew``.
    """
    if size is None:
        m, size = bounding(m, extents)
    inv = np.linalg.inv(m)
    volumes = voxels.select("t", "c").distinct()
    grid = voxels.sparkSession.range(size[2]).withColumnRenamed("id", "z")
    for axis, n in zip("yx", size[1::-1]):
        grid = grid.withColumn(axis, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    place = [F.round(float(r[0]) * F.col("x") + float(r[1]) * F.col("y") + float(r[2]) * F.col("z") + float(r[3]), 9) for r in inv[:3]]
    asked = grid.withColumns(dict(zip(("px", "py", "pz"), place)))
    inside = F.lit(True)
    corners = None
    for k, n in zip("xyz", extents):
        p = F.col(f"p{k}")
        inside = inside & p.between(0, n - 1)
        pair = F.filter(F.array(*[F.struct(e.cast("long").alias("at"), (1 - F.abs(p - e)).alias("w")) for e in (F.floor(p), F.floor(p) + 1)]), lambda e: e["w"] > 0)
        corners = [*(corners or []), (k, pair)]
    fed = asked.filter(inside)
    for k, pair in corners:
        fed = fed.withColumn(f"c{k}", F.explode(pair))
    fed = fed.select("z", "y", "x", *[F.col(f"c{k}.at").alias(f"s{k}") for k in "xyz"], (F.col("cx.w") * F.col("cy.w") * F.col("cz.w")).alias("w"))
    source = voxels.select("t", "c", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"), "v")
    met = source.join(fed, ["sx", "sy", "sz"]).select("t", "c", "z", "y", "x", (F.col("w") * F.col("v")).alias("v"))
    empty = volumes.crossJoin(grid).select("t", "c", "z", "y", "x", F.lit(0.0).alias("v"))
    return met.union(empty).groupBy("t", "c", "z", "y", "x").agg(F.floor(F.sum("v") + 0.5).cast("long").alias("v"))


def deskew_block(block: np.ndarray, m: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Trilinear resampling of (x, z, y) lines under a matrix that leaves x unmixed."""
    inv = np.linalg.inv(m)
    height, depth = shape
    zo, yo = np.mgrid[0:depth, 0:height].astype(float)
    yi = np.round(inv[1, 1] * yo + inv[1, 2] * zo + inv[1, 3], 9)
    zi = np.round(inv[2, 1] * yo + inv[2, 2] * zo + inv[2, 3], 9)
    return np.stack([sample_bilinear(plane, yi, zi) for plane in block])


def deskewed_size(step: float, pixel: float, angle: float, extents: tuple[int, int, int]) -> tuple[int, int, int]:
    """Width, height and depth of the deskewed box."""
    width, height, depth = extents
    a = math.radians(angle)
    return width, math.ceil(math.cos(a) * (height - 1) + step / pixel * (depth - 1)) + 1, math.ceil(math.sin(a) * (height - 1)) + 1


def deskew(voxels: DataFrame, step: float, pixel: float, angle: float, extents: tuple[int, int, int], block: int = 4) -> DataFrame:
    """Deskewed volume of every (t, c), grouped by blocks of x.

    The matrix leaves x unmixed, so blocks of x transform alone: the group is one block
    of one volume whatever the width. The whole output box is emitted, zeros included, so that
    means, minima and medians of the result count what lies outside the scan.
    """
    width, height, depth = extents
    m = mx.deskew(step, pixel, angle, height)
    _, out_h, out_d = deskewed_size(step, pixel, angle, extents)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(key[2]) * block
        n = min(block, width - first)
        raw = np.zeros((n, depth, height))
        raw[pdf["x"] - first, pdf["z"], pdf["y"]] = pdf["v"]
        out = np.floor(deskew_block(raw, m, (out_h, out_d)) + 0.5).astype(np.int64)
        x, z, y = np.indices(out.shape).reshape(3, -1)
        return pd.DataFrame({"t": key[0], "c": key[1], "z": z, "y": y, "x": x + first, "v": out.ravel()})

    keyed = voxels.filter(F.col("x") < width).withColumn("_b", F.floor(F.col("x") / block))
    return keyed.groupBy("t", "c", "_b").applyInPandas(run, "t long, c long, z long, y long, x long, v long")


def covered_planes(step: float, pixel: float, angle: float, extents: tuple[int, int, int], z_out: tuple[int, int], y_out: tuple[int, int]) -> list[tuple[int, int, int]]:
    """Raw (plane, first row, last row) cells that a box of the deskewed volume reads, never fewer.

    Each raw plane meets the box in an interval of rows, found from both half-plane bounds.
    """
    width, height, depth = extents
    a = math.radians(angle)
    out = []
    for plane in range(depth):
        # A sample between two planes reads both, so a plane serves positions up to one plane away.
        lo_y = (y_out[0] - step / pixel * (plane + 1)) / math.cos(a)
        hi_y = (y_out[1] - step / pixel * (plane - 1)) / math.cos(a)
        lo_z, hi_z = (height - 1) - z_out[1] / math.sin(a), (height - 1) - z_out[0] / math.sin(a)
        first, last = math.floor(max(lo_y, lo_z, 0)) - 1, math.ceil(min(hi_y, hi_z, height - 1)) + 1
        first, last = max(first, 0), min(last, height - 1)
        if first <= last and hi_y >= -1 and lo_y <= height and hi_z >= -1 and lo_z <= height:
            out.append((plane, first, last))
    return out


def virtual_slice(voxels: DataFrame, step: float, pixel: float, angle: float, extents: tuple[int, int, int], z_out: int) -> DataFrame:
    """One plane of the deskewed volume without making it: only the raw rows it covers are read. Outside the scan it is zero."""
    width, height, depth = extents
    m = mx.deskew(step, pixel, angle, height)
    out_h = math.ceil(math.cos(math.radians(angle)) * (height - 1) + step / pixel * (depth - 1)) + 1
    cells = covered_planes(step, pixel, angle, extents, (z_out, z_out), (0, out_h))
    cells = cells or [(0, 0, 0)]
    low, high = min(c[1] for c in cells), max(c[2] for c in cells)
    near = voxels.filter(F.col("z").between(cells[0][0], cells[-1][0]) & F.col("y").between(low, high))
    inv = np.linalg.inv(m)
    # Raw position of output row y on this plane: y_raw is constant, z_raw is linear in y.
    y_raw = inv[1, 1] * 0 + inv[1, 2] * z_out + inv[1, 3]
    rows = near.withColumn("wy", F.greatest(1 - F.abs(F.col("y") - F.lit(float(np.round(y_raw, 9)))), F.lit(0.0))).filter("wy > 0")
    reach = pixel / step
    k = step / pixel
    base = math.cos(math.radians(angle)) * y_raw
    first = F.greatest(F.ceil(F.lit(base) + (F.col("z") - 1) * k), F.lit(0))
    last = F.least(F.floor(F.lit(base) + (F.col("z") + 1) * k), F.lit(out_h - 1))
    fed = rows.filter(first <= last).withColumn("yo", F.explode(F.sequence(first, last)))
    z_raw = F.round((F.col("yo") - base) * reach, 9)
    fed = fed.withColumn("zr", z_raw).filter(F.col("zr").between(0, depth - 1))
    weight = F.col("wy") * F.greatest(1 - F.abs(F.col("zr") - F.col("z")), F.lit(0.0))
    lines = voxels.select("t", "c", "x").distinct().withColumn("yo", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(out_h - 1).cast("long"))))
    values = fed.select("t", "c", "x", F.col("yo").cast("long").alias("yo"), (weight * F.col("v")).alias("v")).union(lines.select("t", "c", "x", "yo", F.lit(0.0).alias("v")))
    return values.groupBy("t", "c", F.col("yo").alias("y"), "x").agg(F.floor(F.sum("v") + 0.5).cast("long").alias("v"))
