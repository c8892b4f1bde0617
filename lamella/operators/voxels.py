"""Row-wise geometry of voxel tables: crop, split, flip, permute, scale, pad, decimate.

A voxel table has the key columns ``t, c, z, y, x`` and a value ``v``. All operators
here are filters and coordinate arithmetic: no shuffle, except where an operator needs
neighbours (``scale``, ``interpolate_z``) or a generated grid (``fit_to_size``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["t", "c", "z", "y", "x"]


def clamp_box(x: int, y: int, w: int, h: int, z0: int, z1: int, width: int, height: int, depth: int) -> tuple[int, ...]:
    """(x0, x1, y0, y1, z0, z1), inclusive, inside the extent; w or h <= 0 takes the full axis; never empty."""

    def axis(start, size, extent):
        if size <= 0:
            return 0, extent - 1
        lo = min(max(start, 0), extent - 1)
        return lo, min(max(start + size - 1, lo), extent - 1)

    zlo = min(max(z0, 0), depth - 1)
    return (*axis(x, w, width), *axis(y, h, height), zlo, min(max(z1, zlo), depth - 1))


def region(voxels: DataFrame, box: tuple[int, ...]) -> DataFrame:
    """Voxels inside the inclusive box, with coordinates moved to its corner; the filter reaches the scan."""
    x0, x1, y0, y1, z0, z1 = box
    inside = voxels.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1) & F.col("z").between(z0, z1))
    return inside.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0, "z": F.col("z") - z0})


def half_width(width: int, midline: str = "floor") -> int:
    """Width of a half; ``share`` lets both halves own the middle column of an odd width."""
    return (width + 1) // 2 if midline == "share" else width // 2


def split_half(voxels: DataFrame, width: int, side: str, midline: str = "floor") -> DataFrame:
    """Left or right half; the right one starts at ``width - half`` and is moved to 0."""
    half = half_width(width, midline)
    if side == "left":
        return voxels.filter(F.col("x") < half)
    start = width - half
    return voxels.filter(F.col("x") >= start).withColumn("x", F.col("x") - start)


def channel_parts(voxels: DataFrame, width: int, option: str) -> DataFrame:
    """Parts by option (whole, left, right, separate, fold), labelled by ``part``."""
    if option == "whole":
        return voxels.withColumn("part", F.lit("whole"))
    if option in ("left", "right"):
        return split_half(voxels, width, option).withColumn("part", F.lit(option))
    half = half_width(width)
    right = F.col("x") >= width - half
    moved = F.col("x") - (width - half)
    if option == "fold":
        moved = half - 1 - moved
    elif option != "separate":
        raise ValueError(f"unknown option {option}")
    kept = voxels.filter((F.col("x") < half) | right)
    return kept.withColumns({"part": F.when(right, "right").otherwise("left"), "x": F.when(right, moved).otherwise(F.col("x"))})


def flip(voxels: DataFrame, axis: str, extent: int) -> DataFrame:
    """Mirror an axis: x becomes extent - 1 - x."""
    return voxels.withColumn(axis, extent - 1 - F.col(axis))


def fold_x(voxels: DataFrame, width: int) -> DataFrame:
    """Mirrored right half as channel 2 over the left half as channel 1."""
    parts = channel_parts(voxels, width, "fold")
    return parts.withColumn("c", F.when(F.col("part") == "right", 2).otherwise(1)).drop("part")


ORDERS = ("xyz", "xzy", "yxz", "yzx", "zxy", "zyx")


def permute(voxels: DataFrame, order: str) -> DataFrame:
    """New x, y, z are the named old axes; an unknown order leaves the volume as it is."""
    order = order.lower()
    if order not in ORDERS:
        return voxels
    return voxels.select(*[c for c in voxels.columns if c not in "xyz"], *[F.col(old).alias(new) for new, old in zip("xyz", order)])


def pad_or_crop(voxels: DataFrame, extents: dict[str, int], size: dict[str, int]) -> DataFrame:
    """Exact size at the far edge: larger axes are cut, smaller ones filled with zeros."""
    kept = voxels.filter(reduce(lambda a, b: a & b, [F.col(k) < n for k, n in size.items()]))
    planes = voxels.select("t", "c").distinct()
    zeros = []
    inner = {k: min(extents[k], size[k]) for k in size}
    # The missing voxels are three slabs: beyond z; beyond y inside z; beyond x inside y and z.
    for slab, fixed in (("z", ()), ("y", ("z",)), ("x", ("z", "y"))):
        if size[slab] <= inner[slab]:
            continue
        grid = planes
        for k in "zyx":
            lo, hi = (inner[k], size[k]) if k == slab else (0, inner[k] if k in fixed else size[k])
            grid = grid.withColumn(k, F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))))
        zeros.append(grid.select("t", "c", "z", "y", "x", F.lit(0).alias("v")))
    return reduce(DataFrame.unionByName, zeros, kept.select(*KEYS, "v"))


def _scaled(voxels: DataFrame, axis: str, n_in: int, n_out: int) -> DataFrame:
    """Linear resampling of one axis with both ends kept. Each input row feeds the few outputs around it."""
    others = [k for k in KEYS if k != axis]
    ratio = (n_in - 1) / (n_out - 1) if n_out > 1 else 0.0
    reach = 1 / ratio if ratio else float(n_out)
    first = F.greatest(F.lit(0), F.floor((F.col(axis) - 1) * reach).cast("int"))
    last = F.least(F.lit(n_out - 1), F.ceil((F.col(axis) + 1) * reach).cast("int"))
    fed = voxels.withColumn("_out", F.explode(F.sequence(first, last)))
    weight = F.lit(1.0) - F.abs(F.col("_out") * F.lit(ratio) - F.col(axis))
    return (
        fed.withColumn("_w", weight).filter("_w > 1e-12").groupBy(*others, F.col("_out").alias(axis)).agg(F.sum(F.col("_w") * F.col("v")).alias("v"))
    )


def scale(voxels: DataFrame, sizes: dict[str, tuple[int, int]]) -> DataFrame:
    """Resample axes linearly: ``{axis: (size in, size out)}``, each axis by its own factor."""
    out = voxels
    for axis, (n_in, n_out) in sizes.items():
        if n_in != n_out:
            out = _scaled(out, axis, n_in, n_out)
    return out


def decimate(voxels: DataFrame, factor: int, phase: int) -> DataFrame:
    """Every factor-th plane from a phase, renumbered."""
    return voxels.filter((F.col("z") >= phase) & ((F.col("z") - phase) % factor == 0)).withColumn("z", F.floor((F.col("z") - phase) / factor).cast("long"))


def interpolate_z(voxels: DataFrame, factor: int) -> DataFrame:
    """(n-1) * factor + 1 planes by linear interpolation along z, in one window over each column of voxels."""
    line = Window.partitionBy("t", "c", "y", "x").orderBy("z")
    ahead = voxels.withColumn("_next", F.lead("v").over(line))
    steps = F.sequence(F.lit(0), F.when(F.col("_next").isNull(), 0).otherwise(factor - 1))
    out = ahead.withColumn("_k", F.explode(steps))
    value = F.col("v") + F.coalesce(F.col("_next") - F.col("v"), F.lit(0)) * (F.col("_k") / factor)
    return out.select("t", "c", (F.col("z") * factor + F.col("_k")).alias("z"), "y", "x", value.cast("double").alias("v"))


def zero_extended(voxels: DataFrame, dz: float, dy: float, dx: float) -> DataFrame:
    """Trilinear value at (z + dz, y + dy, x + dx) for every voxel, zero outside; fractions in [0, 1)."""
    corners = [(a, b, c, (dz if a else 1 - dz) * (dy if b else 1 - dy) * (dx if c else 1 - dx)) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    fed = voxels.withColumn("_k", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"), F.lit(w).alias("w")) for a, b, c, w in corners if w])))
    moved = fed.select("t", "c", (F.col("z") - F.col("_k.a")).alias("z"), (F.col("y") - F.col("_k.b")).alias("y"), (F.col("x") - F.col("_k.c")).alias("x"), (F.col("v") * F.col("_k.w")).alias("v"))
    return moved.filter("z >= 0 AND y >= 0 AND x >= 0").groupBy(*KEYS).agg(F.sum("v").alias("v"))


def side_by_side(left: DataFrame, right: DataFrame, left_width: int) -> DataFrame:
    """Two volumes next to each other along x."""
    return left.select(*KEYS, "v").unionByName(right.select(*KEYS, "v").withColumn("x", F.col("x") + left_width))


def concatenate(parts: list[DataFrame], axis: str, extents: list[int], backwards: bool = False) -> DataFrame:
    """Join parts end to end along an axis."""
    if backwards:
        parts, extents = parts[::-1], extents[::-1]
    out, start = [], 0
    for part, extent in zip(parts, extents):
        out.append(part.withColumn(axis, F.col(axis) + start))
        start += extent
    return reduce(DataFrame.unionByName, out)


def split_axis(voxels: DataFrame, axis: str, extent: int, parts: int) -> DataFrame:
    """``part`` and coordinates inside the part, for parts of equal length (the last may be shorter)."""
    length = -(-extent // parts)
    return voxels.withColumns({"part": F.floor(F.col(axis) / length).cast("long"), axis: (F.col(axis) % length).cast("long")})


def reassign(voxels: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Exchange the roles of c, z and t: ``{new: old}``."""
    return voxels.select(*[F.col(roles.get(k, k)).alias(k) for k in KEYS], "v")


def plane_index(t: Column, z: Column, c: Column, depth: int, channels: int) -> Column:
    """Linear plane number with the channel fastest, then z, then t (all from 0)."""
    return (t * depth + z) * channels + c


def plane_position(index: Column, depth: int, channels: int) -> dict[str, Column]:
    """Inverse of ``plane_index``."""
    return {
        "c": index % channels,
        "z": F.floor(index / channels).cast("long") % depth,
        "t": F.floor(index / (channels * depth)).cast("long"),
    }


def to_planes(voxels: DataFrame, width: int, height: int) -> DataFrame:
    """Planes with ``px`` in row order."""
    pixels = F.array_sort(F.collect_list(F.struct("y", "x", "v")))
    return voxels.groupBy("t", "c", "z").agg(F.transform(pixels, lambda p: p["v"]).alias("px")).withColumns({"width": F.lit(width), "height": F.lit(height)})


def to_voxels(planes: DataFrame) -> DataFrame:
    out = planes.select("t", "c", "z", "width", F.posexplode("px").alias("pos", "v"))
    return out.select("t", "c", "z", F.floor(F.col("pos") / F.col("width")).cast("long").alias("y"), (F.col("pos") % F.col("width")).cast("long").alias("x"), "v")
