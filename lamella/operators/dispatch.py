"""Named operations, calibration and movie concatenation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.operators import project, voxels

OPERATIONS = {
    "flip": voxels.flip, "fold_x": voxels.fold_x, "permute": voxels.permute, "scale": voxels.scale, "decimate": voxels.decimate,
    "interpolate_z": voxels.interpolate_z, "region": voxels.region, "split_half": voxels.split_half, "projection": project.projection,
}


def apply_named(df: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """Apply operations by name, each to every channel and time point at once."""
    for name, arguments in steps:
        if name not in OPERATIONS:
            raise ValueError(f"unknown operation {name}; known: {', '.join(sorted(OPERATIONS))}")
        df = df.transform(OPERATIONS[name], **arguments)
    return df


def calibrated(df: DataFrame, pixel: float, step: float, angle: float, interval: float) -> DataFrame:
    """Physical coordinates: pixel pitch in the plane, depth of a plane along the optical axis, seconds."""
    depth = step * math.sin(math.radians(angle))
    return df.withColumns({
        "x_um": F.col("x") * pixel, "y_um": F.col("y") * pixel, "z_um": F.round(F.col("z") * depth, 6), "seconds": F.col("t") * interval,
    })


def append_movie(first: DataFrame, size: tuple[int, int, int], second: DataFrame, other: tuple[int, int, int], shift: int) -> DataFrame:
    """Frames of a second movie after the first; planes are padded to the larger width and height, depths must agree."""
    if size[2] != other[2]:
        raise ValueError(f"depths differ: {size[2]} and {other[2]}")
    w, h = max(size[0], other[0]), max(size[1], other[1])

    def fit(df, own):
        return voxels.pad_or_crop(df, dict(zip("xyz", own)), {"x": w, "y": h, "z": own[2]})

    return fit(first, size).unionByName(fit(second, other).withColumn("t", F.col("t") + shift))
