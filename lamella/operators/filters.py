"""Neighbourhood filters: separable Gaussian by windows, plane kernels by Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gaussian_weights(sigma: float, radius: int) -> list[float]:
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return (w / w.sum()).tolist()


def gaussian(voxels: DataFrame, axis: str, sigma: float, radius: int) -> DataFrame:
    """Gaussian along an axis with clamped edges: a sum of lags over each line of voxels, JVM only."""
    line = Window.partitionBy("t", "c", *[k for k in "zyx" if k != axis]).orderBy(axis)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first("v").over(whole), F.last("v").over(whole)
    total = F.lit(0.0)
    for d, w in zip(range(-radius, radius + 1), gaussian_weights(sigma, radius)):
        moved = F.lag("v", -d).over(line) if d < 0 else F.lead("v", d).over(line)
        value = F.coalesce(moved, first if d < 0 else last) if d else F.col("v")
        total = total + value * w
    return voxels.withColumn("v", total)


def gaussian_x(voxels: DataFrame, sigma: float, radius: int) -> DataFrame:
    return gaussian(voxels, "x", sigma, radius)


def gaussian_plane(image: np.ndarray, sigma: float, radius: int) -> np.ndarray:
    w = np.array(gaussian_weights(sigma, radius))
    for axis in (0, 1):
        pad = [(radius, radius) if a == axis else (0, 0) for a in (0, 1)]
        wide = np.pad(image, pad, mode="edge")
        image = sum(w[k] * np.take(wide, range(k, k + image.shape[axis]), axis=axis) for k in range(2 * radius + 1))
    return image


def median_plane(image: np.ndarray, radius: int) -> np.ndarray:
    """Median over the disc of a radius, edges clamped."""
    wide = np.pad(image, radius, mode="edge")
    views = np.lib.stride_tricks.sliding_window_view(wide, (2 * radius + 1, 2 * radius + 1))
    dy, dx = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    return np.median(views[:, :, dy * dy + dx * dx <= radius * radius + radius], axis=2)


def per_plane(planes: DataFrame, kernel, *arguments) -> DataFrame:
    """A numpy kernel on every plane row (``width, height, px``): no shuffle, one Arrow batch at a time."""
    names, types = planes.columns, ", ".join(f"{f.name} {'array<double>' if f.name == 'px' else f.dataType.simpleString()}" for f in planes.schema.fields)
    place = names.index("px")

    def run(batches):
        for batch in batches:
            w, h = batch.column("width").to_pylist(), batch.column("height").to_pylist()
            out = []
            for px, x, y in zip(batch.column("px"), w, h):
                image = np.asarray(px.values.to_numpy(zero_copy_only=False), dtype=float).reshape(y, x)
                out.append(kernel(image, *arguments).ravel())
            columns = list(batch.columns)
            columns[place] = pa.array(out, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return planes.mapInArrow(run, types)
