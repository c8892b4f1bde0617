"""Grouped numpy kernels: sample regions, maxima, deconvolution.

Each kernel is a small function over arrays; Spark groups the rows so that a group
is one camera column, one pair of images, or one tile with its halo.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components_of(mask: np.ndarray) -> np.ndarray:
    """4-connected labels (from 1) of a plane by union-find."""
    labels, parent = np.zeros(mask.shape, int), [0]

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for y, x in zip(*np.nonzero(mask)):
        near = sorted({top(labels[q]) for q in ((y - 1, x), (y, x - 1)) if min(q) >= 0 and labels[q]})
        if near:
            labels[y, x] = near[0]
            for other in near[1:]:
                parent[other] = near[0]
        else:
            parent.append(len(parent))
            labels[y, x] = len(parent) - 1
    roots = {r: i + 1 for i, r in enumerate(sorted({top(i) for i in range(1, len(parent))}))}
    return np.vectorize(lambda i: roots[top(i)] if i else 0, otypes=[int])(labels)


def sample_region(planes: DataFrame, threshold: float) -> DataFrame:
    """Bounding box of the largest component above a threshold and the number of components."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                labels = components_of(np.array(r.px, float).reshape(r.height, r.width) > threshold)
                count = np.bincount(labels.ravel())[1:]
                if len(count):
                    y, x = np.nonzero(labels == count.argmax() + 1)
                    out.append((r.t, r.c, r.z, int(x.min()), int(y.min()), int(x.max() - x.min() + 1), int(y.max() - y.min() + 1), len(count)))
            yield pd.DataFrame(out, columns=["t", "c", "z", "x", "y", "w", "h", "parts"])

    return planes.select("t", "c", "z", "width", "height", "px").mapInPandas(run, "t long, c long, z long, x long, y long, w long, h long, parts long")


def richardson_lucy(image: np.ndarray, psf: np.ndarray, rounds: int, variation: float = 0.0) -> np.ndarray:
    """FFT deconvolution of a tile, optionally damped by total variation."""
    shape = image.shape
    kernel = np.zeros(shape)
    kernel[tuple(slice(0, n) for n in psf.shape)] = psf / psf.sum()
    kernel = np.roll(kernel, [-(n // 2) for n in psf.shape], axis=tuple(range(psf.ndim)))
    axes = tuple(range(len(shape)))
    otf = np.fft.rfftn(kernel)
    estimate = np.full(shape, max(image.mean(), 1e-6))
    for _ in range(rounds):
        blurred = np.fft.irfftn(np.fft.rfftn(estimate) * otf, shape, axes)
        ratio = image / np.maximum(blurred, 1e-6)
        gain = np.fft.irfftn(np.fft.rfftn(ratio) * np.conj(otf), shape, axes)
        if variation:
            slope = np.stack(np.gradient(estimate))
            norm = np.sqrt((slope**2).sum(0)) + 1e-6
            divergence = sum(np.gradient(slope[i] / norm, axis=i) for i in range(len(shape)))
            gain = gain / np.maximum(1 - variation * divergence, 0.1)
        estimate = np.maximum(estimate * gain, 0)
    return estimate


def deconvolve(voxels: DataFrame, psf: np.ndarray, extents: tuple[int, int, int], tile: tuple[int, int, int], rounds: int = 10, variation: float = 0.0) -> DataFrame:
    """Tiled deconvolution: voxels are copied into every tile whose halo holds them, tiles are groups.

    ``psf`` and ``tile`` are in (z, y, x). The halo is half the point-spread function, at
    most a tile; a tile's result is kept inside its core only. The tile's box follows from its
    place, so absent voxels are zeros and the whole core is emitted.
    """
    halo = [min(n // 2, t) for n, t in zip(psf.shape, tile)]
    ends = (extents[2], extents[1], extents[0])
    out = voxels
    for k, t, h, n in zip("zyx", tile, halo, ends):
        first = F.greatest(F.floor((F.col(k) - h) / t), F.lit(0))
        last = F.least(F.floor((F.col(k) + h) / t), F.lit((n - 1) // t))
        out = out.withColumn(f"_{k}", F.explode(F.sequence(first, last)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        place = [int(k) for k in key[2:]]
        low = [max(0, p * t - h) for p, t, h in zip(place, tile, halo)]
        high = [min(n, (p + 1) * t + h) for p, t, h, n in zip(place, tile, halo, ends)]
        image = np.zeros([b - a for a, b in zip(low, high)])
        image[tuple(pdf[k] - a for k, a in zip("zyx", low))] = pdf["v"]
        pads = [(0, max(0, p - n)) for p, n in zip(psf.shape, image.shape)]
        done = richardson_lucy(np.pad(image, pads), psf, rounds, variation)
        core = [(p * t, min(n, (p + 1) * t)) for p, t, n in zip(place, tile, ends)]
        done = done[tuple(slice(a - o, b - o) for (a, b), o in zip(core, low))]
        z, y, x = np.indices(done.shape).reshape(3, -1)
        return pd.DataFrame({"t": key[0], "c": key[1], "z": z + core[0][0], "y": y + core[1][0], "x": x + core[2][0], "v": done.ravel()})

    return out.groupBy("t", "c", "_z", "_y", "_x").applyInPandas(run, "t long, c long, z long, y long, x long, v double")


def prominent_maxima(image: np.ndarray, tolerance: float) -> list[tuple[int, int]]:
    """Maxima that stand at least ``tolerance`` above the saddle to any higher ground (flooding from the top)."""
    h, w = image.shape
    order = np.argsort(-image, axis=None, kind="stable")
    owner = np.full(h * w, -1)
    flat = image.ravel()
    peaks: dict[int, int] = {}

    def top(i):
        while peaks[i] != i:
            i = peaks[i]
        return i

    kept = []
    for p in order:
        y, x = divmod(int(p), w)
        near = {top(owner[q]) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and 0 <= y + dy < h and 0 <= x + dx < w and owner[q := (y + dy) * w + x + dx] >= 0}
        if not near:
            peaks[int(p)] = int(p)
            owner[p] = p
            continue
        best = max(near, key=lambda i: (flat[i], -i))
        for other in near - {best}:
            if flat[other] - flat[p] >= tolerance:
                kept.append(other)
            peaks[other] = best
        owner[p] = best
    kept += [i for i in peaks if peaks[i] == i and flat[i] - flat.min() >= tolerance]
    return sorted(divmod(int(i), w) for i in set(kept))


def tolerance_for(image: np.ndarray, wanted: int, steps: int = 10) -> tuple[float, int]:
    """Tolerance that yields about ``wanted`` maxima: at most ``steps`` bisections, within 5 % or one."""
    lo, hi = 0.0, float(image.max() - image.min())
    best = (hi, len(prominent_maxima(image, hi)))
    for _ in range(steps):
        middle = (lo + hi) / 2
        n = len(prominent_maxima(image, middle))
        if abs(n - wanted) < abs(best[1] - wanted):
            best = (middle, n)
        if abs(n - wanted) <= max(1, 0.05 * wanted):
            return middle, n
        lo, hi = (middle, hi) if n > wanted else (lo, middle)
    return best


def maxima(planes: DataFrame, tolerance: float | None = None, wanted: int | None = None) -> DataFrame:
    """Prominent maxima of every plane row, by a tolerance or by a wanted number."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                image = np.array(r.px, float).reshape(r.height, r.width)
                level = tolerance if wanted is None else tolerance_for(image, wanted)[0]
                out += [(r.t, r.c, y, x, float(image[y, x])) for y, x in prominent_maxima(image, level)]
            yield pd.DataFrame(out, columns=["t", "c", "y", "x", "v"])

    return planes.select("t", "c", "width", "height", "px").mapInPandas(run, "t long, c long, y long, x long, v double")
