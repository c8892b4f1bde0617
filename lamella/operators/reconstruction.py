"""Fourier reconstruction of sparsely scanned volumes, its noise, and the study of scan steps.

A scan of step d under the angle a puts the signal of a raw (scan, row) section into a band about
the line ``scan frequency = slope * row frequency``, slope = d / (pixel cos a). Keeping every m-th
plane repeats the band m times along the scan axis; the mask of half width 1 / (2 m) keeps one copy.
The distance to the band is taken modulo one cycle a sample, as the line wraps round that axis.

The mask does not depend on x, so Spark groups rows into blocks of camera columns, and each
column's section is one padded two-dimensional transform of bounded size inside a task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.operators.sampling_study import NOISE, SUMS

BLOCK = 8  # camera columns a group
BINS = 1 << 21  # transform bins held at a time


@dataclass(frozen=True)
class Scan:
    """Geometry and filter of a reconstruction.

    ``step`` lies between the planes there are, ``factor`` is how much finer the result is; ``padding``
    planes and rows of background surround a section; ``taper`` is the part of the half band that a
    cosine edge takes.
    """

    pixel: float
    step: float
    angle: float
    factor: int = 1
    padding: int = 32
    background: float = 0.0
    taper: float = 0.0

    def __post_init__(self):
        positive = all(math.isfinite(v) and v > 0 for v in (self.pixel, self.step, self.angle))
        if not positive or self.angle >= 89.9 or not 1 <= self.factor <= 64 or not 0 <= self.padding <= 4096 or not math.isfinite(self.background) or not 0 <= self.taper < 1:
            raise ValueError("pitches must be positive, 0 < angle < 89.9, factor 1 to 64, padding 0 to 4096, 0 <= taper < 1")

    @property
    def slope(self) -> float:
        return self.step / self.factor / (self.pixel * math.cos(math.radians(self.angle)))

    def every(self, factor: int, refinement: int = 1) -> Scan:
        """The scan that keeps every ``factor``-th plane of this dense one and is made ``refinement`` times finer than it."""
        return replace(self, step=self.step * factor, factor=factor * refinement)


def padded(extent: int, padding: int) -> int:
    """The least power of two, from 2 on, that holds the extent with padding on both sides."""
    return max(2, 1 << (extent + 2 * padding - 1).bit_length())


def band_distance(nz: int, ny: int, slope: float) -> np.ndarray:
    """Distance of every (scan, row) bin from the band, in cycles a fine sample."""
    offset = np.fft.fftfreq(nz)[:, None] - slope * np.fft.fftfreq(ny)[None, :]
    return np.abs(offset - np.rint(offset))


def _conjugate(bins: np.ndarray) -> np.ndarray:
    return np.roll(bins[::-1, ::-1], 1, axis=(0, 1))


@lru_cache(maxsize=64)
def band_weights(nz: int, ny: int, slope: float, factor: int, taper: float = 0.0) -> np.ndarray:
    """The mask; a bin and its conjugate have the smaller weight of both, so that results are real."""
    if factor == 1:
        return np.ones((nz, ny))
    edge = 0.5 / factor
    d = band_distance(nz, ny, slope)
    inner = edge * (1 - taper)
    fall = 0.5 + 0.5 * np.cos(np.pi * (d - inner) / (edge * taper)) if taper else np.ones_like(d)
    weight = np.where(d >= edge, 0.0, np.where(d <= inner, 1.0, fall))
    return np.minimum(weight, _conjugate(weight))


def _filtered(sections: np.ndarray, transfer: np.ndarray) -> np.ndarray:
    """Circular convolution of sections on the padded grid, a bounded number at a time."""
    some = max(1, BINS // transfer.size)
    return np.concatenate([np.fft.ifft2(np.fft.fft2(sections[i : i + some]) * transfer) for i in range(0, len(sections), some)])


def _on_grid(sections: np.ndarray, depth: int, every: int, padding: int) -> np.ndarray:
    """Sections (x, plane, row) on the padded grid, their planes ``every`` apart."""
    nx, n, ny = sections.shape
    out = np.zeros((nx, padded(depth, padding), padded(ny, padding)), sections.dtype)
    out[:, padding : padding + n * every : every, padding : padding + ny] = sections
    return out


def _inside(grid: np.ndarray, depth: int, rows: int, padding: int) -> np.ndarray:
    return grid[:, padding : padding + depth, padding : padding + rows]


def reconstruct_sections(sections: np.ndarray, scan: Scan) -> np.ndarray:
    """Sections (x, plane, row) on a scan grid ``factor`` times finer, from the first plane to the last."""
    nx, n, ny = sections.shape
    depth = (n - 1) * scan.factor + 1
    grid = _on_grid(sections - scan.background, depth, scan.factor, scan.padding)
    out = _filtered(grid, band_weights(*grid.shape[1:], scan.slope, scan.factor, scan.taper)).real
    return scan.factor * _inside(out, depth, ny, scan.padding) + scan.background


def interpolate_sections(sections: np.ndarray, factor: int) -> np.ndarray:
    """Linear interpolation along the scan, what reconstructions are compared with."""
    at = np.arange((sections.shape[1] - 1) * factor + 1)
    low = sections[:, at // factor]
    high = sections[:, np.minimum(at // factor + 1, sections.shape[1] - 1)]
    return low + (high - low) * ((at % factor) / factor)[:, None]


@lru_cache(maxsize=32)
def _squared_transfer(nz: int, ny: int, slope: float, factor: int, taper: float) -> np.ndarray:
    kernel = factor * np.fft.ifft2(band_weights(nz, ny, slope, factor, taper)).real
    return np.fft.fft2(kernel * kernel)


def propagate_sections(first: np.ndarray, second: np.ndarray, scan: Scan) -> tuple[np.ndarray, np.ndarray]:
    """Variance that a reconstruction carries from independent noise of its planes, for two maps of it.

    Each variance travels by the square of the reconstruction's own kernel, on the same padded
    grid; as that kernel is real, the two maps are the real and imaginary part of one transform.
    """
    nx, n, ny = first.shape
    depth = (n - 1) * scan.factor + 1
    grid = _on_grid(first + 1j * second, depth, scan.factor, scan.padding)
    out = _inside(_filtered(grid, _squared_transfer(*grid.shape[1:], scan.slope, scan.factor, scan.taper)), depth, ny, scan.padding)
    return out.real, out.imag


def _columns(pdf: pd.DataFrame, extents: tuple[int, int], *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """x of the group's camera columns and their (plane, row) sections; absent voxels are zero."""
    xs, at = np.unique(pdf["x"].to_numpy(), return_inverse=True)
    out = []
    for name in names:
        grid = np.zeros((len(xs), *extents))
        grid[at, pdf["z"].to_numpy(), pdf["y"].to_numpy()] = pdf[name].to_numpy(float)
        out.append(grid)
    return xs, out


def _by_columns(voxels: DataFrame):
    return voxels.withColumn("_b", F.floor(F.col("x") / BLOCK)).groupBy("t", "c", "_b")


def _rows(t, c, xs, sections: dict[str, np.ndarray], **more) -> pd.DataFrame:
    x, z, y = (g.ravel() for g in np.indices(next(iter(sections.values())).shape))
    return pd.DataFrame({"t": t, "c": c, **more, "z": z, "y": y, "x": xs[x], **{k: v.ravel() for k, v in sections.items()}})


def reconstruct(voxels: DataFrame, scan: Scan, extents: tuple[int, int]) -> DataFrame:
    """The volume on a scan grid ``scan.factor`` times finer, (planes - 1) * factor + 1 planes.

    ``extents`` (planes, rows) are those of the sparse volume; negative ringing is kept, and a
    column with a value that is not finite is refused.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        xs, (grid,) = _columns(pdf, extents, "v")
        if not np.isfinite(grid).all():
            raise ValueError("the input holds values that are not finite")
        return _rows(*key[:2], xs, {"v": reconstruct_sections(grid, scan)})

    return _by_columns(voxels).applyInPandas(run, "t long, c long, z long, y long, x long, v double")


# --- noise -----------------------------------------------------------------------------------------------


@lru_cache(maxsize=32)
def noise_band(nz: int, ny: int, slope: float, band: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(bins that hold noise only, transform of their kernel's square, share of such bins)."""
    d = band_distance(nz, ny, slope)
    keep = ((d > band) & (_conjugate(d) > band)).astype(float)
    kernel = np.abs(np.fft.ifft2(keep)) ** 2
    return keep, np.fft.fft2(kernel), float(keep.mean())


def noise_sums(voxels: DataFrame, scan: Scan, extents: tuple[int, int], band: float, guards: dict[str, tuple[int, int]]) -> DataFrame:
    """``t, c, n, s, ss, r, sr, fraction``: the sums that fit the noise of a dense volume.

    r is the square of the residual beyond ``band`` and s the signal over the background spread by the
    square of the residual's own kernel: noise of a voxel spreads over its neighbours, so the
    signal at the voxel itself would be a biased regressor. Only voxels inside the guards count.
    """
    (z0, z1), (y0, y1) = guards["z"], guards["y"]
    shape = padded(extents[0], scan.padding), padded(extents[1], scan.padding)
    fraction = noise_band(*shape, scan.slope, band)[2]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, (grid,) = _columns(pdf, extents, "v")
        keep, spread, _ = noise_band(*shape, scan.slope, band)
        wide = _on_grid(grid - scan.background, extents[0], 1, scan.padding)
        cut = np.s_[:, z0 : z1 + 1, y0 : y1 + 1]
        r = _inside(_filtered(wide, keep).real, *extents, scan.padding)[cut] ** 2
        s = _inside(_filtered(wide, spread).real, *extents, scan.padding)[cut]
        return pd.DataFrame([(*key[:2], r.size, s.sum(), (s * s).sum(), r.sum(), (s * r).sum())])

    inner = voxels.filter(F.col("x").between(*guards["x"]))
    parts = _by_columns(inner).applyInPandas(run, "t long, c long, n long, s double, ss double, r double, sr double")
    sums = [F.sum(k).alias(k) for k in ("n", "s", "ss", "r", "sr")]
    return parts.groupBy("t", "c").agg(*sums).withColumn("fraction", F.lit(fraction))


def noise_floors(jobs: DataFrame, scan: Scan, extents: tuple[int, int]) -> DataFrame:
    """Variance of a reconstructed volume by what multiplies it, ``read`` (read variance) and ``shot`` (gain).

    ``jobs`` are voxels (t, c, z, y, x, signal) of a dense volume with a factor and a phase on each row: the
    planes phase, phase + factor, ... are taken as acquired. z counts dense planes.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t, c, factor, phase = (int(k) for k in key[:4])
        xs, (signal,) = _columns(pdf, extents, "signal")
        kept = signal[:, phase::factor]
        read, shot = propagate_sections(np.ones_like(kept), kept, scan.every(factor))
        return _rows(t, c, xs, {"read": read, "shot": shot}, factor=factor, phase=phase).assign(z=lambda d: d["z"] + phase)

    grouped = jobs.withColumn("_b", F.floor(F.col("x") / BLOCK)).groupBy("t", "c", "factor", "phase", "_b")
    return grouped.applyInPandas(run, "t long, c long, factor int, phase int, z long, y long, x long, read double, shot double")


# --- spectra of beads -------------------------------------------------------------------------------------


def bead_spectrum(section: np.ndarray, scan: Scan, threshold: float) -> tuple[np.ndarray, float] | None:
    """(log10 amplitude over that of zero frequency, zero in the middle; support) of a (plane, row) section.

    Nothing where the section has no positive sum over the background.
    """
    nz, ny = (padded(n, scan.padding) for n in section.shape)
    spectrum = np.fft.fft2(section, (nz, ny))
    if not spectrum[0, 0].real > 0:
        return None
    amplitude = np.abs(spectrum) / spectrum[0, 0].real
    support = band_distance(nz, ny, scan.slope)[amplitude >= threshold].max()
    return np.roll(np.log10(np.maximum(amplitude, 1e-6)), (nz // 2, ny // 2), axis=(0, 1)), float(support)


def _sections(crops: DataFrame, radius: dict[str, int], background: float):
    """Crops summed over x; absent voxels are background."""
    return crops.groupBy("bead", "dz", "dy").agg(F.sum(F.col("v") - background).alias("v")).groupBy("bead"), (2 * radius["z"] + 1, 2 * radius["y"] + 1)


def _section(pdf: pd.DataFrame, radius: dict[str, int], shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape)
    out[pdf["dz"] + radius["z"], pdf["dy"] + radius["y"]] = pdf["v"]
    return out


def bead_spectra(crops: DataFrame, radius: dict[str, int], scan: Scan, threshold: float = 0.05) -> DataFrame:
    """``bead, support, factor``: the largest band distance with an amplitude from ``threshold`` on, and the factor 0.5 / support.

    Both are unknown where the bead has no positive sum over the background; the factor has no
    bound (infinity) where only the band's middle is held.
    """
    grouped, shape = _sections(crops, radius, scan.background)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = bead_spectrum(_section(pdf, radius, shape), scan, threshold)
        support = None if found is None else found[1]
        return pd.DataFrame([(key[0], support, None if support is None else 0.5 / support if support > 0 else math.inf)])

    return grouped.applyInPandas(run, "bead long, support double, factor double")


def bead_amplitudes(crops: DataFrame, radius: dict[str, int], scan: Scan) -> DataFrame:
    """``bead, kz, ky, amplitude``: log10 amplitude over that of zero frequency, bins from the middle on."""
    grouped, shape = _sections(crops, radius, scan.background)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = bead_spectrum(_section(pdf, radius, shape), scan, 0.5)
        if found is None:
            return pd.DataFrame([], columns=["bead", "kz", "ky", "amplitude"])
        kz, ky = (g.ravel() for g in np.indices(found[0].shape))
        nz, ny = found[0].shape
        return pd.DataFrame({"bead": key[0], "kz": kz - nz // 2, "ky": ky - ny // 2, "amplitude": found[0].ravel()})

    return grouped.applyInPandas(run, "bead long, kz long, ky long, amplitude double")


# --- study of scan steps ----------------------------------------------------------------------------------


def domain(depth: int, factors: list[int], guard: int) -> tuple[int, int]:
    """First and last plane that every phase of every factor spans, inside the guard."""
    ends = []
    for m in factors:
        for phase in range(m):
            if phase + m >= depth:
                raise ValueError("too few planes for every phase")
            ends.append((phase, phase + (depth - 1 - phase) // m * m))
    first, last = max(a for a, _ in ends) + guard, min(b for _, b in ends) - guard
    if last - first < 2:
        raise ValueError("fewer than three planes are left inside the guard")
    return first, last


def _scored(grid, mask, signal, scan, m, phase, planes, refinement):
    """(method, held out, sums) of one factor and phase."""
    kept = grid[:, phase::m]
    own = scan.every(m, refinement)
    at = refinement * (planes - phase)
    offset = (planes - phase) % m
    share = (offset / m)[None, :, None]
    ref, inside = grid[:, planes], mask[:, planes]
    noise = None
    if signal is not None:
        s = signal[:, planes]
        read, shot = (v[:, at] for v in propagate_sections(np.ones_like(kept), signal[:, phase::m], own))
        low, high = signal[:, planes - offset], signal[:, np.minimum(planes - offset + m, grid.shape[1] - 1)]
        a, b = (1 - share) ** 2, share**2
        noise = {"fourier": (1 + read, s + shot), "linear": (1 + a + b + 0 * s, s + a * low + b * high)}
    for method, whole in (("fourier", reconstruct_sections(kept, own)), ("linear", interpolate_sections(kept, own.factor))):
        pred = whole[:, at]
        for held in (True, False):
            use = inside & ((offset != 0) == held)[None, :, None]
            r, p = ref[use], pred[use]
            d = p - r
            sums = [r.size, r.sum(), p.sum(), (r * r).sum(), (p * p).sum(), (r * p).sum(), (d * d).sum(), d.sum(), ((r - scan.background) ** 2).sum()]
            if noise is None:
                sums += [0.0] * 4
            else:
                floors = [f[use].sum() if held else 0.0 for f in noise[method]]
                sums += [*floors, float(r.size), s[use].sum()]
            yield (m, phase, method, held), np.array(sums, float)


def sweep(voxels: DataFrame, scan: Scan, factors: list[int], extents: tuple[int, int], guard: int = 0, refinement: int = 1) -> DataFrame:
    """Sums of every factor, phase and method, scored at the planes of the dense volume itself.

    ``voxels`` of a dense volume with columns ``mask`` (whether a voxel is scored; all where there is no such
    column) and ``signal`` (smoothed, not negative: noise floors are then summed, else they are
    zero). Result: t, c, factor, phase, method, heldout and the mergeable sums of the study; planes
    between kept ones are held out. All phases are scored over the same planes.
    """
    planes = np.arange(*[e + i for i, e in enumerate(domain(extents[0], factors, guard))])
    wanted = [(m, phase) for m in factors for phase in range(m)]
    has_mask, has_signal = "mask" in voxels.columns, "signal" in voxels.columns
    names = [*SUMS, *NOISE]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, (grid,) = _columns(pdf, extents, "v")
        mask = _columns(pdf, extents, "mask")[1][0] > 0 if has_mask else np.ones(grid.shape, bool)
        signal = _columns(pdf, extents, "signal")[1][0] if has_signal else None
        out = [(*key[:2], *k, *sums) for m, phase in wanted for k, sums in _scored(grid, mask, signal, scan, m, phase, planes, refinement)]
        return pd.DataFrame(out, columns=["t", "c", "factor", "phase", "method", "heldout", *names])

    kinds = "t long, c long, factor int, phase int, method string, heldout boolean, " + ", ".join(f"{k} double" for k in names)
    kept = voxels.select("t", "c", "z", "y", "x", "v", *["mask"] * has_mask, *["signal"] * has_signal)
    parts = _by_columns(kept).applyInPandas(run, kinds)
    return parts.groupBy("t", "c", "factor", "phase", "method", "heldout").agg(*[F.sum(k).alias(k) for k in names])


def noise_only_from(step: float, angle: float, kz: float) -> float:
    """Band distance from which a dense scan holds noise alone, by the optics' axial support ``kz``; beyond 0.45 none is left."""
    return max(0.30, 1.5 * step * math.tan(math.radians(angle)) * kz)
