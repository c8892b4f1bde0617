"""Channel alignment from bead images: detection, coarse shift, robust rigid fit, calibration.

An image is one row, and an image's spots are at most ``MOST``, so groups are bounded by a
pair of images; pairs are independent.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions import matrix as mx
from lamella.operators.filters import gaussian_plane

MOST = 2000  # spots kept of an image
SIGMA = 2.0
LIMIT_X, LIMIT_Y = 80, 35  # largest shift between channels, pixels
PASSES = ((8.0, 2.0), (4.0, 1.25), (2.5, 1.25))  # radius of matching and tolerance of the fit
ROUNDS, LEAST_SHARE, LEAST = 2000, 0.20, 3
REWEIGHTED = 20  # rounds of the final fit
SEED = 11


def _blur(image: np.ndarray, sigma: float) -> np.ndarray:
    return gaussian_plane(image, sigma, math.ceil(4 * sigma))


def _robust(values: np.ndarray) -> tuple[float, float]:
    """Median and MAD sigma by upper order statistics."""
    ordered = np.sort(values, axis=None)
    median = ordered[len(ordered) // 2]
    return float(median), 1.4826 * float(np.sort(np.abs(ordered - median))[len(ordered) // 2])


def _offset(minus, centre, plus):
    bend = minus - 2 * centre + plus
    flat = np.abs(bend) < 1e-12
    return np.where(flat, 0.0, np.clip(0.5 * (minus - plus) / np.where(flat, 1.0, bend), -0.5, 0.5))


def spots_of(image: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """(x, y, response) of bright round spots, brightest first.

    Difference of two Gaussians, robust threshold, strict maxima away from the border, quadratic
    sub-pixel peaks; a spot too close to a brighter one is dropped, and at most MOST stay.
    """
    response = _blur(image, sigma) - _blur(image, 1.6 * sigma)
    median, spread = _robust(response)
    border = max(3, math.ceil(3 * sigma))
    h, w = response.shape
    if h <= 2 * border or w <= 2 * border:
        return np.zeros((0, 3))
    inner = response[border : h - border, border : w - border]
    peak = inner > median + max(6 * spread, 1.0)
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if dy or dx:
                peak &= inner > response[border + dy : h - border + dy, border + dx : w - border + dx]
    y, x = np.nonzero(peak)
    y, x = y + border, x + border
    centre = response[y, x]
    px = x + _offset(response[y, x - 1], centre, response[y, x + 1])
    py = y + _offset(response[y - 1, x], centre, response[y + 1, x])
    apart = max(3.0, 2 * sigma)
    cells: dict[tuple[int, int], list[tuple[float, float]]] = {}
    kept = []
    for i in np.lexsort((x, y, -centre)):
        cx, cy = int(px[i] // apart), int(py[i] // apart)
        near = (p for a in (-1, 0, 1) for b in (-1, 0, 1) for p in cells.get((cx + a, cy + b), ()))
        if all((px[i] - q) ** 2 + (py[i] - r) ** 2 >= apart * apart for q, r in near):
            cells.setdefault((cx, cy), []).append((px[i], py[i]))
            kept.append(i)
            if len(kept) == MOST:
                break
    return np.column_stack([px, py, centre])[kept]


def detect(planes: DataFrame, keys: list[str], sigma: float = SIGMA) -> DataFrame:
    """``keys, rank, x, y, response`` of the spots of every image row (keys, width, height, px)."""
    fields = ", ".join(f"{k} {dict(planes.dtypes)[k]}" for k in keys)

    def run(batches):
        for batch in batches:
            out = []
            for i, (px, w, h) in enumerate(zip(batch.column("px"), batch.column("width").to_pylist(), batch.column("height").to_pylist())):
                image = np.asarray(px.values.to_numpy(zero_copy_only=False), float).reshape(h, w)
                found = pd.DataFrame(spots_of(image, sigma), columns=["x", "y", "response"])
                for k in reversed(keys):
                    found.insert(0, k, batch.column(k)[i].as_py())
                found.insert(len(keys), "rank", np.arange(len(found)))
                out.append(found)
            if out:
                yield from pa.Table.from_pandas(pd.concat(out), preserve_index=False).to_batches()

    return planes.select(*keys, "width", "height", "px").mapInArrow(run, f"{fields}, rank long, x double, y double, response double")


def _texture(image: np.ndarray) -> np.ndarray:
    """What stands out of an image: positive difference of Gaussians over a robust threshold."""
    out = np.maximum(_blur(image, 0.8) - _blur(image, 2.4), 0)
    median, spread = _robust(out)
    return np.where(out < median + 3 * spread, 0.0, out)


def _reduced(image: np.ndarray) -> tuple[int, np.ndarray]:
    """The factor of reduction, four where the image is large enough, and the texture of the reduced image."""
    factor = 4 if min(image.shape) >= 64 else 1
    h, w = (n // factor * factor for n in image.shape)
    return factor, _texture(image[:h, :w].reshape(h // factor, factor, w // factor, factor).mean(axis=(1, 3)))


def _best_shift(a: np.ndarray, b: np.ndarray, factor: int, limit_x: int, limit_y: int) -> tuple[int, int, float]:
    h, w = a.shape
    reach_x, reach_y = min(w - 1, math.ceil(limit_x / factor)), min(h - 1, math.ceil(limit_y / factor))
    best = (0, 0, -1.0)
    for dy in range(-reach_y, reach_y + 1):
        for dx in range(-reach_x, reach_x + 1):
            one = a[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
            two = b[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)]
            score = (one * two).sum() / math.sqrt(max(1e-30, (one * one).sum() * (two * two).sum()))
            if score > best[2]:
                best = (dx * factor, dy * factor, float(score))
    return best


def coarse_shift(fixed: np.ndarray, moving: np.ndarray, limit_x: int = LIMIT_X, limit_y: int = LIMIT_Y) -> tuple[int, int, float]:
    """Shift (dx, dy) that brings ``moving`` onto ``fixed``, and its correlation.

    Normalised correlation of the overlap of both textures, reduced four times where the images are
    large enough, over all shifts within the limits.
    """
    (factor, a), (_, b) = _reduced(fixed), _reduced(moving)
    return _best_shift(a, b, factor, limit_x, limit_y)


def coarse_shifts(fixed: DataFrame, moving: DataFrame, keys: list[str], limit_x: int = LIMIT_X, limit_y: int = LIMIT_Y) -> DataFrame:
    """``keys, dx, dy, score`` of every pair of image rows (keys, width, height, px) with equal keys.

    Images are reduced to their textures where they are made, a sixteenth of them, and only textures are joined. The
    planner cannot know how long those are, so it is told to sort both sides: no task or driver holds a table of them.
    """
    fields = ", ".join(f"{k} {dict(fixed.dtypes)[k]}" for k in keys)

    def textures(images: DataFrame) -> DataFrame:
        def run(batches):
            for batch in batches:
                for i, (px, w, h) in enumerate(zip(batch.column("px"), batch.column("width").to_pylist(), batch.column("height").to_pylist())):
                    factor, a = _reduced(np.asarray(px.values.to_numpy(zero_copy_only=False), float).reshape(h, w))
                    columns = [*(batch.column(k).slice(i, 1) for k in keys), pa.array([factor]), pa.array([a.shape[1]]), pa.array([a.tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, [*keys, "factor", "width", "texture"])

        return images.select(*keys, "width", "height", "px").mapInArrow(run, f"{fields}, factor long, width long, texture binary")

    pairs = textures(fixed).hint("merge").join(textures(moving).select(*keys, F.col("texture").alias("other")), keys)

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                a, b = (np.frombuffer(t, float).reshape(-1, r.width) for t in (r.texture, r.other))
                out.append((*(getattr(r, k) for k in keys), *_best_shift(a, b, r.factor, limit_x, limit_y)))
            yield pd.DataFrame(out, columns=[*keys, "dx", "dy", "score"])

    return pairs.mapInPandas(run, f"{fields}, dx long, dy long, score double")


def _rigid(f: np.ndarray, m: np.ndarray, weights: np.ndarray | None = None) -> tuple[float, float, float]:
    """Angle and shift of the (weighted) least-squares rigid map of m onto f."""
    w = np.ones(len(f)) if weights is None else weights
    cf, cm = np.average(f, 0, w), np.average(m, 0, w)
    p, q = f - cf, m - cm
    a = math.atan2((w * (q[:, 0] * p[:, 1] - q[:, 1] * p[:, 0])).sum(), (w[:, None] * q * p).sum())
    c, s = math.cos(a), math.sin(a)
    return a, cf[0] - c * cm[0] + s * cm[1], cf[1] - s * cm[0] - c * cm[1]


def _moved(m: np.ndarray, fit: tuple[float, float, float]) -> np.ndarray:
    c, s = math.cos(fit[0]), math.sin(fit[0])
    return np.column_stack([c * m[:, 0] - s * m[:, 1] + fit[1], s * m[:, 0] + c * m[:, 1] + fit[2]])


def mutual(fixed: np.ndarray, moving: np.ndarray, fit: tuple[float, float, float], radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of spots that are each other's nearest within a radius after a map.

    Both lists are cut to comparable brightness first: three times the other's length, at least 100.
    """
    nf, nm = min(len(fixed), max(100, 3 * len(moving))), min(len(moving), max(100, 3 * len(fixed)))
    moved = _moved(moving[:nm], fit)
    d = (moved[:, 0][:, None] - fixed[:nf, 0][None, :]) ** 2 + (moved[:, 1][:, None] - fixed[:nf, 1][None, :]) ** 2
    to_f, to_m = d.argmin(axis=1), d.argmin(axis=0)
    m = np.arange(nm)
    good = (to_m[to_f] == m) & (d[m, to_f] <= radius * radius)
    return to_f[good], m[good]


def consensus(f: np.ndarray, m: np.ndarray, tolerance: float) -> tuple[tuple[float, float, float], np.ndarray] | None:
    """Rigid fit of the largest consistent set of pairs, by ROUNDS seeded samples of two; None under a fifth or three."""
    n = len(f)
    if n < LEAST:
        return None
    rng = np.random.RandomState(SEED)
    i = rng.randint(0, n, ROUNDS)
    j = (i + rng.randint(1, n, ROUNDS)) % n
    df, dm = f[j] - f[i], m[j] - m[i]
    angle = np.arctan2(dm[:, 0] * df[:, 1] - dm[:, 1] * df[:, 0], (dm * df).sum(1))
    c, s = np.cos(angle), np.sin(angle)
    cf, cm = (f[i] + f[j]) / 2, (m[i] + m[j]) / 2
    sx, sy = cf[:, 0] - c * cm[:, 0] + s * cm[:, 1], cf[:, 1] - s * cm[:, 0] - c * cm[:, 1]
    best, inside = 0, None
    for at in np.array_split(np.arange(ROUNDS), max(1, ROUNDS * n // 2_000_000)):  # bounded temporary arrays
        x = c[at, None] * m[None, :, 0] - s[at, None] * m[None, :, 1] + sx[at, None]
        y = s[at, None] * m[None, :, 0] + c[at, None] * m[None, :, 1] + sy[at, None]
        hit = (x - f[None, :, 0]) ** 2 + (y - f[None, :, 1]) ** 2 <= tolerance * tolerance
        k = int(hit.sum(1).argmax())
        if hit[k].sum() > best:
            best, inside = int(hit[k].sum()), hit[k]
    if best < max(LEAST, math.ceil(LEAST_SHARE * n)):
        return None
    return _rigid(f[inside], m[inside]), inside


def reweighted(f: np.ndarray, m: np.ndarray, fit: tuple[float, float, float]) -> tuple[float, float, float]:
    """The fit with pairs weighted by their agreement, in units of the median distance.

    Spots that overlap a neighbour are off by up to the tolerance, and not evenly to all sides; by plain least squares they turn the map.
    """
    for _ in range(REWEIGHTED):
        rest = np.hypot(*(_moved(m, fit) - f).T)
        fit = _rigid(f, m, 1 / (1 + (rest / max(float(np.median(rest)), 1e-3)) ** 2) ** 2)
    return fit


def refined(fixed: np.ndarray, moving: np.ndarray, start: tuple[float, float, float]):
    """(fit, pairs, rms) after three passes that match anew with a smaller radius each; None if one finds no consensus.

    The fit is the last pass's, reweighted; pairs and rms are those of the consensus it rests on.
    """
    fit, out = start, None
    for radius, tolerance in PASSES:
        a, b = mutual(fixed, moving, fit, radius)
        found = consensus(fixed[a], moving[b], tolerance)
        if found is None:
            return None
        fit, inside = found
        rest = _moved(moving[b][inside], fit) - fixed[a][inside]
        out = reweighted(fixed[a][inside], moving[b][inside], fit), int(inside.sum()), math.sqrt(float((rest * rest).sum(1).mean()))
    return out


def vote(fixed: np.ndarray, moving: np.ndarray, limit_x: int = LIMIT_X, limit_y: int = LIMIT_Y, top: int = 300) -> tuple[float, float, float]:
    """The shift that most pairs of the brightest spots agree on, in bins of two pixels."""
    d = np.floor(fixed[:top, None, :2] - moving[None, :top, :2] + 0.5).reshape(-1, 2)
    d = d[(np.abs(d[:, 0]) <= limit_x) & (np.abs(d[:, 1]) <= limit_y)]
    if not len(d):
        return 0.0, 0.0, 0.0
    bins, count = np.unique(np.floor(d / 2 + 0.5).astype(int), axis=0, return_counts=True)
    return 0.0, 2.0 * bins[count.argmax(), 0], 2.0 * bins[count.argmax(), 1]


def align_spots(fixed: DataFrame, moving: DataFrame, shifts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, angle`` (degrees), ``dx, dy, pairs, rms, start`` of every pair of spot lists (keys, rank, x, y).

    ``shifts`` (keys, dx, dy) is tried first, then the vote of the brightest spots; without a
    consensus the fit is NULL. Groups hold at most MOST spots a side.
    """
    fields = ", ".join(f"{k} {dict(fixed.dtypes)[k]}" for k in keys)
    started = moving.join(shifts.select(*keys, "dx", "dy"), keys, "left")

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        nothing = (*key, None, None, None, 0, None, None)
        f, m = (t.sort_values("rank")[["x", "y"]].to_numpy(float) for t in (left, right))
        if len(f) >= LEAST and len(m) >= LEAST:
            shift = right[["dx", "dy"]].iloc[0]
            starts = [("correlation", (0.0, float(shift["dx"]), float(shift["dy"])))] if shift.notna().all() else []
            for name, start in [*starts, ("vote", vote(f, m))]:
                found = refined(f, m, start)
                if found is not None:
                    (a, dx, dy), pairs, rms = found
                    return pd.DataFrame([(*key, math.degrees(a), dx, dy, pairs, rms, name)])
        return pd.DataFrame([nothing])

    schema = f"{fields}, angle double, dx double, dy double, pairs int, rms double, start string"
    return fixed.select(*keys, "rank", "x", "y").groupBy(*keys).cogroup(started.select(*keys, "rank", "x", "y", "dx", "dy").groupBy(*keys)).applyInPandas(run, schema)


def chosen(fits: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, method, m00 ... m12``: the bead fit where it is plausible, else none (the identity)."""
    a = F.radians("angle")
    m = [F.cos(a), -F.sin(a), F.col("dx"), F.sin(a), F.cos(a), F.col("dy")]
    good = F.coalesce(mx.plausible(m, 2.0, float(LIMIT_X), float(LIMIT_Y)) & (F.col("pairs") >= LEAST), F.lit(False))
    return fits.select(*keys, F.when(good, "beads").otherwise("none").alias("method"), *[F.when(good, e).otherwise(d).alias(k) for k, e, d in zip(mx.SIX, m, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0))])


def calibrate(fixed: DataFrame, moving: DataFrame, keys: list[str], adjust: list | None = None, sigma: float = SIGMA) -> DataFrame:
    """Alignment of every pair of bead projections (keys, width, height, px): detect, shift, match, fit, choose, and correct by hand.

    ``adjust`` is a 2x3 matrix of columns applied after the fit.
    """
    fits = align_spots(detect(fixed, keys, sigma), detect(moving, keys, sigma), coarse_shifts(fixed, moving, keys), keys)
    out = chosen(fits, keys)
    if adjust is None:
        return out
    return out.select(*keys, "method", *[c.alias(k) for k, c in zip(mx.SIX, mx.product2(adjust, mx.mat()))])


def saved_set(matrices: DataFrame, path: str, name) -> None:
    """Write alignments as ``source,<name>,m00,...,m12`` lines, a file set that ``sources.text.alignments`` reads."""
    numbers = F.concat_ws(",", *[F.format_string("%.17g", F.col(k).cast("double")) for k in mx.SIX])
    matrices.select(F.concat_ws(",", F.lit("source"), name, numbers).alias("value")).write.text(path)
