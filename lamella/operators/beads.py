"""Beads and point-spread functions: quality, combination, greedy spacing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def crowded(beads: DataFrame, radius: dict[str, int], keys: list[str]) -> DataFrame:
    """``bead`` of the beads whose support ellipsoid holds another one of their volume: a bucketed self-join."""
    spread, plain = beads, beads
    for axis, r in radius.items():
        cell = F.floor(F.col(f"b{axis}") / r)
        spread = spread.withColumn(f"_{axis}", F.explode(F.array(cell - 1, cell, cell + 1)))
        plain = plain.withColumn(f"_{axis}", cell)
    other = plain.select(*keys, *[f"_{a}" for a in radius], F.col("bead").alias("other"), *[F.col(f"b{a}").alias(f"o{a}") for a in radius])
    distance = sum(((F.col(f"b{a}") - F.col(f"o{a}")) / r) * ((F.col(f"b{a}") - F.col(f"o{a}")) / r) for a, r in radius.items())
    met = spread.join(other, [*keys, *[f"_{a}" for a in radius]]).filter((F.col("bead") != F.col("other")) & (distance <= 1))
    return met.select("bead").distinct()


def shell(radius: dict[str, int], share: float):
    """Whether a crop's voxel lies in its outer shell: ``share`` of the side, at least a voxel, on every face."""
    hit = F.lit(False)
    for axis, r in radius.items():
        n = 2 * r + 1
        width = max(1, int(np.ceil(n * min(max(share, 0.01), 0.49))))
        hit = hit | (F.col(f"d{axis}") < width - r) | (F.col(f"d{axis}") > r - width)
    return hit


def bead_quality(
    crops: DataFrame, beads: DataFrame, radius: dict[str, int], keys: list[str], saturation: float = float("inf"), snr: float = 5.0, sbr: float = 1.5,
    off_centre: float = 0.5, share: float = 0.15, neighbours: bool = True,
) -> DataFrame:
    """``bead, background, noise, peak, snr, sbr, offset, integral, reason`` of every candidate.

    ``crops``: bead, dz, dy, dx, v; ``beads``: bead, keys, bz, by, bx. The first reason that
    applies is given: edge (the crop leaves the volume), neighbour, saturated, empty (no shell),
    low snr, low sbr, off centre, empty (nothing over the background); else accepted.
    Background and noise are median and 1.4826 MAD of the unsaturated shell. The peak is the
    first maximum in plane, row and column order; its offset is in radii.
    """
    size = int(np.prod([2 * r + 1 for r in radius.values()]))
    order = list(radius)
    in_shell = shell(radius, share) & (F.col("v") < saturation)
    first = crops.groupBy("bead").agg(
        F.count(F.lit(1)).alias("n"), F.max("v").alias("peak"), F.median(F.when(in_shell, F.col("v"))).alias("background"), F.count_if(in_shell).alias("shell"),
        F.max_by(F.struct(*[f"d{a}" for a in order]), F.struct("v", *[-F.col(f"d{a}") for a in order])).alias("at"),
    )
    spread = crops.join(first.select("bead", "background"), "bead").groupBy("bead").agg(
        (F.lit(1.4826) * F.median(F.when(in_shell, F.abs(F.col("v") - F.col("background"))))).alias("noise"), F.sum(F.greatest(F.col("v") - F.col("background"), F.lit(0.0))).alias("integral")
    )
    offset = F.sqrt(sum(F.pow(F.col(f"at.d{a}") / F.lit(float(r)), 2) for a, r in radius.items()))
    measured = beads.select("bead").join(first, "bead", "left").join(spread, "bead", "left").withColumns({
        "offset": offset, "snr": (F.col("peak") - F.col("background")) / F.greatest("noise", F.lit(1e-12)),
        "sbr": F.when(F.col("background") > 0, F.col("peak") / F.col("background")).otherwise(F.lit(float("inf"))),
    })
    if neighbours:
        near = crowded(beads.select("bead", *keys, *[f"b{a}" for a in radius]), radius, keys).withColumn("near", F.lit(True))
        measured = measured.join(near, "bead", "left")
    else:
        measured = measured.withColumn("near", F.lit(None).cast("boolean"))
    signal = F.col("peak") - F.col("background")
    reason = (
        F.when(F.coalesce(F.col("n"), F.lit(0)) < size, "edge").when(F.col("near"), "neighbour").when(F.col("peak") >= saturation, "saturated").when(F.col("shell") == 0, "empty")
        .when(~(signal > 0) | (F.col("snr") < max(snr, 0.0)), "low snr").when(F.col("sbr") < max(sbr, 0.0), "low sbr").when(F.col("offset") > max(off_centre, 0.0), "off centre")
        .when(~(F.col("integral") > 0), "empty").otherwise("accepted")
    )
    return measured.select("bead", "background", "noise", "peak", "snr", "sbr", "offset", "integral", reason.alias("reason"))


def reason_counts(quality: DataFrame) -> DataFrame:
    """Candidates by reason, accepted ones included."""
    return quality.groupBy("reason").agg(F.count(F.lit(1)).alias("beads"))


def normalised(crops: DataFrame, quality: DataFrame) -> DataFrame:
    """Crops of the accepted beads without background, scaled to unit integral."""
    good = quality.filter("reason = 'accepted'").select("bead", "background", "integral")
    value = F.greatest(F.col("v") - F.col("background"), F.lit(0.0)) / F.col("integral")
    return crops.join(good, "bead").withColumn("v", value).drop("background", "integral")


def combined(crops: DataFrame, keys: list[str], method: str) -> DataFrame:
    """One point-spread function a group by ``median`` or ``mean`` of its crops, or ``all`` beads side by side, of unit integral.

    With ``all`` the rows keep their ``bead`` and negative values count as nothing. What has no
    positive sum is left as it is.
    """
    if method == "all":
        own, one = [*keys, "bead"], crops.withColumn("m", F.greatest(F.col("v").cast("double"), F.lit(0.0)))
    else:
        own, value = keys, F.median("v") if method == "median" else F.avg("v")
        one = crops.groupBy(*keys, "dz", "dy", "dx").agg(value.cast("double").alias("m"))
    total = F.sum("m").over(Window.partitionBy(*own))
    return one.select(*own, "dz", "dy", "dx", F.when(total > 0, F.col("m") / total).otherwise(F.col("m")).alias("v"))


def greedy_spots(points: DataFrame, keys: list[str], distance: float, most: int) -> DataFrame:
    """Brightest spots first, each at least a distance from those taken, up to a number per image.

    The choice is sequential inside an image, so an image is one group; images are
    independent. Taken spots lie in cells of the distance, so a spot meets few others.
    """

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["response", "y", "x", "id"], ascending=[False, True, True, True])
        cells: dict[tuple[int, int], list[tuple[float, float]]] = {}
        kept = []
        for i, (x, y) in enumerate(zip(pdf["x"], pdf["y"])):
            cx, cy = int(x // distance), int(y // distance)
            near = (p for dx in (-1, 0, 1) for dy in (-1, 0, 1) for p in cells.get((cx + dx, cy + dy), ()))
            if all((x - a) ** 2 + (y - b) ** 2 >= distance * distance for a, b in near):
                cells.setdefault((cx, cy), []).append((x, y))
                kept.append(i)
                if len(kept) == most:
                    break
        return pdf.iloc[kept]

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.groupBy(*keys).applyInPandas(take, fields)


def padded(psf: np.ndarray, shape: tuple[int, ...], fill: str = "zero") -> np.ndarray:
    """A point-spread function centred in a larger volume, padded with zero or with its border mean."""
    value = 0.0
    if fill == "mean":
        inner = psf[tuple(slice(1, -1) if n > 2 else slice(None) for n in psf.shape)]
        value = (psf.sum() - inner.sum()) / max(psf.size - inner.size, 1)
    out = np.full(shape, value, psf.dtype)
    at = tuple(slice((n - k) // 2, (n - k) // 2 + k) for n, k in zip(shape, psf.shape))
    out[at] = psf
    return out
