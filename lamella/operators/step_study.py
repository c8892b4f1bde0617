"""The study of scan steps as one job: mask, noise model, sweep over factors and phases, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.operators import reconstruction as rc
from lamella.operators import sampling_study as ss

KEYS = ["t", "c"]


def noise_model(voxels: DataFrame, scan: rc.Scan, extents: tuple[int, int], kz: float, guards: dict[str, tuple[int, int]], entered: DataFrame) -> DataFrame:
    """``t, c, sigma, gain, check_sigma, check_gain, status, variance``: two fits beyond the band of the optics and their acceptance.

    ``entered``: t, c, background_sigma, noise_known, noise_free, mean_signal. The second fit begins halfway
    between the band's edge and half a cycle.
    """
    band = rc.noise_only_from(scan.step, scan.angle, kz)
    entered = entered.withColumn("band", F.lit(band))
    if band > ss.WIDEST:
        fits = entered.withColumns({k: F.lit(None).cast("double") for k in ("sigma", "gain", "check_sigma", "check_gain")})
    else:
        fit = ss.noise_fit(rc.noise_sums(voxels, scan, extents, band, guards))
        check = ss.noise_fit(rc.noise_sums(voxels, scan, extents, (band + 0.5) / 2, guards))
        check = check.withColumnsRenamed({"sigma": "check_sigma", "gain": "check_gain"})
        fits = entered.join(fit, KEYS, "left").join(check, KEYS, "left")
    model = ss.noise_acceptance(fits.withColumn("fitted_gain", F.col("gain")))
    used = F.col("variance").isNotNull() & ~F.coalesce(F.col("noise_free"), F.lit(False))
    return model.withColumns({
        "check_variance": F.when(used, F.col("check_sigma") * F.col("check_sigma")).otherwise(F.col("variance")),
        "check_used_gain": F.when(used, F.col("check_gain")).otherwise(F.col("gain")),
    })


def step_study(
    voxels: DataFrame,
    scan: rc.Scan,
    factors: list[int],
    extents: tuple[int, int, int],
    entered: DataFrame,
    kz: float,
    guard: int = 16,
    sigmas: float = 5.0,
    fraction: float = 0.1,
    refinement: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """(noise, sums): the noise model of every volume (t, c) and the sums of every factor, phase and method.

    ``scan`` is the dense scan, ``extents`` its planes, rows and columns. ``entered``: t, c, background_sigma,
    noise_known, noise_free. Voxels are scored where the volume, smoothed, lies over the mask's threshold; the
    expected noise at a voxel is variance + gain * signal of the lightly smoothed volume, and the
    floors are what the reconstruction carries of it. Sums go with the columns variance and gain
    of the accepted model, which ``verdicts`` takes by name.
    """
    first, last = rc.domain(extents[0], factors, guard)
    guards = {"z": (first, last), "y": (guard, extents[1] - 1 - guard), "x": (guard, extents[2] - 1 - guard)}
    sigma = entered.select(*KEYS, F.when(F.col("noise_free"), 0.0).otherwise(F.col("background_sigma")).alias("sigma"))
    mask = ss.signal_mask(voxels, KEYS, sigma, sigmas, fraction, guards, scan.background).select(*KEYS, "z", "y", "x", F.lit(1.0).alias("mask"))
    signal = ss.smoothed(voxels, 0.7, 2, scan.background).select(*KEYS, "z", "y", "x", F.greatest("v", F.lit(0.0)).alias("signal"))
    place = [*KEYS, "z", "y", "x"]
    rows = voxels.join(signal, place).join(mask, place, "left").fillna(0.0, ["mask"])
    mean = rows.filter("mask > 0").groupBy(*KEYS).agg(F.avg("signal").alias("mean_signal"))
    model = noise_model(voxels, scan, extents[:2], kz, guards, entered.join(mean, KEYS, "left").fillna(0.0, ["mean_signal"]))
    sums = rc.sweep(rows, scan, factors, extents[:2], guard, refinement)
    return model, sums.join(model.select(*KEYS, "variance", "gain", "check_variance", "check_used_gain"), KEYS)
