"""Comparison statistics and verdicts of the scan-sampling study.

Sufficient statistics are plain sums, so they merge over phases and partitions; a pooled
score comes from summed sums, never from a mean of scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators.filters import gaussian

SUMS = {
    "n": "1", "sr": "ref", "sp": "pred", "srr": "ref * ref", "spp": "pred * pred", "srp": "ref * pred",
    "se": "(pred - ref) * (pred - ref)", "sb": "pred - ref", "power": "(ref - background) * (ref - background)",
}
# Expected noise in ``se`` and in ``power``, by what multiplies it: the read variance or the gain.
NOISE = ["read_floor", "shot_floor", "read_noise", "shot_noise"]


def statistics(pairs: DataFrame, keys: list[str], background: float = 0.0) -> DataFrame:
    """Mergeable sums over (ref, pred) rows, and over the columns of NOISE where ``pairs`` has them (else 0)."""
    rows = pairs.withColumn("background", F.lit(background))
    noise = [F.sum(k if k in pairs.columns else F.lit(0.0)).cast("double").alias(k) for k in NOISE]
    return rows.groupBy(*keys).agg(*[F.expr(f"sum({e})").alias(k) for k, e in SUMS.items()], *noise)


def scores(fit: tuple | None = None) -> dict:
    """Scores of summed columns; NULL where undefined. ``fit`` is the noise model (read variance, gain): numbers or names of columns.

    ``nrmse`` relates the squared error to the power over the background, ``bias`` is the mean
    difference. ``excess`` removes the expected noise from both before it relates them, and
    ``noise_share`` is the noise's part of the squared error; both are unknown without a fit.
    """
    variance, gain = ((F.col(v) if isinstance(v, str) else F.lit(v)).cast("double") for v in fit or (None, None))
    floor = variance * F.col("read_floor") + gain * F.col("shot_floor")
    clean = F.col("power") - (variance * F.col("read_noise") + gain * F.col("shot_noise"))
    ref2, pred2 = "(srr - sr * sr / greatest(n, 1))", "(spp - sp * sp / greatest(n, 1))"
    return {
        "nrmse": F.expr("CASE WHEN n > 0 AND power > 0 THEN sqrt(se / power) END"),
        "bias": F.expr("CASE WHEN n > 0 THEN sb / n END"),
        "correlation": F.expr(f"CASE WHEN {ref2} > 1e-12 AND {pred2} > 1e-12 THEN (srp - sr * sp / n) / sqrt({ref2} * {pred2}) END"),
        "excess": F.when((F.col("n") > 0) & (clean > 0), F.sqrt(F.greatest(F.col("se") - floor, F.lit(0.0)) / F.when(clean > 0, clean))),
        "noise_share": F.when(F.col("se") > 0, floor / F.when(F.col("se") > 0, F.col("se"))),
    }


def _merged(fit: tuple | None) -> list[Column]:
    """Summed sums; columns of the noise model, one value a group, go along."""
    return [*[F.sum(k).alias(k) for k in [*SUMS, *NOISE]], *[F.max(v).alias(v) for v in fit or () if isinstance(v, str)]]


def pooled(stats: DataFrame, keys: list[str], fit: tuple | None = None) -> DataFrame:
    """Merged sums and their scores."""
    return stats.groupBy(*keys).agg(*_merged(fit)).withColumns(scores(fit))


def verdicts(stats: DataFrame, keys: list[str], limit: float, fit: tuple | None = None, evidence: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Pooled and worst-phase score of each factor, its verdict, and the increase over factor 2.

    A factor needs all its phases, each with a score, and eligible ``evidence`` (``by``,
    evidence). The increase compares error energies of the noise-corrected excess and is
    given only where factor 2 and the factor are scored in every phase.
    """
    phase = stats.withColumns({"own": scores(fit)["nrmse"]})
    merged = phase.groupBy(*keys, "factor").agg(
        *_merged(fit), F.count(F.lit(1)).alias("phases"), F.max("own").alias("worst"), F.count_if(F.col("own").isNull()).alias("unscored")
    )
    scored = merged.withColumns(scores(fit))
    if evidence is not None:
        scored = scored.join(evidence, by, "left")
    eligible = F.lit(True) if evidence is None else F.coalesce(F.col("evidence") == "eligible", F.lit(False))
    complete = F.col("phases") == F.col("factor")
    known = (F.col("unscored") == 0) & F.col("nrmse").isNotNull()
    verdict = (
        F.when(~complete, "Incomplete").when(~(eligible & known), "Insufficient evidence")
        .when((F.col("nrmse") <= limit) & (F.col("worst") <= limit), "Pass").otherwise("Fails")
    )
    usable = F.when(complete & (F.col("unscored") == 0), F.col("excess"))
    base = F.max(F.when(F.col("factor") == 2, usable)).over(Window.partitionBy(*keys))
    increase = F.sqrt(F.greatest(usable * usable - base * base, F.lit(0.0)))
    return scored.select(*keys, "factor", F.col("nrmse").alias("score"), "worst", "excess", "noise_share", verdict.alias("verdict"), F.when(usable.isNotNull() & base.isNotNull(), increase).alias("increase"))


def passing_range(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Largest factor of the unbroken passing chain from 2, and passes beyond it."""
    line = Window.partitionBy(*keys).orderBy("factor")
    chained = runs.withColumn("i", F.row_number().over(line)).withColumn("chain", F.bool_and(F.expr("pass AND factor = i + 1")).over(line))
    apart = F.array_sort(F.collect_list(F.when(F.expr("pass AND NOT chain"), F.col("factor"))))
    out = chained.groupBy(*keys).agg(F.max(F.when(F.col("chain"), F.col("factor"))).alias("contiguous_to"), apart.alias("apart"))
    return out.select(*keys, "contiguous_to", F.when(F.size("apart") > 0, F.array_join(F.transform("apart", lambda f: f.cast("string")), ",")).alias("isolated"))


def smoothed(voxels: DataFrame, sigma: float, radius: int, background: float = 0.0) -> DataFrame:
    """``v - background`` under a separable Gaussian, edges clamped: one window an axis."""
    out = voxels.withColumn("v", F.col("v").cast("double") - background)
    for axis in "xyz":
        out = gaussian(out, axis, sigma, radius)
    return out


def mask_threshold(smooth: DataFrame, keys: list[str], sigma: DataFrame, sigmas: float, fraction: float, inside) -> DataFrame:
    """``keys, threshold``: max(sigmas * sigma, fraction * order statistic floor(0.995 (n - 1))) inside the guards.

    Only the tail over an approximate quantile is ranked, about a hundredth of the voxels.
    """
    inner = smooth.filter(inside)
    cut = F.when(F.count(F.lit(1)) < 2000, F.min("v")).otherwise(F.percentile_approx("v", 0.985, 10_000))
    low = inner.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), cut.alias("low"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("v")))
    tail = inner.join(low, keys).filter("v >= low").select(*keys, "n", "v", place.alias("place"))
    high = tail.filter(F.col("place") == F.col("n") - F.floor(F.lit(0.995) * (F.col("n") - 1))).select(*keys, F.col("v").alias("high"))
    return high.join(sigma, keys).select(*keys, F.greatest(sigmas * F.col("sigma"), fraction * F.col("high")).alias("threshold"))


def signal_mask(voxels: DataFrame, keys: list[str], sigma: DataFrame, sigmas: float, fraction: float, guards: dict[str, tuple[int, int]], background: float = 0.0) -> DataFrame:
    """Voxels of the mask: the smoothed volume lies over the threshold, inside the guards of every axis.

    The mask is read from a smoothed volume, as one read from the voxels it then scores would
    prefer those with high noise. ``sigma``: keys, sigma (0 where a volume is free of noise).
    """
    smooth = smoothed(voxels, 1.0, 4, background)
    inside = F.lit(True)
    for axis, (lo, hi) in guards.items():
        inside = inside & F.col(axis).between(lo, hi)
    limit = mask_threshold(smooth, keys, sigma, sigmas, fraction, inside)
    return smooth.filter(inside).join(limit, keys).filter("v > threshold").select("t", "c", "z", "y", "x", "v")


def evidence(minimum_signal: int) -> Column:
    """The first reason why a region is no evidence, or ``eligible``.

    Columns: geometry_confirmed, noise_known, noise_free, sigma, signal (mask voxels), planes
    (with signal), saturated (voxels at the top).
    """
    free = F.coalesce(F.col("noise_free"), F.lit(False))
    return (
        F.when(~F.coalesce(F.col("geometry_confirmed"), F.lit(False)), "geometry unverified").when(~F.coalesce(F.col("noise_known"), F.lit(False)) & ~free, "noise unverified")
        .when(~free & (F.coalesce(F.col("sigma"), F.lit(0.0)) == 0), "zero noise").when((F.col("signal") < minimum_signal) | (F.col("planes") < 3), "insufficient foreground")
        .when(F.col("saturated") > 0, "saturated").otherwise("eligible")
    )


def with_evidence(regions: DataFrame, minimum_signal: int = 64) -> DataFrame:
    return regions.withColumn("evidence", evidence(minimum_signal))


AGREEMENT = 0.25  # by how much two estimates of a noise may differ
WIDEST = 0.45  # band distance beyond which no noise-only band is left


def noise_fit(sums: DataFrame) -> DataFrame:
    """``gain, sigma`` from the sums n, s, ss, r, sr of (spread signal s, squared residual r) and the kept ``fraction`` of bins.

    Least squares of r on s; a slope that is not positive is no gain. The constant is divided
    by the kept fraction; where it is not positive, there is no fit and both are null.
    """
    spread = F.expr("n * ss - s * s")
    slope = F.when((F.col("n") > 2) & (spread > 0), F.expr("n * sr - s * r") / F.when(spread > 0, spread))
    gain = F.greatest(F.coalesce(slope, F.lit(0.0)), F.lit(0.0))
    fitted = sums.withColumn("gain", gain).withColumn("_v", F.expr("(r - gain * s) / greatest(n, 1) / fraction"))
    known = (F.col("_v") > 0) & (F.col("_v") < float("inf"))
    return fitted.withColumn("sigma", F.when(known, F.sqrt("_v"))).withColumn("gain", F.when(known, F.col("gain"))).drop("_v", "n", "s", "ss", "r", "sr", "fraction")


def noise_acceptance(fits: DataFrame) -> DataFrame:
    """``status`` (why a noise fit is not used, or ``accepted``), and ``variance, gain`` where it is.

    Columns: band (where the fit begins), sigma, gain, check_sigma, check_gain (a second fit halfway to the
    end), background_sigma, noise_known, noise_free, mean_signal (of the scored voxels). The fit
    must agree with the verified background and with the second fit, at the mean scored signal,
    within a quarter. A volume declared free of noise has no noise.
    """
    free, unknown = F.coalesce(F.col("noise_free"), F.lit(False)), F.col("sigma").isNull()
    at_signal = F.col("sigma") * F.col("sigma") + F.col("gain") * F.col("mean_signal")
    other = F.col("check_sigma") * F.col("check_sigma") + F.col("check_gain") * F.col("mean_signal")
    background = F.when(F.col("background_sigma") > 0, F.col("background_sigma"))
    status = (
        F.when(free, "accepted").when(F.col("band") > WIDEST, "no noise-only band").when(unknown, "fit failed")
        .when(~F.coalesce(F.col("noise_known"), F.lit(False)), "background unverified").when(background.isNull(), "no background sigma")
        .when(F.abs(F.col("sigma") / background - 1) > AGREEMENT, "contradicts background").when(F.col("check_sigma").isNull(), "check failed")
        .when(F.abs(other / at_signal - 1) > AGREEMENT, "unstable across band").otherwise("accepted")
    )
    out = fits.withColumn("status", status)
    used = lambda c: F.when(F.col("status") == "accepted", F.when(free, F.lit(0.0)).otherwise(c))
    return out.withColumns({"variance": used(F.col("sigma") * F.col("sigma")), "gain": used(F.col("gain"))})


def compare(one: DataFrame, two: DataFrame, keys: list[str], offset: int, guard: tuple[int, int]) -> DataFrame:
    """Voxel-by-voxel differences at a plane offset, inside the guard planes of the first volume."""
    other = two.select(*keys, (F.col("z") + offset).alias("z"), "y", "x", F.col("v").alias("w"))
    diff = F.abs(F.col("v") - F.col("w"))
    return one.filter(F.col("z").between(*guard)).join(other, [*keys, "z", "y", "x"]).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("voxels"), F.sum(diff).alias("absolute"), F.max(diff).alias("worst")
    )
