"""Sampling model of a scan: alias limits, plane counts, spectral weights, parameter checks."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sinc(x: Column) -> Column:
    return F.when(F.abs(F.lit(math.pi) * x) < 1e-9, 1.0).otherwise(F.sin(F.lit(math.pi) * x) / (F.lit(math.pi) * x))


def alias_cap(support: Column, degrees: Column) -> Column:
    """Largest step without aliasing of a band: 1 / (2 k tan)."""
    return 1 / (2 * support * F.tan(F.radians(degrees)))


def plane_count(extent: Column, step: Column) -> Column:
    """Planes that cover an extent; a quotient within rounding of a whole number is that number."""
    ratio = extent / step
    ulp = F.pow(F.lit(2.0), F.floor(F.log2(ratio)) - 52)
    whole = F.abs(ratio - F.rint(ratio)) <= F.greatest(F.lit(1e-12), 8 * ulp)
    return F.when(whole, F.rint(ratio)).otherwise(F.ceil(ratio)).cast("long") + 1


def factors(step: Column, limit: Column, most: int) -> Column:
    """Decimation factors whose step stays within a limit."""
    return F.filter(F.sequence(F.lit(2), F.lit(most)), lambda f: f * step <= limit)


def bin_frequency(k: Column, n: int) -> Column:
    return F.when(k < n // 2, k).otherwise(k - n) / F.lit(float(n))


def wrapped_distance(f: Column, centre: Column) -> Column:
    """Distance on the unit circle of frequencies."""
    d = f - centre
    return F.abs(d - F.floor(d + 0.5))


def cosine_taper(d: Column, inner: float, outer: float) -> Column:
    return F.when(d <= inner, 1.0).when(d >= outer, 0.0).otherwise(0.5 * (1 + F.cos(F.lit(math.pi) * (d - inner) / (outer - inner))))


def padded_power(n: Column) -> Column:
    """Next power of two."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(n))).cast("long")


def problem(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that does not hold (or is unknown); NULL if all hold."""
    return reduce(lambda out, rule: out.when(~F.coalesce(rule[1], F.lit(False)), rule[0]), rules[1:], F.when(~F.coalesce(rules[0][1], F.lit(False)), rules[0][0]))


FWHM = 2 * math.sqrt(2 * math.log(2))  # of a Gaussian, in standard deviations


def support(settings: DataFrame) -> DataFrame:
    """``settings`` with the support of its optics: kz_, ky_ (cycles a micrometre), alias_cap, sensitivity_cap, row_fraction, x_fraction.

    optics 0: Gaussian detection times sheet (na, wavelength_nm, refractive_index, sheet_fwhm);
    1: effective Gaussian widths (fwhm_x, fwhm_y, fwhm_z); 2: entered support (kz, ky), which says
    nothing of the camera's rows. ``threshold`` is the transfer at which support ends, ``safety`` the
    share of the alias limit to use. Camera fractions relate the band to the Nyquist limit.
    """
    col = F.col
    detection, entered = col("optics") == 0, col("optics") == 2
    um = col("wavelength_nm") / 1000
    sx = F.when(detection, 0.51 * um / col("na") / FWHM).otherwise(col("fwhm_x") / FWHM)
    sy = F.when(detection, 0.51 * um / col("na") / FWHM).otherwise(col("fwhm_y") / FWHM)
    sz = F.when(detection, 1.77 * col("refractive_index") * um / (col("na") * col("na")) / FWHM).otherwise(col("fwhm_z") / FWHM)
    sine, cosine = F.sin(F.radians("angle")), F.cos(F.radians("angle"))
    sheet = F.when(detection, F.pow(FWHM / col("sheet_fwhm"), 2)).otherwise(0.0)
    qxx, qyy, qzz, qyz = 1 / (sx * sx), 1 / (sy * sy) + sine * sine * sheet, 1 / (sz * sz) + cosine * cosine * sheet, sine * cosine * sheet
    at = lambda log: F.lit(1 / (2 * math.pi**2)) * log
    c = at(F.log(1 / col("threshold")))
    out = settings.withColumns({
        "kz_": F.when(entered, col("kz")).otherwise(F.sqrt(c * qzz)), "ky_": F.when(entered, col("ky")).otherwise(F.sqrt(c * qyy)),
        "x_fraction": F.when(~entered, 2 * col("pixel") * F.sqrt(c * qxx)),
        "row_fraction": F.when(~entered, 2 * col("pixel") * F.sqrt(c * (cosine * cosine * qyy + sine * sine * qzz - 2 * sine * cosine * qyz))),
        "sensitivity_cap": F.when(~entered, col("safety") * alias_cap(F.sqrt(at(F.lit(math.log(10))) * qzz), col("angle"))),
    })
    return out.withColumn("alias_cap", col("safety") * alias_cap(col("kz_"), col("angle")))


def predict(rows: DataFrame, candidate: Column, samples: int = 256) -> DataFrame:
    """``rows`` (settings with their support) with what a candidate scan step does to aliasing, motion and time.

    scan_mode 0: continuous, 1: step and hold, 2: unknown. ``relative_motion`` is the least ratio of
    the motion's transfer to that of the present step over the band; it is known only inside the
    transfer's first lobe and where the present transfer is high enough.
    """
    col = F.col
    hold, unknown = col("scan_mode") == 1, col("scan_mode") == 2
    out = rows.withColumn("candidate", candidate).withColumn("t0", F.when(col("measured_period"), col("period_ms")).otherwise(col("exposure_ms") + col("overhead_ms")))
    out = out.withColumns({"frame_ms": F.when(col("fixed_velocity"), col("t0") * col("candidate") / col("step")).otherwise(col("t0")), "l0": col("step") * col("exposure_ms") / col("t0")})
    out = out.withColumn("frame_exposure_ms", F.when(col("preserve_blur"), col("l0") * col("frame_ms") / col("candidate")).otherwise(col("exposure_ms")))
    out = out.withColumn("blur", F.when(hold, 0.0).otherwise(col("candidate") * col("frame_exposure_ms") / col("frame_ms")))
    lobe = hold | ((col("ky_") * col("l0") < 1) & (col("ky_") * col("blur") < 1))
    base = F.when(hold, 1.0).otherwise(sinc(col("ky_") * col("l0")))

    def ratio(i: Column) -> Column:
        k = col("ky_") * i / float(samples)
        return sinc(k * col("blur")) / F.when(hold, 1.0).otherwise(sinc(k * col("l0")))

    # Inside the first lobe the ratio has one direction: with g(x) = pi x cot(pi x) - 1, which falls from 0 to 1, its slope has the sign of
    # g(k blur) - g(k l0). So the least of 1 and all samples is that of 1 and the last one. Settings without that sign of lobe are sampled.
    first_lobe = (F.abs(col("ky_") * col("blur")) < 1) & (F.abs(col("ky_") * col("l0")) < 1)
    sampled = F.aggregate(F.sequence(F.lit(1), F.lit(samples)), F.lit(1.0), lambda low, i: F.least(low, ratio(i)))
    worst = F.when(first_lobe, F.least(F.lit(1.0), ratio(F.lit(samples)))).otherwise(sampled)
    planes = plane_count(col("extent"), col("candidate"))
    seconds = ((planes - 1) * col("frame_ms") + col("frame_exposure_ms") + col("flyback_ms")) / 1000
    present = ((plane_count(col("extent"), col("step")) - 1) * col("t0") + col("exposure_ms") + col("flyback_ms")) / 1000
    out = out.withColumns({
        "lobe": lobe, "absolute_motion": F.when(~unknown, F.abs(sinc(col("ky_") * col("blur")))),
        "relative_motion": F.when(~unknown & lobe & (base >= col("baseline_motion_floor")), worst),
        "planes": planes, "overshoot": F.greatest((planes - 1) * col("candidate") - col("extent"), F.lit(0.0)), "seconds": seconds, "speedup": present / seconds,
    })
    camera = (F.coalesce(col("row_fraction"), F.lit(0.0)) >= 1) | (F.coalesce(col("x_fraction"), F.lit(0.0)) >= 1)
    timed = (col("frame_exposure_ms") <= col("frame_ms")) & (col("frame_exposure_ms") > 0)
    still = ~col("gate_absolute_motion") | F.coalesce(col("absolute_motion") >= col("absolute_motion_floor"), F.lit(False))
    moves = F.coalesce(col("relative_motion") >= col("relative_motion_floor"), F.lit(False))
    return out.withColumns({"alias_pass": (col("candidate") <= col("alias_cap")) & ~camera, "motion_pass": col("lobe") & moves & still & timed})


def step_interval(settings: DataFrame, samples: int = 1001) -> DataFrame:
    """``id, lo, hi``: the first unbroken run of passing steps among ``samples`` from minimum_step to maximum_step; NULL if none.

    Candidates are generated inside each row and reduced again by the next aggregate. Settings are short and their candidates many,
    so they are dealt to tasks by their number and not by their bytes, and by id, so that candidates need no shuffle.
    """
    last = samples - 1
    tasks = int(settings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = support(settings.repartition(tasks, "id")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(last))))
    tried = predict(each, F.col("minimum_step") + (F.col("maximum_step") - F.col("minimum_step")) * F.col("i") / float(last))
    passed = F.col("alias_pass") & F.col("motion_pass")
    runs = tried.groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(passed, F.struct("i", "candidate")))).alias("good"), F.count(F.lit(1)).alias("n")
    )
    # Of the passing steps in order, those before the first gap: index minus place is constant there.
    first = F.filter("good", lambda g, k: g["i"] - k == F.col("good")[0]["i"])
    return runs.withColumn("run", first).select("id", F.when(F.size("good") > 0, F.try_element_at("run", F.lit(1))["candidate"]).alias("lo"), F.when(F.size("good") > 0, F.try_element_at("run", F.lit(-1))["candidate"]).alias("hi"))
