"""Operators against published worked examples, computed independently of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from lamella.functions import model
from lamella.operators import beads, kernels, project as pj, reconstruction as rc, resample as rs, sampling_study as ss

VOXEL = "t long, c long, z long, y long, x long, v long"
DEFAULTS = {
    "optics": 0.0, "angle": 25.0, "pixel": 0.116, "step": 0.265, "extent": 119.25, "minimum_step": 0.265, "maximum_step": 1.06, "na": 0.8, "wavelength_nm": 520.0, "refractive_index": 1.333,
    "sheet_fwhm": 1.0, "fwhm_x": 0.5, "fwhm_y": 0.5, "fwhm_z": 1.1, "kz": 0.8, "ky": 1.75, "threshold": 0.05, "safety": 0.8, "scan_mode": 0.0, "exposure_ms": 100.0, "period_ms": 100.0, "overhead_ms": 0.0,
    "flyback_ms": 0.0, "relative_motion_floor": 0.8, "absolute_motion_floor": 0.8, "baseline_motion_floor": 0.1, "measured_period": False, "fixed_velocity": False, "preserve_blur": False, "gate_absolute_motion": False,
}


def volume(spark, values, c=1):
    """Voxels of one line along x."""
    return spark.createDataFrame([(0, c, 0, 0, i, int(v)) for i, v in enumerate(values)], VOXEL)


def ranged(spark, values, previous=0):
    r = pj.auto_range(volume(spark, values), ["t", "c"], previous).first()
    return r.low, r.high, r.stage


def test_stages_halve_and_wrap_after_nine():
    stage, seen = 0, []
    for _ in range(11):
        stage = pj.next_stage(stage)
        seen.append(stage)
    assert seen == [5000, 2500, 1250, 625, 312, 156, 78, 39, 19, 9, 5000]


def test_automatic_range(spark):
    low, high, stage = ranged(spark, [0] * 9000 + [100 + i % 200 for i in range(1000)])
    assert low > 90 and high < 300 and stage == 5000  # a background peak of 90 % is ignored
    assert ranged(spark, range(256), 19) == (0, 255, 0)  # no bin passes: the whole range, and the cycle begins anew
    assert ranged(spark, [123] * 50)[:2] == (123, 124)
    values = [0, 10000] + [1000 + i % 1000 for i in range(2, 20000)]
    stage, widths = 0, []
    for _ in range(15):
        low, high, stage = ranged(spark, values, stage)
        widths.append(high - low)
        if stage == 0:
            break
    assert stage == 0 and (low, high) == (0, 10000) and min(widths[1:]) < widths[0]
    assert ranged(spark, values, stage)[2] == 5000


def test_pooled_error_is_no_mean(spark):
    pairs = spark.createDataFrame([(0, 1.0, 2.0), (1, 10.0, 11.0)], "phase int, ref double, pred double")
    stats = ss.statistics(pairs, ["phase"])
    one = ss.pooled(stats.withColumn("k", F.lit(1)), ["k"]).first()
    assert one.nrmse == pytest.approx(0.14071950894605836, abs=1e-12) and one.bias == 1.0 and one.excess is None
    phases = [r.nrmse for r in ss.pooled(stats, ["phase"]).collect()]
    assert sum(phases) / 2 == pytest.approx(0.55, abs=1e-12)


def test_increase_is_a_difference_of_energies(spark):
    """Factor 2 scored in both phases, factor 3 in all, factor 4 in three of four."""
    rows = [(f, p, 10.0, 10.0 + d) for f, d in ((2, 1.0), (3, 2.0), (4, 3.0)) for p in range(f) if (f, p) != (4, 3)]
    stats = ss.statistics(spark.createDataFrame(rows, "factor int, phase int, ref double, pred double").withColumn("k", F.lit(1)), ["k", "factor", "phase"])
    got = {r.factor: r for r in ss.verdicts(stats, ["k"], 0.15, fit=(0.0, 0.0)).collect()}
    assert [got[f].verdict for f in (2, 3, 4)] == ["Pass", "Fails", "Incomplete"]
    assert got[2].increase == 0 and got[3].increase == pytest.approx(math.sqrt(0.2**2 - 0.1**2)) and got[4].increase is None
    none = spark.createDataFrame([(1, "saturated")], "k int, evidence string")
    assert {r.verdict for r in ss.verdicts(stats, ["k"], 0.15, evidence=none, by=["k"]).collect()} == {"Insufficient evidence", "Incomplete"}


def test_reasons_against_evidence_come_in_order(spark):
    rows = [(0, False, False, False, 0.0, 0, 0, 9), (1, True, False, False, 1.0, 99, 9, 0), (2, True, True, False, 0.0, 99, 9, 0), (3, True, True, False, 1.0, 63, 9, 0), (4, True, False, True, 0.0, 64, 2, 0), (5, True, True, False, 1.0, 64, 3, 1), (6, True, True, False, 1.0, 64, 3, 0)]
    df = spark.createDataFrame(rows, "i int, geometry_confirmed boolean, noise_known boolean, noise_free boolean, sigma double, signal int, planes int, saturated int")
    got = [r.evidence for r in ss.with_evidence(df).orderBy("i").collect()]
    assert got == ["geometry unverified", "noise unverified", "zero noise", "insufficient foreground", "insufficient foreground", "saturated", "eligible"]


def settings(spark, **changes):
    return spark.createDataFrame([{"id": 1, **DEFAULTS, **changes}])


def predicted(spark, factor, **changes):
    df = model.support(settings(spark, **changes))
    return model.predict(df, F.lit(0.265 * factor)).first()


def test_step_model(spark):
    assert predicted(spark, 1, optics=2.0).absolute_motion == pytest.approx(0.6819363698580614, abs=1e-12)
    twice = predicted(spark, 2, optics=2.0, preserve_blur=True)
    assert (twice.frame_exposure_ms, twice.frame_ms, twice.blur) == pytest.approx((50, 100, 0.265), abs=1e-12)
    base, twice = predicted(spark, 1, optics=2.0, fixed_velocity=True), predicted(spark, 2, optics=2.0, fixed_velocity=True)
    assert twice.seconds == pytest.approx(base.seconds, abs=1e-12) and twice.speedup == pytest.approx(1, abs=1e-12)
    assert not predicted(spark, 1, optics=2.0, fixed_velocity=True, gate_absolute_motion=True).motion_pass
    assert predicted(spark, 1, optics=2.0, scan_mode=2.0).relative_motion is None
    assert predicted(spark, 1).planes == 451


def test_support_of_the_optics(spark):
    width = 2 * math.sqrt(2 * math.log(2))
    sigma = 1.77 * 1.333 * 0.520 / 0.8**2 / width
    precision = 1 / sigma**2 + (math.cos(math.radians(25)) * width) ** 2
    got = model.support(settings(spark)).first()
    assert got.kz_ == pytest.approx(math.sqrt(math.log(20) / (2 * math.pi**2) * precision), abs=1e-12)
    cap = spark.range(1).select(model.alias_cap(F.lit(0.8), F.lit(33.5)).alias("c")).first().c
    assert cap == pytest.approx(0.944271996009313, abs=1e-12)


def test_step_interval_ends_at_the_first_gap(spark):
    r = model.step_interval(settings(spark, optics=2.0, scan_mode=1.0, maximum_step=2.0)).first()
    assert r.lo == pytest.approx(0.265) and r.hi == pytest.approx(0.8 * 1 / (2 * 0.8 * math.tan(math.radians(25))), abs=2e-3)
    assert model.step_interval(settings(spark, optics=2.0, scan_mode=2.0)).first().lo is None


def bead_volume(spark, size, base, spots):
    nx, ny, nz = size
    return spark.createDataFrame([(0, 1, z, y, x, float(spots.get((x, y, z), base))) for z in range(nz) for y in range(ny) for x in range(nx)], VOXEL.replace("v long", "v double"))


def quality(spark, size, base, spots, centres, radius, **settings):
    from lamella.operators import points as pt

    v = bead_volume(spark, size, base, spots)
    b = spark.createDataFrame([(i, 0, 1, z, y, x) for i, (x, y, z) in enumerate(centres)], "bead long, t long, c long, bz long, by long, bx long")
    crops = pt.crops(v, b, radius)
    given = {"snr": 0.0, "sbr": 0.0, "off_centre": 2.0, "neighbours": False, **settings}
    return crops, beads.bead_quality(crops, b, radius, ["t", "c"], **given)


def test_accepted_bead_has_no_background_and_unit_integral(spark):
    radius = {"z": 2, "y": 3, "x": 3}
    crops, q = quality(spark, (9, 9, 7), 100.0, {(4, 4, 3): 500.0, (3, 4, 3): 180.0, (5, 4, 3): 180.0}, [(4, 4, 3)], radius, snr=5.0, sbr=1.5)
    assert q.first().reason == "accepted"
    one = beads.normalised(crops, q)
    assert one.agg(F.sum("v")).first()[0] == pytest.approx(1.0) and one.filter("dz = -2 AND dy = -3 AND dx = -3").first().v == 0
    assert {r.reason: r.beads for r in beads.reason_counts(q).collect()} == {"accepted": 1}


@pytest.mark.parametrize("case", [
    ("edge", (9, 9, 9), 10.0, {(1, 4, 4): 50.0}, [(1, 4, 4)], {}),
    ("neighbour", (9, 9, 9), 10.0, {(4, 4, 4): 50.0, (5, 4, 4): 50.0}, [(4, 4, 4), (5, 4, 4)], {"neighbours": True}),
    ("saturated", (9, 9, 9), 10.0, {(4, 4, 4): 65535.0}, [(4, 4, 4)], {"saturation": 65535.0}),
    ("off centre", (9, 9, 9), 10.0, {(6, 4, 4): 100.0}, [(4, 4, 4)], {"off_centre": 0.5}),
    ("low snr", (9, 9, 9), 100.0, {**{(x, y, z): 99.0 + (x + y + z) % 3 for x in range(2, 7) for y in range(2, 7) for z in range(2, 7)}, (4, 4, 4): 102.0}, [(4, 4, 4)], {"snr": 5.0}),
    ("low sbr", (9, 9, 9), 100.0, {(4, 4, 4): 120.0}, [(4, 4, 4)], {"sbr": 1.5}),
    ("low snr", (9, 9, 9), 100.0, {}, [(4, 4, 4)], {}),
])
def test_reasons_to_reject_a_bead(spark, case):
    reason, size, base, spots, centres, given = case
    _, q = quality(spark, size, base, spots, centres, {"z": 2, "y": 2, "x": 2}, **given)
    assert {r.reason for r in q.collect()} == {reason}


def test_combined_kernels(spark):
    rows = [(b, 0, y, x, v if (y, x) == (0, 0) else 0.0) for b, v in ((1, 2.0), (2, 8.0)) for y in (-1, 0, 1) for x in (-1, 0, 1)]
    crops = spark.createDataFrame([(1, *r) for r in rows], "g int, bead long, dz long, dy long, dx long, v double")
    for method in ("median", "mean"):
        assert [r.v for r in beads.combined(crops, ["g"], method).filter("v > 0").collect()] == [1.0]
    every = beads.combined(crops, ["g"], "all").filter("v > 0").collect()
    assert [(r.bead, r.v) for r in sorted(every)] == [(1, 1.0), (2, 1.0)]


def test_mean_of_a_deskewed_constant_counts_what_lies_outside(spark):
    """Against numpy over the whole box: a constant volume of 1000 has a mean projection under 1000."""
    from lamella.functions import matrix as mx

    shape = (3, 6, 5)  # x, y, z
    v = spark.createDataFrame([(0, 1, z, y, x, 1000) for z in range(5) for y in range(6) for x in range(3)], VOXEL)
    import numpy as np

    dense = np.floor(rs.deskew_block(np.full((3, 5, 6), 1000.0), mx.deskew(0.2, 0.1, 30.0, 6), rs.deskewed_size(0.2, 0.1, 30.0, shape)[1:]) + 0.5)
    out = rs.deskew(v, 0.2, 0.1, 30.0, shape, block=2)
    assert out.count() == dense.size
    got = {(r.y, r.x): r.v for r in pj.projection(out, "z", "mean").collect()}
    for (y, x), m in got.items():
        assert m == (int(dense[x, :, y].sum()) + dense.shape[1] // 2) // dense.shape[1]
    assert max(got.values()) < 1000
    general = rs.affine(v, mx.deskew(0.2, 0.1, 30.0, 6), shape, rs.deskewed_size(0.2, 0.1, 30.0, shape))
    assert sorted(map(tuple, general.collect())) == sorted(map(tuple, out.collect()))


def test_kernels_do_not_depend_on_the_rows_present(spark):
    """Volumes with and without their zero rows give equal results."""
    import numpy as np

    rng = np.random.RandomState(4)
    rows = [(0, 1, z, y, x, int(rng.randint(1, 500)) if z < 6 and y > 2 and x > 1 else 0) for z in range(8) for y in range(8) for x in range(6)]
    full = spark.createDataFrame(rows, VOXEL)
    part = full.filter("v > 0")
    psf, scan = np.ones((3, 3, 3)), rc.Scan(0.116, 0.265, 25.0, padding=4)
    for f in (
        lambda v: kernels.deconvolve(v, psf, (6, 8, 8), (4, 4, 4), rounds=2).filter("v > 1e-9"),
        lambda v: rc.reconstruct(v.filter("z % 2 = 0").withColumn("z", F.expr("z div 2")), scan.every(2), (4, 8)).filter("x > 1"),
        lambda v: rc.noise_sums(v, scan, (8, 8), 0.3, {"z": (0, 7), "y": (0, 7), "x": (2, 5)}),
        lambda v: rc.sweep(v.filter("x > 1"), scan, [2], (8, 8)),
    ):
        one, two = (sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in f(v).collect()) for v in (full, part))
        assert one == two
