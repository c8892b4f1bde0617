"""Fourier reconstruction, its noise and the step study against analytic fields and seeded noise."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.operators import reconstruction as rc, sampling_study as ss, step_study as st

PIXEL, STEP, ANGLE = 0.116, 0.265, 33.5
WIDTH = 2.3548  # full width at half maximum of a Gaussian, in sigmas


def dense(step=STEP, **more):
    return rc.Scan(PIXEL, step, ANGLE, **more)


def raw(field, height=128, depth=129):
    """A dense (plane, row) section of a field of (y, z) in the sample, over a background of 100."""
    a = math.radians(ANGLE)
    u, v = np.arange(height)[None, :] - (height - 1) / 2, np.arange(depth)[:, None] - (depth - 1) / 2
    return 100 + field(PIXEL * math.cos(a) * u + STEP * v, -PIXEL * math.sin(a) * u + 0 * v)


def bead(fy, fz):
    return lambda y, z: 1000 * np.exp(-0.5 * ((y * WIDTH / fy) ** 2 + (z * WIDTH / fz) ** 2))


def packet(ky):
    return lambda y, z: 500 * np.exp(-(y * y + z * z) / (2 * 1.5**2)) * np.cos(2 * np.pi * ky * y)


def error(field, factor, phase, guard=4):
    """NRMSE at the planes left out."""
    section = raw(field)
    scan = dense(background=100.0).every(factor)
    got = rc.reconstruct_sections(section[None, phase::factor], scan)[0]
    ref = section[phase : phase + len(got)]
    held = np.arange(len(got)) % factor != 0
    held[:guard] = held[-guard:] = False
    return math.sqrt(((got - ref)[held] ** 2).sum() / ((ref[held] - 100) ** 2).sum())


def test_narrow_bead_and_wrapped_frequencies_come_back():
    for phase in (0, 1):
        assert error(bead(0.30, 0.80), 2, phase) < 0.02
    for ky in (2.5, 3.0):  # over half a cycle a plane: the band wraps round
        assert error(packet(ky), 2, 0) < 0.01


@pytest.mark.parametrize("phase", [0, 1])
def test_tilted_spot_comes_back(phase):
    v, u = np.arange(97)[:, None] - 48.0, np.arange(96)[None, :] - 47.5
    a = math.radians(ANGLE)
    section = 100 + 1000 * np.exp(-0.5 * ((STEP / PIXEL * v + math.cos(a) * u) ** 2 / 4 + (math.sin(a) * u) ** 2 / 16))
    got = rc.reconstruct_sections(section[None, phase::2], dense(background=100.0).every(2))[0]
    ref = section[phase : phase + len(got)]
    assert math.sqrt(((got - ref)[5:-4:2] ** 2).sum() / ((ref[5:-4:2] - 100) ** 2).sum()) < 0.015


def test_mask_keeps_one_copy_of_each_frequency():
    for factor in (2, 3, 4):
        w = rc.band_weights(120, 64, dense().slope, factor)
        copies = w.reshape(factor, 120 // factor, 64).sum(axis=0)
        assert copies.max() <= 1 and (copies == 1).mean() >= 0.98
    w = rc.band_weights(64, 32, dense().slope, 2, 0.2)
    assert w[0, 0] == 1 and np.array_equal(w, rc._conjugate(w)) and ((w > 0) & (w < 1)).any()


def test_one_is_the_identity_and_background_stays():
    rng = np.random.default_rng(1)
    section = rng.normal(0, 50, (3, 20, 16))
    assert np.allclose(rc.reconstruct_sections(section, dense()), section, atol=1e-9)
    flat = rc.reconstruct_sections(np.full((1, 7, 16), 100.0), dense(background=100.0).every(3))
    assert flat.shape == (1, 19, 16) and np.allclose(flat, 100, atol=1e-9)
    for bad in ({"angle": 90.0}, {"step": math.nan}, {"pixel": 0.0}, {"factor": 65}, {"padding": -1}, {"taper": 1.0}):
        with pytest.raises(ValueError):
            rc.Scan(**({"pixel": PIXEL, "step": STEP, "angle": ANGLE} | bad))


def test_padded_sizes_are_powers_of_two():
    assert [rc.padded(n, p) for n, p in ((1, 0), (2, 0), (3, 0), (64, 32), (65, 32))] == [2, 2, 4, 128, 256]


def test_support_of_a_bead_is_that_of_its_spectrum(spark):
    section = raw(bead(0.45, 1.04))
    kz = math.sqrt(math.log(1 / 0.05) / (2 * math.pi**2 * (1.04 / WIDTH) ** 2))
    bound = 1 / (2 * STEP * math.tan(math.radians(ANGLE)) * kz)
    _, support = rc.bead_spectrum(section - 100, dense(), 0.05)
    assert 0.5 / support == pytest.approx(bound, rel=0.03)
    assert rc.bead_spectrum(section - 200, dense(), 0.05) is None  # too high a background leaves no positive sum
    rows = [(k, z, y, x, float(v)) for k, spot in ((1, [[0, 0, 0], [0, 9, 0], [0, 0, 0]]), (2, [[0, 0, 0], [0, 0, 0], [0, 0, 0]])) for z, r in zip((-1, 0, 1), spot) for y, v in zip((-1, 0, 1), r) for x in (0, 1)]
    crops = spark.createDataFrame(rows, "bead long, dz long, dy long, dx long, v double")
    got = {r.bead: (r.support, r.factor) for r in rc.bead_spectra(crops, {"z": 1, "y": 1}, dense(padding=2)).collect()}
    assert got[1] == (0.5, 1.0) and got[2] == (None, None)  # a point has all frequencies
    flat = rc.bead_amplitudes(crops, {"z": 1, "y": 1}, dense(padding=2))
    assert flat.count() == 64 and flat.agg(F.max(F.abs("amplitude"))).first()[0] < 1e-9


def test_variance_of_a_reconstruction_by_repeated_noise():
    """Noise that varies in space, 4000 draws: the propagated variance within 5 % (its own error is 2 %)."""
    rng = np.random.default_rng(3)
    scan = dense(padding=4, background=7.0).every(3)
    variance = 1 + 20 * rng.random((1, 6, 12)) * (np.arange(12) > 6)
    read, shot = rc.propagate_sections(np.ones_like(variance), variance, scan)
    draws = np.concatenate([rc.reconstruct_sections(7 + rng.normal(size=(500, 6, 12)) * np.sqrt(variance), scan) for _ in range(8)])
    assert abs(draws.var(axis=0) / shot[0] - 1).max() < 0.15 and draws.var(axis=0).mean() == pytest.approx(shot.mean(), rel=0.02)
    assert not np.allclose(read * variance.mean(), shot, rtol=0.2)  # a mean level would not do


def spots(seed, gain, sigma, shape=(12, 64, 80)):
    """Twelve spots (x, plane, row) as wide as measured ones, shot noise of a gain and read noise."""
    rng = np.random.default_rng(seed)
    nx, nz, ny = shape
    x, z, y = np.indices(shape)
    a = math.radians(ANGLE)
    clean = np.zeros(shape)
    for _ in range(12):
        cx, cz, cy = rng.uniform(3, nx - 3), rng.uniform(14, nz - 14), rng.uniform(14, ny - 14)
        ly, lz = PIXEL * math.cos(a) * (y - cy) + STEP * (z - cz), -PIXEL * math.sin(a) * (y - cy)
        clean += rng.uniform(400, 900) * np.exp(-0.5 * ((ly * WIDTH / 0.5) ** 2 + (lz * WIDTH / 1.1) ** 2 + ((x - cx) * PIXEL * WIDTH / 0.5) ** 2))
    noisy = clean + rng.normal(size=shape) * np.sqrt(gain * clean + sigma**2)
    return clean + 100, noisy + 100


def frame(spark, volume, t=0):
    import pandas as pd

    x, z, y = (g.ravel() for g in np.indices(volume.shape))
    pdf = pd.DataFrame({"t": t, "c": 1, "z": z, "y": y, "x": x, "v": volume.ravel()})
    return spark.createDataFrame(pdf, "t long, c long, z long, y long, x long, v double")


@pytest.mark.parametrize(("gain", "sigma"), [(2.0, 8.9), (0.5, 3.0), (4.0, 15.0)])
def test_gain_and_read_noise_are_found(spark, gain, sigma):
    _, noisy = spots(5, gain, sigma)
    guards = {"z": (8, 55), "y": (8, 71), "x": (0, 11)}
    sums = rc.noise_sums(frame(spark, noisy), dense(background=100.0), (64, 80), 0.3, guards)
    fit = ss.noise_fit(sums).first()
    assert fit.gain == pytest.approx(gain, rel=0.25) and fit.sigma == pytest.approx(sigma, rel=0.1)


def entered(spark, rows):
    return spark.createDataFrame(rows, "t long, c long, background_sigma double, noise_known boolean, noise_free boolean")


def test_study_separates_noise_from_structure(spark):
    """The excess of noisy spots is near the error of the same spots without noise; the raw score is not."""
    clean, noisy = spots(8, 2.0, 8.9)
    volumes = frame(spark, noisy).union(frame(spark, clean, t=1))
    model, sums = st.step_study(volumes, dense(background=100.0), [2, 3], (64, 80, 12), entered(spark, [(0, 1, 8.9, True, False), (1, 1, 0.0, False, True)]), kz=0.8, guard=2)
    status = {r.t: (r.status, r.variance, r.gain) for r in model.collect()}
    assert status[0][0] == "accepted" and status[0][2] == pytest.approx(2.0, rel=0.25) and status[1] == ("accepted", 0.0, 0.0)
    out = ss.verdicts(sums.filter("heldout"), ["t", "c", "method"], 0.15, ("variance", "gain"))
    got = {(r.t, r.method, r.factor): r for r in out.collect()}
    for factor in (2, 3):
        own, truth = got[0, "fourier", factor], got[1, "fourier", factor]
        assert own.noise_share > 0.3 and truth.noise_share == 0 and truth.excess == pytest.approx(truth.score)
        assert abs(own.excess - truth.excess) < 0.06 < own.score - truth.score
    assert sums.filter("NOT heldout AND method = 'fourier'").agg(F.max("read_floor")).first()[0] == 0


def test_every_reason_against_a_noise_model(spark):
    rows = [
        # band, sigma, gain, check sigma and gain, background, known, free, mean signal
        (0.46, None, None, None, None, 1.0, True, False, 1.0, "no noise-only band"),
        (0.3, None, None, 1.0, 0.0, 1.0, True, False, 1.0, "fit failed"),
        (0.3, 1.0, 0.0, 1.0, 0.0, 1.0, False, False, 1.0, "background unverified"),
        (0.3, 1.0, 0.0, 1.0, 0.0, 0.0, True, False, 1.0, "no background sigma"),
        (0.3, 88.0, 0.0, 88.0, 0.0, 1.0, True, False, 1.0, "contradicts background"),
        (0.3, 1.0, 0.0, None, None, 1.0, True, False, 1.0, "check failed"),
        (0.3, 1.0, 1.0, 1.0, 2.0, 1.0, True, False, 10.0, "unstable across band"),
        (0.3, 1.0, 1.0, 1.0, 1.1, 0.9, True, False, 10.0, "accepted"),
        (0.46, None, None, None, None, None, None, True, None, "accepted"),
    ]
    fits = spark.createDataFrame(rows, "band double, sigma double, gain double, check_sigma double, check_gain double, background_sigma double, noise_known boolean, noise_free boolean, mean_signal double, expected string")
    got = ss.noise_acceptance(fits).collect()
    assert [r.status for r in got] == [r.expected for r in got]
    assert [(r.variance, r.gain) for r in got] == [(None, None)] * 7 + [(1.0, 1.0), (0.0, 0.0)]


def test_fit_without_a_positive_constant_is_refused(spark):
    sums = spark.createDataFrame([(10, 100.0, 1001.0, 5.0, 60.0, 0.4), (10, 100.0, 1010.0, 90.0, 850.0, 0.5), (0, 0.0, 0.0, 0.0, 0.0, 0.5)], "n long, s double, ss double, r double, sr double, fraction double")
    got = [(r.gain, r.sigma) for r in ss.noise_fit(sums).collect()]
    assert got[0] == (None, None) and got[1] == (0.0, pytest.approx(math.sqrt(18))) and got[2] == (None, None)


def test_planes_common_to_all_phases():
    assert rc.domain(10, [2, 3, 4], 0) == (3, 6)
    for depth, factors, guard in ((10, [2, 3, 4], 1), (4, [4], 0)):
        with pytest.raises(ValueError):
            rc.domain(depth, factors, guard)
