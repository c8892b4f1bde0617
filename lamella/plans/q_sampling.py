"""Queries of Fourier reconstruction, its noise and the study of scan steps."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamella.operators import reconstruction as rc, sampling_study as ss, step_study as st, voxels as vx
from lamella.plans import views
from lamella.plans.q_points import CROPS_SQL, RADIUS, crops
from lamella.plans.q_projections import _smooth_sql
from lamella.plans.registry import query

W = H = D = 10
V = f"WITH {views.VOXELS} "
LEVEL = 5000  # about the mean of the views' voxels: what lies over it counts as signal
DENSE = rc.Scan(pixel=0.116, step=0.265, angle=25.0, padding=4, background=float(LEVEL), taper=0.2)
SIDE = rc.padded(H, DENSE.padding)


def _v(spark, sf_dir):
    return views.voxels(spark, sf_dir)


def _bin(k: str, n: int) -> str:
    return f"(CASE WHEN {k} < {(n + 1) // 2} THEN {k} ELSE {k} - {n} END / {n}.0e0)"


def _distance(kz: str, ky: str, nz: int, ny: int, slope: float) -> str:
    offset = f"({_bin(kz, nz)} - {slope!r}e0 * {_bin(ky, ny)})"
    return f"abs({offset} - floor({offset} + 0.5e0))"


def _bins(nz: int, ny: int, slope: float) -> str:
    """Rows (kz, ky, d, e): every bin's distance from the band and that of its conjugate."""
    return f"""(SELECT kz, ky, {_distance("kz", "ky", nz, ny, slope)} AS d, {_distance(f"(({nz} - kz) % {nz})", f"(({ny} - ky) % {ny})", nz, ny, slope)} AS e
      FROM (SELECT unnest(range({nz})) AS kz), (SELECT unnest(range({ny})) AS ky))"""


def _kernel(name: str, weights: str, nz: int, ny: int) -> str:
    """CTE ``name`` (dz, dy, k): the circular kernel of symmetric weights (kz, ky, w)."""
    return f"""{name} AS (SELECT dz, dy, sum(w * cos(2 * pi() * (kz * dz / {nz}.0e0 + ky * dy / {ny}.0e0))) / {nz * ny} AS k
      FROM {weights}, (SELECT unnest(range({nz})) AS dz), (SELECT unnest(range({ny})) AS dy) WHERE w <> 0 GROUP BY dz, dy)"""


def band_sql(name: str, nz: int, ny: int, factor: int, scan=DENSE) -> str:
    """CTE ``name``: kernel of the band mask of a factor, the smaller weight of a bin and its conjugate."""
    edge, inner = 0.5 / factor, 0.5 / factor * (1 - scan.taper)
    w = lambda d: f"CASE WHEN {d} >= {edge!r}e0 THEN 0.0e0 WHEN {d} <= {inner!r}e0 THEN 1.0e0 ELSE 0.5e0 + 0.5e0 * cos(pi() * ({d} - {inner!r}e0) / {edge * scan.taper!r}e0) END"
    return _kernel(name, f"(SELECT kz, ky, least({w('d')}, {w('e')}) AS w FROM {_bins(nz, ny, scan.slope)})", nz, ny)


def noise_sql(name: str, band: float, guards: dict[str, tuple[int, int]]) -> str:
    """CTEs ending in ``name`` (t, c, n, s, ss, r, sr, fraction) and ``name_f`` (t, c, gain, sigma): sums over squared residuals beyond a band, and their fit."""
    keep = f"(SELECT kz, ky, CASE WHEN d > {band!r}e0 AND e > {band!r}e0 THEN 1.0e0 ELSE 0.0e0 END AS w FROM {_bins(SIDE, SIDE, DENSE.slope)})"
    (z0, z1), (y0, y1), (x0, x1) = guards["z"], guards["y"], guards["x"]
    return f"""{_kernel(f"{name}_k", keep, SIDE, SIDE)},
      {name}_r AS (SELECT t, c, x, a.z, b.y, sum(k * (v - {LEVEL})) AS r, sum(k * k * (v - {LEVEL})) AS s FROM voxels p, (SELECT unnest(range({z0}, {z1 + 1})) AS z) a, (SELECT unnest(range({y0}, {y1 + 1})) AS y) b
        JOIN {name}_k ON dz = (a.z - p.z + {SIDE}) % {SIDE} AND dy = (b.y - p.y + {SIDE}) % {SIDE} WHERE p.x BETWEEN {x0} AND {x1} GROUP BY ALL),
      {name} AS (SELECT t, c, count(*) AS n, sum(s) AS s, sum(s * s) AS ss, sum(r * r) AS r, sum(s * r * r) AS sr, (SELECT avg(w) FROM {keep}) AS fraction FROM {name}_r GROUP BY t, c),
      {_fit_sql(name)}"""


def _fit_sql(name: str) -> str:
    return f"""{name}_g AS (SELECT *, greatest(CASE WHEN n > 2 AND n * ss - s * s > 0 THEN (n * sr - s * r) / (n * ss - s * s) ELSE 0 END, 0) AS g FROM {name}),
      {name}_f AS (SELECT t, c, CASE WHEN (r - g * s) > 0 THEN g END AS gain, CASE WHEN (r - g * s) > 0 THEN sqrt((r - g * s) / greatest(n, 1) / fraction) END AS sigma FROM {name}_g)"""


@query("k01_fourier_reconstruction", V + ", " + band_sql("b", 32, SIDE, 2) + f""", g AS (SELECT unnest(range(9)) AS z), h AS (SELECT unnest(range(10)) AS y)
    SELECT t, c, g.z, h.y, x, round(2 * sum(k * (v - {LEVEL})) + {LEVEL}, 3) AS v FROM (SELECT * FROM voxels WHERE z % 2 = 0) p, g, h JOIN b ON dz = (g.z - p.z + 32) % 32 AND dy = (h.y - p.y + 32) % 32 GROUP BY t, c, g.z, h.y, x""")
def k01(spark, sf_dir):
    return rc.reconstruct(vx.decimate(_v(spark, sf_dir), 2, 0), DENSE.every(2), (D // 2, H)).withColumn("v", F.round("v", 3))


GUARDS = {"z": (1, 8), "y": (1, 8), "x": (1, 8)}


@query("k02_noise_band", V + ", " + noise_sql("a", 0.3, GUARDS) + " SELECT a.t, a.c, n, round(s, 2) AS s, round(r, 2) AS r, round(fraction, 6) AS fraction, round(gain, 4) AS gain, round(sigma, 4) AS sigma FROM a JOIN a_f USING (t, c)")
def k02(spark, sf_dir):
    sums = rc.noise_sums(_v(spark, sf_dir), DENSE, (D, H), 0.3, GUARDS)
    both = sums.join(ss.noise_fit(sums), ["t", "c"])
    return both.select("t", "c", "n", F.round("s", 2).alias("s"), F.round("r", 2).alias("r"), F.round("fraction", 6).alias("fraction"), F.round("gain", 4).alias("gain"), F.round("sigma", 4).alias("sigma"))


def _phases_sql(factors: list[int]) -> str:
    """Rows (factor, phase, n, pad): planes kept and padded length of every phase."""
    rows = [(m, a, (D - 1 - a) // m + 1) for m in factors for a in range(m)]
    return "(SELECT * FROM (VALUES " + ", ".join(f"({m}, {a}, {n}, {rc.padded((n - 1) * m + 1, DENSE.padding)})" for m, a, n in rows) + ") v(factor, phase, n, pad))"


def _kernels_sql(factors: list[int]) -> str:
    """CTEs ending in ``ker`` (factor, pad, dz, dy, k)."""
    pairs = sorted({(m, rc.padded((D - 1 - a) // m * m + 1, DENSE.padding)) for m in factors for a in range(m)})
    return ", ".join(band_sql(f"b{m}_{pad}", pad, SIDE, m) for m, pad in pairs) + ", ker AS (" + " UNION ALL ".join(f"SELECT {m} AS factor, {pad} AS pad, dz, dy, k FROM b{m}_{pad}" for m, pad in pairs) + ")"


@query("k03_propagated_variance", V + ", " + _kernels_sql([2, 3]) + f""", j AS {_phases_sql([2, 3])}, q AS (SELECT *, unnest(range((n - 1) * factor + 1)) AS z FROM j), h AS (SELECT unnest(range(10)) AS y)
    SELECT p.t, p.c, q.factor, q.phase, q.z + q.phase AS z, h.y, p.x, round(q.factor ** 2 * sum(k * k), 4) AS read, round(q.factor ** 2 * sum(k * k * p.v), 2) AS shot
    FROM q CROSS JOIN h JOIN voxels p ON p.z >= q.phase AND (p.z - q.phase) % q.factor = 0 JOIN ker ON ker.factor = q.factor AND ker.pad = q.pad AND dz = (q.z - (p.z - q.phase) + q.pad) % q.pad AND dy = (h.y - p.y + {SIDE}) % {SIDE}
    GROUP BY p.t, p.c, q.factor, q.phase, q.z, h.y, p.x""")
def k03(spark, sf_dir):
    wanted = F.array(*[F.struct(F.lit(m).alias("factor"), F.lit(a).alias("phase")) for m in (2, 3) for a in range(m)])
    jobs = _v(spark, sf_dir).withColumn("j", F.explode(wanted)).select("t", "c", "z", "y", "x", F.col("v").alias("signal"), "j.factor", "j.phase")
    return rc.noise_floors(jobs, DENSE, (D, H)).withColumn("read", F.round("read", 4)).withColumn("shot", F.round("shot", 2))


# Crops of 5 planes and 3 rows on a grid of 16 by 16 bins.
BEAD = rc.Scan(pixel=0.116, step=0.265, angle=25.0, padding=4, background=float(LEVEL))
SPECTRA_SQL = CROPS_SQL + f""", s AS (SELECT bead, dz, dy, sum(v - {LEVEL}) AS v FROM k GROUP BY ALL), f AS (SELECT kz, ky, d FROM {_bins(16, 16, BEAD.slope)}), d AS (SELECT bead, sum(v) AS dc FROM s GROUP BY bead),
    a AS (SELECT bead, kz, ky, d, sqrt(sum(v * cos(2 * pi() * (kz * dz + ky * dy) / 16.0e0)) ** 2 + sum(v * sin(2 * pi() * (kz * dz + ky * dy) / 16.0e0)) ** 2) / any_value(dc) AS a FROM s JOIN d USING (bead), f WHERE dc > 0 GROUP BY ALL)"""


@query("k04_bead_spectra", SPECTRA_SQL + ", u AS (SELECT bead, max(d) FILTER (a >= 0.1) AS support FROM a GROUP BY bead) SELECT bead, round(support, 6) AS support, round(0.5 / support, 6) AS factor FROM d LEFT JOIN u USING (bead)")
def k04(spark, sf_dir):
    found = rc.bead_spectra(crops(spark, sf_dir), RADIUS, BEAD, 0.1)
    return found.select("bead", F.round("support", 6).alias("support"), F.round("factor", 6).alias("factor"))


@query("k04_bead_amplitudes", SPECTRA_SQL + " SELECT bead, CASE WHEN kz < 8 THEN kz ELSE kz - 16 END AS kz, CASE WHEN ky < 8 THEN ky ELSE ky - 16 END AS ky, round(log10(greatest(a, 1e-6)), 5) AS amplitude FROM a")
def k04b(spark, sf_dir):
    return rc.bead_amplitudes(crops(spark, sf_dir), RADIUS, BEAD).withColumn("amplitude", F.round("amplitude", 5))


# The study: planes 3 to 6 lie in every phase of factors 2 to 4; rows and columns are guarded by one.
FACTORS, KZ = [2, 3, 4], 0.3
FIRST, LAST = rc.domain(D, FACTORS, 0)
STUDY = {"z": (FIRST, LAST), "y": (0, 9), "x": (0, 9)}
BAND = rc.noise_only_from(DENSE.step, DENSE.angle, KZ)
ENTERED_SQL = """e AS (SELECT t, c, CASE WHEN t % 5 = 3 THEN 0.0e0 ELSE stddev_samp(v) * (1 + (t * 2 + c) % 4 * 0.1e0) END AS background_sigma, t % 4 <> 1 OR c = 2 AS noise_known, t % 7 = 6 AS noise_free FROM voxels GROUP BY t, c)"""


def _taps(name: str, sigma: float, radius: int) -> str:
    return f"{name}_d AS (SELECT unnest(range(-{radius}, {radius + 1})) AS d), {name} AS (SELECT d, exp(-0.5e0 * d * d / {sigma * sigma!r}e0) / (SELECT sum(exp(-0.5e0 * d * d / {sigma * sigma!r}e0)) FROM {name}_d) AS w FROM {name}_d)"


def _smoothing(name: str, sigma: float, radius: int) -> str:
    steps, source = [], "lifted"
    for axis in "xyz":
        steps.append(f"{name}{axis} AS " + _smooth_sql(axis, source).replace("CROSS JOIN k ", f"CROSS JOIN {name} "))
        source = f"{name}{axis}"
    return _taps(name, sigma, radius) + ", " + ", ".join(steps)


STUDY_SQL = V + ", " + ENTERED_SQL + f", lifted AS (SELECT t, c, z, y, x, v - {LEVEL}.0e0 AS v FROM voxels), " + _smoothing("wide", 1.0, 4) + ", " + _smoothing("light", 0.7, 2) + f""",
    i AS (SELECT *, row_number() OVER (PARTITION BY t, c ORDER BY v) - 1 AS rank, count(*) OVER (PARTITION BY t, c) AS n FROM widez WHERE z BETWEEN {FIRST} AND {LAST}),
    th AS (SELECT t, c, greatest(CASE WHEN noise_free THEN 0 ELSE 0.2e0 * background_sigma END, 0.3e0 * v) AS threshold FROM i JOIN e USING (t, c) WHERE rank = floor(0.995 * (n - 1))),
    mask AS (SELECT i.t, i.c, i.z, i.y, i.x FROM i JOIN th USING (t, c) WHERE v > threshold), sig AS (SELECT t, c, z, y, x, greatest(v, 0) AS s FROM lightz),
    ms AS (SELECT t, c, avg(s) AS mean_signal FROM sig JOIN mask USING (t, c, z, y, x) GROUP BY t, c), """ + noise_sql("na", BAND, STUDY) + ", " + noise_sql("nb", (BAND + 0.5) / 2, STUDY) + """,
    md AS (SELECT e.*, coalesce(mean_signal, 0) AS mean_signal, f.sigma, f.gain AS fitted, g.sigma AS check_sigma, g.gain AS check_gain FROM e LEFT JOIN ms USING (t, c) LEFT JOIN na_f f USING (t, c) LEFT JOIN nb_f g USING (t, c)),
    model AS (SELECT *, CASE WHEN noise_free THEN 'accepted' WHEN sigma IS NULL THEN 'fit failed' WHEN NOT noise_known THEN 'background unverified' WHEN NOT background_sigma > 0 THEN 'no background sigma'
      WHEN abs(sigma / background_sigma - 1) > 0.25 THEN 'contradicts background' WHEN check_sigma IS NULL THEN 'check failed' WHEN abs((check_sigma ** 2 + check_gain * mean_signal) / (sigma ** 2 + fitted * mean_signal) - 1) > 0.25 THEN 'unstable across band' ELSE 'accepted' END AS status FROM md),
    used AS (SELECT t, c, CASE WHEN noise_free THEN 0 WHEN status = 'accepted' THEN sigma ** 2 END AS variance, CASE WHEN noise_free THEN 0 WHEN status = 'accepted' THEN fitted END AS gain FROM model)"""

SWEEP_SQL = STUDY_SQL + ", " + _kernels_sql(FACTORS) + f""", j AS {_phases_sql(FACTORS)}, q AS (SELECT *, unnest(range({FIRST}, {LAST + 1})) AS z FROM j), q2 AS (SELECT * FROM q WHERE (z - phase) % factor <> 0),
    m AS (SELECT q2.*, mask.t, mask.c, mask.y, mask.x FROM q2 JOIN mask ON mask.z = q2.z),
    r AS (SELECT 'fourier' AS method, m.t, m.c, m.factor, m.phase, m.z, m.y, m.x, m.factor * sum(k * (p.v - {LEVEL})) + {LEVEL} AS pred, 1 + m.factor ** 2 * sum(k * k) AS rf, m.factor ** 2 * sum(k * k * sig.s) AS sf
      FROM m JOIN voxels p ON p.t = m.t AND p.c = m.c AND p.x = m.x AND p.z >= m.phase AND (p.z - m.phase) % m.factor = 0 JOIN sig ON sig.t = p.t AND sig.c = p.c AND sig.z = p.z AND sig.y = p.y AND sig.x = p.x
      JOIN ker ON ker.factor = m.factor AND ker.pad = m.pad AND dz = (m.z - p.z + m.pad) % m.pad AND dy = (m.y - p.y + {SIDE}) % {SIDE} GROUP BY m.t, m.c, m.factor, m.phase, m.z, m.y, m.x),
    l AS (SELECT 'linear' AS method, m.t, m.c, m.factor, m.phase, m.z, m.y, m.x, a.v + (b.v - a.v) * ((m.z - phase) % factor) / CAST(factor AS DOUBLE) AS pred, 1 + (1 - ((m.z - phase) % factor) / CAST(factor AS DOUBLE)) ** 2 + (((m.z - phase) % factor) / CAST(factor AS DOUBLE)) ** 2 AS rf,
        (1 - ((m.z - phase) % factor) / CAST(factor AS DOUBLE)) ** 2 * sa.s + (((m.z - phase) % factor) / CAST(factor AS DOUBLE)) ** 2 * sb.s AS sf
      FROM m JOIN voxels a ON a.t = m.t AND a.c = m.c AND a.x = m.x AND a.y = m.y AND a.z = m.z - (m.z - m.phase) % m.factor JOIN voxels b ON b.t = m.t AND b.c = m.c AND b.x = m.x AND b.y = m.y AND b.z = a.z + m.factor
      JOIN sig sa ON sa.t = a.t AND sa.c = a.c AND sa.z = a.z AND sa.y = a.y AND sa.x = a.x JOIN sig sb ON sb.t = b.t AND sb.c = b.c AND sb.z = b.z AND sb.y = b.y AND sb.x = b.x),
    st AS (SELECT d.t, d.c, method, factor, phase, count(*) AS n, sum((pred - v.v) ** 2) AS se, sum(pred - v.v) AS sb, sum((v.v - {LEVEL}.0e0) ** 2) AS power, sum(rf) AS read_floor, sum(sf + s) AS shot_floor, count(*) AS read_noise, sum(s) AS shot_noise
      FROM (SELECT * FROM r UNION ALL SELECT * FROM l) d JOIN voxels v ON v.t = d.t AND v.c = d.c AND v.x = d.x AND v.y = d.y AND v.z = d.z JOIN sig ON sig.t = d.t AND sig.c = d.c AND sig.x = d.x AND sig.y = d.y AND sig.z = d.z GROUP BY ALL)"""


def _study(spark, sf_dir):
    v = _v(spark, sf_dir)
    entered = v.groupBy("t", "c").agg(F.stddev_samp("v").alias("s")).select(
        "t", "c", F.when(F.col("t") % 5 == 3, 0.0).otherwise(F.col("s") * F.expr("1 + (t * 2 + c) % 4 * 0.1D")).alias("background_sigma"), ((F.col("t") % 4 != 1) | (F.col("c") == 2)).alias("noise_known"), (F.col("t") % 7 == 6).alias("noise_free")
    )
    return st.step_study(v, DENSE, FACTORS, (D, H, W), entered, KZ, guard=0, sigmas=0.2, fraction=0.3)


@query("a18_noise_acceptance", STUDY_SQL + " SELECT t, c, round(mean_signal, 3) AS mean_signal, round(sigma, 3) AS sigma, round(fitted, 4) AS gain, round(check_sigma, 3) AS check_sigma, round(check_gain, 4) AS check_gain, status FROM model")
def a18(spark, sf_dir):
    model = _study(spark, sf_dir)[0]
    return model.select("t", "c", F.round("mean_signal", 3).alias("mean_signal"), F.round("sigma", 3).alias("sigma"), F.round("fitted_gain", 4).alias("gain"), F.round("check_sigma", 3).alias("check_sigma"), F.round("check_gain", 4).alias("check_gain"), "status")


@query("k05_sampling_sweep", SWEEP_SQL + """, sc AS (SELECT t, c, method, factor, count(*) AS phases, sum(se) AS se, sum(power) AS power, max(sqrt(se / power)) AS worst, sum(read_floor) AS read_floor, sum(shot_floor) AS shot_floor, sum(read_noise) AS read_noise, sum(shot_noise) AS shot_noise FROM st GROUP BY ALL),
    ex AS (SELECT sc.*, CASE WHEN power - variance * read_noise - gain * shot_noise > 0 THEN sqrt(greatest(se - variance * read_floor - gain * shot_floor, 0) / (power - variance * read_noise - gain * shot_noise)) END AS excess, (variance * read_floor + gain * shot_floor) / se AS noise_share FROM sc LEFT JOIN used USING (t, c))
    SELECT a.t, a.c, a.method, a.factor, round(sqrt(a.se / a.power), 6) AS score, round(a.worst, 6) AS worst, round(a.excess, 5) AS excess, round(a.noise_share, 5) AS noise_share, CASE WHEN a.phases <> a.factor THEN 'Incomplete' WHEN sqrt(a.se / a.power) <= 0.9 AND a.worst <= 0.9 THEN 'Pass' ELSE 'Fails' END AS verdict,
      round(CASE WHEN a.phases = a.factor AND b.phases = 2 AND a.excess IS NOT NULL AND b.excess IS NOT NULL THEN sqrt(greatest(a.excess ** 2 - b.excess ** 2, 0)) END, 5) AS increase FROM ex a LEFT JOIN ex b ON b.t = a.t AND b.c = a.c AND b.method = a.method AND b.factor = 2""")
def k05(spark, sf_dir):
    sums = _study(spark, sf_dir)[1].filter("heldout AND n > 0")
    out = ss.verdicts(sums, ["t", "c", "method"], limit=0.9, fit=("variance", "gain"))
    return out.select("t", "c", "method", "factor", *[F.round(k, d).alias(k) for k, d in (("score", 6), ("worst", 6), ("excess", 5), ("noise_share", 5))], "verdict", F.round("increase", 5).alias("increase"))


@query("k05_sweep_linear", V + f""", l AS (SELECT t, c, y, x, list(v ORDER BY z) AS l FROM voxels GROUP BY ALL), p AS (SELECT factor, unnest(range(factor)) AS phase FROM (SELECT unnest({FACTORS}) AS factor)),
  e AS (SELECT t, c, factor, phase, l, z, (z - phase) % factor AS o FROM l, p, (SELECT unnest(range({FIRST}, {LAST + 1})) AS z)),
  d AS (SELECT t, c, factor, phase, CAST(l[z + 1] AS DOUBLE) AS ref, l[z - o + 1] + (l[z - o + factor + 1] - l[z - o + 1]) * (o / CAST(factor AS DOUBLE)) AS pred FROM e WHERE o <> 0),
  s AS (SELECT t, c, factor, phase, sum((pred - ref) ** 2) AS se, sum((ref - {LEVEL}) ** 2) AS power FROM d GROUP BY ALL), q AS (SELECT t, c, factor, count(*) AS phases, sqrt(sum(se) / sum(power)) AS score, max(sqrt(se / power)) AS worst FROM s GROUP BY ALL)
  SELECT t, c, factor, round(score, 6) AS score, round(worst, 6) AS worst, CASE WHEN phases <> factor THEN 'Incomplete' WHEN score <= 0.9 AND worst <= 0.9 THEN 'Pass' ELSE 'Fails' END AS verdict FROM q""")
def k05b(spark, sf_dir):
    sums = rc.sweep(_v(spark, sf_dir), DENSE, FACTORS, (D, H)).filter("method = 'linear' AND heldout")
    return ss.verdicts(sums, ["t", "c"], limit=0.9).select("t", "c", "factor", F.round("score", 6).alias("score"), F.round("worst", 6).alias("worst"), "verdict")


@query("k06_dense_comparison", SWEEP_SQL + " SELECT t, c, method, factor, phase, n AS voxels, round(sqrt(se / power), 6) AS nrmse, round(sb / n, 5) AS bias FROM st")
def k06(spark, sf_dir):
    out = ss.pooled(_study(spark, sf_dir)[1].filter("heldout AND n > 0"), ["t", "c", "method", "factor", "phase"])
    return out.select("t", "c", "method", "factor", "phase", F.col("n").cast("long").alias("voxels"), F.round("nrmse", 6).alias("nrmse"), F.round("bias", 5).alias("bias"))


# Differences of neighbours as residuals: two voxels' noise, so the kept fraction is two.
@query("a17_noise_fit", V + ", d AS (SELECT t, c, v AS s, CAST(lead(v) OVER (PARTITION BY t, c, z, y ORDER BY x) - v AS DOUBLE) ** 2 AS r FROM voxels), a AS (SELECT t, c, count(*) AS n, sum(CAST(s AS DOUBLE)) AS s, sum(CAST(s AS DOUBLE) * s) AS ss, sum(r) AS r, sum(s * r) AS sr, 2.0e0 AS fraction FROM d WHERE r IS NOT NULL GROUP BY t, c), " + _fit_sql("a") + " SELECT t, c, round(gain, 4) AS gain, round(sigma, 4) AS sigma FROM a_f")
def a17(spark, sf_dir):
    rows = _v(spark, sf_dir).withColumn("r", F.lead("v").over(Window.partitionBy("t", "c", "z", "y").orderBy("x")) - F.col("v")).filter("r IS NOT NULL")
    rows = rows.select("t", "c", F.col("v").cast("double").alias("s"), (F.col("r").cast("double") * F.col("r")).alias("r"))
    sums = rows.groupBy("t", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("s"), F.sum(F.expr("s * s")).alias("ss"), F.sum("r").alias("r"), F.sum(F.expr("s * r")).alias("sr"))
    return ss.noise_fit(sums.withColumn("fraction", F.lit(2.0))).select("t", "c", F.round("gain", 4).alias("gain"), F.round("sigma", 4).alias("sigma"))
