"""Queries of affine algebra and acquisition geometry."""

import math

from pyspark.sql import functions as F

from lamella.functions import matrix as mx
from lamella.functions import model
from lamella.plans import views
from lamella.plans.registry import query

# One small alignment per part, and acquisition settings per supplier.
M_SQL = "SELECT p_partkey AS id, cos(radians(p_size / 50.0)) AS m00, -sin(radians(p_size / 50.0)) AS m01, p_partkey % 90 * 1.0 AS m02, sin(radians(p_size / 50.0)) AS m10, cos(radians(p_size / 50.0)) AS m11, p_size * 1.0 - 20 AS m12 FROM part"
G_SQL = "SELECT s_suppkey AS id, 0.1e0 + s_suppkey % 7 * 0.02e0 AS pixel, 0.2e0 + s_suppkey % 11 * 0.05e0 AS step, 15.0 + s_suppkey % 40 AS angle, 32 + s_suppkey % 64 AS width, 48 + s_suppkey % 32 AS height, 10 + s_suppkey % 90 AS depth FROM supplier"


def _m(spark, sf_dir):
    a = "radians(p_size / 50.0D)"
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *[F.expr(e).alias(k) for k, e in zip(mx.SIX, (
        f"cos({a})", f"-sin({a})", "p_partkey % 90 * 1.0D", f"sin({a})", f"cos({a})", "p_size * 1.0D - 20"))])


def _g(spark, sf_dir):
    k = "s_suppkey"
    return views.table(spark, sf_dir, "supplier").select(F.col(k).alias("id"), *[F.expr(e).alias(n) for n, e in {
        "pixel": f"0.1D + {k} % 7 * 0.02D", "step": f"0.2D + {k} % 11 * 0.05D", "angle": f"15.0D + {k} % 40", "width": f"32 + {k} % 64", "height": f"48 + {k} % 32",
        "depth": f"10 + {k} % 90"}.items()])


def _round(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _six(df, values):
    return _round(df.select("id", *[v.alias(k) for k, v in zip(mx.SIX, values)]))


@query("p10_deskew_matrix", f"SELECT id, round(cos(radians(angle)), 6) AS yy, round(step / pixel, 6) AS yz, round(-sin(radians(angle)), 6) AS zy FROM ({G_SQL})")
def p10(spark, sf_dir):
    g = _g(spark, sf_dir)
    return _round(g.select("id", *[v.alias(k) for k, v in mx.deskew_columns(F.col("step"), F.col("pixel"), F.col("angle")).items()]))


@query("p11_recovered_geometry", f"SELECT id, CASE WHEN id % 5 <> 0 THEN round(angle, 6) END AS angle, CASE WHEN id % 5 <> 0 THEN round(step, 6) END AS step FROM ({G_SQL})")
def p11(spark, sf_dir):
    g = _g(spark, sf_dir)
    m = mx.deskew_columns(F.col("step"), F.col("pixel"), F.col("angle"))
    bent = F.when(F.col("id") % 5 == 0, m["yy"] * 1.2).otherwise(m["yy"])
    return _round(g.select("id", *[v.alias(k) for k, v in mx.recovered_geometry(bent, m["yz"], m["zy"], F.col("pixel")).items()]))


_D = mx.deskew(0.265, 0.116, 25.0, 100)
_C, _S, _K = math.cos(math.radians(25)), math.sin(math.radians(25)), 0.265 / 0.116


@query("p12_transformed_box", f"SELECT id, 0.0 AS min_x, CAST(width AS BIGINT) AS size_x, 0.0 AS min_y, CAST(ceil(height * {_C!r}e0 + depth * {_K!r}e0 - 1e-9) AS BIGINT) AS size_y, round({_S!r}e0 * 99 - {_S!r}e0 * height, 6) AS min_z, CAST(ceil(height * {_S!r}e0 - 1e-9) AS BIGINT) AS size_z FROM ({G_SQL})")
def p12(spark, sf_dir):
    g = _g(spark, sf_dir)
    return _round(g.select("id", *[v.cast("double").alias(k) if k.startswith("min") else v.cast("long").alias(k) for k, v in mx.corner_box(_D, F.col("width"), F.col("height"), F.col("depth")).items()]))


@query("p13_parsed_transform", f"WITH {views.POINTS} SELECT id, round(-(y + 2), 6) AS x, round((x + 1) * 2, 6) AS y, round(response - 3.0, 6) AS z FROM points")
def p13(spark, sf_dir):
    m = mx.parse("translate 1 2 -3; rotate z 90; scale 1 2 1")
    p = views.points(spark, sf_dir)
    x, y, z = mx.apply(m, F.col("x"), F.col("y"), F.col("response"))
    return _round(p.select("id", x.alias("x"), y.alias("y"), z.alias("z")))


INV = "m11 / d AS i00, -m01 / d AS i01, -(m11 * m02 - m01 * m12) / d AS i02, -m10 / d AS i10, m00 / d AS i11, -(m00 * m12 - m10 * m02) / d AS i12"


@query("p14_mirrored_alignment", f"""WITH m AS ({M_SQL}), i AS (SELECT id, {INV} FROM (SELECT *, m00 * m11 - m01 * m10 AS d FROM m))
    SELECT id, round(i00, 6) AS m00, round(-i01, 6) AS m01, round(511 - i00 * 511 - i02, 6) AS m02, round(-i10, 6) AS m10, round(i11, 6) AS m11, round(i10 * 511 + i12, 6) AS m12 FROM i""")
def p14(spark, sf_dir):
    m = _m(spark, sf_dir)
    return _six(m, mx.mirrored(mx.mat(), F.lit(512)))


@query("p15_raw_indices", f"""WITH {views.POINTS} SELECT id, CAST(floor(x + 0.5) AS BIGINT) AS x, CAST(greatest(floor({_S!r}e0 * 99 / {_S!r}e0 - response / {_S!r}e0 + 0.5), 0) AS BIGINT) AS y,
    CAST(greatest(floor((y - {_C!r}e0 * (99 - response / {_S!r}e0)) / {_K!r}e0 + 0.5), 0) AS BIGINT) AS z FROM points""")
def p15(spark, sf_dir):
    p = views.points(spark, sf_dir)
    x, y, z = mx.raw_indices(_D, F.col("x"), F.col("y"), F.col("response"))
    return p.select("id", x.alias("x"), y.alias("y"), z.alias("z"))


@query("p16_source_to_world", f"WITH {views.POINTS} SELECT id, round(2 * x + 0.5, 6) AS x, round({_C!r}e0 * (2 * y + 1) + {_K!r}e0 * (2 * response + 1) - 0.5, 6) AS y, round(-{_S!r}e0 * (2 * y + 1) + {_S!r}e0 * 99 - 0.5, 6) AS z FROM points")
def p16(spark, sf_dir):
    p = views.points(spark, sf_dir)
    x, y, z = mx.apply(mx.source_to_world(_D, 2), F.col("x"), F.col("y"), F.col("response"))
    return _round(p.select("id", x.alias("x"), y.alias("y"), z.alias("z")))


@query("p18_displacement_bound", f"""WITH m AS ({M_SQL}), k AS (SELECT m.*, unnest([0, 511, 0, 511]) AS x, unnest([0, 0, 255, 255]) AS y FROM m)
    SELECT id, round(max(sqrt((m00 * x + m01 * y + m02 - x) ** 2 + (m10 * x + m11 * y + m12 - y) ** 2)), 6) AS bound FROM k GROUP BY id""")
def p18(spark, sf_dir):
    return _round(_m(spark, sf_dir).select("id", mx.worst_displacement(mx.mat(), F.lit(512), F.lit(256)).alias("bound")))


@query("p18_orthogonal_alignment", f"""SELECT id, 'x' AS view, false AS flip, 1.0 AS m00, 0.0 AS m02, round(m11, 6) AS m11, round(m10 * 255.5 + m12, 6) AS m12, round(abs(m10) * 255.5, 6) AS spread FROM ({M_SQL})
    UNION ALL SELECT id, 'y', true, round(m00, 6), round(m01 * 127.5 + m02, 6), 1.0, 0.0, round(abs(m01) * 127.5, 6) FROM ({M_SQL})""")
def p18b(spark, sf_dir):
    out = None
    for axis in "xy":
        o = mx.orthogonal(mx.mat(), axis, F.lit(512), F.lit(256))
        values = dict(zip(mx.SIX, o["matrix"]))
        rows = _m(spark, sf_dir).select("id", F.lit(axis).alias("view"), o["flip"].alias("flip"), *[values[k].alias(k) for k in ("m00", "m02", "m11", "m12")], o["spread"].alias("spread"))
        out = rows if out is None else out.union(rows)
    return _round(out)


@query("h11_near_identity", f"SELECT id, abs(m00 - 1) <= 1e-3 AND abs(m01) <= 1e-3 AND abs(m02) <= 1e-3 AND abs(m10) <= 1e-3 AND abs(m12) <= 1e-3 * greatest(1, abs(m12)) AS identity FROM ({M_SQL})")
def h11(spark, sf_dir):
    return _m(spark, sf_dir).select("id", mx.near_identity(mx.mat(), 1e-3).alias("identity"))


@query("h16_adjusted_alignment", f"""WITH m AS ({M_SQL}), a AS (SELECT *, cos(radians(1.5)) AS c, sin(radians(1.5)) AS s FROM m), t AS (SELECT *, 255.5 - c * 255.5 + s * 127.5 + 4 AS tx, 127.5 - s * 255.5 - c * 127.5 - 2 AS ty FROM a)
    SELECT id, round(c * m00 - s * m10, 6) AS m00, round(c * m01 - s * m11, 6) AS m01, round(c * m02 - s * m12 + tx, 6) AS m02, round(s * m00 + c * m10, 6) AS m10, round(s * m01 + c * m11, 6) AS m11, round(s * m02 + c * m12 + ty, 6) AS m12 FROM t""")
def h16(spark, sf_dir):
    turn = mx.about_centre(F.lit(1.5), F.lit(4.0), F.lit(-2.0), F.lit(512), F.lit(256))
    m = _m(spark, sf_dir)
    return _six(m, mx.product2(turn, mx.mat()))


@query("h17_plausible_alignments", f"SELECT id, m02 <= 80 AND abs(m12) <= 25 AND degrees(atan2(m10, m00)) <= 0.7 AS plausible FROM ({M_SQL})")
def h17(spark, sf_dir):
    return _m(spark, sf_dir).select("id", mx.plausible(mx.mat(), 0.7, 80.0, 25.0).alias("plausible"))


@query("h09_alias_factors", f"""WITH g AS ({G_SQL}), k AS (SELECT *, 1 / (2 * 3.0 * tan(radians(angle))) AS cap, depth * 0.5 / step AS raw FROM g)
    SELECT id, round(cap, 6) AS cap, CAST(ceil(raw * (1 - 4e-16)) AS BIGINT) + 1 AS planes, CASE WHEN abs(step) < 1e-12 THEN 1.0 ELSE round(sin(pi() * step) / (pi() * step), 6) END AS sinc,
      array_to_string(list_filter([2, 3, 4, 5, 6], lambda f: f * step <= 1.0), ',') AS factors FROM k""")
def h09(spark, sf_dir):
    g = _g(spark, sf_dir)
    factors = F.array_join(F.transform(model.factors(F.col("step"), F.lit(1.0), 6), lambda f: f.cast("string")), ",")
    return _round(g.select("id", model.alias_cap(F.lit(3.0), F.col("angle")).alias("cap"), model.plane_count(F.col("depth") * 0.5, F.col("step")).alias("planes"), model.sinc(F.col("step")).alias("sinc"), factors.alias("factors")))


@query("h10_taper_weights", f"""WITH {views.POINTS}, k AS (SELECT id, id % 64 AS bin, CASE WHEN id % 64 < 32 THEN id % 64 ELSE id % 64 - 64 END / 64.0 AS f FROM points), w AS (SELECT *, abs(f + 0.2 - floor(f + 0.2 + 0.5)) AS d FROM k)
    SELECT id, round(f, 6) AS f, round(d, 6) AS distance, round(CASE WHEN d <= 0.1 THEN 1 WHEN d >= 0.3 THEN 0 ELSE 0.5 * (1 + cos(pi() * (d - 0.1) / 0.2)) END, 6) AS weight, CAST(2 ** ceil(log2(id + 1)) AS BIGINT) AS padded FROM w""")
def h10(spark, sf_dir):
    p = views.points(spark, sf_dir)
    f = model.bin_frequency(F.col("id") % 64, 64)
    d = model.wrapped_distance(f, F.lit(-0.2))
    return _round(p.select("id", f.alias("f"), d.alias("distance"), model.cosine_taper(d, 0.1, 0.3).alias("weight"), model.padded_power(F.col("id") + 1).alias("padded")))


@query("p32_parameter_problems", f"SELECT id, CASE WHEN angle > 45 THEN 'angle' WHEN step > 0.6e0 THEN 'step' WHEN depth < 20 THEN 'planes' END AS problem FROM ({G_SQL})")
def p32(spark, sf_dir):
    g = _g(spark, sf_dir)
    return g.select("id", model.problem([("angle", F.col("angle") <= 45), ("step", (F.col("step") > 0) & (F.col("step") <= 0.6)), ("planes", F.col("depth") >= 20)]).alias("problem"))


# Acquisition settings by supplier, in expressions that both engines read alike.
SETTINGS = {
    "optics": "s_suppkey % 3", "angle": "20 + s_suppkey % 11", "pixel": "0.1 + 0.004 * (s_suppkey % 5)", "step": "0.2 + 0.01 * (s_suppkey % 8)", "extent": "100 + s_suppkey % 13",
    "minimum_step": "0.15", "maximum_step": "0.9 + 0.1 * (s_suppkey % 4)", "na": "0.7 + 0.02 * (s_suppkey % 6)", "wavelength_nm": "488 + 10 * (s_suppkey % 9)", "refractive_index": "1.333",
    "sheet_fwhm": "1 + 0.2 * (s_suppkey % 4)", "fwhm_x": "0.5", "fwhm_y": "0.5 + 0.02 * (s_suppkey % 3)", "fwhm_z": "1.1 + 0.1 * (s_suppkey % 5)", "kz": "0.6 + 0.05 * (s_suppkey % 5)",
    "ky": "1 + 0.1 * (s_suppkey % 10)", "threshold": "0.05", "safety": "0.8", "scan_mode": "s_suppkey // 3 % 3", "exposure_ms": "60 + 5 * (s_suppkey % 7)", "period_ms": "110", "overhead_ms": "s_suppkey % 4",
    "flyback_ms": "20", "relative_motion_floor": "0.8", "absolute_motion_floor": "0.7", "baseline_motion_floor": "0.1",
}
FLAGS = {"measured_period": "s_suppkey % 5 = 0", "fixed_velocity": "s_suppkey % 7 = 0", "preserve_blur": "s_suppkey % 4 = 1", "gate_absolute_motion": "s_suppkey % 6 = 2"}
_SETTINGS_SQL = ", ".join([*(f"CAST({e} AS DOUBLE) AS {k}" for k, e in SETTINGS.items()), *(f"{e} AS {k}" for k, e in FLAGS.items())])
_SINC = "CASE WHEN abs(pi() * ({0})) < 1e-9 THEN 1.0 ELSE sin(pi() * ({0})) / (pi() * ({0})) END"
_PLANES = "CAST(CASE WHEN abs({0} / {1} - round_even({0} / {1}, 0)) <= 1e-12 THEN round_even({0} / {1}, 0) ELSE ceil({0} / {1}) END AS BIGINT) + 1"
# Widths, precision matrix, supports and limits; then the predictions of one candidate step.
MODEL_SQL = f"""s AS (SELECT s_suppkey AS id, {_SETTINGS_SQL} FROM supplier), f AS (SELECT *, 2 * sqrt(2 * ln(2)) AS w, radians(angle) AS a FROM s),
  g AS (SELECT *, CASE WHEN optics = 0 THEN 0.51 * wavelength_nm / 1000 / na / w ELSE fwhm_x / w END AS sx, CASE WHEN optics = 0 THEN 0.51 * wavelength_nm / 1000 / na / w ELSE fwhm_y / w END AS sy,
    CASE WHEN optics = 0 THEN 1.77 * refractive_index * wavelength_nm / 1000 / (na * na) / w ELSE fwhm_z / w END AS sz, CASE WHEN optics = 0 THEN (w / sheet_fwhm) ** 2 ELSE 0 END AS sheet, ln(1 / threshold) / (2 * pi() ** 2) AS c FROM f),
  h AS (SELECT *, sy ** -2 + sin(a) ** 2 * sheet AS qyy, sz ** -2 + cos(a) ** 2 * sheet AS qzz, sin(a) * cos(a) * sheet AS qyz FROM g),
  k AS (SELECT *, CASE WHEN optics = 2 THEN kz ELSE sqrt(c * qzz) END AS k_z, CASE WHEN optics = 2 THEN ky ELSE sqrt(c * qyy) END AS k_y, CASE WHEN optics <> 2 THEN 2 * pixel * sqrt(c) / sx END AS fx,
    CASE WHEN optics <> 2 THEN 2 * pixel * sqrt(c * (cos(a) ** 2 * qyy + sin(a) ** 2 * qzz - 2 * sin(a) * cos(a) * qyz)) END AS fr FROM h),
  u AS (SELECT *, safety / (2 * k_z * tan(a)) AS cap, CASE WHEN measured_period THEN period_ms ELSE exposure_ms + overhead_ms END AS t0 FROM k)"""


def _predicted(source: str) -> str:
    """CTEs of the predictions for the column ``cand`` of ``source``."""
    return f"""v AS (SELECT *, CASE WHEN fixed_velocity THEN t0 * cand / step ELSE t0 END AS frame, step * exposure_ms / t0 AS l0 FROM {source}),
  x AS (SELECT *, CASE WHEN preserve_blur THEN l0 * frame / cand ELSE exposure_ms END AS ex FROM v), y AS (SELECT *, CASE WHEN scan_mode = 1 THEN 0 ELSE cand * ex / frame END AS blur FROM x),
  z AS (SELECT *, scan_mode = 1 OR (k_y * l0 < 1 AND k_y * blur < 1) AS lobe, CASE WHEN scan_mode = 1 THEN 1 ELSE {_SINC.format("k_y * l0")} END AS base FROM y),
  r AS (SELECT *, CASE WHEN scan_mode <> 2 AND lobe AND base >= baseline_motion_floor THEN least(1.0, list_min(list_transform(range(1, 257), lambda i: ({_SINC.format("k_y * i / 256.0 * blur")}) / CASE WHEN scan_mode = 1 THEN 1.0 ELSE {_SINC.format("k_y * i / 256.0 * l0")} END))) END AS rel,
    CASE WHEN scan_mode <> 2 THEN abs({_SINC.format("k_y * blur")}) END AS ab, {_PLANES.format("extent", "cand")} AS planes, {_PLANES.format("extent", "step")} AS planes0 FROM z),
  e AS (SELECT *, ((planes - 1) * frame + ex + flyback_ms) / 1000 AS seconds, ((planes0 - 1) * t0 + exposure_ms + flyback_ms) / 1000 AS seconds0, cand <= cap AND coalesce(fr, 0) < 1 AND coalesce(fx, 0) < 1 AS alias_pass,
    lobe AND coalesce(rel >= relative_motion_floor, false) AND (NOT gate_absolute_motion OR coalesce(ab >= absolute_motion_floor, false)) AND ex <= frame AND ex > 0 AS motion_pass FROM r)"""


def _settings(spark, sf_dir):
    rows = views.table(spark, sf_dir, "supplier")
    numbers = [F.expr(e.replace("s_suppkey // 3 % 3", "(s_suppkey div 3) % 3")).cast("double").alias(k) for k, e in SETTINGS.items()]
    return rows.select(F.col("s_suppkey").alias("id"), *numbers, *[F.expr(e).alias(k) for k, e in FLAGS.items()])


@query("k07_step_model", f"""WITH {MODEL_SQL}, m AS (SELECT *, 2 * step AS cand FROM u), {_predicted("m")}
    SELECT id, round(k_z, 6) AS kz, round(k_y, 6) AS ky, round(cap, 6) AS alias_cap, round(fr, 6) AS row_fraction, round(rel, 6) AS relative_motion, round(ab, 6) AS absolute_motion, planes, round(seconds, 6) AS seconds, round(seconds0 / seconds, 6) AS speedup, alias_pass, motion_pass FROM e""")
def k07(spark, sf_dir):
    p = model.predict(model.support(_settings(spark, sf_dir)), 2 * F.col("step"))
    named = p.select("id", F.col("kz_").alias("kz"), F.col("ky_").alias("ky"), "alias_cap", "row_fraction", "relative_motion", "absolute_motion", "seconds", "speedup", "planes", "alias_pass", "motion_pass")
    return named.select("id", *[F.round(c, 6).alias(c) for c in named.columns[1:9]], "planes", "alias_pass", "motion_pass")


@query("k07_step_interval", f"""WITH {MODEL_SQL}, m AS (SELECT *, minimum_step + (maximum_step - minimum_step) * i / 1000.0e0 AS cand FROM u, (SELECT unnest(range(1001)) AS i)), {_predicted("m")},
  o AS (SELECT id, i, cand, i - row_number() OVER (PARTITION BY id ORDER BY i) AS island FROM e WHERE alias_pass AND motion_pass), n AS (SELECT id, island, min(cand) AS lo, max(cand) AS hi FROM o GROUP BY id, island)
    SELECT s.id, round(arg_min(lo, island), 6) AS lo, round(arg_min(hi, island), 6) AS hi FROM s LEFT JOIN n ON n.id = s.id GROUP BY s.id""")
def k07b(spark, sf_dir):
    return _round(model.step_interval(_settings(spark, sf_dir)))
