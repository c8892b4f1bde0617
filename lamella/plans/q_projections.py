"""Queries of projections, display ranges and comparison statistics."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamella.operators import project as pj
from lamella.operators import sampling_study as ss
from lamella.plans import views
from lamella.plans.registry import query

V = f"WITH {views.VOXELS} "
SQL_KINDS = {
    "max": "max(v)", "min": "min(v)", "sum": "least(sum(v), 65535)", "mean": "least((sum(v) + count(*) // 2) // count(*), 65535)",
    "median": "CAST(floor(median(v) + 0.5) AS BIGINT)",
    "std": "CASE WHEN count(*) < 2 THEN 0 ELSE least(CAST(floor(stddev_samp(v) + 0.5) AS BIGINT), 65535) END",
}


def _v(spark, sf_dir):
    return views.voxels(spark, sf_dir)


def _register(axis, kind):
    a, b = pj.OTHER[axis]
    sql = V + f"SELECT t, c, {a}, {b}, CAST({SQL_KINDS[kind]} AS BIGINT) AS v FROM voxels GROUP BY t, c, {a}, {b}"
    query(f"a01_projection_{kind}_{axis}", sql)(lambda spark, sf_dir: pj.projection(_v(spark, sf_dir), axis, kind).withColumn("v", F.col("v").cast("long")))


for _axis, _kind in [("z", "max"), ("z", "mean"), ("z", "median"), ("z", "std"), ("y", "max"), ("y", "sum"), ("x", "mean"), ("x", "min")]:
    _register(_axis, _kind)


@query(
    "a03_six_projections",
    V + f"""SELECT t, c, 'X' AS view, y AS h, z AS w, max(v) AS max_v, CAST({SQL_KINDS["mean"]} AS BIGINT) AS mean_v FROM voxels GROUP BY t, c, y, z
    UNION ALL SELECT t, c, 'Y', z, x, max(v), CAST({SQL_KINDS["mean"]} AS BIGINT) FROM voxels GROUP BY t, c, x, z
    UNION ALL SELECT t, c, 'Z', y, x, max(v), CAST({SQL_KINDS["mean"]} AS BIGINT) FROM voxels GROUP BY t, c, x, y""",
)
def a03(spark, sf_dir):
    return pj.six_projections(_v(spark, sf_dir))


@query(
    "a05_grouped_median_z",
    V + """, m AS (SELECT t, c, y, x, z // 3 AS g, avg(v) AS m FROM voxels GROUP BY ALL)
    SELECT t, c, y, x, CAST(floor(median(m) + 0.5) AS BIGINT) AS v FROM m GROUP BY t, c, y, x""",
)
def a05(spark, sf_dir):
    return pj.grouped_median_z(_v(spark, sf_dir), 3)


@query(
    "a07_projection_movie",
    V + """, f AS (SELECT c, t, row_number() OVER (PARTITION BY c ORDER BY t) - 1 AS frame FROM (SELECT DISTINCT c, t FROM voxels))
    SELECT c, t, frame, y, x, max(v) AS v FROM voxels JOIN f USING (c, t) GROUP BY ALL""",
)
def a07(spark, sf_dir):
    return pj.movie(_v(spark, sf_dir), "z", "max")


RANGE_SQL = """, h AS (SELECT t, c, v, count(*) AS n FROM voxels GROUP BY ALL),
    k AS (SELECT t, c, v, sum(n) OVER (PARTITION BY t, c ORDER BY v) AS b, sum(n) OVER (PARTITION BY t, c ORDER BY v DESC) AS a, sum(n) OVER (PARTITION BY t, c) * ({cut}) AS cut FROM h),
    r AS (SELECT t, c, min(CASE WHEN b > cut THEN v END) AS low, max(CASE WHEN a > cut THEN v END) AS high FROM k GROUP BY t, c)"""


@query("a08_saturated_range", V + RANGE_SQL.format(cut="1.0 / 200") + " SELECT * FROM r")
def a08(spark, sf_dir):
    return pj.saturated_range(_v(spark, sf_dir), ["t", "c"], 1.0)


@query(
    "a09_auto_range",
    V + """, e AS (SELECT t, c, min(v) AS lo, max(v) AS hi, count(*) AS total FROM voxels GROUP BY t, c),
    n AS (SELECT t, c, lo, hi, total, CASE WHEN hi = lo THEN 0 ELSE least(CAST(trunc((v - lo) * (256.0e0 / (hi - lo))) AS INTEGER), 255) END AS bin, count(*) AS n FROM voxels JOIN e USING (t, c) GROUP BY ALL),
    p AS (SELECT *, n > total // 500 AND n <= total // 10 AS fits FROM n),
    r AS (SELECT t, c, lo, hi, coalesce(min(bin) FILTER (fits AND bin < 255), 255) AS a, coalesce(max(bin) FILTER (fits AND bin > 0), 0) AS b FROM p GROUP BY ALL),
    w AS (SELECT *, lo + a * ((hi - lo) / 256.0e0) AS bottom, lo + b * ((hi - lo) / 256.0e0) AS top FROM r)
    SELECT t, c, CAST(CASE WHEN b < a OR bottom = top THEN lo ELSE bottom END AS DOUBLE) AS low,
      CAST(CASE WHEN b < a OR bottom = top THEN CASE WHEN hi = lo THEN lo + 1 ELSE hi END ELSE top END AS DOUBLE) AS high, CASE WHEN b < a THEN 0 ELSE 500 END AS stage FROM w""",
)
def a09(spark, sf_dir):
    return pj.auto_range(_v(spark, sf_dir), ["t", "c"], previous=1000)


@query(
    "a10_trimmed_range",
    V + RANGE_SQL.format(cut="0.00005")
    + """ SELECT r.t, r.c, CASE WHEN r.low >= r.high THEN coalesce(p.low, r.low) ELSE r.low END AS low,
      CASE WHEN r.low >= r.high THEN coalesce(p.high, r.high) ELSE r.high END AS high FROM r LEFT JOIN r p ON p.t = r.t AND p.c = 3 - r.c""",
)
def a10(spark, sf_dir):
    return pj.trimmed_range(_v(spark, sf_dir), ["t", "c"], 3 - F.col("c"))


@query(
    "a11_median_mad",
    V + """, m AS (SELECT t, c, median(v) AS median FROM voxels GROUP BY t, c)
    SELECT t, c, median, median(abs(v - median)) * 1.4826 AS sigma FROM voxels JOIN m USING (t, c) GROUP BY t, c, median""",
)
def a11(spark, sf_dir):
    return pj.median_mad(_v(spark, sf_dir), ["t", "c"])


# Of an even number of values the upper of the middle two; the region of one plane has 64 pixels.
@query(
    "a11_order_statistics",
    V + """, r AS (SELECT t, c, v, row_number() OVER (PARTITION BY t, c ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY t, c) AS n FROM voxels), m AS (SELECT t, c, v AS median FROM r WHERE k = n // 2),
    d AS (SELECT t, c, median, abs(v - median) AS d, row_number() OVER (PARTITION BY t, c ORDER BY abs(v - median)) - 1 AS k, count(*) OVER (PARTITION BY t, c) AS n FROM voxels JOIN m USING (t, c))
    SELECT t, c, median, round(d / 0.6744897501960817e0, 4) AS sigma FROM d WHERE k = n // 2""",
)
def a11b(spark, sf_dir):
    return pj.order_median_mad(_v(spark, sf_dir), ["t", "c"]).withColumn("sigma", F.round("sigma", 4))


@query(
    "a11_roi_background",
    V + """, p AS (SELECT * FROM voxels WHERE x BETWEEN 1 AND 8 AND y BETWEEN 2 AND 9), m AS (SELECT t, c, z, list_sort(list(v))[33] AS median FROM p GROUP BY ALL)
    SELECT t, c, z, CAST(any_value(median) AS DOUBLE) AS median, round(list_sort(list(abs(v - median)))[33] / 0.6744897501960817e0, 4) AS sigma FROM p JOIN m USING (t, c, z) GROUP BY t, c, z""",
)
def a11c(spark, sf_dir):
    return pj.roi_background(_v(spark, sf_dir), ["t", "c", "z"], (1, 2, 8, 8), 10, 10).withColumn("sigma", F.round("sigma", 4))


@query(
    "a26_size_estimate",
    "SELECT o_orderkey AS id, CASE WHEN CAST(o_orderkey AS HUGEINT) * 4000000000 * 400000000 > 9223372036854775807 THEN 9223372036854775807 ELSE CAST(CAST(o_orderkey AS HUGEINT) * 4000000000 * 400000000 AS BIGINT) END AS bytes FROM orders",
)
def a26(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("id"), pj.saturating_product(F.col("o_orderkey"), F.lit(4_000_000_000), F.lit(400_000_000)).alias("bytes"))


@query(
    "a27_run_statistics",
    """WITH r AS (SELECT user_id, ts, value AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
    SELECT user_id, count(*) AS n, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95,
      (count(*) - 1) / nullif(epoch(max(ts)) - epoch(min(ts)), 0) AS rate FROM r WHERE k <= 50 GROUP BY user_id""",
)
def a27(spark, sf_dir):
    recent = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = views.table(spark, sf_dir, "events").withColumn("k", F.row_number().over(recent)).filter("k <= 50")
    seconds = "(cast(cast(max(ts) as timestamp) as double) - cast(cast(min(ts) as timestamp) as double))"
    return rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.expr(f"try_divide(count(1) - 1, {seconds})").alias("rate"),
    )


@query(
    "a28_content_digest",
    V + """, p AS (SELECT t, c, z, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY y, x)) AS h, count(CASE WHEN v >= 9000 THEN 1 END) AS s FROM voxels GROUP BY t, c, z)
    SELECT t, c, sha256(string_agg(h, '' ORDER BY z)) AS digest, CAST(sum(s) AS BIGINT) AS saturated FROM p GROUP BY t, c""",
)
def a28(spark, sf_dir):
    return pj.plane_digests(_v(spark, sf_dir), 9000)


@query("a29_part_dimensions", V + """, p AS (SELECT t, CASE WHEN x < 4 THEN 'a' WHEN x < 9 THEN 'b' ELSE 'd' END AS part, max(y) + 1 AS h, count(DISTINCT x) AS w FROM voxels WHERE y < 4 + x GROUP BY ALL)
    SELECT t, max(h) AS tallest, CAST(sum(w) AS BIGINT) AS total_width FROM p GROUP BY t""")
def a29(spark, sf_dir):
    part = F.when(F.col("x") < 4, "a").when(F.col("x") < 9, "b").otherwise("d")
    parts = _v(spark, sf_dir).filter("y < 4 + x").groupBy("t", part.alias("part")).agg((F.max("y") + 1).alias("h"), F.countDistinct("x").alias("w"))
    return parts.groupBy("t").agg(F.max("h").alias("tallest"), F.sum("w").alias("total_width"))


FIT = (4.0, 0.1)  # read variance and gain of the study's noise model
STUDY = """, e AS (
    SELECT a.t, f.factor, a.z % f.factor AS phase, a.v / 100.0 AS r, b.v / 100.0 AS p
    FROM voxels a JOIN voxels b ON a.t = b.t AND a.y = b.y AND a.x = b.x AND a.c = 1 AND b.c = 2 AND a.z = b.z, (SELECT unnest([2, 3, 4]) AS factor) f),
  s AS (SELECT t, factor, phase, count(*) AS n, sum(r) AS sr, sum(p) AS sp, sum(r * r) AS srr, sum(p * p) AS spp, sum(r * p) AS srp, sum((p - r) ** 2) AS se, sum(p - r) AS sb, sum((r - 20) ** 2) AS power,
    4.0 * 1.25 * count(*) + 0.1 * sum(r / 2) AS noise, 4.0 * count(*) + 0.1 * sum(r / 4) AS own FROM e WHERE NOT (factor = 4 AND phase = 3 AND t % 2 = 1) GROUP BY ALL),
  q AS (SELECT t, factor, count(*) AS phases, sum(n) AS n, sum(sr) AS sr, sum(sp) AS sp, sum(srr) AS srr, sum(spp) AS spp, sum(srp) AS srp, sum(se) AS se, sum(sb) AS sb, sum(power) AS power, sum(noise) AS noise, sum(own) AS own, max(sqrt(se / power)) AS worst FROM s GROUP BY t, factor)"""


@query(
    "a12_comparison_statistics",
    V + STUDY + """ SELECT t, factor, round(sqrt(se / power), 6) AS nrmse, round(sb / n, 6) AS bias, round((srp - sr * sp / n) / sqrt((srr - sr * sr / n) * (spp - sp * sp / n)), 6) AS correlation,
      round(sqrt(greatest(se - noise, 0) / (power - own)), 6) AS excess, round(noise / se, 6) AS noise_share FROM q""",
)
def a12(spark, sf_dir):
    pooled = ss.pooled(ss.statistics(_study(spark, sf_dir), ["t", "factor", "phase"], background=20.0), ["t", "factor"], FIT)
    return pooled.select("t", "factor", *[F.round(c, 6).alias(c) for c in ("nrmse", "bias", "correlation", "excess", "noise_share")])


def _study(spark, sf_dir):
    """Channel 2 as a prediction of channel 1, with the noise that a linear method would carry; one phase is missing at odd times."""
    v = _v(spark, sf_dir)
    left = v.filter("c = 1").select("t", "z", "y", "x", (F.col("v") / 100.0).alias("ref"))
    right = v.filter("c = 2").select("t", "z", "y", "x", (F.col("v") / 100.0).alias("pred"))
    pairs = left.join(right, ["t", "z", "y", "x"]).withColumns({"read_floor": F.lit(1.25), "shot_floor": F.col("ref") / 2, "read_noise": F.lit(1.0), "shot_noise": F.col("ref") / 4})
    pairs = pairs.withColumn("factor", F.explode(F.array(F.lit(2), F.lit(3), F.lit(4)))).withColumn("phase", F.col("z") % F.col("factor"))
    return pairs.filter("NOT (factor = 4 AND phase = 3 AND t % 2 = 1)")


@query(
    "a13_verdicts",
    V + STUDY + """, x AS (SELECT *, CASE WHEN phases = factor THEN sqrt(greatest(se - noise, 0) / (power - own)) END AS excess FROM q)
    SELECT x.t, x.factor, round(sqrt(x.se / x.power), 6) AS score, round(x.worst, 6) AS worst,
      CASE WHEN x.phases <> x.factor THEN 'Incomplete' WHEN x.t % 3 = 2 THEN 'Insufficient evidence' WHEN sqrt(x.se / x.power) <= 1.1 AND x.worst <= 1.1 THEN 'Pass' ELSE 'Fails' END AS verdict,
      CASE WHEN x.excess IS NOT NULL AND b.excess IS NOT NULL THEN round(sqrt(greatest(x.excess ** 2 - b.excess ** 2, 0)), 6) END AS increase FROM x LEFT JOIN x b ON b.t = x.t AND b.factor = 2""",
)
def a13(spark, sf_dir):
    evidence = _v(spark, sf_dir).select("t").distinct().withColumn("evidence", F.when(F.col("t") % 3 == 2, "noise unverified").otherwise("eligible"))
    v = ss.verdicts(ss.statistics(_study(spark, sf_dir), ["t", "factor", "phase"], background=20.0), ["t"], 1.1, FIT, evidence, ["t"])
    return v.select("t", "factor", *[F.round(c, 6).alias(c) for c in ("score", "worst", "increase")], "verdict")


@query(
    "a14_passing_range",
    """WITH r AS (SELECT o_custkey AS run, 2 + o_orderkey % 6 AS factor, bool_and(o_totalprice < 250000) AS pass FROM orders GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY factor) AS i FROM r),
    g AS (SELECT *, bool_and(pass AND factor = i + 1) OVER (PARTITION BY run ORDER BY factor) AS chain FROM k)
    SELECT run, max(CASE WHEN chain THEN factor END) AS contiguous_to, string_agg(CASE WHEN pass AND NOT chain THEN CAST(factor AS VARCHAR) END, ',' ORDER BY factor) AS isolated FROM g GROUP BY run""",
)
def a14(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    runs = orders.groupBy(F.col("o_custkey").alias("run"), F.expr("2 + o_orderkey % 6").alias("factor")).agg(F.bool_and(F.col("o_totalprice") < 250000).alias("pass"))
    return ss.passing_range(runs, ["run"])


def _smooth_sql(axis: str, source: str) -> str:
    at = " AND ".join(f"p.{k} = a.{k}" for k in "tczyx" if k != axis)
    return f"(SELECT a.t, a.c, a.z, a.y, a.x, sum(w * p.v) AS v FROM {source} a CROSS JOIN k JOIN {source} p ON {at} AND p.{axis} = least(greatest(a.{axis} + d, 0), 9) GROUP BY ALL)"


# The volume under a Gaussian of sigma 1 with taps to 4, its robust noise, the order statistic inside the guards, and the mask.
MASK_SQL = f""", d AS (SELECT unnest(range(-4, 5)) AS d), k AS (SELECT d, exp(-0.5 * d * d) / (SELECT sum(exp(-0.5 * d * d)) FROM d) AS w FROM d),
    gx AS {_smooth_sql("x", "voxels")}, gy AS {_smooth_sql("y", "gx")}, gz AS {_smooth_sql("z", "gy")},
    m AS (SELECT t, c, median(v) AS median FROM voxels GROUP BY t, c), s AS (SELECT t, c, 1.4826 * median(abs(v - median)) AS sigma FROM voxels JOIN m USING (t, c) GROUP BY t, c),
    i AS (SELECT *, row_number() OVER (PARTITION BY t, c ORDER BY v) - 1 AS rank, count(*) OVER (PARTITION BY t, c) AS n FROM gz WHERE z BETWEEN 1 AND 8 AND y BETWEEN 1 AND 8 AND x BETWEEN 2 AND 7),
    h AS (SELECT t, c, v AS high FROM i WHERE rank = floor(0.995 * (n - 1))),
    mask AS (SELECT i.* FROM i JOIN h USING (t, c) JOIN s USING (t, c) WHERE v > greatest(0.5 * sigma, 0.9 * high))"""
GUARDS = {"z": (1, 8), "y": (1, 8), "x": (2, 7)}


def _mask(spark, sf_dir):
    v = _v(spark, sf_dir)
    sigma = pj.median_mad(v, ["t", "c"]).select("t", "c", "sigma")
    return v, sigma, ss.signal_mask(v, ["t", "c"], sigma, sigmas=0.5, fraction=0.9, guards=GUARDS)


@query(
    "a15_evidence",
    V + MASK_SQL + """, q AS (SELECT t, c, count(*) AS signal, count(DISTINCT z) AS planes FROM mask GROUP BY t, c), p AS (SELECT t, c, count(*) FILTER (v >= 48000) AS saturated FROM voxels GROUP BY t, c)
    SELECT p.t, p.c, coalesce(signal, 0) AS signal, coalesce(planes, 0) AS planes, saturated, CASE WHEN p.t % 6 = 5 THEN 'geometry unverified' WHEN p.t % 4 = 3 AND p.t % 7 <> 4 THEN 'noise unverified' WHEN p.t % 7 <> 4 AND sigma = 0 THEN 'zero noise'
      WHEN coalesce(signal, 0) < 5 OR coalesce(planes, 0) < 3 THEN 'insufficient foreground' WHEN saturated > 0 THEN 'saturated' ELSE 'eligible' END AS evidence FROM p LEFT JOIN q USING (t, c) JOIN s USING (t, c)""",
)
def a15(spark, sf_dir):
    v, sigma, mask = _mask(spark, sf_dir)
    regions = v.groupBy("t", "c").agg(F.count_if(F.col("v") >= 48000).alias("saturated")).join(sigma, ["t", "c"])
    regions = regions.join(mask.groupBy("t", "c").agg(F.count(F.lit(1)).alias("signal"), F.countDistinct("z").alias("planes")), ["t", "c"], "left").fillna(0, ["signal", "planes"])
    flags = {"geometry_confirmed": F.col("t") % 6 != 5, "noise_known": F.col("t") % 4 != 3, "noise_free": F.col("t") % 7 == 4}
    return ss.with_evidence(regions.withColumns(flags), minimum_signal=5).select("t", "c", "signal", "planes", "saturated", "evidence")


@query("a16_signal_mask", V + MASK_SQL + " SELECT t, c, z, y, x, round(v, 4) AS v FROM mask")
def a16(spark, sf_dir):
    return _mask(spark, sf_dir)[2].withColumn("v", F.round("v", 4))


@query(
    "j08_compare_volumes",
    V + """ SELECT a.t, count(*) AS voxels, sum(abs(a.v - b.v)) AS absolute, max(abs(a.v - b.v)) AS worst
    FROM voxels a JOIN voxels b ON a.t = b.t AND a.c = 1 AND b.c = 2 AND a.y = b.y AND a.x = b.x AND a.z = b.z + 1 WHERE a.z BETWEEN 2 AND 7 GROUP BY a.t""",
)
def j08(spark, sf_dir):
    v = _v(spark, sf_dir)
    return ss.compare(v.filter("c = 1"), v.filter("c = 2"), ["t"], offset=1, guard=(2, 7))
