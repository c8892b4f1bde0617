"""Queries of detected spots, matches, fits and local maxima."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamella.functions import names as nm
from lamella.operators import points as pt
from lamella.operators import project as pj
from lamella.plans import views
from lamella.plans.registry import query

P = f"WITH {views.POINTS}, fixed AS (SELECT * FROM points WHERE id // 512 % 2 = 0), moving AS (SELECT * FROM points WHERE id // 512 % 2 = 1) "
V = f"WITH {views.VOXELS} "


def _halves(spark, sf_dir):
    p = views.points(spark, sf_dir)
    return p.filter("id div 512 % 2 = 0"), p.filter("id div 512 % 2 = 1")


MATCH_SQL = P + """, d AS (SELECT f.id AS fixed_id, m.id AS moving_id, f.x AS fx, f.y AS fy, m.x AS mx, m.y AS my, (f.x - (m.x + 3)) * (f.x - (m.x + 3)) + (f.y - (m.y - 2)) * (f.y - (m.y - 2)) AS d2
    FROM fixed f JOIN moving m ON abs(f.x - (m.x + 3)) <= 20 AND abs(f.y - (m.y - 2)) <= 20),
  r AS (SELECT *, row_number() OVER (PARTITION BY fixed_id ORDER BY d2, moving_id) AS ra, row_number() OVER (PARTITION BY moving_id ORDER BY d2, fixed_id) AS rb FROM d WHERE d2 <= 400) """


@query("j03_mutual_matches", MATCH_SQL + "SELECT fixed_id, moving_id, round(d2, 6) AS d2 FROM r WHERE ra = 1 AND rb = 1")
def j03(spark, sf_dir):
    return pt.mutual_matches(*_halves(spark, sf_dir), (3.0, -2.0), 20.0).withColumn("d2", F.round("d2", 6))


# A few hundred faint channel's spots against thousands: the brighter list is cut to three times theirs.
@query("j03_credible_matches", f"WITH {views.POINTS}, few AS (SELECT * FROM points WHERE id % 50 = 7), n AS (SELECT greatest(100, 3 * count(*)) AS most FROM few), many AS (SELECT * FROM points WHERE id % 50 <> 7 QUALIFY row_number() OVER (ORDER BY response DESC, y, x, id) <= (SELECT most FROM n))" + """,
  d AS (SELECT m.id AS fixed_id, f.id AS moving_id, (m.x - (0.999e0 * f.x - 0.02e0 * f.y + 3)) ** 2 + (m.y - (0.02e0 * f.x + 0.999e0 * f.y - 2)) ** 2 AS d2 FROM many m, few f),
  r AS (SELECT *, row_number() OVER (PARTITION BY fixed_id ORDER BY d2, moving_id) AS ra, row_number() OVER (PARTITION BY moving_id ORDER BY d2, fixed_id) AS rb FROM d)
  SELECT fixed_id, moving_id, round(d2, 6) AS d2 FROM r WHERE ra = 1 AND rb = 1 AND d2 <= 400""")
def j03b(spark, sf_dir):
    p = views.points(spark, sf_dir)
    found = pt.mutual_matches(p.filter("id % 50 <> 7"), p.filter("id % 50 = 7"), (0.999, -0.02, 3.0, 0.02, 0.999, -2.0), 20.0)
    return found.withColumn("d2", F.round("d2", 6))


@query("a30_rigid_fit", MATCH_SQL + """, p AS (SELECT fixed_id % 7 AS k, fx, fy, mx, my FROM r WHERE ra = 1 AND rb = 1),
  c AS (SELECT k, count(*) AS n, avg(fx) AS cfx, avg(fy) AS cfy, avg(mx) AS cmx, avg(my) AS cmy FROM p GROUP BY k),
  s AS (SELECT k, any_value(n) AS n, any_value(cfx) AS cfx, any_value(cfy) AS cfy, any_value(cmx) AS cmx, any_value(cmy) AS cmy,
    atan2(sum((mx - cmx) * (fy - cfy) - (my - cmy) * (fx - cfx)), sum((mx - cmx) * (fx - cfx) + (my - cmy) * (fy - cfy))) AS a FROM p JOIN c USING (k) GROUP BY k)
  SELECT k, n AS pairs, round(degrees(a), 4) AS angle, round(cfx - cos(a) * cmx + sin(a) * cmy, 4) AS dx, round(cfy - sin(a) * cmx - cos(a) * cmy, 4) AS dy FROM s WHERE n >= 3""")
def a30(spark, sf_dir):
    fixed, moving = _halves(spark, sf_dir)
    m = pt.mutual_matches(fixed, moving, (3.0, -2.0), 20.0)
    pairs = m.join(fixed.select(F.col("id").alias("fixed_id"), F.col("x").alias("fx"), F.col("y").alias("fy")), "fixed_id")
    pairs = pairs.join(moving.select(F.col("id").alias("moving_id"), F.col("x").alias("mx"), F.col("y").alias("my")), "moving_id")
    fit = pt.rigid_fit(pairs.withColumn("k", F.col("fixed_id") % 7), ["k"]).filter("pairs >= 3")
    return fit.select("k", "pairs", *[F.round(c, 4).alias(c) for c in ("angle", "dx", "dy")])


@query("j04_shift_votes", P + """, a AS (SELECT x AS ax, y AS ay FROM fixed ORDER BY response DESC, y, x, id LIMIT 300), b AS (SELECT x AS bx, y AS mb FROM moving ORDER BY response DESC, y, x, id LIMIT 300)
  SELECT CAST(2 * floor(floor(ax - bx + 0.5) / 2 + 0.5) AS BIGINT) AS dx, CAST(2 * floor(floor(ay - mb + 0.5) / 2 + 0.5) AS BIGINT) AS dy, count(*) AS votes FROM a, b WHERE abs(floor(ax - bx + 0.5)) <= 40 AND abs(floor(ay - mb + 0.5)) <= 20 GROUP BY 1, 2""")
def j04(spark, sf_dir):
    return pt.shift_votes(*_halves(spark, sf_dir), 40.0, 20.0)


@query("j05_isolated_points", P + "SELECT id FROM points p WHERE NOT EXISTS (SELECT 1 FROM points q WHERE p.id <> q.id AND abs(p.x - q.x) <= 0.3 AND abs(p.y - q.y) <= 0.2 AND ((p.x - q.x) / 0.3) ** 2 + ((p.y - q.y) / 0.2) ** 2 <= 1)")
def j05(spark, sf_dir):
    return pt.isolated(views.points(spark, sf_dir), {"x": 0.3, "y": 0.2}).select("id")


@query("j06_points_apart", P + "SELECT id FROM points p WHERE x BETWEEN 8 AND 503 AND y BETWEEN 8 AND 503 AND NOT EXISTS (SELECT 1 FROM points q WHERE p.id <> q.id AND abs(p.x - q.x) < 0.25 AND abs(p.y - q.y) < 0.25 AND (p.x - q.x) ** 2 + (p.y - q.y) ** 2 < 0.0625)")
def j06(spark, sf_dir):
    return pt.apart_from_others(views.points(spark, sf_dir), 0.25, 512, 512, 8).select("id")


CROPS_SQL = V + """, b AS (SELECT t, c, z AS z0, y AS y0, x AS x0, (t * 10 + c) * 1000 + z * 100 + y * 10 + x AS bead FROM voxels WHERE v % 97 = 5),
  k AS (SELECT bead, v.z - z0 AS dz, v.y - y0 AS dy, v.x - x0 AS dx, v.v FROM b JOIN voxels v ON v.t = b.t AND v.c = b.c AND abs(v.z - z0) <= 2 AND abs(v.y - y0) <= 1 AND abs(v.x - x0) <= 1) """


RADIUS = {"z": 2, "y": 1, "x": 1}


def bead_places(spark, sf_dir):
    v = views.voxels(spark, sf_dir).filter("v % 97 = 5")
    return v.select("t", "c", F.col("z").alias("bz"), F.col("y").alias("by"), F.col("x").alias("bx"), F.expr("(t * 10 + c) * 1000 + z * 100 + y * 10 + x").alias("bead"))


def crops(spark, sf_dir):
    return pt.crops(views.voxels(spark, sf_dir), bead_places(spark, sf_dir), RADIUS)


@query("j09_bead_crops", CROPS_SQL + "SELECT * FROM k")
def j09(spark, sf_dir):
    return crops(spark, sf_dir)


# Shell background and noise, peak and its first place, ratios, neighbours; then the first reason that applies.
QUALITY_SQL = CROPS_SQL + """, e AS (SELECT *, abs(dz) = 2 OR abs(dy) = 1 OR abs(dx) = 1 AS shell FROM k),
  m AS (SELECT bead, count(*) AS n, max(v) AS peak, median(v) FILTER (shell AND v < 45000) AS background, count(*) FILTER (shell AND v < 45000) AS taken, arg_max({'z': dz, 'y': dy, 'x': dx}, v * 1000 - ((dz + 2) * 9 + (dy + 1) * 3 + dx + 1)) AS pos FROM e GROUP BY bead),
  n AS (SELECT m.bead, 1.4826 * median(abs(v - background)) FILTER (shell AND v < 45000) AS noise, sum(greatest(v - background, 0)) AS integral FROM e JOIN m USING (bead) GROUP BY m.bead),
  p AS (SELECT DISTINCT a.bead FROM b a JOIN b o ON o.t = a.t AND o.c = a.c AND o.bead <> a.bead AND ((a.z0 - o.z0) / 2.0) ** 2 + ((a.y0 - o.y0) / 1.0) ** 2 + ((a.x0 - o.x0) / 1.0) ** 2 <= 1),
  q AS (SELECT b.t, b.c, b.bead, n, peak, background, taken, noise, integral, p.bead IS NOT NULL AS near, (peak - background) / greatest(noise, 1e-12) AS snr, CASE WHEN background > 0 THEN peak / background ELSE 'inf' END AS sbr,
    sqrt((pos.z / 2.0) ** 2 + pos.y ** 2 + pos.x ** 2) AS off FROM b LEFT JOIN m USING (bead) LEFT JOIN n USING (bead) LEFT JOIN p USING (bead)),
  r AS (SELECT *, CASE WHEN n < 45 THEN 'edge' WHEN near THEN 'neighbour' WHEN peak >= 45000 THEN 'saturated' WHEN taken = 0 THEN 'empty' WHEN NOT (peak > background) OR snr < 2 THEN 'low snr' WHEN sbr < 3.5 THEN 'low sbr' WHEN off > 1.2 THEN 'off centre'
    WHEN NOT integral > 0 THEN 'empty' ELSE 'accepted' END AS reason FROM q)"""


def _quality(spark, sf_dir):
    from lamella.operators.beads import bead_quality

    beads = bead_places(spark, sf_dir)
    return bead_quality(crops(spark, sf_dir), beads, RADIUS, ["t", "c"], saturation=45000.0, snr=2.0, sbr=3.5, off_centre=1.2)


@query("a19_bead_quality", QUALITY_SQL + " SELECT bead, background, round(noise, 6) AS noise, peak, round(snr, 6) AS snr, round(sbr, 6) AS sbr, round(off, 6) AS offset_, reason FROM r")
def a19(spark, sf_dir):
    q = _quality(spark, sf_dir)
    return q.select("bead", "background", F.round("noise", 6).alias("noise"), "peak", F.round("snr", 6).alias("snr"), F.round("sbr", 6).alias("sbr"), F.round("offset", 6).alias("offset_"), "reason")


@query("a19_reason_counts", QUALITY_SQL + " SELECT reason, count(*) AS beads FROM r GROUP BY reason")
def a19b(spark, sf_dir):
    from lamella.operators.beads import reason_counts

    return reason_counts(_quality(spark, sf_dir))


COMBINED_SQL = QUALITY_SQL + """, u AS (SELECT r.t, r.c, bead, bead % 3 AS g, dz, dy, dx, greatest(v - background, 0) / integral AS v FROM k JOIN r USING (bead) WHERE reason = 'accepted')"""


def bead_kernels(spark, sf_dir):
    from lamella.operators.beads import normalised

    return normalised(crops(spark, sf_dir), _quality(spark, sf_dir)).withColumn("g", F.col("bead") % 3)


for _method, _value in (("median", "median(v)"), ("mean", "avg(v)")):

    @query(f"a20_combined_{_method}", COMBINED_SQL + f", j AS (SELECT g, dz, dy, dx, {_value} AS m FROM u GROUP BY ALL) SELECT g, dz, dy, dx, round(m / sum(m) OVER (PARTITION BY g), 8) AS v FROM j")
    def a20(spark, sf_dir, method=_method):
        from lamella.operators.beads import combined

        return combined(bead_kernels(spark, sf_dir), ["g"], method).withColumn("v", F.round("v", 8))


@query("a20_all_beads", COMBINED_SQL + " SELECT g, bead, dz, dy, dx, round(v / sum(v) OVER (PARTITION BY bead), 8) AS v FROM u")
def a20c(spark, sf_dir):
    from lamella.operators.beads import combined

    return combined(bead_kernels(spark, sf_dir), ["g"], "all").withColumn("v", F.round("v", 8))


@query("a21_psf_per_channel", COMBINED_SQL + """, w AS (SELECT printf('_Channel%04d-%s', c, CASE WHEN bead % 10 < 5 THEN 'left' ELSE 'right' END) AS psf, dz, dy, dx, avg(v) AS m FROM u GROUP BY ALL)
  SELECT psf, dz, dy, dx, round(m / sum(m) OVER (PARTITION BY psf), 8) AS v FROM w""")
def a21(spark, sf_dir):
    from lamella.operators.beads import combined

    side = F.when(F.col("bead") % 10 < 5, "left").otherwise("right")
    named = bead_kernels(spark, sf_dir).join(bead_places(spark, sf_dir).select("bead", "c"), "bead").withColumn("psf", nm.source_key(F.col("c"), side))
    return combined(named, ["psf"], "mean").withColumn("v", F.round("v", 8))


@query("w06_local_maxima", V + """, p AS (SELECT t, c, y, x, max(v) AS v FROM voxels GROUP BY ALL)
  SELECT p.t, p.c, p.y, p.x, p.v FROM p JOIN p q ON p.t = q.t AND p.c = q.c AND abs(p.y - q.y) <= 1 AND abs(p.x - q.x) <= 1 AND (p.y <> q.y OR p.x <> q.x) GROUP BY ALL HAVING count(*) = 8 AND max(q.v) < p.v""")
def w06(spark, sf_dir):
    return pt.local_maxima(pj.projection(views.voxels(spark, sf_dir), "z", "max"))


@query("w07_subpixel_peaks", V + """, p AS (SELECT t, c, y, x, max(v) AS v FROM voxels GROUP BY ALL), w AS (SELECT *, lag(v) OVER k AS a, lead(v) OVER k AS b FROM p WINDOW k AS (PARTITION BY t, c, y ORDER BY x))
  SELECT t, c, y, x, round(CASE WHEN a - 2 * v + b = 0 THEN 0 ELSE least(greatest((a - b) / (2.0 * (a - 2 * v + b)), -0.5), 0.5) END, 6) AS offset FROM w WHERE a < v AND b < v""")
def w07(spark, sf_dir):
    p = pj.projection(views.voxels(spark, sf_dir), "z", "max")
    line = Window.partitionBy("t", "c", "y").orderBy("x")
    w = p.withColumns({"a": F.lag("v").over(line), "b": F.lead("v").over(line)}).filter("a < v AND b < v")
    return w.select("t", "c", "y", "x", F.round(pt.parabola(F.col("a"), F.col("v"), F.col("b")), 6).alias("offset"))


@query("t05_first_maximum_z", V + "SELECT t, c, y, x, arg_max(z, v * 100 + (10 - z)) AS z FROM voxels GROUP BY t, c, y, x")
def t05(spark, sf_dir):
    return pt.first_maximum_z(views.voxels(spark, sf_dir))


@query("t04_brightest_spots", P + "SELECT id, response FROM points ORDER BY response DESC, y, x, id LIMIT 200")
def t04(spark, sf_dir):
    return pt.brightest(views.points(spark, sf_dir), 200).select("id", "response")


# Spots of an image from the brightest on: each is kept if none of those kept so far is nearer than 20, until there are 50.
@query("t04_spaced_spots", """WITH RECURSIVE points AS (SELECT p_partkey AS id, CAST((p_partkey * 37) % 512 + p_size / 100.0 AS DOUBLE) AS x, CAST((p_partkey * 101) % 512 + (p_retailprice - floor(p_retailprice)) / 10 AS DOUBLE) AS y, p_size AS response FROM part),
  o AS (SELECT *, id // 500 AS image, row_number() OVER (PARTITION BY id // 500 ORDER BY response DESC, y, x, id) AS rn FROM points),
  g AS (SELECT DISTINCT image, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(id BIGINT, x DOUBLE, y DOUBLE)[]) AS kept FROM o
    UNION ALL SELECT g.image, o.rn, CASE WHEN len(kept) < 50 AND len(list_filter(kept, lambda p: (p.x - o.x) ** 2 + (p.y - o.y) ** 2 < 400)) = 0 THEN list_append(kept, {'id': CAST(o.id AS BIGINT), 'x': o.x, 'y': o.y}) ELSE kept END FROM g JOIN o ON o.image = g.image AND o.rn = g.rn + 1),
  l AS (SELECT image, unnest(arg_max(kept, rn)) AS k FROM g GROUP BY image)
  SELECT o.id, o.x, o.y, o.response, o.image FROM l JOIN o ON o.id = l.k.id""")
def t04b(spark, sf_dir):
    from lamella.operators.beads import greedy_spots

    return greedy_spots(views.points(spark, sf_dir).withColumn("image", F.expr("id div 500")), ["image"], distance=20.0, most=50)


@query(
    "w08_gaussian",
    V + """, k AS (SELECT unnest([-2, -1, 0, 1, 2]) AS d, unnest([0.05448868454964294, 0.2442013420032363, 0.40261994689424746, 0.2442013420032363, 0.05448868454964294]) AS w)
    SELECT a.t, a.c, a.z, a.y, a.x, round(sum(CAST(p.v AS DOUBLE) * w), 5) AS v FROM voxels a CROSS JOIN k
    JOIN voxels p ON p.t = a.t AND p.c = a.c AND p.z = a.z AND p.y = a.y AND p.x = least(greatest(a.x + d, 0), 9) GROUP BY ALL""",
)
def w08(spark, sf_dir):
    from lamella.operators.filters import gaussian_x

    return gaussian_x(views.voxels(spark, sf_dir), 1.0, 2).withColumn("v", F.round("v", 5))
