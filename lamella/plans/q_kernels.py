"""Queries of resampling, Fourier, detection, alignment and deconvolution kernels."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

from lamella.functions import matrix as mx
from lamella.operators import alignment as al, filters, kernels, points as pt, project as pj, resample as rs, voxels as vx
from lamella.plans import views
from lamella.plans.registry import query

W = H = D = 10
V = f"WITH {views.VOXELS} "
STEP, PIXEL, ANGLE = 0.265, 0.116, 25.0
TURN = [math.cos(0.02), -math.sin(0.02), 0.6, math.sin(0.02), math.cos(0.02), -0.4]
PSF = np.exp(-0.5 * sum(g**2 for g in np.mgrid[-2:3, -1:2, -1:2]))


def _v(spark, sf_dir):
    return views.voxels(spark, sf_dir)


def _planes(spark, sf_dir, kind="max"):
    flat = pj.projection(_v(spark, sf_dir), "z", kind).withColumn("z", F.lit(0).cast("long"))
    return vx.to_planes(flat, W, H)


def _embedded(spark, sf_dir):
    e = views.table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("z"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.col("embedding").cast("array<double>").alias("px"))


def deskew_sql(name: str, source: str, width: int, height: int = H, depth: int = D) -> str:
    """CTE ``name`` (t, c, z, y, x, v): every voxel of the deskewed box by bilinear weights of the raw row and plane it comes from."""
    a = math.radians(ANGLE)
    tall, deep = math.ceil(math.cos(a) * (height - 1) + STEP / PIXEL * (depth - 1)) + 1, math.ceil(math.sin(a) * (height - 1)) + 1
    row = f"({height - 1} - z / {math.sin(a)!r}e0)"
    return f"""{name}_o AS (SELECT t, c, x, z, y, round({row}, 9) AS ry, round((y - {math.cos(a)!r}e0 * {row}) / {STEP / PIXEL!r}e0, 9) AS rz
        FROM (SELECT DISTINCT t, c, x FROM {source}), (SELECT unnest(range({deep})) AS z), (SELECT unnest(range({tall})) AS y)),
      {name} AS (SELECT o.t, o.c, o.z, o.y, o.x, CAST(floor(coalesce(sum((1 - abs(ry - s.y)) * (1 - abs(rz - s.z)) * s.v), 0) + 0.5) AS BIGINT) AS v FROM {name}_o o
        LEFT JOIN {source} s ON s.t = o.t AND s.c = o.c AND s.x = o.x AND abs(ry - s.y) < 1 AND abs(rz - s.z) < 1 AND ry BETWEEN 0 AND {height - 1} AND rz BETWEEN 0 AND {depth - 1} GROUP BY ALL)"""


@query("p09_deskewed_volume", V + ", " + deskew_sql("dk", "voxels", W) + " SELECT * FROM dk")
def p09(spark, sf_dir):
    return rs.deskew(_v(spark, sf_dir), STEP, PIXEL, ANGLE, (W, H, D))


# A matrix that mixes all axes: turned about z and x, stretched along z.
MIXED = mx.product([mx.rotate("z", 12.0), mx.rotate("x", 20.0), mx.scale(1.0, 1.0, 1.3)])


def _affine_sql():
    moved, size = rs.bounding(MIXED, (W, H, D))
    i = np.linalg.inv(moved)
    at = [f"round({float(r[0])!r}e0 * x + {float(r[1])!r}e0 * y + {float(r[2])!r}e0 * z + {float(r[3])!r}e0, 9)".replace("e-", "E-") for r in i[:3]]
    at = [re.sub(r"(E-\d+)e0", r"\1", e) for e in at]
    return V + f""", o AS (SELECT t, c, z, y, x, {at[0]} AS px, {at[1]} AS py, {at[2]} AS pz FROM (SELECT DISTINCT t, c FROM voxels), (SELECT unnest(range({size[2]})) AS z), (SELECT unnest(range({size[1]})) AS y), (SELECT unnest(range({size[0]})) AS x))
    SELECT o.t, o.c, o.z, o.y, o.x, CAST(floor(coalesce(sum((1 - abs(px - s.x)) * (1 - abs(py - s.y)) * (1 - abs(pz - s.z)) * s.v), 0) + 0.5) AS BIGINT) AS v FROM o
    LEFT JOIN voxels s ON s.t = o.t AND s.c = o.c AND s.x IN (floor(px), floor(px) + 1) AND s.y IN (floor(py), floor(py) + 1) AND s.z IN (floor(pz), floor(pz) + 1)
      AND px BETWEEN 0 AND 9 AND py BETWEEN 0 AND 9 AND pz BETWEEN 0 AND 9 GROUP BY ALL"""


@query("p09_affine_volume", _affine_sql())
def p09b(spark, sf_dir):
    return rs.affine(_v(spark, sf_dir), MIXED, (W, H, D))


def _align_sql():
    a = np.array([TURN[:3], TURN[3:], [0, 0, 1]])
    i = np.linalg.inv(a)
    px = f"round({i[0, 0]!r}e0 * o.x + {i[0, 1]!r}e0 * o.y + {i[0, 2]!r}e0, 9)".replace("np.float64(", "").replace(")e0", "e0")
    py = f"round({i[1, 0]!r}e0 * o.x + {i[1, 1]!r}e0 * o.y + {i[1, 2]!r}e0, 9)".replace("np.float64(", "").replace(")e0", "e0")
    return V + f""", p AS (SELECT t, c, y, x, max(v) AS v FROM voxels GROUP BY ALL), o AS (SELECT *, {px} AS px, {py} AS py FROM p o)
    SELECT o.t, o.c, 0 AS z, o.y, o.x, CAST(floor(coalesce(sum((1 - abs(px - s.x)) * (1 - abs(py - s.y)) * s.v), 0) + 0.5) AS BIGINT) AS v
    FROM o LEFT JOIN p s ON s.t = o.t AND s.c = o.c AND abs(px - s.x) < 1 AND abs(py - s.y) < 1 AND px BETWEEN 0 AND 9 AND py BETWEEN 0 AND 9 GROUP BY ALL"""


@query("p17_aligned_voxels", _align_sql())
def p17(spark, sf_dir):
    flat = pj.projection(_v(spark, sf_dir), "z", "max").withColumn("z", F.lit(0).cast("long"))
    return rs.align_voxels(flat, TURN, W, H)


@query("p17_aligned_planes", _align_sql())
def p17b(spark, sf_dir):
    return vx.to_voxels(filters.per_plane(_planes(spark, sf_dir), rs.align_plane, TURN)).withColumn("v", F.col("v").cast("long"))


@query("p22_virtual_slice", V + ", " + deskew_sql("dk", "voxels", W) + " SELECT t, c, y, x, v FROM dk WHERE z = 2")
def p22(spark, sf_dir):
    return rs.virtual_slice(_v(spark, sf_dir), STEP, PIXEL, ANGLE, (W, H, D), 2)


@query("p29_median_filter", """WITH e AS (SELECT vec_id AS z, unnest(range(64)) AS pos, embedding FROM embeddings), v AS (SELECT z, pos // 8 AS y, pos % 8 AS x, CAST(embedding[pos + 1] AS DOUBLE) AS v FROM e),
    d AS (SELECT unnest([-1, -1, -1, 0, 0, 0, 1, 1, 1]) AS dy, unnest([-1, 0, 1, -1, 0, 1, -1, 0, 1]) AS dx)
    SELECT a.z, a.y, a.x, median(b.v) AS v FROM v a CROSS JOIN d JOIN v b ON b.z = a.z AND b.y = least(greatest(a.y + dy, 0), 7) AND b.x = least(greatest(a.x + dx, 0), 7) GROUP BY a.z, a.y, a.x""")
def p29(spark, sf_dir):
    out = filters.per_plane(_embedded(spark, sf_dir), filters.median_plane, 1)
    px = out.select("z", F.posexplode("px").alias("pos", "v"))
    return px.select("z", F.expr("pos div 8").alias("y"), F.expr("pos % 8").alias("x"), "v")


def _blur_sql(sigma: float, radius: int) -> str:
    k = f"(SELECT d, exp(-0.5 * (d / {sigma}e0) ** 2) / (SELECT sum(exp(-0.5 * (d / {sigma}e0) ** 2)) FROM (SELECT unnest(range({-radius}, {radius + 1})) AS d)) AS w FROM (SELECT unnest(range({-radius}, {radius + 1})) AS d))"
    return f"(SELECT a.z, a.y, a.x, sum(j.w * i.w * b.v) AS v FROM v a CROSS JOIN {k} j CROSS JOIN {k} i JOIN v b ON b.z = a.z AND b.y = least(greatest(a.y + j.d, 0), 7) AND b.x = least(greatest(a.x + i.d, 0), 7) GROUP BY ALL)"


@query("w08_difference_of_gaussians", f"""WITH v AS (SELECT vec_id AS z, pos // 8 AS y, pos % 8 AS x, CAST(embedding[pos + 1] AS DOUBLE) AS v FROM (SELECT vec_id, unnest(range(64)) AS pos, embedding FROM embeddings))
    SELECT z, CAST(y * 8 + x AS INTEGER) AS pos, round(one.v - two.v, 9) AS v FROM {_blur_sql(1.0, 3)} one JOIN {_blur_sql(1.6, 5)} two USING (z, y, x)""")
def w08b(spark, sf_dir):
    def dog(image):
        return filters.gaussian_plane(image, 1.0, 3) - filters.gaussian_plane(image, 1.6, 5)

    return filters.per_plane(_embedded(spark, sf_dir), dog).select("z", F.posexplode("px").alias("pos", "v")).withColumn("v", F.round("v", 9))


_CELLS = rs.covered_planes(STEP, PIXEL, ANGLE, (W, H, D), (1, 2), (6, 12))
_CELLS_SQL = ", ".join(f"({p}, {a}, {b})" for p, a, b in _CELLS)


@query("j10_covered_cells", V + f"SELECT t, c, z, y, x, v FROM voxels JOIN (VALUES {_CELLS_SQL}) k(p, a, b) ON z = p AND y BETWEEN a AND b")
def j10(spark, sf_dir):
    cells = spark.createDataFrame(_CELLS, "z long, first long, last long").withColumn("y", F.explode(F.sequence("first", "last")))
    return _v(spark, sf_dir).join(cells.select("z", "y"), ["z", "y"], "left_semi").select("t", "c", "z", "y", "x", "v")


# Pairs of bead images with a known map; an image counts here once it has its full number of beads.
IMAGES_SQL = "WITH i AS (SELECT p_partkey // 200 AS image FROM part GROUP BY 1 HAVING count(*) = 200) "


def bead_pairs(spark, sf_dir):
    """(channel 1, channel 2) bead images of the full groups."""
    full = views.table(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 200").alias("image")).count().filter("count = 200").select("image")
    return [views.bead_images(spark, sf_dir, full, c).drop("c") for c in (1, 2)]


@query("k08_robust_alignment", IMAGES_SQL + "SELECT image, true AS angle, image % 11 - 20 AS dx, 5 - image % 9 AS dy, true AS enough FROM i")
def k08(spark, sf_dir):
    fixed, moving = (al.detect(p, ["image"]) for p in bead_pairs(spark, sf_dir))
    near = fixed.select("image").distinct().withColumns({"dx": F.col("image") % 11 - 18, "dy": 3 - F.col("image") % 9})  # a start two pixels off
    fits = al.align_spots(fixed, moving, near, ["image"])
    near = F.abs(F.col("angle") - 0.05 * (F.col("image") % 7)) <= 0.06
    return fits.select("image", near.alias("angle"), F.round("dx").cast("long").alias("dx"), F.round("dy").cast("long").alias("dy"), ((F.col("pairs") >= 50) & (F.col("rms") < 0.5)).alias("enough"))


@query("k09_coarse_shifts", IMAGES_SQL + "SELECT image, true AS near FROM i")
def k09(spark, sf_dir):
    shifts = al.coarse_shifts(*bead_pairs(spark, sf_dir), ["image"])
    near = (F.abs(F.col("dx") - (F.col("image") % 11 - 20)) <= 4) & (F.abs(F.col("dy") - (5 - F.col("image") % 9)) <= 4)
    return shifts.select("image", near.alias("near"))


# Beads at least 9 pixels from any other of their channel; each must be found within a quarter of a pixel.
@query("k10_detected_spots", IMAGES_SQL + """, b AS (SELECT p_partkey // 200 AS image, p_partkey AS id, 30 + (CAST(p_partkey AS BIGINT) * p_partkey * 37 + 11 * p_partkey) % 196 + p_size / 100.0 AS x, 30 + (CAST(p_partkey AS BIGINT) * p_partkey * p_partkey % 1009 * 53 + 17 * p_partkey) % 196 + (p_partkey % 83) / 100.0 AS y FROM part WHERE (p_partkey + 4) % 9 <> 0 AND p_partkey // 200 IN (SELECT image FROM i))
    SELECT image, id, true AS found FROM b a WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.image = a.image AND o.id <> a.id AND (o.x - a.x) ** 2 + (o.y - a.y) ** 2 < 144)""")
def k10(spark, sf_dir):
    spots = al.detect(bead_pairs(spark, sf_dir)[0], ["image"])
    beads = views.table(spark, sf_dir, "part").filter("(p_partkey + 4) % 9 <> 0").select(
        F.expr("p_partkey div 200").alias("image"), F.col("p_partkey").alias("id"), F.expr(f"30 + {views.BEAD_X} + p_size / 100.0D").alias("x"), F.expr(f"30 + {views.BEAD_Y} + (p_partkey % 83) / 100.0D").alias("y")
    ).join(spots.select("image").distinct(), "image")
    crowd = pt.close_pairs(beads, beads, {"x": 12.0, "y": 12.0}, (F.col("a_id") != F.col("b_id")) & ((F.col("a_x") - F.col("b_x")) ** 2 + (F.col("a_y") - F.col("b_y")) ** 2 < 144), ("image",))
    alone = beads.join(crowd.select(F.col("a_id").alias("id")).distinct(), "id", "left_anti")
    hit = pt.close_pairs(alone, spots.select("image", "x", "y"), {"x": 1.0, "y": 1.0}, F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")) < 0.25, ("image",))
    return alone.join(hit.select(F.col("a_id").alias("id"), F.lit(True).alias("found")).distinct(), "id", "left").select("image", "id", F.coalesce("found", F.lit(False)).alias("found"))


# The coarse shift of image 5 is unknown here: the vote takes over. Implausible fits give the identity.
@query("k11_chosen_alignment", IMAGES_SQL + "SELECT image, CASE WHEN image % 4 = 2 THEN 'none' ELSE 'beads' END AS method, CASE WHEN image % 4 = 2 THEN 0 ELSE image % 11 - 20 END AS m02, CASE WHEN image % 4 = 2 THEN 0 ELSE 5 - image % 9 END AS m12 FROM i")
def k11(spark, sf_dir):
    fixed, moving = (al.detect(p, ["image"]) for p in bead_pairs(spark, sf_dir))
    start = fixed.select("image").distinct().filter("image <> 5").withColumns({"dx": F.col("image") % 11 - 20, "dy": 5 - F.col("image") % 9})
    fits = al.align_spots(fixed, moving, start, ["image"])
    turned = fits.withColumn("angle", F.when(F.col("image") % 4 == 2, 5.0).otherwise(F.col("angle")))  # no channel is turned by five degrees
    return al.chosen(turned, ["image"]).select("image", "method", F.round("m02").cast("long").alias("m02"), F.round("m12").cast("long").alias("m12"))


def _deconvolution_sql(rounds: int) -> str:
    """Tiles of 7 x 6 x 6 voxels (a core of 5 x 5 x 5 and its halo) as cells, the circular kernel as a table of pairs of cells, two joins a round."""
    steps = "".join(f""", b{k} AS MATERIALIZED (SELECT t, c, tile, i, sum(w * v) AS b FROM e{k} JOIN nb ON j = cell GROUP BY t, c, tile, i),
      g{k} AS MATERIALIZED (SELECT b.t, b.c, b.tile, j, sum(w * (u.v / greatest(b, 1e-6))) AS g FROM b{k} b JOIN u ON u.t = b.t AND u.c = b.c AND u.tile = b.tile AND u.cell = b.i JOIN nb ON nb.i = b.i GROUP BY b.t, b.c, b.tile, j),
      e{k + 1} AS MATERIALIZED (SELECT e.t, e.c, e.tile, e.cell, greatest(e.v * g, 0) AS v FROM e{k} e JOIN g{k} g ON g.t = e.t AND g.c = e.c AND g.tile = e.tile AND g.j = e.cell)""" for k in range(rounds))
    return V + f""", d AS (SELECT unnest(range(-2, 3)) AS dz), e AS (SELECT unnest(range(-1, 2)) AS dy), f AS (SELECT unnest(range(-1, 2)) AS dx), psf AS (SELECT dz, dy, dx, exp(-0.5e0 * (dz * dz + dy * dy + dx * dx)) AS w FROM d, e, f),
      nb AS MATERIALIZED (SELECT (z * 6 + y) * 6 + x AS i, ((z - dz + 7) % 7 * 6 + (y - dy + 6) % 6) * 6 + (x - dx + 6) % 6 AS j, w / (SELECT sum(w) FROM psf) AS w FROM psf, (SELECT unnest(range(7)) AS z), (SELECT unnest(range(6)) AS y), (SELECT unnest(range(6)) AS x)),
      o AS (SELECT az * 4 + ay * 2 + ax AS tile, az * 3 AS z0, ay * 4 AS y0, ax * 4 AS x0, az, ay, ax FROM (SELECT unnest([0, 1]) AS az), (SELECT unnest([0, 1]) AS ay), (SELECT unnest([0, 1]) AS ax)),
      u AS MATERIALIZED (SELECT t, c, tile, ((z - z0) * 6 + y - y0) * 6 + x - x0 AS cell, CAST(v AS DOUBLE) AS v FROM voxels JOIN o ON z BETWEEN z0 AND z0 + 6 AND y BETWEEN y0 AND y0 + 5 AND x BETWEEN x0 AND x0 + 5),
      e0 AS MATERIALIZED (SELECT t, c, tile, cell, greatest(avg(v) OVER (PARTITION BY t, c, tile), 1e-6) AS v FROM u){steps},
      r AS (SELECT t, c, z0 + cell // 36 AS z, y0 + cell // 6 % 6 AS y, x0 + cell % 6 AS x, az, ay, ax, v FROM e{rounds} JOIN o USING (tile))
    SELECT t, c, z, y, x, round(v, 2) AS v FROM r WHERE z // 5 = az AND y // 5 = ay AND x // 5 = ax"""


@query("k12_tiled_deconvolution", _deconvolution_sql(5))
def k12(spark, sf_dir):
    return kernels.deconvolve(_v(spark, sf_dir), PSF, (W, H, D), (5, 5, 5), rounds=5).withColumn("v", F.round("v", 2))


# Pixels of the mean projection over the threshold, joined to all they reach by their four neighbours; of components of equal size the first one in row order.
@query("k14_sample_region", V.replace("WITH ", "WITH RECURSIVE ", 1) + """, m AS (SELECT t, c, y, x FROM voxels GROUP BY ALL HAVING least((sum(v) + count(*) // 2) // count(*), 65535) > 3500),
  r AS (SELECT t, c, y, x, y * 10 + x AS root FROM m UNION SELECT m.t, m.c, m.y, m.x, r.root FROM r JOIN m ON m.t = r.t AND m.c = r.c AND abs(m.y - r.y) + abs(m.x - r.x) = 1),
  l AS (SELECT t, c, y, x, min(root) AS part FROM r GROUP BY t, c, y, x), b AS (SELECT t, c, part, count(*) AS n, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM l GROUP BY t, c, part)
  SELECT t, c, 0 AS z, x, y, w, h, count(*) OVER (PARTITION BY t, c) AS parts FROM b QUALIFY row_number() OVER (PARTITION BY t, c ORDER BY n DESC, part) = 1""")
def k14(spark, sf_dir):
    return kernels.sample_region(_planes(spark, sf_dir, "mean"), 3500.0)


# A peak stays if the ground within the tolerance below it, as far as it goes on, holds nothing that ranks before it; the highest one must stand that far over the lowest pixel.
@query("t06_prominent_maxima", V.replace("WITH ", "WITH RECURSIVE ", 1) + """, p AS (SELECT t, c, y, x, y * 10 + x AS i, max(v) AS v, arg_max(z, v * 100 + (10 - z)) AS z FROM voxels GROUP BY t, c, y, x),
  k AS (SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.t = a.t AND b.c = a.c AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND (b.v > a.v OR (b.v = a.v AND b.i < a.i)))),
  f AS (SELECT t, c, i AS peak, v AS top, y, x FROM k UNION SELECT f.t, f.c, peak, top, p.y, p.x FROM f JOIN p ON p.t = f.t AND p.c = f.c AND abs(p.y - f.y) <= 1 AND abs(p.x - f.x) <= 1 AND p.v > top - 2000),
  l AS (SELECT DISTINCT f.t, f.c, peak FROM f JOIN p ON p.t = f.t AND p.c = f.c AND p.y = f.y AND p.x = f.x WHERE p.v > top OR (p.v = top AND p.i < peak)), m AS (SELECT t, c, min(v) AS low FROM p GROUP BY t, c)
  SELECT k.t, k.c, k.y, k.x, CAST(k.v AS DOUBLE) AS v, CASE WHEN k.v > 0 THEN k.z END AS z FROM k JOIN m USING (t, c) WHERE k.v - low >= 2000 AND NOT EXISTS (SELECT 1 FROM l WHERE l.t = k.t AND l.c = k.c AND l.peak = k.i)""")
def t06(spark, sf_dir):
    peaks = kernels.maxima(_planes(spark, sf_dir), tolerance=2000.0)
    return peaks.join(pt.first_maximum_z(_v(spark, sf_dir)), ["t", "c", "y", "x"])


# The height of each peak over its saddle: of all ways to a pixel that ranks before it, the one whose lowest pixel is highest. Then the bisection over those heights.
@query("t07_wanted_maxima", V.replace("WITH ", "WITH RECURSIVE ", 1) + """, p AS (SELECT t, c, y, x, y * 10 + x AS i, max(v) AS v FROM voxels GROUP BY t, c, y, x),
  k AS (SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.t = a.t AND b.c = a.c AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND (b.v > a.v OR (b.v = a.v AND b.i < a.i)))),
  w AS (SELECT t, c, i AS peak, v AS top, y, x, v AS low FROM k UNION SELECT w.t, w.c, peak, top, p.y, p.x, least(low, p.v) FROM w JOIN p ON p.t = w.t AND p.c = w.c AND abs(p.y - w.y) <= 1 AND abs(p.x - w.x) <= 1),
  h AS (SELECT w.t, w.c, peak, any_value(top) AS top, max(low) FILTER (p.v > top OR (p.v = top AND p.i < peak)) AS saddle, min(p.v) AS least_ FROM w JOIN p ON p.t = w.t AND p.c = w.c AND p.y = w.y AND p.x = w.x GROUP BY w.t, w.c, peak),
  q AS (SELECT t, c, peak, CAST(top - coalesce(saddle, least_) AS DOUBLE) AS height FROM h), l AS (SELECT q.t, q.c, list(height) AS heights, any_value(span) AS span FROM q JOIN (SELECT t, c, CAST(max(v) - min(v) AS DOUBLE) AS span FROM p GROUP BY t, c) USING (t, c) GROUP BY q.t, q.c),
  s AS (SELECT t, c, heights, 0 AS step, 0.0e0 AS lo, span AS hi, span AS best, len(list_filter(heights, lambda a: a >= span)) AS n, false AS done FROM l
    UNION ALL SELECT t, c, heights, step + 1, CASE WHEN m > 8 THEN mid ELSE lo END, CASE WHEN m > 8 THEN hi ELSE mid END, CASE WHEN abs(m - 8) <= 1 OR abs(m - 8) < abs(n - 8) THEN mid ELSE best END, CASE WHEN abs(m - 8) < abs(n - 8) THEN m ELSE n END, abs(m - 8) <= 1
    FROM (SELECT *, len(list_filter(heights, lambda a: a >= mid)) AS m FROM (SELECT *, (lo + hi) / 2 AS mid FROM s WHERE NOT done AND step < 10))),
  z AS (SELECT t, c, best FROM s QUALIFY row_number() OVER (PARTITION BY t, c ORDER BY step DESC) = 1)
  SELECT k.t, k.c, k.y, k.x, CAST(k.v AS DOUBLE) AS v FROM k JOIN q ON q.t = k.t AND q.c = k.c AND q.peak = k.i JOIN z ON z.t = k.t AND z.c = k.c WHERE height >= best""")
def t07(spark, sf_dir):
    return kernels.maxima(_planes(spark, sf_dir), wanted=8)
