"""Queries of row-wise voxel geometry."""

from pyspark.sql import functions as F

from lamella.operators import voxels as vx
from lamella.plans import views
from lamella.plans.registry import query

W = H = D = 10
V = f"WITH {views.VOXELS} "
ALL = "t, c, z, y, x, v"


def _v(spark, sf_dir):
    return views.voxels(spark, sf_dir)


@query("p01_region", V + "SELECT t, c, z - 1 AS z, y - 2 AS y, x - 3 AS x, v FROM voxels WHERE x BETWEEN 3 AND 9 AND y BETWEEN 2 AND 5 AND z BETWEEN 1 AND 6")
def p01(spark, sf_dir):
    return vx.region(_v(spark, sf_dir), vx.clamp_box(3, 2, 20, 4, 1, 6, W, H, D))


@query("p02_right_half", V + "SELECT t, c, z, y, x - 5 AS x, v FROM voxels WHERE x >= 5")
def p02(spark, sf_dir):
    return vx.split_half(_v(spark, sf_dir), W, "right")


@query(
    "p03_channel_parts",
    V + """SELECT t, c, z, y, CASE WHEN x >= 5 THEN 9 - x ELSE x END AS x, v, CASE WHEN x >= 5 THEN 'right' ELSE 'left' END AS part FROM voxels""",
)
def p03(spark, sf_dir):
    return vx.channel_parts(_v(spark, sf_dir), W, "fold")


@query("p04_flip_z", V + "SELECT t, c, 9 - z AS z, y, x, v FROM voxels")
def p04(spark, sf_dir):
    return vx.flip(_v(spark, sf_dir), "z", D)


@query("p05_fold_x", V + "SELECT t, CASE WHEN x >= 5 THEN 2 ELSE 1 END AS c, z, y, CASE WHEN x >= 5 THEN 9 - x ELSE x END AS x, v FROM voxels WHERE c = 1")
def p05(spark, sf_dir):
    return vx.fold_x(_v(spark, sf_dir).filter("c = 1"), W)


@query("p06_permute_zxy", V + "SELECT t, c, z AS x, x AS y, y AS z, v FROM voxels")
def p06(spark, sf_dir):
    return vx.permute(_v(spark, sf_dir), "zxy")


@query(
    "p07_scale_z",
    V + """, lines AS (SELECT t, c, y, x, list(v ORDER BY z) AS l FROM voxels GROUP BY ALL),
    fed AS (SELECT *, unnest(range(19)) AS z FROM lines)
    SELECT t, c, z, y, x, round(l[z // 2 + 1] * (1 - (z % 2) * 0.5) + coalesce(l[z // 2 + 2], 0) * (z % 2) * 0.5, 6) AS v FROM fed""",
)
def p07(spark, sf_dir):
    return vx.scale(_v(spark, sf_dir), {"z": (10, 19)}).withColumn("v", F.round("v", 6))


@query(
    "p08_pad_or_crop",
    V + """SELECT t, c, z, y, x, coalesce(v, 0) AS v FROM
    (SELECT * FROM (SELECT DISTINCT t, c FROM voxels), (SELECT unnest(range(8)) AS z), (SELECT unnest(range(12)) AS y), (SELECT unnest(range(11)) AS x))
    LEFT JOIN voxels USING (t, c, z, y, x)""",
)
def p08(spark, sf_dir):
    return vx.pad_or_crop(_v(spark, sf_dir), {"x": W, "y": H, "z": D}, {"x": 11, "y": 12, "z": 8})


@query("p19_decimate", V + "SELECT t, c, (z - 1) // 3 AS z, y, x, v FROM voxels WHERE z >= 1 AND (z - 1) % 3 = 0")
def p19(spark, sf_dir):
    return vx.decimate(_v(spark, sf_dir), 3, 1)


@query(
    "p20_interpolate_scan",
    V + """, n AS (SELECT *, lead(v) OVER (PARTITION BY t, c, y, x ORDER BY z) AS w FROM voxels)
    SELECT t, c, z * 3 + k AS z, y, x, v + coalesce(w - v, 0) * (k / 3.0) AS v
    FROM n, (SELECT unnest(range(3)) AS k) WHERE w IS NOT NULL OR k = 0""",
)
def p20(spark, sf_dir):
    return vx.interpolate_z(_v(spark, sf_dir), 3)


@query(
    "p21_zero_extended_sample",
    V + """, k AS (SELECT a, b, d, (CASE WHEN a = 1 THEN 0.25 ELSE 0.75 END) * (CASE WHEN b = 1 THEN 0.5 ELSE 0.5 END) * (CASE WHEN d = 1 THEN 0.75 ELSE 0.25 END) AS w
      FROM (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1]) AS d))
    SELECT t, c, z, y, x, round(sum(v), 6) AS v FROM (SELECT t, c, z - a AS z, y - b AS y, x - d AS x, v * w AS v FROM voxels, k)
    WHERE z >= 0 AND y >= 0 AND x >= 0 GROUP BY ALL""",
)
def p21(spark, sf_dir):
    return vx.zero_extended(_v(spark, sf_dir), 0.25, 0.5, 0.75).withColumn("v", F.round("v", 6))


@query("p23_select_channel", V + "SELECT t, z, y, x, v, 0 AS slot FROM voxels WHERE c = 2 UNION ALL SELECT t, z, y, x, v, 1 FROM voxels WHERE c = 1")
def p23(spark, sf_dir):
    order = F.create_map(F.lit(2), F.lit(0), F.lit(1), F.lit(1))
    return _v(spark, sf_dir).withColumn("slot", order[F.col("c").cast("int")]).filter("slot IS NOT NULL").drop("c")


@query(
    "p24_slot_problems",
    """WITH s AS (SELECT 1 + o_orderkey % 50 AS selection, 1 + (o_orderkey // 5) % 4 AS channel, o_orderstatus AS side FROM orders)
    SELECT selection, count(*) AS slots, max(CASE WHEN side <> 'P' THEN channel END) AS required,
      CASE WHEN count(CASE WHEN side <> 'P' THEN 1 END) = 0 THEN 'empty'
           WHEN bool_or(side = 'F') AND bool_or(side = 'O') THEN 'mixed widths' END AS problem
    FROM s GROUP BY selection""",
)
def p24(spark, sf_dir):
    from lamella.operators.catalogue import slot_problems

    orders = views.table(spark, sf_dir, "orders")
    slots = orders.select(
        F.expr("1 + o_orderkey % 50").alias("selection"), F.expr("1 + (o_orderkey div 5) % 4").alias("channel"),
        F.expr("CASE o_orderstatus WHEN 'P' THEN 'skip' WHEN 'F' THEN 'whole' ELSE 'left' END").alias("side"),
    )
    return slot_problems(slots)


@query("p25_side_by_side", V + "SELECT t, c, z, y, x, v FROM voxels WHERE x < 5 UNION ALL SELECT t, c, z, y, 9 - x + 5, v FROM voxels WHERE x >= 5")
def p25(spark, sf_dir):
    v = _v(spark, sf_dir)
    right = vx.flip(vx.split_half(v, W, "right"), "x", 5)
    return vx.side_by_side(vx.split_half(v, W, "left"), right, 5)


@query("p26_reassign_axes", V + "SELECT t AS z, c, z AS t, y, x, v FROM voxels")
def p26(spark, sf_dir):
    return vx.reassign(_v(spark, sf_dir), {"z": "t", "t": "z"})


@query("p27_split_and_rebuild", V + f"SELECT {ALL} FROM voxels")
def p27(spark, sf_dir):
    return vx.to_voxels(vx.to_planes(_v(spark, sf_dir), W, H))


@query("p28_dispatch", V + "SELECT t, c, z, 9 - x AS y, y AS x, v FROM voxels")
def p28(spark, sf_dir):
    from lamella.operators.dispatch import apply_named

    return apply_named(_v(spark, sf_dir), [("permute", {"order": "yxz"}), ("flip", {"axis": "y", "extent": W})])


@query("p30_calibrate", V + "SELECT t, c, z, y, x, v, x * 0.116 AS x_um, y * 0.116 AS y_um, round(z * 0.265 * sin(radians(25.0)), 6) AS z_um, t * 2.5 AS seconds FROM voxels")
def p30(spark, sf_dir):
    from lamella.operators.dispatch import calibrated

    return calibrated(_v(spark, sf_dir), 0.116, 0.265, 25.0, 2.5)


@query("h15_plane_index", V + "SELECT DISTINCT t, c, z, (t * 10 + z) * 2 + c - 1 AS plane, true AS inverse FROM voxels")
def h15(spark, sf_dir):
    planes = _v(spark, sf_dir).select("t", "c", "z").distinct()
    planes = planes.withColumn("plane", vx.plane_index(F.col("t"), F.col("z"), F.col("c") - 1, D, 2))
    back = vx.plane_position(F.col("plane"), D, 2)
    return planes.withColumn("inverse", (back["t"] == F.col("t")) & (back["z"] == F.col("z")) & (back["c"] == F.col("c") - 1))


@query("u03_partition_and_join", V + "SELECT t, c, z, y, CASE WHEN x < 4 THEN x + 6 WHEN x < 8 THEN x - 2 ELSE x - 8 END AS x, v FROM voxels")
def u03(spark, sf_dir):
    parts = vx.split_axis(_v(spark, sf_dir), "x", W, 3)
    return vx.concatenate([parts.filter(F.col("part") == k).drop("part") for k in range(3)], "x", [4, 4, 2], backwards=True)


@query("u01_append_movie", V + "SELECT t, c, z, y, x, v FROM voxels UNION ALL SELECT t + 100, c, z, y, x, v FROM voxels WHERE y < 7 UNION ALL SELECT DISTINCT t + 100, c, z, u, x, 0 FROM voxels, (SELECT unnest(range(7, 10)) AS u)")
def u01(spark, sf_dir):
    from lamella.operators.dispatch import append_movie

    v = _v(spark, sf_dir)
    return append_movie(v, (W, H, D), v.filter("y < 7"), (W, 7, D), shift=100)
