"""Queries of screen slices through raw scans and of the raw cells they cover."""

import numpy as np
from pyspark.sql import functions as F

from lamella.functions import matrix as mx
from lamella.operators import slices as sl
from lamella.plans import views
from lamella.plans.registry import query

W = H = D = 10
STEP, PIXEL, ANGLE = 0.265, 0.116, 25.0
V = f"WITH {views.VOXELS} "
DESKEW = mx.deskew(STEP, PIXEL, ANGLE, H)
# The whole camera image; and its halves, the right one mirrored and aligned to the left.
WHOLE = sl.Part("whole", 0, W, sl.to_world(DESKEW, W))
LEFT = sl.Part("left", 0, W // 2, sl.to_world(DESKEW, W // 2))
RIGHT = sl.Part("right", W // 2, W // 2, sl.to_world(DESKEW, W // 2, mirror=True, alignment=[0.999, -0.03, 0.4, 0.03, 0.999, -0.3]))
TILTED = sl.facing("z", 2.5) @ mx.rotate("x", 20.0) @ mx.rotate("y", -15.0) @ mx.translate(1.0, -3.0, 0.5)
SCREEN = (14, 24)


def _v(spark, sf_dir):
    return views.voxels(spark, sf_dir)


def _places(part: sl.Part) -> list[str]:
    inverse = np.linalg.inv(part.to_screen)
    return [f"round({float(r[0])!r} * u + {float(r[1])!r} * v + {float(r[3])!r}, 9)".replace("e-", "E-") for r in inverse[:3]]


def _pixels(part: sl.Part) -> str:
    x, y, z = _places(part)
    return f"SELECT '{part.name}' AS part, {part.first} AS first, {part.width} AS width, u, v, CAST({x} AS DOUBLE) AS px, CAST({y} AS DOUBLE) AS py, CAST({z} AS DOUBLE) AS pz FROM (SELECT unnest(range({SCREEN[0]})) AS u), (SELECT unnest(range({SCREEN[1]})) AS v)"


def slice_sql(parts: list[sl.Part], linear: bool = True) -> str:
    """Every pixel over the whole raw volume, by the weights of the voxels around its place."""
    near = "abs(px - (s.x - first)) < 1 AND abs(py - s.y) < 1 AND abs(pz - s.z) < 1" if linear else "s.x - first = floor(px + 0.5) AND s.y = floor(py + 0.5) AND s.z = floor(pz + 0.5)"
    weight = "(1 - abs(px - (s.x - first))) * (1 - abs(py - s.y)) * (1 - abs(pz - s.z))" if linear else "1"
    return V + ", p AS (" + " UNION ALL ".join(map(_pixels, parts)) + f"""), m AS (SELECT s.t, s.c, part, u, p.v, sum({weight} * s.v) AS value FROM p JOIN voxels s ON s.x BETWEEN first AND first + width - 1 AND {near} GROUP BY ALL),
    r AS (SELECT d.t, d.c, p.part, p.u, p.v, CAST(floor(least(greatest(coalesce(value, 0), 0), 65535) + 0.5) AS BIGINT) AS value FROM p CROSS JOIN (SELECT DISTINCT t, c FROM voxels) d LEFT JOIN m ON m.t = d.t AND m.c = d.c AND m.part = p.part AND m.u = p.u AND m.v = p.v)"""


def _registered(name: str, parts: list[sl.Part], linear: bool = True):
    @query(name, slice_sql(parts, linear) + " SELECT * FROM r")
    def run(spark, sf_dir):
        return sl.screen_slice(_v(spark, sf_dir), parts, (W, H, D), SCREEN, rows_per_strip=4, linear=linear)


_registered("p22_slice_xy", [sl.seen(WHOLE, sl.facing("z", 2.0))])
_registered("p22_slice_xz", [sl.seen(WHOLE, sl.facing("y", 9.5))])
_registered("p22_slice_yz", [sl.seen(WHOLE, sl.facing("x", 4.0))])
OBLIQUE = [sl.seen(LEFT, TILTED), sl.seen(RIGHT, TILTED)]
_registered("p22_slice_oblique_parts", OBLIQUE)
_registered("p22_slice_oblique_nearest", OBLIQUE, False)


@query("p22_slice_composed", slice_sql(OBLIQUE) + " SELECT t, u, v, CAST(least(sum(value), 65535) AS BIGINT) AS value FROM r GROUP BY t, u, v")
def p22_composed(spark, sf_dir):
    return sl.composed(sl.screen_slice(_v(spark, sf_dir), OBLIQUE, (W, H, D), SCREEN, rows_per_strip=4))


# Cells by the pixels themselves: each strip with a row that some pixel touches.
@query("j10_cells_of_a_slice", V + ", p AS (" + " UNION ALL ".join(map(_pixels, OBLIQUE)) + """), k AS (SELECT DISTINCT s.z AS plane, s.y // 4 AS strip FROM p JOIN (SELECT DISTINCT x, y, z FROM voxels) s
    ON s.x BETWEEN first AND first + width - 1 AND abs(px - (s.x - first)) < 1 AND abs(py - s.y) < 1 AND abs(pz - s.z) < 1)
    SELECT t, c, plane, strip, sum(v) AS total FROM voxels JOIN k ON z = plane AND y // 4 = strip GROUP BY ALL""")
def j10b(spark, sf_dir):
    v = _v(spark, sf_dir)
    cells = sl.covered_cells(spark, OBLIQUE, (W, H, D), SCREEN, rows_per_strip=4)
    near = sl.read_cells(v, cells, rows_per_strip=4)
    return near.groupBy("t", "c", F.col("z").alias("plane"), F.expr("y div 4").alias("strip")).agg(F.sum("v").alias("total"))
