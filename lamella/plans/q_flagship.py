"""Flagship query: fused deskew and max projection."""

import math

from lamella.operators.deskew import deskewed_max, deskewed_max_of_sides
from lamella.plans import views
from lamella.plans.registry import query

PIXEL, STEP, ANGLE, DEPTH = 0.116, 0.265, 25.0, 10


@query(
    "a06_deskewed_max",
    f"""WITH {views.VOXELS}
    SELECT t, c, CAST(floor({math.cos(math.radians(ANGLE))!r} * y + {STEP / PIXEL!r} * z + 0.5) AS INTEGER) AS y_out, x,
           max(v) AS v
    FROM voxels GROUP BY ALL""",
)
def a06(spark, sf_dir):
    return deskewed_max(views.voxels(spark, sf_dir), ["t", "c"], PIXEL, STEP, ANGLE, DEPTH)


ROW = f"CAST(floor({math.cos(math.radians(ANGLE))!r} * y + {STEP / PIXEL!r} * z + 0.5) AS INTEGER) AS y_out"


# Nine of the ten columns, so that the halves share the middle one.
@query(
    "a06_deskewed_max_sides",
    f"""WITH {views.VOXELS}, s AS (SELECT t, c, 'whole' AS side, {ROW}, x, v FROM voxels WHERE x < 9 UNION ALL SELECT t, c, 'left', {ROW}, x, v FROM voxels WHERE x < 5
      UNION ALL SELECT t, c, 'right', {ROW}, 8 - x, v FROM voxels WHERE x BETWEEN 4 AND 8)
    SELECT t, c, side, y_out, x, max(v) AS v FROM s GROUP BY ALL""",
)
def a06_sides(spark, sf_dir):
    return deskewed_max_of_sides(views.voxels(spark, sf_dir).filter("x < 9"), ["t", "c"], PIXEL, STEP, ANGLE, 9, DEPTH)
