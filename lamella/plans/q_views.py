"""Queries of views of stores with camera halves, in the coordinates of the image they produce, and of channel operations."""

import numpy as np
from pyspark.sql import functions as F

from lamella.operators import pipelines as pl, stored_views as sv
from lamella.operators.project import six_projections
from lamella.plans import views
from lamella.plans.q_sources import _store
from lamella.plans.registry import query
from lamella.sources import ome_zarr

HALF, HEIGHT = 5, 10
LABELS = ["_Channel0001-left", "_Channel0001-right", "_Channel0002-left", "_Channel0002-right"]
RIGHT = (0.998, -0.06, 0.4, 0.06, 0.998, -0.3)  # right halves, mirrored, onto left ones
TAGGED = {"_Channel0001-left": (1.0, 0, 0, 0, 1, 0), "_Channel0001-right": RIGHT, "_Channel0002-left": (1.0, 0, 0.5, 0, 1, -0.5), "_Channel0002-right": (0.999, 0.02, -0.6, -0.02, 0.999, 0.2)}
BOX, WIDE = (1, 3, 2, 8, 2, 6), (3, 7, 2, 8, 2, 6)
TIMES = (1, 3)
HALVES = f"""WITH {views.VOXELS}, s AS (SELECT t, 2 * (c - 1) + CASE WHEN x < 5 THEN 0 ELSE 1 END AS c, z, y, CASE WHEN x < 5 THEN x ELSE x - 5 END AS x, v FROM voxels) """


def _halves(spark, sf_dir):
    return pl.canonical_halves(views.voxels(spark, sf_dir), 2 * HALF)


def _opened(spark, sf_dir):
    """Opens the voxels of a store of halves."""
    root = _store(spark, sf_dir, _halves(spark, sf_dir), chunk=4)
    return lambda: ome_zarr.voxels(spark, root)


def _one_sql(slot: int, source: int, flip: bool, matrix, box=None) -> str:
    """One channel of a view over the whole planes of its store, then cut to the box."""
    x = "4 - x" if flip else "x"
    inside = f"WHERE x BETWEEN {box[0]} AND {box[1]} AND y BETWEEN {box[2]} AND {box[3]} AND z BETWEEN {box[4]} AND {box[5]}" if box else ""
    if matrix is None:
        return f"SELECT * FROM (SELECT t, {slot} AS c, z, y, {x} AS x, v FROM s WHERE c = {source}) {inside}"
    i = np.linalg.inv(np.array([matrix[:3], matrix[3:], (0, 0, 1)], float))
    px, py = (f"round({float(r[0])!r} * o.x + {float(r[1])!r} * o.y + {float(r[2])!r}, 9)".replace("e-", "E-") for r in i[:2])
    return f"""SELECT * FROM (SELECT o.t, {slot} AS c, o.z, o.y, o.x, CAST(floor(coalesce(sum((1 - abs(o.px - p.x)) * (1 - abs(o.py - p.y)) * p.v), 0) + 0.5) AS BIGINT) AS v FROM (SELECT t, z, y, x, CAST({px} AS DOUBLE) AS px, CAST({py} AS DOUBLE) AS py FROM s o WHERE c = {source}) o
      LEFT JOIN (SELECT t, z, y, {x} AS x, v FROM s WHERE c = {source}) p ON p.t = o.t AND p.z = o.z AND abs(o.px - p.x) < 1 AND abs(o.py - p.y) < 1 AND o.px BETWEEN 0 AND 4 AND o.py BETWEEN 0 AND 9 GROUP BY o.t, o.z, o.y, o.x) {inside}"""


def _cut(sql: str, box) -> str:
    return f"SELECT t, c, z - {box[4]} AS z, y - {box[2]} AS y, x - {box[0]} AS x, v FROM ({sql}) WHERE t BETWEEN {TIMES[0]} AND {TIMES[1]}"


def _view(name: str, operation: str, chosen: list[int], parts: list[tuple], box=BOX, **options):
    sql = HALVES + _cut(" UNION ALL ".join(_one_sql(*p, box) for p in parts), box)

    @query(name, sql)
    def run(spark, sf_dir):
        channels = sv.outputs(spark, LABELS, chosen, operation, HALF, **options)
        return sv.stored_view(_opened(spark, sf_dir), channels, HALF, HEIGHT, box, TIMES)


LEFT = sv.seen_from_left(RIGHT, HALF)
_view("x11_view_stored", "stored", [3, 0], [(0, 3, False, None), (1, 0, False, None)])
_view("x11_view_flip", "flip", [0, 1], [(0, 0, True, None), (1, 1, False, None)], flip_side="left")
_view("x11_view_flip_align_right", "flip_align_right", [0, 1, 3], [(0, 0, False, None), (1, 1, True, RIGHT), (2, 3, True, RIGHT)], matrix=RIGHT)
_view("x11_view_flip_align_left", "flip_align_left", [0, 1], [(0, 0, True, LEFT), (1, 1, False, None)], matrix=RIGHT)
_view(
    "x11_view_tagged_right", "flip_align_right", [0, 1, 2, 3], [(0, 0, False, None), (1, 1, True, RIGHT), (2, 2, False, TAGGED[LABELS[2]]), (3, 3, True, TAGGED[LABELS[3]])], tagged=TAGGED, reference=LABELS[0],
)


# Both halves of an acquisition channel, of which one was asked for; the box lies across the seam.
@query("x11_view_side_by_side", HALVES + _cut("SELECT * FROM (SELECT t, c // 2 AS c, z, y, x + 5 * (c % 2) AS x, v FROM s) WHERE x BETWEEN 3 AND 7 AND y BETWEEN 2 AND 8 AND z BETWEEN 2 AND 6", WIDE))
def x11_side_by_side(spark, sf_dir):
    channels = sv.outputs(spark, LABELS, [1, 2], "side_by_side", HALF)
    return sv.stored_view(_opened(spark, sf_dir), channels, HALF, HEIGHT, WIDE, TIMES)


ALIGNED = " UNION ALL ".join(_one_sql(slot, source, flip, m) for slot, source, flip, m in [(0, 0, False, None), (1, 1, True, RIGHT)])


def _operated(spark):
    return sv.outputs(spark, LABELS, [0, 1], "flip_align_right", HALF, matrix=RIGHT)


@query("x06_recomputed_projections", HALVES + f""", a AS ({ALIGNED}) SELECT t, c, 'X' AS view, y AS h, z AS w, max(v) AS max_v, least((sum(v) + count(*) // 2) // count(*), 65535) AS mean_v FROM a GROUP BY t, c, y, z
    UNION ALL SELECT t, c, 'Y', z, x, max(v), least((sum(v) + count(*) // 2) // count(*), 65535) FROM a GROUP BY t, c, x, z UNION ALL SELECT t, c, 'Z', y, x, max(v), least((sum(v) + count(*) // 2) // count(*), 65535) FROM a GROUP BY t, c, x, y""")
def x06b(spark, sf_dir):
    halves = _halves(spark, sf_dir).withColumn("c", F.col("c") - 1)
    return sv.channel_operation(halves, _operated(spark), HALF, HEIGHT)[1]


FLAT = HALVES + ", z AS (SELECT t, c, 0 AS z, y, x, max(v) AS v FROM s GROUP BY ALL) "


@query("x06_without_volume", FLAT + "SELECT 'maxZ' AS view, t, c, y AS h, x AS w, v FROM (" + ALIGNED.replace("FROM s ", "FROM z ") + ")")
def x06c(spark, sf_dir):
    """Results of which only projections are there: those along Z are operated, the others left out."""
    six = six_projections(_halves(spark, sf_dir).withColumn("c", F.col("c") - 1))
    pixels = six.select(F.concat(F.lit("max"), F.col("view")).alias("view"), "t", "c", "h", "w", F.col("max_v").alias("v"))
    return sv.operated_projections(pixels, _operated(spark), HALF, HEIGHT)
