"""Screen slices against plain sampling, cells against every pixel of random screens."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.functions import matrix as mx
from lamella.operators import slices as sl

W, H, D = 9, 7, 6
DESKEW = mx.deskew(0.3, 0.15, 30.0, H)


def random_view(rng):
    turn = mx.rotate("x", rng.uniform(-90, 90)) @ mx.rotate("y", rng.uniform(-90, 90)) @ mx.rotate("z", rng.uniform(-180, 180))
    return mx.translate(*rng.uniform(0, 12, 3)) @ turn @ mx.scale(*rng.uniform(0.5, 1.6, 3)) @ mx.translate(-4, -6, -2)


def parts(rng):
    view = random_view(rng)
    left = sl.Part("left", 0, 4, sl.to_world(DESKEW, 4))
    right = sl.Part("right", 5, 4, sl.to_world(DESKEW, 4, pixel=1.1, mirror=True, alignment=[0.99, -0.1, 0.5, 0.1, 0.99, -0.4]))
    return [sl.seen(p, view) for p in (left, right)]


def samples(part, screen, linear):
    """Raw place of every pixel, and the voxels it reads with their weights."""
    inverse = np.linalg.inv(part.to_screen)
    for u in range(screen[0]):
        for v in range(screen[1]):
            p = np.round(inverse[:3] @ (u, v, 0, 1), 9)
            base = np.floor(p if linear else p + 0.5).astype(int)
            for corner in np.ndindex(2, 2, 2) if linear else [(0, 0, 0)]:
                at = base + corner
                w = np.prod(1 - np.abs(p - at)) if linear else 1.0
                if w > 0 and 0 <= at[0] < part.width and 0 <= at[1] < H and 0 <= at[2] < D:
                    yield u, v, at[0] + part.first, at[1], at[2], w


@pytest.mark.parametrize("linear", [True, False])
def test_no_sampled_row_is_left_out(linear):
    rng = np.random.default_rng(2)
    met = 0
    for _ in range(60):
        for part in parts(rng):
            rows = {k: sl.plane_rows(part, k, (W, H, D), (11, 9), linear) for k in range(D)}
            for _, _, _, y, z, _ in samples(part, (11, 9), linear):
                assert rows[z] is not None and rows[z][0] <= y <= rows[z][1]
                met += 1
    assert met > 300


@pytest.mark.parametrize("linear", [True, False])
def test_slices_equal_plain_sampling(spark, linear):
    rng = np.random.default_rng(6)
    volume = rng.integers(0, 60000, (W, H, D))
    voxels = spark.createDataFrame([(3, 1, z, y, x, int(volume[x, y, z])) for x in range(W) for y in range(H) for z in range(D)], "t long, c long, z long, y long, x long, v long")
    for _ in range(3):
        own = parts(rng)
        expected = {}
        for part in own:
            for u, v, x, y, z, w in samples(part, (8, 7), linear):
                expected[part.name, u, v] = expected.get((part.name, u, v), 0.0) + w * volume[x, y, z]
        got = {(r.part, r.u, r.v): r.value for r in sl.screen_slice(voxels, own, (W, H, D), (8, 7), 2, linear).collect()}
        assert len(got) == 2 * 8 * 7
        for k, value in got.items():
            assert abs(value - expected.get(k, 0.0)) <= 0.5 + 1e-6


def test_only_covered_cells_are_read(spark):
    """A face of the scan asks for few of its rows, the semi-join leaves the others out."""
    part = sl.seen(sl.Part("whole", 0, W, np.eye(4)), sl.facing("y", 3.0))
    cells = sl.covered_cells(spark, [part], (W, H, D), (W, D), linear=False)
    assert sorted(map(tuple, cells.collect())) == [(z, 3) for z in range(D)]
    voxels = spark.range(W * H * D).select(F.lit(0).alias("t"), F.lit(1).alias("c"), F.expr(f"id div {W * H}").alias("z"), F.expr(f"id div {W} % {H}").alias("y"), F.expr(f"id % {W}").alias("x"), F.col("id").alias("v"))
    assert sl.read_cells(voxels, cells).count() == W * D
    away = sl.seen(part, mx.translate(0, 0, 99.0))
    assert sl.covered_cells(spark, [away], (W, H, D), (W, D)).count() == 0
    assert {r.value for r in sl.screen_slice(voxels, [away], (W, H, D), (W, D)).collect()} == {0}
