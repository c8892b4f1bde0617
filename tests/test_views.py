"""Boxes of views in output coordinates against the crop of the whole view; chunks that a box leaves closed; channel operations."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.operators import stored_views as sv
from lamella.sources import ome_zarr

T, C, Z, H, W = 2, 4, 3, 12, 11
LABELS = ["_Channel0001-left", "_Channel0001-right", "_Channel0002-left", "_Channel0002-right"]
TURN = (0.99, -0.12, 1.3, 0.12, 0.99, -0.8)


@pytest.fixture(scope="module")
def volume(spark):
    values = np.random.default_rng(8).integers(1, 60000, (T, C, Z, H, W))
    return spark.createDataFrame([(*k, int(values[k])) for k in np.ndindex(T, C, Z, H, W)], "t long, c long, z long, y long, x long, v long").cache()


def rows(df):
    return sorted(map(tuple, df.select("t", "c", "z", "y", "x", "v").collect()))


CASES = [("stored", {}), ("side_by_side", {}), ("flip", {"flip_side": "left"}), ("flip_align_right", {"matrix": TURN}), ("flip_align_left", {"matrix": TURN}), ("flip_align_left", {"tagged": {LABELS[0]: (1, 0, 0, 0, 1, 0), LABELS[1]: TURN}, "reference": LABELS[0]})]


@pytest.mark.parametrize(("operation", "options"), CASES)
def test_a_box_is_the_crop_of_the_whole_view(spark, volume, operation, options):
    channels = sv.outputs(spark, LABELS, [0, 1], operation, W, **options)
    whole = sv.stored_view(volume, channels, W, H)
    assert whole.count() == T * Z * H * W * 2
    for box in ((0, 3, 0, 2, 0, 0), (7, 10, 9, 11, 1, 2), (4, 4, 5, 5, 2, 2), (9, 13, 3, 6, 0, 1)):
        x1 = min(box[1], sv.whole_box(W, H, Z, operation)[1])
        cut = (box[0], x1, *box[2:])
        inside = whole.filter(F.col("x").between(*cut[:2]) & F.col("y").between(*cut[2:4]) & F.col("z").between(*cut[4:]))
        expected = inside.withColumns({k: F.col(k) - cut[2 * i] for i, k in enumerate("xyz")})
        assert rows(sv.stored_view(volume, channels, W, H, cut)) == rows(expected)
    assert rows(sv.stored_view(volume, channels, W, H, times=(1, 1))) == rows(whole.filter("t = 1"))


@pytest.mark.parametrize(("operation", "options"), CASES[:4])
def test_a_small_box_opens_few_chunks(spark, volume, tmp_path, operation, options):
    """All chunks but those around the box, taken back through the operation, are spoiled."""
    root = f"{tmp_path}/a.zarr"
    ome_zarr.register(spark)
    ome_zarr.write_store(volume, root, (W, H, Z), T, C, 4)
    channels = sv.outputs(spark, LABELS, [1], operation, W, **options)
    box = (1, 2, 4, 5, 1, 1)
    expected = rows(sv.stored_view(volume, channels, W, H, box, (1, 1)))
    spoiled = 0
    for name in os.listdir(f"{root}/s0"):
        if re.fullmatch(r"\d+(\.\d+){4}", name):
            t, c, z, cy, cx = map(int, name.split("."))
            near = cx >= 1 if operation == "flip_align_right" else cx <= 1
            if not (t == 1 and z == 1 and near and c == (0 if operation == "side_by_side" else 1)):
                with open(f"{root}/s0/{name}", "wb") as f:
                    f.write(b"no gzip")
                spoiled += 1
    assert spoiled >= T * C * Z * 9 - 6 and expected
    assert rows(sv.stored_view(lambda: ome_zarr.voxels(spark, root), channels, W, H, box, (1, 1))) == expected


def test_left_seen_from_the_mirrored_side():
    """Left, mirrored and moved by the reframed matrix, lies on right as right, mirrored and moved, lies on left."""
    f = np.array([[-1.0, 0, W - 1], [0, 1, 0], [0, 0, 1]])
    m = np.array([TURN[:3], TURN[3:], (0, 0, 1)])
    k = np.array([*np.reshape(sv.seen_from_left(TURN, W), (2, 3)), (0, 0, 1)])
    for p in np.random.default_rng(1).uniform(0, 10, (20, 2)):
        right = np.array([*p, 1.0])
        left = m @ f @ right  # where a point of the right half lies on the left one
        assert np.allclose(k @ f @ left, right)


def test_operations_skip_incomplete_time_points(spark, volume):
    some = volume.filter("NOT (t = 1 AND c = 1)")
    channels = sv.outputs(spark, LABELS, [0, 1], "flip", W)
    done, projections = sv.channel_operation(some, channels, W, H)
    assert {r.t for r in done.select("t").distinct().collect()} == {0} and {r.t for r in projections.select("t").distinct().collect()} == {0}
    pixels = some.groupBy("t", "c", F.col("y").alias("h"), F.col("x").alias("w")).agg(F.max("v").alias("v")).withColumn("view", F.lit("maxZ"))
    both = pixels.union(pixels.withColumn("view", F.lit("meanX")).select(pixels.columns))
    flat = sv.operated_projections(both, channels, W, H)
    assert {(r.view, r.t) for r in flat.select("view", "t").distinct().collect()} == {("maxZ", 0)}
    expected = projections.filter("view = 'Z'").select("t", "c", F.col("h").cast("long"), F.col("w").cast("long"), F.col("max_v").cast("long"))
    assert sorted(map(tuple, flat.select("t", "c", "h", "w", "v").collect())) == sorted(map(tuple, expected.collect()))
    with pytest.raises(ValueError):
        sv.outputs(spark, LABELS, [0], "turn", W)
