"""Findings of round 3: robust final fit, the least transfer ratio in closed form, tasks by images and not by bytes."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lamella.functions import model
from lamella.operators import alignment as al
from lamella.plans import views

SF = "/root/testdata/sf0.001"


def test_distorted_spots_do_not_turn_the_map():
    rng = np.random.RandomState(3)
    m = rng.uniform(20, 220, (120, 2))
    true = (math.radians(0.3), -15.0, 4.0)
    f = al._moved(m, true) + rng.normal(0, 0.02, m.shape)
    off = (m[:, 0] > 120) & (np.arange(len(m)) % 3 > 0)  # overlapping spots on one side, all drawn one way
    f[off] += (0.1, 0.7)
    fit, pairs, _ = al.refined(f, m, (0.0, -13.0, 2.0))
    assert pairs == 120
    assert abs(math.degrees(fit[0]) - 0.3) < 0.02
    assert abs(fit[1] + 15) < 0.1 and abs(fit[2] - 4) < 0.1


def test_bead_images_are_dealt_by_their_number(spark, tmp_path):
    spark.range(views.BEADS * views.DRAWN * 3).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    images = views.bead_images(spark, str(tmp_path), channel=1).select("image", F.spark_partition_id().alias("task"))
    tasks = images.groupBy("task").count().collect()
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == views.DRAWN * 3


def test_step_interval_is_dealt_to_tasks(spark):
    from lamella.plans.q_matrices import _settings

    one = _settings(spark, SF).coalesce(1)
    assert model.step_interval(one).select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_least_motion_ratio_needs_no_samples(spark):
    from lamella.plans.q_matrices import _settings

    rows = model.support(_settings(spark, SF).withColumn("relative_motion_floor", F.lit(0.0)))
    rows = rows.withColumn("f", F.explode(F.array(*[F.lit(v) for v in (0.3, 0.7, 1.0, 1.6, 2.4)])))
    few, many = (model.predict(rows, F.col("f") * F.col("step"), n).select("id", "f", "relative_motion").orderBy("id", "f").toPandas() for n in (1, 256))
    pd.testing.assert_frame_equal(few, many, rtol=1e-12)
    got = many.dropna()
    assert len(got) and (got["relative_motion"] < 1).any()
    r = model.predict(rows, F.col("f") * F.col("step"))
    sinc = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)
    for x in r.filter("relative_motion IS NOT NULL AND scan_mode <> 1").limit(20).collect():
        least = min(1.0, *(sinc(x.ky_ * i / 256 * x.blur) / sinc(x.ky_ * i / 256 * x.l0) for i in range(1, 257)))
        assert x.relative_motion == pytest.approx(least, rel=1e-12)


def test_coarse_shifts_join_textures(spark):
    rng = np.random.RandomState(1)
    image = np.zeros((128, 128))
    for x, y in rng.randint(30, 98, (12, 2)):
        image[y - 1 : y + 2, x - 1 : x + 2] = 500
    moved = np.roll(image, (-8, 12), (0, 1))
    rows = lambda a: spark.createDataFrame([(7, 128, 128, a.ravel().tolist())], "image long, width int, height int, px array<double>")
    shifts = al.coarse_shifts(rows(image), rows(moved), ["image"])
    assert [tuple(r) for r in shifts.select("image", "dx", "dy").collect()] == [(7, *al.coarse_shift(image, moved)[:2])] == [(7, -12, 8)]
