"""Spots in crowds: neighbours and matches without all pairs, images joined by their own number."""

import numpy as np
from pyspark.sql import functions as F

from lamella.operators import points as pt


def frame(spark, xy, first=0):
    rows = [(first + i, float(x), float(y), int(i * 7 % 13)) for i, (x, y) in enumerate(xy)]
    return spark.createDataFrame(rows, "id long, x double, y double, response int")


def test_isolated_points_of_crowds_and_edges(spark):
    rng = np.random.default_rng(5)
    xy = np.concatenate([rng.uniform(0, 9, (150, 2)), rng.normal(4, 0.05, (60, 2)), np.round(rng.uniform(-3, 0, (60, 2)), 1), [(20, 20), (20.3, 20), (30, 30), (30, 30.2), (40, 40)] * 1])
    radii = {"x": 0.3, "y": 0.2}
    d = sum(((xy[:, None, k] - xy[None, :, k]) / r) ** 2 for k, r in enumerate(radii.values()))
    np.fill_diagonal(d, 9)
    expected = [i for i in range(len(xy)) if not (d[i] <= 1).any()]
    odd = spark.createDataFrame([(900, None, 1.0, 0), (901, float("nan"), 1.0, 0), (902, float("nan"), 1.0, 0), (903, float("inf"), 1.0, 0), (904, float("inf"), 1.0, 0)], "id long, x double, y double, response int")
    got = pt.isolated(frame(spark, xy).union(odd), radii).select("id").collect()
    assert sorted(r.id for r in got) == [*expected, 900, 901, 902, 903, 904]
    assert 0 < len(expected) < len(xy) - 60


def test_points_apart_equal_all_pairs(spark):
    xy = np.round(np.random.default_rng(6).uniform(0, 20, (300, 2)), 1)
    d = ((xy[:, None] - xy[None]) ** 2).sum(2)
    np.fill_diagonal(d, 9)
    expected = [i for i, p in enumerate(xy) if not (d[i] < 0.7 * 0.7).any() and (p >= 2).all() and (p <= 17).all()]
    assert sorted(r.id for r in pt.apart_from_others(frame(spark, xy), 0.7, 20, 20, 2).collect()) == expected


def test_a_crowd_takes_no_pairs(spark):
    """100,000 points at one place: all pairs would be ten thousand million."""
    crowd = spark.range(100_000).select("id", (5 + F.col("id") % 10 / 1000.0).alias("x"), F.lit(5.0).alias("y"), F.lit(1).alias("response"))
    alone = frame(spark, [(1.0, 1.0)], 200_000)
    assert [r.id for r in pt.isolated(crowd.union(alone), {"x": 0.3, "y": 0.2}).collect()] == [200_000]
    moved = crowd.select((F.col("id") + 1_000_000).alias("id"), (F.col("x") - 3).alias("x"), (F.col("y") + 2).alias("y"), "response")
    pairs = pt.mutual_matches(crowd, moved, (3.0, -2.0), 20.0).collect()
    assert sorted((r.fixed_id, r.moving_id) for r in pairs) == [(k, 1_000_000 + k) for k in range(10)]


def test_mutual_matches_equal_all_pairs(spark):
    rng = np.random.default_rng(7)
    a, b = np.round(rng.uniform(0, 60, (400, 2)), 1), np.round(rng.uniform(0, 60, (300, 2)), 0)
    b[:20] = b[20:40]
    moved = b + (3.0, -2.0)
    d = ((a[:, None] - moved[None]) ** 2).sum(2)
    to_b, to_a = d.argmin(1), d.argmin(0)
    expected = [(i, 1000 + to_b[i]) for i in range(len(a)) if to_a[to_b[i]] == i and d[i, to_b[i]] <= 25]
    got = pt.mutual_matches(frame(spark, a), frame(spark, b, 1000), (3.0, -2.0), 5.0).collect()
    assert sorted((r.fixed_id, r.moving_id) for r in got) == expected


def test_brightest_of_many_equal_brightest(spark):
    points = frame(spark, np.random.default_rng(8).uniform(0, 9, (500, 2))).repartition(5)
    for n in (1, 137, 499, 500, 900):
        assert sorted(pt.brightest_many(points, n).collect()) == sorted(pt.brightest(points, n).collect())


def test_close_pairs_of_the_same_image(spark):
    points = frame(spark, [(1, 1), (1.1, 1), (1.2, 1)]).withColumn("image", F.col("id") % 2)
    pairs = pt.close_pairs(points, points, {"x": 1.0, "y": 1.0}, F.col("a_id") != F.col("b_id"), ("image",))
    assert sorted((r.a_id, r.b_id) for r in pairs.collect()) == [(0, 2), (2, 0)]
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_bead_images_go_to_no_broadcast(spark):
    from lamella.operators import alignment as al
    from lamella.plans.q_kernels import bead_pairs

    sf = "/root/testdata/sf0.001"
    pairs = bead_pairs(spark, sf)
    for df in (*pairs, al.coarse_shifts(*pairs, ["image"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        for line in plan.split("\n"):
            assert "Broadcast" not in line or "px" not in line, line
        assert plan.count("BroadcastHashJoin") == 0
