"""Findings F24 and F28: tasks of a conversion plan follow the number of files, and no task grows with the table."""

import pytest
from pyspark.sql import functions as F

from lamella.operators import catalogue as cat


def _sources(spark, rows):
    fields = "dataset long, path string, time_no long, channel long, width int, readable boolean"
    fixed = {"output": "concat('out', dataset)", "height": "48", "slices": "10", "stored_channels": "1", "frames": "1", "named_depth": "CAST(NULL AS INT)", "pixel": "0.1D", "dz": "0.3D"}
    return spark.createDataFrame(rows, fields).withColumns({k: F.expr(e) for k, e in fixed.items()})


def _parameters(spark):
    return spark.createDataFrame([], "dataset long, planes int, roi_width int, roi_height int")


@pytest.mark.parametrize("per_task", [50, 10_000])
def test_tasks_follow_the_number_of_files(spark, monkeypatch, per_task):
    monkeypatch.setattr(cat, "FILES_PER_TASK", per_task, raising=False)
    rows = [(k % 200, f"f{k}", k // 400, (k // 200) % 2, 64 if k % 11 == 0 else 32, k % 23 > 0) for k in range(2000)]
    plan, left = cat.conversion_plan(_sources(spark, rows), _parameters(spark))
    tasks = left.groupBy(F.spark_partition_id()).count().count()
    assert tasks > 20 if per_task == 50 else tasks <= 4
    wide = {r[1] for r in rows if r[4] == 64 and r[5]}
    assert {r.path for r in left.filter("reason = 'unreadable'").collect()} == {r[1] for r in rows if not r[5]}
    assert {r.path for r in left.filter("reason = 'other shape'").collect()} == wide
    assert plan.count() == 200


def test_unknown_numbers_and_ties(spark):
    rows = [(1, "a", 0, 0, 32, True), (1, "b", 0, 1, 32, True), (1, "c", 1, 0, 32, True), (1, "d", None, 0, 32, True)]
    rows += [(2, "e", 0, 0, 32, True), (2, "f", 0, 1, 64, True), (3, "g", 0, 0, 32, False), (None, "h", 0, 0, 32, True), (4, "i", 0, None, 32, True)]
    plan, left = cat.conversion_plan(_sources(spark, rows), _parameters(spark))
    got = {r.dataset: (r.shape, r.channels, r.points, r.incomplete, r.conflicts, r.refused) for r in plan.collect()}
    assert got == {
        1: ("32x48x10x1x1", 2, 1, 2, 0, None), 2: (None, None, None, None, None, "no majority shape"), 3: (None, None, None, None, None, "no sound file"),
        None: (None, None, None, None, None, "no sound file"), 4: ("32x48x10x1x1", 0, 0, 0, 1, "conflicting files"),
    }
    assert sorted((r.path, r.reason) for r in left.collect()) == [("c", "incomplete time point"), ("g", "unreadable")]
