"""Rules that are easily read wrong: line order, legacy pitches, roundings, order statistics, frames, mirrored halves."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.functions import provenance
from lamella.operators import alignment, catalogue as cat, points as pt, project as pj
from lamella.operators.deskew import deskewed_max_of_sides
from lamella.sources import text

LINES = "path string, n int, line string"


def test_last_line_of_a_key_counts(spark):
    rows = [("p", 5, "Tilt angle: 25"), ("p", 1, "Tilt angle: 9"), ("p", 7, "Tilt angle: about 30"), ("p", 2, "Interval: 3 s"), ("p", 3, "Interval: 10 s"), ("p", 8, "﻿Step size /um: 0.4"), ("p", 9, "no colon")]
    r = text.parameters(spark.createDataFrame(rows, LINES).repartition(4)).first()
    assert (r.angle, r.interval, r.step) == ("25", "10 s", "0.4")


def test_lines_are_numbered_as_they_stand(spark, tmp_path):
    (tmp_path / "p.txt").write_text("Tilt angle: 9\r\nTilt angle: 25\n")
    lines = text.read_lines(spark, str(tmp_path))
    assert [(r.n, r.line) for r in lines.orderBy("n").collect()] == [(0, "Tilt angle: 9"), (1, "Tilt angle: 25"), (2, "")]
    assert text.parameters(lines).first().angle == "25"


def test_bare_matrix_keeps_its_rows_in_order(spark):
    rows = [("s", 1, "0, 1, 5"), ("s", 0, "1, 0, 0.5")]
    for parts in (1, 2, 5):
        r = text.alignments(spark.createDataFrame(rows, LINES).repartition(parts, "n")).first()
        assert (r.m00, r.m01, r.m02, r.m10, r.m11, r.m12, r.source) == (1.0, 0.0, 0.5, 0.0, 1.0, 5.0, None)


def test_strict_geometry_refuses_nan(spark):
    rows = [(p, n, x) for p, galvo in (("a", "NaN"), ("b", "0.5")) for n, x in enumerate([f"um per galvo DU: {galvo}", "Galvo DUs per step: 2", "Tilt angle: 25", "Pixel size at object /um: 0.1", "Exposure time /ms: -3"])]
    params = text.parameters(spark.createDataFrame(rows, LINES))
    assert [r.path for r in text.strict_geometry(params).collect()] == ["b"]
    assert {"Invalid Exposure time /ms"} <= set(text.tolerant_geometry(params).filter("path = 'b'").first().warnings)


def test_legacy_pitches(spark):
    a = math.radians(25)
    cases = [([0.1, 0.1 * math.cos(a), 0.3 * math.sin(a)], [0.1] * 3), ([0.1, 0.1, 0.1], [0.1] * 3), ([0.1, 0.0906, 0.1268], [0.1, 0.0906, 0.1268]), ([0.1, 0.1], None), (None, None)]
    df = spark.createDataFrame([(k, (2, 0.1, 0.3, 25.0, v, None, None)) for k, (v, _) in enumerate(cases)], f"k int, r struct<{provenance.SCHEMA.replace(' ', ':').replace(',:', ', ')}>")
    got = [r.v for r in df.orderBy("k").select(provenance.voxel_size(F.col("r")).alias("v")).collect()]
    assert [None if g is None else [round(x, 9) for x in g] for g in got] == [e for _, e in cases]


def test_votes_agree_with_the_array_form(spark):
    rng = random.Random(3)
    fixed = [(k, rng.uniform(0, 300), rng.uniform(0, 300), 1000 - k) for k in range(80)]
    moving = [(k, x - 13.4 + rng.gauss(0, 0.4), y + 6.6 + rng.gauss(0, 0.4), r) for k, x, y, r in fixed]
    frames = [spark.createDataFrame(p, "id long, x double, y double, response long") for p in (fixed, moving)]
    best = pt.shift_votes(*frames, 80, 35).orderBy(F.desc("votes"), "dx", "dy").first()
    array = lambda p: np.array([(x, y) for _, x, y, _ in p])
    assert (best.dx, best.dy) == alignment.vote(array(fixed), array(moving))[1:] and abs(best.dx - 13.4) <= 1.5


@pytest.mark.parametrize("values", [[5, 1, 9, 3], [5, 1, 9, 3, 7], [4], [2, 2, 2, 8, 8, 8]])
def test_order_statistics(spark, values):
    df = spark.createDataFrame([(0, v) for v in values], "k int, v int")
    r = pj.order_median_mad(df, ["k"]).first()
    median = sorted(values)[len(values) // 2]
    mad = sorted(abs(v - median) for v in values)[len(values) // 2]
    assert r.median == median and r.sigma == pytest.approx(mad / 0.6744897501960817)


def test_background_regions(spark):
    rows = [(z, y, x, float("nan") if (z, y, x) == (1, 3, 3) else float(x + 10 * y)) for z in range(2) for y in range(10) for x in range(10)]
    df = spark.createDataFrame(rows, "z int, y int, x int, v double")
    assert [r.z for r in pj.roi_background(df, ["z"], (1, 1, 8, 8), 10, 10).collect()] == [0]
    for box in ((0, 0, 7, 9), (-1, 0, 9, 9), (2, 2, 9, 9)):
        with pytest.raises(ValueError):
            pj.roi_background(df, ["z"], box, 10, 10)


def test_named_frame_goes_before_a_bare_one(spark):
    sources = spark.createDataFrame([("_Channel0001-left", 1, "left"), ("_Channel0001-right", 1, "right")], "source string, channel int, side string")
    one = (1.0, 0.0, 4.0, 0.0, 1.0, 0.0)
    rows = [(None, 1.0, 0.0, -9.0, 0.0, 1.0, 0.0, False), ("_Channel0001-right", *one, True)]
    names = "source string, m00 double, m01 double, m02 double, m10 double, m11 double, m12 double, is_reference boolean"
    for order in (rows, rows[::-1]):
        got = {r.source: r.m02 for r in cat.placements(sources, spark.createDataFrame(order, names), True, 100).collect()}
        assert got == {"_Channel0001-left": 4.0, "_Channel0001-right": None}


def test_right_half_is_mirrored(spark):
    rows = [(0, 0, 0, x, 10 * x) for x in range(7)]
    v = spark.createDataFrame(rows, "t int, z int, y int, x int, v int")
    got = {}
    for r in deskewed_max_of_sides(v, ["t"], 0.1, 0.3, 30.0, 7, 5).collect():
        got.setdefault(r.side, {})[r.x] = r.v
    assert got == {"whole": {x: 10 * x for x in range(7)}, "left": {x: 10 * x for x in range(4)}, "right": {x: 10 * (6 - x) for x in range(4)}}
