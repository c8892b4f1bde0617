"""Parts whose keys are so large that their cubes are no longs: from 2,097,152 on, as in tables over 100 times sf0.1."""

import duckdb
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from lamella.plans import views


def part(spark, tmp_path, keys):
    folder = str(tmp_path)
    spark.createDataFrame([(k, k % 50 + 1) for k in keys], "p_partkey long, p_size int").write.parquet(f"{folder}/part.parquet")
    return folder


def test_calibration_equals_its_sql(spark, tmp_path):
    folder = part(spark, tmp_path, [*range(400), *range(7_000_000, 7_000_600)])
    got = sorted(tuple(r) for r in queries()["x12_channel_calibration"](spark, folder).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet/*.parquet'")
    assert got == sorted(con.execute(oracle_sql()["x12_channel_calibration"]).fetchall()) and len(got) == 5


def test_places_of_beads(spark):
    keys = [0, 1, 195, 196, 1008, 1009, 19_999, 2_097_151, 2_097_152, 7_199_999, 10**9, 10**15]
    got = spark.createDataFrame([(k,) for k in keys], "p_partkey long").select(F.expr(views.BEAD_X), F.expr(views.BEAD_Y)).collect()
    assert [tuple(r) for r in got] == [((k * k * 37 + 11 * k) % 196, (k * k * k % 1009 * 53 + 17 * k) % 196) for k in keys]


def test_spots_are_found(spark, tmp_path):
    folder = part(spark, tmp_path, range(7_000_000, 7_000_200))
    assert {r["found"] for r in queries()["k10_detected_spots"](spark, folder).collect()} == {True}
