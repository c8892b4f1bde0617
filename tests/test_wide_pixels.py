"""Pixels beyond 16 bits through stores and files, and their refusal where they do not fit."""

import os
import shutil

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.operators import conversion as cv, voxels as vx
from lamella.plans import registry
from lamella.sources import ome_zarr, tiff

SF = "/root/testdata/sf0.001"
NAMES = ["r11_stream_sink", "s04_tiff_planes", "s12_store_window", "s17_store_round_trip", "s17_stored_projections", "s19_projection_files", "x08_deflated_files", "x08_format_conversion", "x08_resumed_store", "x08_store_to_files"]


@pytest.fixture(scope="module")
def bright(spark, tmp_path_factory):
    """The tables with values of which some pass 65535 hundredths."""
    folder = str(tmp_path_factory.mktemp("bright"))
    for name in os.listdir(SF):
        if name != "events.parquet":
            (shutil.copytree if os.path.isdir(f"{SF}/{name}") else shutil.copy)(f"{SF}/{name}", f"{folder}/{name}")
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.crossJoin(spark.range(4).toDF("k")).withColumn("event_id", F.col("event_id") + 1000 * F.col("k")).drop("k").withColumn(
        "value", F.col("value") + F.when(F.col("event_id") % 17 == 3, 700.0).otherwise(0.0)
    ).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", [*NAMES, "r12_recovered_store"])
def test_bright_voxels_come_back(spark, bright, name):
    got = registry.queries()[name](spark, bright)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{bright}/events.parquet/*.parquet'")
    columns = ", ".join(got.columns)
    expected = con.execute(f"SELECT {columns} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))


def test_pixels_that_do_not_fit_are_refused(spark, tmp_path):
    ome_zarr.register(spark)
    spark.dataSource.register(tiff.PlanesTiff)
    v = spark.range(12).select(F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("z"), F.expr("id div 4").alias("y"), (F.col("id") % 4).cast("long").alias("x"), (F.col("id") * 7000).alias("v"))
    with pytest.raises(Exception, match="does not fit"):
        ome_zarr.write_store(v, f"{tmp_path}/narrow.zarr", (4, 3, 1), 1, 1, 4)
    with pytest.raises(Exception, match="does not fit"):
        ome_zarr.write_store(v.withColumn("v", -F.col("v")), f"{tmp_path}/negative.zarr", (4, 3, 1), 1, 1, 4, dtype="<u4")
    with pytest.raises(Exception, match="do not fit"):
        tiff.to_files(vx.to_planes(v, 4, 3), cv.NAME).write.format("planes_tiff").mode("append").save(f"{tmp_path}/narrow")
    ome_zarr.write_store(v, f"{tmp_path}/wide.zarr", (4, 3, 1), 1, 1, 4, dtype="<u4")
    with pytest.raises(Exception, match="cannot append"):
        ome_zarr.write_store(v, f"{tmp_path}/wide.zarr", (4, 3, 1), 1, 1, 4, dtype="<u2")
    assert ome_zarr.metadata(f"{tmp_path}/wide.zarr")["dtype"] == "<u4"
    assert sorted(np.ravel(ome_zarr.voxels(spark, f"{tmp_path}/wide.zarr").select("v").collect())) == [k * 7000 for k in range(12)]
    # A store of 16 bits stays one when more is appended to it.
    ome_zarr.write_store(v.filter("v < 60000"), f"{tmp_path}/small.zarr", (4, 3, 1), 1, 1, 4)
    ome_zarr.write_store(v.filter("v < 60000").withColumn("t", F.lit(1).cast("long")), f"{tmp_path}/small.zarr", (4, 3, 1), 2, 1, 4)
    assert ome_zarr.metadata(f"{tmp_path}/small.zarr")["dtype"] == "<u2"
