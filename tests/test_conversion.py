"""Conversions between files and stores: both directions, from a half-written target, refusals."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.operators import conversion as cv, voxels as vx
from lamella.sources import ome_zarr, tiff

T, C, Z, H, W = 3, 2, 3, 6, 8


@pytest.fixture(scope="module")
def volume(spark):
    values = np.random.default_rng(2).integers(0, 65536, (T, C, Z, H, W))
    return spark.createDataFrame([(*k, int(values[k])) for k in np.ndindex(T, C, Z, H, W)], "t long, c long, z long, y long, x long, v long").cache()


def written(spark, volume, folder):
    spark.dataSource.register(tiff.PlanesTiff)
    tiff.to_files(vx.to_planes(volume, W, H), cv.NAME).write.format("planes_tiff").mode("append").save(folder)
    rows = [(f"{folder}/{cv.NAME % (t, c)}", t, c, f"t{t:06d}") for t in range(T) for c in range(C)]
    return spark.createDataFrame(rows, "path string, t long, c long, label string")


def content(df):
    return sorted((r.t, r.c, r.z, r.y, r.x, int(r.v)) for r in df.select("t", "c", "z", "y", "x", "v").collect())


def test_files_to_store_goes_on_where_it_stopped(spark, volume, tmp_path):
    files, root = written(spark, volume, f"{tmp_path}/in"), f"{tmp_path}/a.zarr"
    assert cv.files_to_store(files.filter("t = 0"), root, chunk=4) == 1
    before = {n: os.stat(f"{root}/s0/{n}").st_mtime_ns for n in os.listdir(f"{root}/s0") if n.startswith("0.")}
    os.remove(files.filter("t = 0 AND c = 1").first().path.replace("Channel0001", "Channel0001"))  # what is committed is not read again
    assert cv.files_to_store(files, root, chunk=4) == T
    assert content(ome_zarr.voxels(spark, root)) == content(volume)
    assert {n: os.stat(f"{root}/s0/{n}").st_mtime_ns for n in before} == before
    assert cv.files_to_store(files, root, chunk=4) == T and ome_zarr.metadata(root)["status"] == "complete"
    other = files.withColumn("label", F.concat(F.lit("other"), "t"))
    with pytest.raises(ValueError, match="other time points"):
        cv.files_to_store(other, root, chunk=4)


def test_halves_become_channels(spark, volume, tmp_path):
    files, root = written(spark, volume, f"{tmp_path}/in"), f"{tmp_path}/a.zarr"
    cv.files_to_store(files, root, split=True, chunk=4)
    half = W // 2
    expected = volume.withColumn("c", 2 * F.col("c") + (F.col("x") >= half).cast("int")).withColumn("x", F.col("x") % half)
    assert content(ome_zarr.voxels(spark, root)) == content(expected)


def test_store_to_files_and_deflation(spark, volume, tmp_path):
    root, folder, small = f"{tmp_path}/a.zarr", f"{tmp_path}/out", f"{tmp_path}/deflated"
    ome_zarr.register(spark)
    ome_zarr.write_store(volume, root, (W, H, Z), T, C, 4)
    assert cv.store_to_files(spark, root, folder, deflate=False) == T * C
    path = f"{folder}/{cv.NAME % (1, 0)}"
    whole = open(path, "rb").read()
    with open(path, "wb") as f:
        f.write(whole[: len(whole) // 2])  # half a file is no file
    assert cv.store_to_files(spark, root, folder, deflate=False) == 1 and open(path, "rb").read() == whole
    names = spark.createDataFrame([(f"{folder}/{cv.NAME % (t, c)}", cv.NAME % (t, c), t, c) for t in range(T) for c in range(C)], "path string, name string, t long, c long")
    read = lambda df: content(vx.to_voxels(tiff.planes(df, "t", "c").select("t", "c", "z", "width", "px")))
    assert read(names) == content(volume)
    assert cv.deflate_files(names.select("path", "name"), small) == T * C and cv.deflate_files(names.select("path", "name"), small) == 0
    done = names.withColumn("path", F.concat(F.lit(small + "/"), "name"))
    assert read(done) == content(volume) and tiff.deflated(done).filter("deflated").count() == T * C
    assert cv.deflate_files(done.select("path", "name"), f"{tmp_path}/again") == 0  # deflated already
