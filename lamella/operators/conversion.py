"""Format conversion as jobs: files into a store, a store into files, files deflated anew.

Each job does what is not done yet: time points that a store has committed, and files that are there
and complete, are left alone, so a job that was stopped goes on where it was. Pixels go
from planes to chunks and back inside the tasks that read them.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.sources import ome_zarr, tiff

NAME = "Time%06d_Channel%04d.tif"


def _halved(planes: DataFrame) -> DataFrame:
    """Both halves of each plane as channels 2c and 2c + 1; widths are even."""
    half = F.expr("width div 2")
    rows = F.sequence(F.lit(0), F.col("height") - 1)
    cut = lambda first: F.flatten(F.transform(rows, lambda y: F.slice(F.col("px"), y * F.col("width") + first + 1, half)))
    sides = F.array(F.struct((2 * F.col("c")).alias("c"), cut(F.lit(0)).alias("px")), F.struct((2 * F.col("c") + 1).alias("c"), cut(half).alias("px")))
    each = planes.select("t", "z", half.alias("_w"), "height", F.explode(sides).alias("s"))
    return each.select("t", "s.c", "z", F.col("_w").alias("width"), "height", "s.px")


def pending(files: DataFrame, root: str) -> DataFrame:
    """The files (path, t, c, label) whose time point the store has not committed.

    A store that holds other time points than the first of these files is refused.
    """
    if not os.path.exists(os.path.join(root, "s0", ".zarray")):
        return files
    m = ome_zarr.metadata(root)
    held = files.sparkSession.createDataFrame([(t, x) for t, x in enumerate(m["time_labels"][: m["committed"]])], "t long, held string")
    labels = files.select("t", "label").distinct()
    other = held.join(labels, "t", "left").filter(~F.col("held").eqNullSafe(F.col("label")))
    if not other.isEmpty():
        raise ValueError(f"{root} holds other time points than these files: {[r['held'] for r in other.limit(3).collect()]}")
    return files.join(held.select("t"), "t", "left_anti")


def files_to_store(files: DataFrame, root: str, split: bool = False, chunk: int = ome_zarr.CHUNK_XY, **options) -> int:
    """Convert the files of one dataset (path, t, c from 0, label of the time point) into a store, going on where one was begun.

    All files have the shape of the plan; with ``split``, halves become channels. A new store has 32-bit pixels if a file has. Returns the number of committed time points.
    """
    spark = files.sparkSession
    ome_zarr.register(spark)
    todo = pending(files, root)
    shape = tiff.headers(files.orderBy("t", "c").limit(1)).first()
    count = files.agg((F.max("t") + 1).alias("t"), (F.max("c") + 1).alias("c")).first()
    labels = [r["label"] for r in files.select("t", "label").distinct().orderBy("t").collect()]  # one a time point
    if todo.isEmpty():
        return ome_zarr.metadata(root)["committed"]
    planes = tiff.planes(todo, "t", "c").select("t", "c", "z", "width", "height", "px")
    planes = _halved(planes) if split else planes
    width, channels = (shape["width"] // 2, 2 * count["c"]) if split else (shape["width"], count["c"])
    depth = shape["channels"] * shape["slices"] * shape["frames"]
    if "dtype" not in options and not os.path.exists(os.path.join(root, "s0", ".zarray")):
        options["dtype"] = "<u4" if tiff.bits(todo).agg(F.max("bits")).first()[0] > 16 else "<u2"
    begun = ome_zarr.metadata(root)["committed"] if os.path.exists(os.path.join(root, "s0", ".zarray")) else 0
    size = f"{count['t']},{channels},{depth},{shape['height']},{width}"
    writer = ome_zarr.plane_chunks(planes, chunk).write.format("ome_zarr").options(shape=size, chunk=chunk, complete="true", time_labels=json.dumps(labels[begun:]), **options)
    writer.mode("append").save(root)
    return ome_zarr.metadata(root)["committed"]


def _missing(names: DataFrame, folder: str, overwrite: bool) -> DataFrame:
    """Rows (file, ...) whose file is not there complete."""
    if overwrite:
        return names
    placed = names.withColumn("path", F.concat(F.lit(folder.rstrip("/") + "/"), F.col("file")))
    there = tiff.structure(placed).filter("ready").select("path")
    return placed.join(there, "path", "left_anti").drop("path")


def store_to_files(spark: SparkSession, root: str, folder: str, name: str = NAME, deflate: bool = True, overwrite: bool = False) -> int:
    """Write every committed volume of a store as a TIFF file; complete files stay. Returns how many were written."""
    spark.dataSource.register(tiff.PlanesTiff)
    m = ome_zarr.metadata(root)
    volumes = spark.range(m["committed"]).select(F.col("id").alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m["shape"][1] - 1).cast("long"))).alias("c"))
    todo = _missing(volumes.withColumn("file", F.format_string(name, "t", "c")), folder, overwrite).select("t", "c")
    number = todo.count()
    if number:
        _write(tiff.to_files(ome_zarr.store_planes(todo, root), name, bits=32 if m["dtype"] == "<u4" else 16), folder, deflate, overwrite)
    return number


def deflate_files(files: DataFrame, folder: str, overwrite: bool = False) -> int:
    """Write files (path, name) again with Deflate into a folder; those that are deflated, or there, are left alone. Returns how many were written."""
    files.sparkSession.dataSource.register(tiff.PlanesTiff)
    plain = files.join(tiff.deflated(files).filter("NOT deflated"), "path", "left_semi")
    named = plain.withColumnsRenamed({"name": "file", "path": "source"})
    todo = _missing(named, folder, overwrite).select(F.col("source").alias("path"), "file")
    number = todo.count()
    if number:
        planes = tiff.planes(todo.join(tiff.bits(todo), "path"), "file", "bits").drop("path").withColumnRenamed("file", "name")
        _write(tiff.to_files(planes, "%s", ("name",)), folder, True, overwrite)
    return number


def _write(rows: DataFrame, folder: str, deflate: bool, overwrite: bool) -> None:
    rows.write.format("planes_tiff").option("deflate", "true" if deflate else "false").mode("overwrite" if overwrite else "append").save(folder)
