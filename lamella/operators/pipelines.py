"""User-level jobs composed of the operators."""

from __future__ import annotations

import json
import os
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.operators import kernels, project, resample, voxels as vx
from lamella.sources import ome_zarr, tiff
from lamella.streaming.jobs import shared_folder

VOLUMES_PER_TASK = 64


def canonical_halves(volume: DataFrame, width: int) -> DataFrame:
    """Both camera halves as channels 2c-1 and 2c, neither mirrored nor aligned."""
    parts = vx.channel_parts(volume, width, "separate")
    return parts.withColumn("c", 2 * F.col("c") - F.when(F.col("part") == "left", 1).otherwise(0)).drop("part")


def batch_deskew(volume: DataFrame, step: float, pixel: float, angle: float, extents: tuple[int, int, int]) -> tuple[DataFrame, DataFrame]:
    """Deskewed halves and their six projections."""
    width, height, depth = extents
    deskewed = resample.deskew(canonical_halves(volume, width), step, pixel, angle, (width // 2, height, depth))
    return deskewed, project.six_projections(deskewed)


def compose(volume: DataFrame, slots: list[tuple[int, int]]) -> DataFrame:
    """Chosen source channels in output order: ``(source, slot)``; the slot table is a fixed parameter."""
    table = F.create_map(*[F.lit(x) for source, slot in slots for x in (source, slot)])
    return volume.withColumn("slot", F.try_element_at(table, F.col("c").cast("int"))).filter("slot IS NOT NULL").drop("c").withColumnRenamed("slot", "c")


def split_deskew(volume: DataFrame, step: float, pixel: float, angle: float, extents: tuple[int, int, int], parts: int) -> DataFrame:
    """Deskew in parts along x, which the matrix leaves unmixed, and put the parts end to end again."""
    width, height, depth = extents
    length = -(-width // parts)
    widths = [min(length, width - k * length) for k in range(parts) if k * length < width]
    split = vx.split_axis(volume, "x", width, parts)
    done = [resample.deskew(split.filter(F.col("part") == k).drop("part"), step, pixel, angle, (w, height, depth)) for k, w in enumerate(widths)]
    return vx.concatenate(done, "x", widths)


def multi_channel(volume: DataFrame, extents: tuple[int, int, int], matrices: dict[int, list[float]], slots: list[tuple[int, int]], geometry: tuple[float, float, float], mirrored: tuple[int, ...] = ()) -> DataFrame:
    """Halves, deskew, alignment of the channels that have a matrix, composition.

    The mirror of a channel is part of its deskew: x stays unmixed there, so it is a change of the key column
    before the one resampling, and no pass of its own.
    """
    width, height, depth = extents
    halves = canonical_halves(volume, width)
    halves = halves.withColumn("x", F.when(F.col("c").isin(list(mirrored)), width // 2 - 1 - F.col("x")).otherwise(F.col("x")))
    deskewed = resample.deskew(halves, *geometry, (width // 2, height, depth))
    plain = deskewed.filter(~F.col("c").isin(list(matrices)))
    _, tall, _ = resample.deskewed_size(*geometry, (width // 2, height, depth))
    aligned = [resample.align_voxels(deskewed.filter(F.col("c") == c), m, width // 2, tall) for c, m in matrices.items()]
    return compose(reduce(DataFrame.unionByName, aligned, plain), slots)


def deconvolution_batch(volume: DataFrame, psfs: DataFrame, radius: dict[str, int], extents: tuple[int, int, int], tile: tuple[int, int, int], rounds: int = 10, variation: float = 0.0) -> DataFrame:
    """Deconvolve every channel with the point-spread function of its own (c, dz, dy, dx, v); channels without one are left out.

    The functions are small arrays, one a channel, held by every task.
    """
    shape = tuple(2 * radius[k] + 1 for k in "zyx")
    kernels_by_channel: dict[int, np.ndarray] = {}
    for r in psfs.select("c", "dz", "dy", "dx", "v").collect():
        kernels_by_channel.setdefault(int(r["c"]), np.zeros(shape))[r["dz"] + radius["z"], r["dy"] + radius["y"], r["dx"] + radius["x"]] = r["v"]
    done = [kernels.deconvolve(volume.filter(F.col("c") == c), psf, extents, tile, rounds, variation) for c, psf in sorted(kernels_by_channel.items()) if psf.sum() > 0]
    empty = volume.limit(0).select("t", "c", "z", "y", "x", F.col("v").cast("double").alias("v"))
    return reduce(DataFrame.unionByName, done, empty)


def view(volume: DataFrame, channels: list[int], box: tuple[int, ...], operation: str, width: int) -> DataFrame:
    """Channels, region and operation of a view: stored, flip, side_by_side."""
    picked = vx.region(volume.filter(F.col("c").isin(channels)), box)
    if operation == "stored":
        return picked
    if operation == "flip":
        return vx.flip(picked, "x", box[1] - box[0] + 1)
    if operation == "side_by_side":
        half = (box[1] - box[0] + 1) // 2
        size = box[1] - box[0] + 1
        return vx.side_by_side(vx.split_half(picked, size, "left"), vx.flip(vx.split_half(picked, size, "right"), "x", half), half)
    raise ValueError(f"unknown operation {operation}")


def region_export(volume: DataFrame, target: str, box: tuple[int, ...], channels: list[int], times: tuple[int, int], sink: str = "store", overwrite: bool = False, bits: int = 16, **options) -> str:
    """Write a box of some channels and time points (first to last) to a store or to TIFF files; returns ``target``.

    The result has its own numbering of channels (in the given order) and of time points, from
    0. A target that exists is refused unless it is to be overwritten.
    """
    if os.path.exists(target) and not overwrite:
        raise FileExistsError(f"{target} exists")
    slots = F.create_map(*[F.lit(x) for i, c in enumerate(channels) for x in (int(c), i)])
    picked = vx.region(volume.filter(F.col("c").isin(channels) & F.col("t").between(*times)), box)
    out = picked.withColumns({"t": F.col("t") - times[0], "c": slots[F.col("c").cast("int")].cast("long")})
    width, height, depth = box[1] - box[0] + 1, box[3] - box[2] + 1, box[5] - box[4] + 1
    mode = "overwrite" if overwrite else "append"
    if sink == "store":
        ome_zarr.write_store(out, target, (width, height, depth), times[1] - times[0] + 1, len(channels), mode=mode, complete="true", dtype="<u4" if bits > 16 else "<u2", **options)
    elif sink == "tiff":
        tiff.to_files(vx.to_planes(out, width, height), "Time%06d_Channel%04d.tif", bits=bits).write.format("planes_tiff").options(**options).mode(mode).save(target)
    else:
        raise ValueError(f"unknown sink {sink}")
    return target


def _kept(rows: DataFrame) -> DataFrame:
    """Rows that are made once, and read by all that use them."""
    path = shared_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def live_deskew(groups: DataFrame, volume: DataFrame, root: str, geometry: tuple[float, float, float], extents: tuple[int, int, int], channels: int, checkpoint: str, dtype: str = "<u2") -> None:
    """Follow complete time points (a stream with ``t``), deskew their halves and append them and their projections to a store, once each.

    A micro-batch writes its new time points in order after those that the store has committed, by
    label; a batch that is run again after a failure finds its labels there and leaves them. Volumes are
    dealt to tasks by their number, as a deskewed volume is longer than its source; it and its projections are made once.
    """
    width, height, depth = extents
    size = resample.deskewed_size(*geometry, (width // 2, height, depth))

    def put(batch: DataFrame, number: int) -> None:
        known = set(ome_zarr.metadata(root)["time_labels"]) if os.path.exists(os.path.join(root, "s0", ".zarray")) else set()
        ready = sorted(r["t"] for r in batch.select("t").distinct().collect())  # the time points of one batch
        fresh = [t for t in ready if f"t{t:06d}" not in known]
        if not fresh:
            return
        places = batch.sparkSession.createDataFrame([(int(t), len(known) + i) for i, t in enumerate(fresh)], "t long, place long")
        own = volume.join(places, "t").drop("t").withColumnRenamed("place", "t")
        halves = canonical_halves(own, width).repartition(len(fresh) * 2 * channels // VOLUMES_PER_TASK + 1, "t", "c")
        deskewed = _kept(resample.deskew(halves, *geometry, (width // 2, height, depth)).withColumn("c", F.col("c") - 1))
        six = _kept(project.six_projections(deskewed))
        views = {f"{kind}{axis}": six.filter(F.col("view") == axis).select("t", "c", "h", "w", F.col(f"{kind}_v").alias("v")) for kind in ("max", "mean") for axis in "XYZ"}
        labels = json.dumps([f"t{t:06d}" for t in fresh])
        ome_zarr.write_store(deskewed, root, size, len(known) + len(fresh), 2 * channels, views=views, time_labels=labels, dtype=dtype)

    query = groups.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
