"""Filters that choose chunks, and the stream sink of stores under failures."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.operators import voxels as vx
from lamella.sources import ome_zarr
from lamella.streaming.sources import files_as_stream

T, C, Z, Y, X = 3, 2, 4, 9, 10


@pytest.fixture(scope="module")
def volume(spark):
    rng = np.random.default_rng(4)
    values = rng.integers(1, 60000, (T, C, Z, Y, X))
    rows = [(t, c, z, y, x, int(values[t, c, z, y, x])) for t, c, z, y, x in np.ndindex(T, C, Z, Y, X)]
    return spark.createDataFrame(rows, "t long, c long, z long, y long, x long, v long").cache()


def store(spark, volume, root):
    ome_zarr.register(spark)
    ome_zarr.write_store(volume, root, (X, Y, Z), T, C, 4)
    return ome_zarr.voxels(spark, root)


def test_a_plain_read_may_be_used_twice(spark, volume, tmp_path):
    """Without pruning, the same read under two filters; with it, a read for each."""
    store(spark, volume, f"{tmp_path}/a.zarr")
    one = spark.read.format("ome_zarr_voxels").load(f"{tmp_path}/a.zarr")
    expected = sorted(map(tuple, volume.filter("z = 1 OR (z = 3 AND x < 2)").collect()))
    assert sorted(map(tuple, one.filter("z = 1").union(one.filter("z = 3 AND x < 2")).collect())) == expected
    two = ome_zarr.voxels(spark, f"{tmp_path}/a.zarr").filter("z = 1").union(ome_zarr.voxels(spark, f"{tmp_path}/a.zarr").filter("z = 3 AND x < 2"))
    assert sorted(map(tuple, two.collect())) == expected


CASES = [
    ("t = 1 AND c = 0 AND z = 2 AND y = 5 AND x = 9", 1),
    ("z >= 1 AND z < 3 AND y > 3 AND y <= 7 AND x BETWEEN 4 AND 7", T * C * 2),
    ("x IN (0, 3) AND t IN (0, 2)", 2 * C * Z * 3),
    ("x IN (1, 9) AND v > 30000", T * C * Z * 3 * 3),
    ("z = 99", 0),
    ("y < 0", 0),
    ("t = 5 OR x = 1", T * C * Z * 9),
    ("NOT z = 1", T * C * Z * 9),
]


@pytest.mark.parametrize(("condition", "chunks"), CASES)
def test_plain_filters_open_only_their_chunks(spark, volume, tmp_path, condition, chunks):
    """All chunks that the filter leaves out are spoiled: opening one would fail."""
    root = f"{tmp_path}/a.zarr"
    read = store(spark, volume, root)
    inside = volume.filter("true" if "OR" in condition or "NOT" in condition else condition)
    wanted = {(r.t, r.c, r.z, r.cy, r.cx) for r in inside.select("t", "c", "z", F.expr("y div 4").alias("cy"), F.expr("x div 4").alias("cx")).distinct().collect()}
    if "IN (" in condition:  # a list on x opens the span it covers
        low, high = {"x IN (0, 3)": (0, 0), "x IN (1, 9)": (0, 2)}[re.match(r"x IN \(\d, \d\)", condition)[0]]
        times = (0, 2) if "t IN" in condition else range(T)
        wanted = {(t, c, z, cy, cx) for t in times for c in range(C) for z in range(Z) for cy in range(3) for cx in range(low, high + 1)}
    spoiled = 0
    for name in os.listdir(f"{root}/s0"):
        if re.fullmatch(r"\d+(\.\d+){4}", name) and tuple(map(int, name.split("."))) not in wanted:
            with open(f"{root}/s0/{name}", "wb") as f:
                f.write(b"no gzip")
            spoiled += 1
    assert len(wanted) == chunks and spoiled == T * C * Z * 9 - chunks
    got = sorted(map(tuple, read.filter(condition).collect()))
    assert got == sorted(map(tuple, volume.filter(condition).collect()))


def test_pushed_filters_are_not_evaluated_again(spark, volume, tmp_path):
    read = store(spark, volume, f"{tmp_path}/a.zarr")
    above = lambda q: q._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]
    evaluated = lambda q: re.sub(r"isnotnull\(\w+#\d+\)", "", above(q))
    assert not re.search(r"[zy]#\d+ [=<]", evaluated(read.filter("z = 1 AND y < 4"))) and re.search(r"v#\d+ >", evaluated(read.filter("v > 5")))


def stream(spark, folder, root, state, fail=None):
    """Write the planes of a folder, a file a batch; fails on the way while the file ``fail`` exists."""

    def guarded(batches):
        for batch in batches:
            if fail and os.path.exists(fail) and 1 in batch.column("t").to_pylist():
                raise RuntimeError("lost")
            yield batch

    planes = files_as_stream(spark, folder, files_per_trigger=1)
    chunks = ome_zarr.plane_chunks(planes, 4)
    chunks = chunks.mapInArrow(guarded, chunks.schema)
    sink = chunks.writeStream.format("ome_zarr").options(path=root, shape=f"{T},{C},{Z},{Y},{X}", chunk=4, run="r", checkpointLocation=state)
    return sink.trigger(availableNow=True).start()


def test_failed_batch_leaves_each_time_point_once(spark, volume, tmp_path):
    ome_zarr.register(spark)
    folder, root, state, flag = f"{tmp_path}/planes", f"{tmp_path}/s.zarr", f"{tmp_path}/state", f"{tmp_path}/fail"
    planes = vx.to_planes(volume, X, Y)
    for k, own in enumerate(("t = 0", "t = 1 AND z < 2", "t = 2", "t = 1 AND z >= 2")):  # time point 2 is there before 1 is whole
        planes.filter(own).coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            if name.startswith("part") and os.path.getmtime(f"{folder}/{name}") > 10**9 + 100:
                os.utime(f"{folder}/{name}", (10**9 + k, 10**9 + k))
    open(flag, "w").close()
    with pytest.raises(Exception, match="lost"):
        stream(spark, folder, root, state, flag).awaitTermination()
    assert ome_zarr.metadata(root)["committed"] == 1
    os.remove(flag)
    stream(spark, folder, root, state, flag).awaitTermination()
    m = ome_zarr.metadata(root)
    assert m["committed"] == T and m["shape"][0] == T and len(m["time_labels"]) == T
    read = spark.read.format("ome_zarr_voxels").load(root)
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, volume.collect()))
    batches = ome_zarr._load(f"{root}/.zattrs")["opm_write_state"]["batches"]
    assert batches == {"r": 3}
    # The same batch told again changes nothing, not even where a time point more would be whole.
    writer = ome_zarr.StoreStreamWriter({"path": root, "shape": f"{T},{C},{Z},{Y},{X}", "chunk": "4", "run": "r"})
    before = ome_zarr._load(f"{root}/.zattrs")
    writer.commit([], 3)
    assert ome_zarr._load(f"{root}/.zattrs") == before
