"""Finding F30: a live batch deskews its time points once, whatever the number of projections."""

from pyspark.sql import functions as F

from lamella.operators import pipelines as pl
from lamella.sources import ome_zarr
from lamella.streaming import jobs
from lamella.streaming.sources import replayed


def test_volume_is_read_once(spark, tmp_path):
    ome_zarr.register(spark)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    n = 3 * 2 * 4 * 6 * 8
    v = spark.range(n).selectExpr("id div 384 AS t", "id div 192 % 2 + 1 AS c", "id div 48 % 4 AS z", "id div 8 % 6 AS y", "id % 8 AS x", "id % 97 + 1 AS v")
    volume = v.mapInArrow(counted, v.schema)
    groups = replayed(spark.createDataFrame([(2,), (0,)], "t long"), "t", 1)
    root = f"{tmp_path}/live.zarr"
    pl.live_deskew(groups, volume, root, (0.265, 0.116, 25.0), (8, 6, 4), 2, jobs.shared_folder(spark))
    assert read.value == n
    assert ome_zarr.metadata(root)["time_labels"] == ["t000000", "t000002"]
    got = ome_zarr.voxels(spark, root).groupBy("t").agg(F.countDistinct("c").alias("c"), F.max("v").alias("v")).orderBy("t").collect()
    assert [(r.t, r.c) for r in got] == [(0, 4), (1, 4)] and all(r.v > 0 for r in got)
