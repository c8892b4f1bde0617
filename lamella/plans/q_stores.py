"""Queries of store commits, recovery, live writing and run stamps."""

import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lamella.functions import provenance
from lamella.operators import beads, pipelines as pl, project as pj, voxels as vx
from lamella.plans import views
from lamella.plans.q_pipelines import HALVES
from lamella.plans.q_points import CROPS_SQL, crops
from lamella.plans.q_sources import _folder, _projected, _store, _tiffs, _whole
from lamella.plans.registry import query
from lamella.sources import ome_zarr, tiff
from lamella.streaming import jobs, state

V = f"WITH {views.VOXELS} "
FIRST = "SELECT t, c, z, y, x, v FROM voxels WHERE t = 0"


@query("a02_integer_rules", V + "SELECT t, c, z, y, least((sum(v) + count(*) // 2) // count(*), 65535) AS mean, least(sum(v), 65535) AS total FROM voxels GROUP BY ALL")
def a02(spark, sf_dir):
    return views.voxels(spark, sf_dir).groupBy("t", "c", "z", "y").agg(pj.reducer("mean").alias("mean"), pj.reducer("sum").alias("total"))


@query("a04_projection_shapes", V + "SELECT t, c, u.view AS view, CAST(CASE u.view WHEN 'X' THEN 10 WHEN 'Y' THEN 10 ELSE 10 END AS BIGINT) AS width, 10 AS height FROM (SELECT DISTINCT t, c FROM voxels), (SELECT unnest(['X', 'Y', 'Z']) AS view) u")
def a04(spark, sf_dir):
    six = pj.six_projections(views.voxels(spark, sf_dir))
    return six.groupBy("t", "c", "view").agg((F.max("w") + 1).cast("long").alias("width"), (F.max("h") + 1).cast("int").alias("height"))


@query("s18_store_attributes", V + """SELECT max(t) + 1 AS committed, 't,c,z,y,x' AS axes, '2.0,1.0,0.3,0.1,0.1' AS scale, k.name, k.axes AS view_axes, k.scale AS view_scale, 'one:5-900,two:0-65535' AS channels FROM voxels,
    (SELECT unnest(['maxZ', 'meanX', 'maxY']) AS name, unnest(['t,c,y,x', 't,c,y,z', 't,c,z,x']) AS axes, unnest(['2.0,1.0,0.1,0.1', '2.0,1.0,0.1,0.3', '2.0,1.0,0.3,0.1']) AS scale) k GROUP BY ALL""")
def s18(spark, sf_dir):
    attrs = ome_zarr.attributes(spark.createDataFrame([(_projected(spark, sf_dir),)], "root string"))
    array = "axes array<struct<name:string>>"
    scales = "coordinateTransformations array<struct<scale:array<double>>>"
    schema = f"multiscales array<struct<{array.replace(' ', ':', 1)},datasets:array<struct<{scales.replace(' ', ':', 1)}>>>>, opm_write_state struct<committedTimepoints:long>, opm_projections struct<datasets:array<struct<name:string,{array.replace(' ', ':', 1)},{scales.replace(' ', ':', 1)}>>>, omero struct<channels:array<struct<label:string,window:struct<start:long,end:long>>>>"
    a = F.from_json("attrs", schema)
    joined = lambda values: F.array_join(F.transform(values, lambda x: x.cast("string")), ",")
    rows = attrs.select(a.alias("a"), F.explode(a["opm_projections"]["datasets"]).alias("p"))
    m = F.col("a.multiscales")[0]
    channels = F.transform(F.col("a.omero.channels"), lambda c: F.concat(c["label"], F.lit(":"), c["window"]["start"].cast("string"), F.lit("-"), c["window"]["end"].cast("string")))
    return rows.select(
        F.col("a.opm_write_state.committedTimepoints").alias("committed"), F.array_join(m["axes"]["name"], ",").alias("axes"), joined(m["datasets"][0]["coordinateTransformations"][0]["scale"]).alias("scale"),
        F.col("p.name").alias("name"), F.array_join(F.col("p.axes.name"), ",").alias("view_axes"), joined(F.col("p.coordinateTransformations")[0]["scale"]).alias("view_scale"), F.array_join(channels, ",").alias("channels"),
    )


@query("s19_projection_files", V + "SELECT t, c, 'maxZ' AS view, y, x, max(v) AS v FROM voxels GROUP BY t, c, y, x UNION ALL SELECT t, c, 'meanZ', y, x, least((sum(v) + count(*) // 2) // count(*), 65535) FROM voxels GROUP BY t, c, y, x")
def s19b(spark, sf_dir):
    """One file per time point and view, in a folder of the view."""
    spark.dataSource.register(tiff.PlanesTiff)
    root, out = _folder(spark), None
    for view, kind in (("maxZ", "max"), ("meanZ", "mean")):
        pixels = pj.projection(views.voxels(spark, sf_dir), "z", kind).withColumn("z", F.lit(0).cast("long"))
        tiff.to_files(vx.to_planes(pixels, 10, 10), f"{view}/v_Time%06d_Channel%04d-{view}.tif", bits=32).write.format("planes_tiff").option("deflate", "true").mode("append").save(root)
        names = pixels.select("t", "c").distinct().withColumn("path", F.concat(F.lit(f"{root}/{view}/"), F.format_string(f"v_Time%06d_Channel%04d-{view}.tif", "t", "c")))
        rows = vx.to_voxels(tiff.planes(names).join(names, "path").select("t", "c", "z", "width", "px")).select("t", "c", F.lit(view).alias("view"), "y", "x", F.col("v").cast("long").alias("v"))
        out = rows if out is None else out.union(rows)
    return out


@query("s19_tiff_sink", V + "SELECT DISTINCT t, c, true AS complete FROM voxels")
def s19(spark, sf_dir):
    root, names = _tiffs(spark, sf_dir)
    # A second write leaves complete files as they are.
    tiff.to_files(vx.to_planes(views.voxels(spark, sf_dir), 10, 10), "v_Time%06d_Channel%04d.tif", bits=32).write.format("planes_tiff").mode("append").save(root)
    return tiff.structure(names).join(names, "path").select("t", "c", F.col("ready").alias("complete"))


@query("s23_replaced_alignment", V + "SELECT max(c) AS channels, 'second' AS source, true AS original_kept FROM voxels")
def s23(spark, sf_dir):
    root = _store(spark, sf_dir)
    for name, shift in (("first", 1.0), ("second", 2.0)):  # an action on metadata, once, by the driver
        ome_zarr.set_alignment(root, {"right": [1, 0, shift, 0, 1, 0]}, name)
    attrs = ome_zarr.attributes(spark.createDataFrame([(root,)], "root string"))
    p = F.from_json("attrs", "opm_provenance struct<alignSource:string,originalAlignMatrices:map<string,array<double>>>")["opm_provenance"]
    channels = views.voxels(spark, sf_dir).agg(F.max("c").alias("channels"))
    return channels.crossJoin(attrs.select(p["alignSource"].alias("source"), (p["originalAlignMatrices"]["right"][2] == 1.0).alias("original_kept")))


def _halted(spark, sf_dir):
    """A store of all time points in which one chunk of the last one is missing."""
    v = views.voxels(spark, sf_dir)
    last = v.agg(F.max("t")).first()[0]
    return _store(spark, sf_dir, v.filter(~((F.col("t") == last) & (F.col("z") == 4) & (F.col("y") < 8) & (F.col("x") < 8))), whole=False)


@query("r11_commit_in_order", V + "SELECT CAST(max(t) AS INTEGER) AS committed, CAST(greatest(max(t), 1) AS INTEGER) AS times FROM voxels")
def r11(spark, sf_dir):
    found = ome_zarr.discover(spark, spark.createDataFrame([(_halted(spark, sf_dir),)], "path string"))
    return found.select("committed", F.col("shape")[0].cast("int").alias("times"))


@query("r11_stream_sink", V + "SELECT t, c, z, y, x, v FROM voxels")
def r11b(spark, sf_dir):
    """Planes arrive in eight files, one a batch; the store's stream sink commits the time points as they become whole."""
    from lamella.streaming.sources import files_as_stream

    ome_zarr.register(spark)
    v = views.voxels(spark, sf_dir).withColumn("c", F.col("c") - 1)
    n = v.agg(*[(F.max(k) + 1).alias(k) for k in "tcz"]).first()
    folder, root = _folder(spark), _folder(spark) + "/stream.zarr"
    vx.to_planes(v, 10, 10).repartition(8, "t", "c", "z").write.parquet(folder)
    chunks = ome_zarr.plane_chunks(files_as_stream(spark, folder, files_per_trigger=1), 8)
    sink = chunks.writeStream.format("ome_zarr").options(path=root, shape=f"{n['t']},{n['c']},{n['z']},10,10", chunk=8, dtype="<u4", run="all", checkpointLocation=jobs.shared_folder(spark))
    sink.trigger(availableNow=True).start().awaitTermination()
    return _whole(spark, root)


@query("r12_recovered_store", V + "SELECT t, c, z, y, x, v FROM voxels WHERE t < (SELECT max(t) FROM voxels)")
def r12(spark, sf_dir):
    return _whole(spark, _halted(spark, sf_dir))


@query("r13_finish_marker", V + "SELECT 'finished' AS step, 'complete' AS status, max(t) + 1 AS committed FROM voxels UNION ALL SELECT 'reopened', 'writing', max(t) + 1 FROM voxels")
def r13(spark, sf_dir):
    """A finished store, and after a further (already committed) time point was written to it again."""
    root = _store(spark, sf_dir, complete="true")
    one = lambda step: ome_zarr.discover(spark, spark.createDataFrame([(root,)], "path string")).select(F.lit(step).alias("step"), "status", F.col("committed").cast("long").alias("committed"))
    finished = spark.createDataFrame(one("finished").collect(), "step string, status string, committed long")
    m = ome_zarr.metadata(root)
    _, c, z, y, x = m["shape"]
    again = views.voxels(spark, sf_dir).filter("t = 0").withColumn("c", F.col("c") - 1)
    ome_zarr.write_store(again, root, (x, y, z), m["committed"], c, 8)
    return finished.union(one("reopened"))


RESUME_SQL = """WITH o AS (SELECT o_custkey AS dataset, list('t' || o_orderkey ORDER BY o_orderkey) AS labels, list(o_orderdate || '/' || o_orderkey ORDER BY o_orderkey) AS prints FROM orders GROUP BY o_custkey)
    SELECT dataset, CASE WHEN dataset % 11 = 0 THEN NULL WHEN dataset % 7 = 1 THEN 'the store''s kind differs' WHEN dataset % 7 = 2 THEN 'the store''s layout differs' WHEN dataset % 7 = 3 THEN 'the store''s channels differ' WHEN dataset % 7 = 4 THEN 'the store''s sampling differs'
      WHEN dataset % 7 = 5 THEN 'the store''s time points differ' WHEN dataset % 7 = 6 THEN 'the store''s files differ' END AS problem FROM o"""


@query("r14_resume_rules", RESUME_SQL)
def r14(spark, sf_dir):
    """A plan per customer over its orders as time points; its store has the first half of them, spoiled by the customer's number."""
    o = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dataset"), F.concat(F.lit("t"), "o_orderkey").alias("label"), F.concat_ws("/", F.col("o_orderdate").cast("string"), "o_orderkey").alias("print"), "o_orderkey")
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", "label", "print")))
    fixed = {"kind": "'volume'", "identity": "concat('set', dataset)", "layout": "array(10L, 512L, 512L)", "chunks": "array(1, 512, 512)", "channels": "array('a', 'b')", "sampling": "array(0.1D, 0.1D, 0.3D)"}
    plans = o.groupBy("dataset").agg(rows.alias("r")).select("dataset", *[F.expr(e).alias(k) for k, e in fixed.items()], F.col("r.label").alias("labels"), F.col("r.print").alias("fingerprints"))
    spoiled = {
        "kind": "if(dataset % 7 = 1, 'projection', kind)", "layout": "if(dataset % 7 = 2, array(11L, 512L, 512L), layout)", "channels": "if(dataset % 7 = 3, array('a'), channels)", "sampling": "if(dataset % 7 = 4, array(0.2D, 0.1D, 0.3D), sampling)",
        "labels": "if(dataset % 7 = 5, array('other'), slice(labels, 1, greatest(1, size(labels) div 2)))", "fingerprints": "if(dataset % 7 = 6, array('other'), slice(fingerprints, 1, greatest(1, size(fingerprints) div 2)))",
    }
    stores = plans.filter("dataset % 11 <> 0").withColumns({k: F.expr(e) for k, e in spoiled.items()})
    return ome_zarr.resume_problems(stores, plans, "dataset")


# A crop of 5 x 3 x 3 in 9 x 7 x 7, filled with the mean of its border (all but the three voxels in its middle).
@query("k13_padded_psf", CROPS_SQL + """ SELECT bead, round(sum(v) + (sum(v) - coalesce(sum(v) FILTER (abs(dz) <= 1 AND dy = 0 AND dx = 0), 0)) / 42.0 * (9 * 7 * 7 - 45), 4) AS total, CAST(sum(v) FILTER (dz = 0 AND dy = 0 AND dx = 0) AS DOUBLE) AS centre FROM k GROUP BY bead""")
def k13(spark, sf_dir):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        psf = np.zeros((5, 3, 3))
        psf[pdf["dz"] + 2, pdf["dy"] + 1, pdf["dx"] + 1] = pdf["v"]
        wide = beads.padded(psf, (9, 7, 7), "mean")
        return pd.DataFrame([(pdf["bead"].iloc[0], float(wide.sum()), float(wide[4, 3, 3]))], columns=["bead", "total", "centre"])

    return crops(spark, sf_dir).groupBy("bead").applyInPandas(run, "bead long, total double, centre double").withColumn("total", F.round("total", 4))


@query("h14_run_stamp", "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS stamp, 'UTC' AS time_zone FROM orders")
def h14(spark, sf_dir):
    stamp = provenance.environment(spark)
    return views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), provenance.utc_stamp(F.col("o_orderdate").cast("timestamp")).alias("stamp"), stamp["time_zone"].alias("time_zone"))


@query("r02_announced_paths", f"WITH {views.FILES} SELECT DISTINCT 'f' || size AS path FROM files WHERE size % 3 > 0 OR size % 2 = 0")
def r02(spark, sf_dir):
    from lamella.streaming.sources import files_as_stream

    orders = files_as_stream(spark, f"{sf_dir}/orders.parquet")
    path = F.concat(F.lit("f"), F.col("o_orderkey"))
    announced = orders.filter("o_orderkey % 3 > 0").select(path.alias("path"))
    listed = orders.filter("o_orderkey % 2 = 0").select(path.alias("path"))
    return jobs.drain(announced.union(listed).dropDuplicates(["path"]))


@query("x10_live_deskew", V + HALVES.replace("FROM voxels)", "FROM voxels WHERE t IN (SELECT t FROM voxels GROUP BY t HAVING count(DISTINCT c) = 2))") + """, i AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM (SELECT DISTINCT t FROM dk))
    SELECT i AS t, c, 'volume' AS view, z, y, x, v FROM dk JOIN i USING (t) UNION ALL SELECT i, c, 'maxZ', 0, y, x, max(v) FROM dk JOIN i USING (t) GROUP BY i, c, y, x
    UNION ALL SELECT i, c, 'meanX', 0, y, z, least((sum(v) + count(*) // 2) // count(*), 65535) FROM dk JOIN i USING (t) GROUP BY i, c, y, z""")
def x10(spark, sf_dir):
    """Whole captures leave the stream, are deskewed once and appended to a store with their projections; the store is read back."""
    from lamella.streaming.sources import files_as_stream

    ome_zarr.register(spark)
    events = files_as_stream(spark, f"{sf_dir}/events.parquet")
    arrivals = events.filter("event_id % 1000 = 0").select(F.lit(1).cast("long").alias("position"), F.expr("event_id div 2000").alias("time_id"), F.expr("(event_id div 1000) % 2 + 1").alias("channel"))
    ready = state.complete_groups(arrivals, [1, 2]).filter("status = 'complete'").select(F.col("time_id").alias("t"))
    root = _folder(spark) + "/live.zarr"
    pl.live_deskew(ready, views.voxels(spark, sf_dir), root, (0.265, 0.116, 25.0), (10, 10, 10), 2, jobs.shared_folder(spark), dtype="<u4")
    if not os.path.exists(root):  # no capture was whole
        return spark.createDataFrame([], "t long, c long, view string, z long, y long, x long, v long")
    parts = [_whole(spark, root, **({} if view == "volume" else {"projection": view})).withColumn("view", F.lit(view)) for view in ("volume", "maxZ", "meanX")]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.select(F.col("t").cast("long").alias("t"), F.col("c").cast("long").alias("c"), "view", F.col("z").cast("long").alias("z"), "y", "x", F.col("v").cast("long").alias("v"))
