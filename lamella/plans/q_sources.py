"""Queries through sources and sinks: stores, TIFF files, parameter and alignment texts, logs."""

import os

from pyspark.sql import functions as F

from lamella.operators import catalogue as cat, voxels as vx
from lamella.operators.pipelines import region_export
from lamella.operators.project import six_projections
from lamella.plans import views
from lamella.plans.q_catalogue import LOG_SQL, _log
from lamella.plans.registry import query
from lamella.sources import ome_zarr, text, tiff
from lamella.streaming import looks
from lamella.streaming.jobs import drain, shared_folder

V = f"WITH {views.VOXELS} "


def _folder(spark) -> str:
    """A new shared folder as a plain path: these formats are opened by the tasks themselves."""
    return shared_folder(spark).removeprefix("file:").replace("//", "/")


def _store(spark, sf_dir, voxels=None, chunk=8, whole=True, **options) -> str:
    """A new store of the voxels (channels from 0), whose values may pass 16 bits; without ``whole``, chunks without voxels stay absent."""
    voxels = views.voxels(spark, sf_dir) if voxels is None else voxels
    ome_zarr.register(spark)
    n = voxels.agg(*[(F.max(k) + 1).alias(k) for k in "tczyx"]).first()
    root = _folder(spark) + "/a.zarr"
    shifted = voxels.withColumn("c", F.col("c") - 1)
    if whole:
        ome_zarr.write_store(shifted, root, (n["x"], n["y"], n["z"]), n["t"], n["c"] - 1, chunk, dtype="<u4", **options)
    else:
        shape = f"{n['t']},{n['c'] - 1},{n['z']},{n['y']},{n['x']}"
        ome_zarr.to_chunks(shifted, chunk).write.format("ome_zarr").options(shape=shape, chunk=chunk, dtype="<u4").mode("append").save(root)
    return root


def _whole(spark, root, **options):
    chunks = spark.read.format("ome_zarr").options(**options).load(root)
    return ome_zarr.to_voxels(chunks).withColumn("c", F.col("c") + 1)


def _tiffs(spark, sf_dir, deflate="true"):
    spark.dataSource.register(tiff.PlanesTiff)
    root = _folder(spark)
    tiff.to_files(vx.to_planes(views.voxels(spark, sf_dir), 10, 10), "v_Time%06d_Channel%04d.tif", bits=32).write.format("planes_tiff").option("deflate", deflate).mode("append").save(root)
    names = views.voxels(spark, sf_dir).select("t", "c").distinct().withColumn("path", F.concat(F.lit(root + "/"), F.format_string("v_Time%06d_Channel%04d.tif", "t", "c")))
    return root, names


@query("s12_store_window", V + "SELECT t, c, z, y, x, v FROM voxels WHERE z BETWEEN 2 AND 5 AND y BETWEEN 3 AND 8 AND x BETWEEN 0 AND 6 AND c = 1")
def s12(spark, sf_dir):
    return _whole(spark, _store(spark, sf_dir), box="2:6,3:9,0:7", channels="0")


@query("s12_plain_filter", V + "SELECT t, c, z, y, x, v FROM voxels WHERE z BETWEEN 2 AND 5 AND y > 2 AND y <= 8 AND x IN (1, 4, 6) AND c = 2 AND t >= 1")
def s12b(spark, sf_dir):
    """Filters of a plain read choose the chunks; those on y, x and whole axes are not evaluated again."""
    voxels = ome_zarr.voxels(spark, _store(spark, sf_dir, chunk=4))
    return voxels.filter("z BETWEEN 2 AND 5 AND y > 2 AND y <= 8 AND x IN (1, 4, 6) AND c = 1 AND t >= 1").withColumn("c", F.col("c") + 1)


@query("s17_store_round_trip", V + "SELECT t, c, z, y, x, v FROM voxels")
def s17(spark, sf_dir):
    return _whole(spark, _store(spark, sf_dir))


@query("s11_store_metadata", V + "SELECT max(t) + 1 AS committed, max(c) AS channels, 10 AS depth, 'writing' AS status, 0 AS warnings FROM voxels")
def s11(spark, sf_dir):
    found = ome_zarr.discover(spark, spark.createDataFrame([(_store(spark, sf_dir),)], "path string"))
    return found.select(
        F.col("committed").cast("long").alias("committed"), F.col("shape")[1].alias("channels"), F.col("shape")[2].cast("int").alias("depth"), "status", F.size("warnings").alias("warnings")
    )


PROJECTED = {"maxZ": ("max", "z"), "meanX": ("mean", "x"), "maxY": ("max", "y")}


@query("s17_stored_projections", V + """SELECT 'maxZ' AS name, t, c, y AS h, x AS w, max(v) AS v FROM voxels GROUP BY t, c, y, x UNION ALL SELECT 'maxY', t, c, z, x, max(v) FROM voxels GROUP BY t, c, z, x
    UNION ALL SELECT 'meanX', t, c, y, z, least((sum(v) + count(*) // 2) // count(*), 65535) FROM voxels GROUP BY t, c, y, z""")
def s17b(spark, sf_dir):
    root = _projected(spark, sf_dir)
    out = None
    for name in PROJECTED:
        rows = _whole(spark, root, projection=name).select(F.lit(name).alias("name"), "t", "c", F.col("y").alias("h"), F.col("x").alias("w"), F.col("v").cast("long").alias("v"))
        out = rows if out is None else out.union(rows)
    return out


def _projected(spark, sf_dir):
    """A store with three projections of its volume, scales and channel labels."""
    v = views.voxels(spark, sf_dir).withColumn("c", F.col("c") - 1)
    six = six_projections(v)
    pixels = {n: six.filter(F.col("view") == a.upper()).select("t", "c", "h", "w", F.col(f"{k}_v").alias("v")) for n, (k, a) in PROJECTED.items()}
    return _store(spark, sf_dir, views=pixels, scale="[2.0, 1, 0.3, 0.1, 0.1]", labels='["one", "two"]', windows="[[5, 900], [0, 65535]]")


@query("s20_region_export", V + "SELECT t - 1 AS t, CASE c WHEN 2 THEN 1 ELSE 2 END AS c, z - 2 AS z, y - 1 AS y, x - 4 AS x, v FROM voxels WHERE z BETWEEN 2 AND 4 AND y BETWEEN 1 AND 7 AND x BETWEEN 4 AND 9 AND t BETWEEN 1 AND 3")
def s20(spark, sf_dir):
    ome_zarr.register(spark)
    box = vx.clamp_box(4, 1, 20, 7, 2, 4, 10, 10, 10)
    return _whole(spark, region_export(views.voxels(spark, sf_dir), _folder(spark) + "/r.zarr", box, [2, 1], (1, 3), bits=32))


@query("s20_region_files", V + "SELECT t - 1 AS t, c - 1 AS c, z - 2 AS z, y - 1 AS y, x - 4 AS x, v FROM voxels WHERE z BETWEEN 2 AND 4 AND y BETWEEN 1 AND 7 AND x BETWEEN 4 AND 9 AND t BETWEEN 1 AND 3")
def s20b(spark, sf_dir):
    spark.dataSource.register(tiff.PlanesTiff)
    box = vx.clamp_box(4, 1, 20, 7, 2, 4, 10, 10, 10)
    v = views.voxels(spark, sf_dir)
    root = region_export(v, _folder(spark) + "/r", box, [1, 2], (1, 3), sink="tiff", bits=32, deflate="true")
    names = v.filter("t BETWEEN 1 AND 3").select((F.col("t") - 1).alias("t"), (F.col("c") - 1).alias("c")).distinct()
    names = names.withColumn("path", F.concat(F.lit(root + "/"), F.format_string("Time%06d_Channel%04d.tif", "t", "c")))
    return vx.to_voxels(tiff.planes(names).join(names, "path").select("t", "c", "z", "width", "px")).withColumn("v", F.col("v").cast("int"))


@query("s04_tiff_planes", V + "SELECT t, c, z, y, x, v FROM voxels")
def s04(spark, sf_dir):
    _, names = _tiffs(spark, sf_dir)
    return vx.to_voxels(tiff.planes(names).join(names, "path").select("t", "c", "z", "width", "px")).withColumn("v", F.col("v").cast("int"))


@query("s05_structure_check", V + "SELECT DISTINCT t, c, true AS ready FROM voxels")
def s05(spark, sf_dir):
    _, names = _tiffs(spark, sf_dir)
    return tiff.structure(names).join(names, "path").select("t", "c", "ready")


@query("s06_headers", V + "SELECT DISTINCT t, c, 10 AS width, 10 AS height, 10 AS slices, 1 AS frames FROM voxels")
def s06(spark, sf_dir):
    _, names = _tiffs(spark, sf_dir)
    return tiff.headers(names).join(names, "path").select("t", "c", "width", "height", "slices", "frames")


def _lines(spark, sf_dir):
    k = F.col("s_suppkey")
    lines = F.array(
        F.concat(F.lit("Pixel size at object /um: "), F.expr("cast(0.1D + s_suppkey % 7 * 0.02D as string)")), F.concat(F.lit("um per galvo DU: "), F.expr("CASE WHEN s_suppkey % 5 = 0 THEN 'NaN' ELSE '0.5' END")),
        F.lit("Galvo DUs per step: 0.5"), F.concat(F.lit("Step size /um: "), F.expr("CASE WHEN s_suppkey % 3 = 0 THEN '0.3' ELSE '0.25' END")),
        F.concat(F.lit("Tilt angle: "), F.expr("cast(s_suppkey % 100 as string)")), F.concat(F.lit("Planes per volume: "), F.expr("cast((s_suppkey % 9) / 2 as string)")), F.lit("Interval: 2 min"),
        F.lit("Camera ROI X0, X1, Y0, Y1: 0 640 100 612"),
        F.concat(F.lit("Exposure time /ms: "), F.expr("cast(s_suppkey % 4 * 10 as string)")), F.lit("Frame period /ms: none"), F.lit("Frame period /ms: 12.5"), F.lit("Frame period /ms: camera"), F.concat(F.lit("Effective detection NA: "), F.expr("CASE WHEN s_suppkey % 6 = 0 THEN '-1' ELSE '0.8' END")),
        F.lit("Emission wavelength /nm: 9"), F.concat(F.lit("Emission wavelength /nm: "), F.expr("cast(500 + s_suppkey as string)")),
    )
    return views.table(spark, sf_dir, "supplier").select(F.format_string("/data/run%d/params.txt", k).alias("path"), F.posexplode(lines).alias("n", "line")).repartition(5)


PARAM_SQL = """WITH p AS (SELECT s_suppkey AS k, 0.1e0 + s_suppkey % 7 * 0.02e0 AS pixel, CASE WHEN s_suppkey % 5 <> 0 THEN 0.25 END AS product, CASE WHEN s_suppkey % 3 = 0 THEN 0.3 ELSE 0.25 END AS step, s_suppkey % 100 AS angle, (s_suppkey % 9) / 2.0 AS planes FROM supplier) """


@query("s07_strict_parameters", PARAM_SQL + "SELECT '/data/run' || k || '/params.txt' AS path, round(pixel * 1e3, 6) AS pixel_nm, round(product * 1e3, 6) AS step_nm, angle * 1.0 AS angle, 120.0 AS interval_s FROM p WHERE product IS NOT NULL")
def s07(spark, sf_dir):
    g = text.strict_geometry(text.parameters(_lines(spark, sf_dir)))
    return g.select("path", F.round("pixel_nm", 6).alias("pixel_nm"), F.round("step_nm", 6).alias("step_nm"), "angle", "interval_s")


@query("s08_tolerant_parameters", PARAM_SQL + """SELECT '/data/run' || k || '/params.txt' AS path, round(coalesce(product, step), 6) AS step, CASE WHEN angle > 0 AND angle < 89.9 THEN angle * 1.0 END AS angle,
    CASE WHEN planes = floor(planes) AND planes >= 2 THEN CAST(planes AS INTEGER) END AS planes,
    (CASE WHEN angle <= 0 OR angle >= 89.9 THEN 1 ELSE 0 END) + (CASE WHEN product IS NOT NULL AND step > 0.26 THEN 1 ELSE 0 END) + (CASE WHEN planes <> floor(planes) OR planes < 2 THEN 1 ELSE 0 END) + (CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END) + (CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END) AS warnings,
    CASE WHEN k % 4 > 0 THEN k % 4 * 10.0 END AS exposure_ms, CASE WHEN k % 6 > 0 THEN 0.8 END AS na, 500.0 + k AS wavelength_nm, 12.5 AS period_ms FROM p""")
def s08(spark, sf_dir):
    g = text.tolerant_geometry(text.parameters(_lines(spark, sf_dir)))
    return g.select("path", F.round("step", 6).alias("step"), "angle", "planes", F.size("warnings").alias("warnings"), "exposure_ms", "na", "wavelength_nm", "period_ms")


@query("s09_planes_per_volume", PARAM_SQL + "SELECT '/data/run' || k || '/params.txt' AS path, CAST(planes AS INTEGER) AS planes FROM p WHERE planes = floor(planes) AND planes >= 2")
def s09(spark, sf_dir):
    return text.tolerant_geometry(text.parameters(_lines(spark, sf_dir))).filter("planes IS NOT NULL").select("path", "planes")


@query("s10_nearest_parameters", PARAM_SQL + "SELECT '/data/run' || k || CASE WHEN k % 2 = 0 THEN '/v.tif' ELSE '/sub/v.tif' END AS path, round(pixel, 6) AS pixel FROM p")
def s10(spark, sf_dir):
    files = views.table(spark, sf_dir, "supplier").select(F.expr("concat('/data/run', s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '/v.tif' ELSE '/sub/v.tif' END)").alias("path"))
    found = text.with_parameters(files, text.tolerant_geometry(text.parameters(_lines(spark, sf_dir))))
    return found.select("path", F.round("pixel", 6).alias("pixel"))


@query("s21_alignment_sets", """SELECT 'set' || p_partkey // 7 AS path, 'k' || p_partkey AS source, 1.0 AS m00, p_size * 1.0 AS m02, 0.0 AS m12, p_partkey % 7 = 3 AS is_reference FROM part
    UNION ALL SELECT 'bare' || p_partkey AS path, NULL, 0.5, p_size * 1.0, -1.0 * p_partkey, false FROM part WHERE p_partkey % 5 = 0""")
def s21(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    rows = F.expr("CASE WHEN p_partkey % 7 = 3 THEN array(concat('source,k', p_partkey, ',1,0,', p_size, ',0,1,0'), concat('reference,k', p_partkey)) ELSE array(concat('source,k', p_partkey, ',1,0,', p_size, ',0,1,0')) END")
    # The second row of a bare matrix comes from another partition, before the first.
    row = lambda n, e: part.filter("p_partkey % 5 = 0").select(F.expr("concat('bare', p_partkey)").alias("path"), F.lit(n).alias("n"), F.expr(e).alias("line"))
    bare = row(1, "concat('0, 1,-', p_partkey)").union(row(0, "concat('0.5,0, ', p_size)"))
    return text.alignments(part.select(F.expr("concat('set', p_partkey div 7)").alias("path"), F.posexplode(rows).alias("n", "line")).union(bare)).select("path", "source", "m00", "m02", "m12", "is_reference")


@query("s22_matrix_files", "SELECT p_partkey * 1.0 AS c0, p_size * 0.5 AS c1, 1.0 AS c2 FROM part")
def s22(spark, sf_dir):
    path = f"{shared_folder(spark)}/matrix"
    text.write_matrix(views.table(spark, sf_dir, "part").selectExpr("p_partkey * 1.0D", "p_size * 0.5D", "1.0D"), path)
    return text.read_matrix(spark, path, 3)


@query("s24_study_export", "SELECT p_partkey AS id, CASE WHEN p_size % 3 > 0 THEN p_size * 0.25 END AS score FROM part")
def s24(spark, sf_dir):
    folder = shared_folder(spark)
    rows = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("CASE WHEN p_size % 3 > 0 THEN p_size * 0.25D ELSE double('NaN') END").alias("score"))
    text.export_study(rows, folder)
    return spark.read.schema("id long, score double").json(f"{folder}/rows.json")


@query("s25_manifest_log", LOG_SQL + "SELECT * FROM m")
def s25(spark, sf_dir):
    path = f"{shared_folder(spark)}/manifest"
    log = _log(spark, sf_dir)
    text.append_manifest(log.filter("seq % 2 = 0"), path)
    text.append_manifest(log.filter("seq % 2 = 1"), path)
    return cat.latest_manifest(text.read_manifest(spark, path))


@query("r17_follow_store", V + "SELECT DISTINCT t, printf('t%06d', CAST(t AS INTEGER)) AS label FROM voxels")
def r17(spark, sf_dir):
    from lamella.streaming.sources import GrowingStore

    root = _store(spark, sf_dir)
    spark.dataSource.register(GrowingStore)
    return drain(spark.readStream.format("growing_store").load(root)).select(F.col("t").cast("long").alias("t"), "label")


@query("r01_looks_by_tasks", V + "SELECT DISTINCT printf('v_Time%06d_Channel%04d.tif', CAST(t AS INTEGER), CAST(c AS INTEGER)) AS name, t % 3 = 1 AS gone FROM voxels WHERE t % 3 < 2")
def r01b(spark, sf_dir):
    """Two looks at a folder of which, between them, some files are taken away and some come back with an older time."""
    from lamella.functions.names import base_name

    root, _ = _tiffs(spark, sf_dir)
    kept = shared_folder(spark)
    takes = sorted(n for n in os.listdir(root) if n.endswith(".tif"))
    before = looks.take_look(spark, root, kept, 1, (".tif",))
    for name in takes:
        time = int(name[6:12])
        if time % 3 == 1:
            os.remove(f"{root}/{name}")
        elif time % 3 == 0:
            os.utime(f"{root}/{name}", (10**9, 10**9))
    told = looks.changes(before, looks.take_look(spark, root, kept, 2, (".tif",)))
    return told.select(base_name(F.col("path")).alias("name"), (F.col("size") == -1).alias("gone"))


@query("r01_folder_listing", V + "SELECT DISTINCT printf('v_Time%06d_Channel%04d.tif', CAST(t AS INTEGER), CAST(c AS INTEGER)) AS name FROM voxels")
def r01(spark, sf_dir):
    from lamella.functions.names import base_name
    from lamella.streaming.sources import FolderListing

    root, _ = _tiffs(spark, sf_dir)
    spark.dataSource.register(FolderListing)
    return drain(spark.readStream.format("folder_listing").options(suffixes=".tif", listings=_folder(spark)).load(root)).select(base_name(F.col("path")).alias("name"))
