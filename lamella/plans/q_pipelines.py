"""Queries of user-level jobs."""

import os

from pyspark.sql import functions as F

from lamella.functions import names as nm
from lamella.functions import provenance
from lamella.operators import alignment as al, conversion as cv, pipelines as pl, project as pj, voxels as vx
from lamella.operators.beads import combined
from lamella.plans import views
from lamella.plans.q_kernels import IMAGES_SQL, bead_pairs, deskew_sql
from lamella.plans.q_points import RADIUS, bead_kernels, bead_places
from lamella.plans.registry import query
from lamella.sources import ome_zarr, text, tiff
from lamella.streaming.jobs import shared_folder

V = f"WITH {views.VOXELS} "
GEOMETRY = (0.265, 0.116, 25.0)
EXTENTS = (10, 10, 10)


def _v(spark, sf_dir):
    return views.voxels(spark, sf_dir)


def _folder(spark) -> str:
    return shared_folder(spark).removeprefix("file:").replace("//", "/")


HALVES = ", ch AS (SELECT t, 2 * c - CASE WHEN x < 5 THEN 1 ELSE 0 END AS c, z, y, CASE WHEN x < 5 THEN x ELSE x - 5 END AS x, v FROM voxels), " + deskew_sql("dk", "ch", 5)


@query("x01_batch_deskew", V + HALVES + """ SELECT t, c, 'X' AS view, y AS h, z AS w, max(v) AS max_v, least((sum(v) + count(*) // 2) // count(*), 65535) AS mean_v FROM dk GROUP BY t, c, y, z
    UNION ALL SELECT t, c, 'Y', z, x, max(v), least((sum(v) + count(*) // 2) // count(*), 65535) FROM dk GROUP BY t, c, x, z
    UNION ALL SELECT t, c, 'Z', y, x, max(v), least((sum(v) + count(*) // 2) // count(*), 65535) FROM dk GROUP BY t, c, x, y""")
def x01(spark, sf_dir):
    return pl.batch_deskew(_v(spark, sf_dir), *GEOMETRY, EXTENTS)[1]


@query("x02_split_run_join", V + ", " + deskew_sql("dk", "voxels", 10) + " SELECT * FROM dk")
def x02(spark, sf_dir):
    return pl.split_deskew(_v(spark, sf_dir), *GEOMETRY, EXTENTS, parts=3)


# Channels 2 and 4 are moved right by half a pixel: each is the mean of two neighbours, and nothing at the left edge.
@query("x03_multi_channel", V + HALVES + """, al AS (SELECT t, c, z, y, x, v FROM dk WHERE c IN (1, 3) UNION ALL
    SELECT a.t, a.c, a.z, a.y, a.x, CASE WHEN a.x = 0 THEN 0 ELSE CAST(floor((a.v + b.v) / 2.0 + 0.5) AS BIGINT) END FROM dk a LEFT JOIN dk b ON b.t = a.t AND b.c = a.c AND b.z = a.z AND b.y = a.y AND b.x = a.x - 1 WHERE a.c IN (2, 4))
    SELECT t, CASE c WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS c, z, y, x, v FROM al WHERE c <> 3""")
def x03(spark, sf_dir):
    shift = [1.0, 0.0, 0.5, 0.0, 1.0, 0.0]
    return pl.multi_channel(_v(spark, sf_dir), EXTENTS, {2: shift, 4: shift}, [(2, 1), (1, 2), (4, 3)], GEOMETRY)


# The same with the right halves mirrored before they are moved.
@query("x03_mirrored_channels", V + HALVES.replace("CASE WHEN x < 5 THEN x ELSE x - 5 END AS x", "CASE WHEN x < 5 THEN x ELSE 9 - x END AS x") + """, al AS (SELECT t, c, z, y, x, v FROM dk WHERE c IN (1, 3) UNION ALL
    SELECT a.t, a.c, a.z, a.y, a.x, CASE WHEN a.x = 0 THEN 0 ELSE CAST(floor((a.v + b.v) / 2.0 + 0.5) AS BIGINT) END FROM dk a LEFT JOIN dk b ON b.t = a.t AND b.c = a.c AND b.z = a.z AND b.y = a.y AND b.x = a.x - 1 WHERE a.c IN (2, 4))
    SELECT t, c, z, y, x, v FROM al""")
def x03b(spark, sf_dir):
    shift = [1.0, 0.0, 0.5, 0.0, 1.0, 0.0]
    return pl.multi_channel(_v(spark, sf_dir), EXTENTS, {2: shift, 4: shift}, [(k, k) for k in (1, 2, 3, 4)], GEOMETRY, mirrored=(2, 4))


@query("x04_canonical_halves", V + "SELECT t, 2 * c - CASE WHEN x < 5 THEN 1 ELSE 0 END AS c, z, y, CASE WHEN x < 5 THEN x ELSE x - 5 END AS x, v FROM voxels")
def x04(spark, sf_dir):
    return pl.canonical_halves(_v(spark, sf_dir), 10)


@query("x05_projection_batch", V + "SELECT t, c, CASE WHEN x < 5 THEN 'left' ELSE 'right' END AS part, y, CASE WHEN x < 5 THEN x ELSE x - 5 END AS x, max(v) AS v FROM voxels GROUP BY ALL")
def x05(spark, sf_dir):
    return pj.projection(vx.channel_parts(_v(spark, sf_dir), 10, "separate"), "z", "max", ("t", "c", "part"))


@query("x06_channel_operation", V + """, p AS (SELECT t FROM voxels GROUP BY t HAVING count(DISTINCT c) = 2), f AS (SELECT t, c, z, y, CASE WHEN c = 2 THEN 9 - x ELSE x END AS x, v FROM voxels JOIN p USING (t)) SELECT t, c, y, x, max(v) AS v FROM f GROUP BY ALL""")
def x06(spark, sf_dir):
    v = _v(spark, sf_dir)
    paired = v.groupBy("t").agg(F.countDistinct("c").alias("n")).filter("n = 2").select("t")
    both = v.join(paired, "t").withColumn("x", F.when(F.col("c") == 2, 9 - F.col("x")).otherwise(F.col("x")))
    return pj.projection(both, "z", "max")


@query("x07_deconvolution_batch")
def x07(spark, sf_dir):
    """Kernels from the accepted beads of each channel, then the deconvolution of all volumes with them."""
    psf = combined(bead_kernels(spark, sf_dir).join(bead_places(spark, sf_dir).select("bead", "c"), "bead"), ["c"], "mean")
    done = pl.deconvolution_batch(_v(spark, sf_dir), psf, RADIUS, EXTENTS, (5, 10, 10), rounds=3, variation=0.01)
    return pj.projection(done.withColumn("v", F.floor("v").cast("long")), "z", "max")


@query("x08_format_conversion", V + "SELECT t, c, z, y, x, v FROM voxels")
def x08(spark, sf_dir):
    from lamella.plans.q_sources import _store, _whole, s04

    return _whole(spark, _store(spark, sf_dir, s04(spark, sf_dir)))


def _raw_files(spark, sf_dir):
    """Plain TIFF files of all volumes, with their places in a plan."""
    from lamella.plans.q_sources import _tiffs

    root, names = _tiffs(spark, sf_dir, deflate="false")
    return root, names.select("path", "t", (F.col("c") - 1).alias("c"), F.format_string("t%06d", "t").alias("label"))


@query("x08_resumed_store", V + "SELECT t, 2 * (c - 1) + CASE WHEN x < 5 THEN 0 ELSE 1 END AS c, z, y, CASE WHEN x < 5 THEN x ELSE x - 5 END AS x, v FROM voxels")
def x08b(spark, sf_dir):
    """Files into a store of halves: a first run has only the first half of them, the second goes on in its store."""
    _, files = _raw_files(spark, sf_dir)
    root = _folder(spark) + "/converted.zarr"
    half = files.agg(F.max("t")).first()[0] // 2
    cv.files_to_store(files.filter(F.col("t") <= half), root, split=True, chunk=4)
    cv.files_to_store(files, root, split=True, chunk=4)
    return ome_zarr.voxels(spark, root)


@query("x08_store_to_files", V + "SELECT t, c - 1 AS c, z, y, x, v FROM voxels")
def x08c(spark, sf_dir):
    """A store into deflated files; one of them is taken away, and only that one is written again."""
    from lamella.plans.q_sources import _store

    root, folder = _store(spark, sf_dir), _folder(spark)
    first = cv.store_to_files(spark, root, folder)
    os.remove(f"{folder}/{cv.NAME % (0, 0)}")
    again = cv.store_to_files(spark, root, folder)
    if (first, again) != (ome_zarr.metadata(root)["committed"] * ome_zarr.metadata(root)["shape"][1], 1):
        raise AssertionError(f"{first} files, then {again}")
    names = views.voxels(spark, sf_dir).select("t", (F.col("c") - 1).alias("c")).distinct().withColumn("path", F.concat(F.lit(folder + "/"), F.format_string(cv.NAME, "t", "c")))
    return vx.to_voxels(tiff.planes(names, "t", "c").select("t", "c", "z", "width", "px")).withColumn("v", F.col("v").cast("int"))


@query("x08_deflated_files", V + "SELECT t, c - 1 AS c, true AS deflated, sum(v) AS total FROM voxels GROUP BY t, c")
def x08d(spark, sf_dir):
    """Plain files deflated into another folder."""
    root, files = _raw_files(spark, sf_dir)
    folder = _folder(spark)
    named = files.withColumn("name", F.substring_index("path", "/", -1))
    cv.deflate_files(named.select("path", "name"), folder)
    done = named.withColumn("path", F.concat(F.lit(folder + "/"), F.col("name")))
    sums = tiff.planes(done, "t", "c").groupBy("path", "t", "c").agg(F.sum(F.aggregate("px", F.lit(0.0), lambda a, v: a + v)).cast("long").alias("total"))
    return sums.join(tiff.deflated(done), "path").select("t", "c", "deflated", "total")


@query("x11_view", V + "SELECT t, c, z - 2 AS z, y - 1 AS y, CASE WHEN x < 5 THEN x - 1 ELSE 12 - x END AS x, v FROM voxels WHERE c = 1 AND z BETWEEN 2 AND 6 AND y BETWEEN 1 AND 8 AND x BETWEEN 1 AND 8")
def x11(spark, sf_dir):
    box = vx.clamp_box(1, 1, 8, 8, 2, 6, 10, 10, 10)
    return pl.view(_v(spark, sf_dir), [1], box, "side_by_side", 10)


# The known map of channel 2 onto channel 1, then a correction by hand of three pixels to the right and one up.
@query("x12_channel_calibration", IMAGES_SQL + "SELECT '_Channel' || printf('%04d', image) || '-right' AS source, round(cos(radians(0.05 * (image % 7))), 4) AS m00, image % 11 - 20 + 3 AS m02, 5 - image % 9 - 1 AS m12 FROM i")
def x12(spark, sf_dir):
    folder = shared_folder(spark) + "/alignments"
    shift = [F.lit(v) for v in (1.0, 0.0, 3.0, 0.0, 1.0, -1.0)]
    found = al.calibrate(*bead_pairs(spark, sf_dir), ["image"], adjust=shift)
    al.saved_set(found.filter("method = 'beads'"), folder, nm.source_key(F.col("image"), F.lit("right")))
    lines = spark.read.text(folder).select(F.lit("set").alias("path"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    got = text.alignments(lines)
    return got.select("source", F.round("m00", 4).alias("m00"), F.round("m02").cast("long").alias("m02"), F.round("m12").cast("long").alias("m12"))


@query("j07_composed_channels", V + "SELECT t, CASE c WHEN 2 THEN 0 ELSE 1 END AS c, z, y, x, v FROM voxels")
def j07(spark, sf_dir):
    return pl.compose(_v(spark, sf_dir), [(2, 0), (1, 1)])


@query("p31_recorded_view", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 < 2 THEN 0.1 + (o_orderkey % 5) * 0.01 END AS pixel, CASE WHEN o_orderkey % 3 < 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'L1' ELSE 'L1,R2' END END AS sources FROM orders""")
def p31(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_json(F.struct(
        F.expr("CAST(o_orderkey % 3 + 1 AS INT)").alias("version"), F.expr("0.1D + (o_orderkey % 5) * 0.01D").alias("pixel"), F.lit(25.0).alias("angle"),
        F.expr("CASE WHEN o_orderkey % 2 = 0 THEN array(array('L1', 'skip')) ELSE array(array('L1', 'R2')) END").alias("sources"),
    )).alias("record"))
    r = provenance.parse(F.col("record"))
    kept = F.filter(r["sources"][0], lambda s: s != "skip")
    return o.select("id", F.round(r["pixel"], 6).alias("pixel"), F.when(r.isNotNull(), F.array_join(kept, ",")).alias("sources"))


# Recorded pitches: of the pixel, as old writers gave them, anisotropic on purpose (not quite the old ones), none.
# By the order's number: combined halves or whole widths with skipped slots, single files with every option, one that is not known, none, raw data.
@query("p31_view_of_settings", """WITH o AS (SELECT o_orderkey AS id, o_orderkey % 11 AS k, o_orderkey % 3 = 0 AS combine, o_orderkey % 2 = 0 AS flip_left, o_orderkey % 7 AS w FROM orders),
    s AS (SELECT *, combine AND w <> 5 AS combined, w = 4 AS whole FROM o),
    r AS (SELECT id, CASE WHEN k = 10 THEN NULL WHEN combined THEN CASE WHEN whole THEN 'side_by_side' WHEN flip_left THEN 'flip_align_left' ELSE 'flip_align_right' END
        ELSE CASE k WHEN 0 THEN 'side_by_side' WHEN 1 THEN 'flip' WHEN 2 THEN 'flip_align_right' WHEN 3 THEN 'flip_align_right' WHEN 4 THEN 'stored' WHEN 5 THEN 'stored' WHEN 6 THEN 'stored' END END AS operation,
      CASE WHEN combined THEN 'configured' WHEN k = 4 THEN 'left' WHEN k = 5 THEN 'right' ELSE 'all' END AS selection, CASE WHEN NOT combined THEN '' WHEN whole THEN '_Channel0002-whole,_Channel0001-whole' ELSE '_Channel0002-right,_Channel0001-left' END AS sources,
      CASE WHEN combined AND NOT whole AND flip_left THEN 'left' ELSE 'right' END AS flip_half FROM s)
    SELECT id, operation, CASE WHEN operation IS NOT NULL THEN selection END AS selection, CASE WHEN operation IS NOT NULL THEN sources END AS sources, CASE WHEN operation IS NOT NULL THEN flip_half END AS flip_half FROM r""")
def p31b(spark, sf_dir):
    options = F.array(*[F.lit(x) for x in [*provenance.SINGLE_FILE, "by hand", None, None, "whole image"]])
    order = "CASE o_orderkey % 7 WHEN 5 THEN array('skip', NULL) WHEN 4 THEN array('_Channel0002-whole', 'skip', '_Channel0001-whole') ELSE array('_Channel0002-right', 'skip', '_Channel0001-left', 'skip') END"
    o = views.table(spark, sf_dir, "orders")
    k = F.expr("CAST(o_orderkey % 11 AS INT)")
    view = provenance.view_of_settings(F.get(options, k), F.col("o_orderkey") % 3 == 0, F.expr(order), F.expr("if(o_orderkey % 2 = 0, 'left', 'right')"), F.lit(True), k == 10)
    return o.select(F.col("o_orderkey").alias("id"), view.alias("v")).select("id", "v.operation", "v.selection", F.array_join("v.sources", ",").alias("sources"), "v.flip_half")


@query("h13_provenance_voxel", """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '0.116,0.116,0.116' WHEN 1 THEN '0.116,0.116,0.116' WHEN 2 THEN '0.116,0.105,0.112' END AS voxel, o_orderkey % 4 = 1 AS legacy FROM orders""")
def h13(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_json(F.struct(
        F.lit(2).alias("version"), F.lit(0.116).alias("pixel"), F.lit(0.265).alias("step"), F.lit(25.0).alias("angle"),
        F.expr("CASE o_orderkey % 4 WHEN 0 THEN array(0.116D, 0.116D, 0.116D) WHEN 1 THEN array(0.116D, 0.116D * cos(radians(25D)), 0.265D * sin(radians(25D))) WHEN 2 THEN array(0.116D, 0.105D, 0.112D) END").alias("voxel"),
    )).alias("record"))
    record = provenance.parse(F.col("record"))
    return o.select("id", F.array_join(F.transform(provenance.voxel_size(record), lambda v: v.cast("string")), ",").alias("voxel"), provenance.legacy_voxels(record).alias("legacy"))
