"""Operators against closed forms and small numpy references."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.functions import matrix as mx, model, names as nm
from lamella.operators import alignment as al, beads, catalogue as cat, kernels, pipelines as pl, project as pj, resample as rs, voxels as vx
from lamella.sources import ome_zarr, text, tiff
from lamella.streaming import jobs, state


def ramp(spark, w=7, h=5, d=3):
    """A value distinct per voxel."""
    rows = [(0, 1, z, y, x, x + 7 * y + 35 * z) for z in range(d) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "t long, c long, z long, y long, x long, v long")


def cube(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.z, r.y, r.x] = r.v
    return out


def test_two_channel_projections(spark):
    """The worked example: v = 100 c + 6 z + index + 1 on a 3x2 plane, two planes, two channels."""
    rows = [(0, c, z, i // 3, i % 3, 100 * c + 6 * z + i + 1) for c in (0, 1) for z in (0, 1) for i in range(6)]
    v = spark.createDataFrame(rows, "t long, c long, z long, y long, x long, v long")
    six = {(r.c, r.view, r.h, r.w): (r.max_v, r.mean_v) for r in pj.six_projections(v).collect()}
    assert six[0, "X", 0, 0] == (3, 2) and six[0, "Z", 0, 0] == (7, 4) and six[1, "Z", 0, 0][0] == 107


@pytest.mark.parametrize("order", vx.ORDERS)
def test_permutations(spark, order):
    a = cube(ramp(spark), (3, 5, 7))
    got = vx.permute(ramp(spark), order)
    axes = {"x": 2, "y": 1, "z": 0}
    expected = a.transpose(axes[order[2]], axes[order[1]], axes[order[0]])
    assert np.array_equal(cube(got, expected.shape), expected)


def test_flip_twice_and_unknown_order(spark):
    v = ramp(spark)
    back = vx.flip(vx.flip(v, "x", 7), "x", 7)
    assert np.array_equal(cube(back, (3, 5, 7)), cube(v, (3, 5, 7)))
    assert vx.permute(v, "abc") is v


def test_scale_keeps_both_ends(spark):
    got = cube(vx.scale(ramp(spark), {"x": (7, 13), "z": (3, 5)}), (5, 5, 13))
    a = cube(ramp(spark), (3, 5, 7))
    assert np.allclose(got[::2, :, ::2], a) and np.allclose(got[1, :, 0], (a[0, :, 0] + a[1, :, 0]) / 2)


def test_region_is_clamped_and_never_empty():
    assert vx.clamp_box(-5, 100, 0, 3, 2, 1, 10, 8, 4) == (0, 9, 7, 7, 2, 2)


def test_deskew_matrix_and_back():
    m = mx.deskew(0.265, 0.116, 25.0, 40)
    assert m[1, 1] == pytest.approx(math.cos(math.radians(25))) and m[1, 2] == pytest.approx(0.265 / 0.116)
    assert np.allclose(np.linalg.inv(m) @ m, np.eye(4))


def test_alignment_relation_equals_the_plane_kernel(spark):
    rng = np.random.RandomState(0)
    image = rng.randint(0, 1000, (12, 9)).astype(float)
    m = [math.cos(0.03), -math.sin(0.03), 1.3, math.sin(0.03), math.cos(0.03), -0.7]
    rows = [(0, 1, 0, y, x, int(image[y, x])) for y in range(12) for x in range(9)]
    v = spark.createDataFrame(rows, "t long, c long, z long, y long, x long, v long")
    for mirror in (False, True):
        got = cube(rs.align_voxels(v, m, 9, 12, mirror), (1, 12, 9))[0]
        assert np.array_equal(got, rs.align_plane(image, m, "linear", mirror))


def test_virtual_slice_equals_the_volume(spark):
    rng = np.random.RandomState(1)
    rows = [(0, 1, z, y, x, int(rng.randint(0, 500))) for z in range(8) for y in range(9) for x in range(4)]
    v = spark.createDataFrame(rows, "t long, c long, z long, y long, x long, v long")
    whole = rs.deskew(v, 0.2, 0.1, 30.0, (4, 9, 8))
    for z in (0, 1, 3):
        a = {(r.y, r.x): r.v for r in whole.filter(F.col("z") == z).collect()}
        b = {(r.y, r.x): r.v for r in rs.virtual_slice(v, 0.2, 0.1, 30.0, (4, 9, 8), z).collect()}
        assert a == b


def test_coverage_contains_every_sampled_cell():
    cells = {p: (a, b) for p, a, b in rs.covered_planes(0.265, 0.116, 25.0, (10, 40, 30), (3, 6), (20, 40))}
    inv = np.linalg.inv(mx.deskew(0.265, 0.116, 25.0, 40))
    for z in np.linspace(3, 6, 7):
        for y in np.linspace(20, 40, 41):
            yr, zr = inv[1, 1] * y + inv[1, 2] * z + inv[1, 3], inv[2, 1] * y + inv[2, 2] * z + inv[2, 3]
            if 0 <= yr <= 39 and 0 <= zr <= 29:
                for p in {math.floor(zr), math.ceil(zr)}:
                    assert p in cells and cells[p][0] <= math.floor(yr) and math.ceil(yr) <= cells[p][1]


def _turned(m, degrees, shift):
    a = math.radians(degrees)
    return m @ np.array([[math.cos(a), math.sin(a)], [-math.sin(a), math.cos(a)]]) + shift


def test_refined_fit_ignores_outliers():
    rng = np.random.RandomState(3)
    m = rng.uniform(0, 500, (120, 2))
    f = np.vstack([rng.uniform(0, 500, (30, 2)), _turned(m[30:], 0.4, [12.0, -7.0])])
    (a, dx, dy), pairs, rms = al.refined(f, m, (0.0, 10.0, -6.0))
    assert math.degrees(a) == pytest.approx(0.4, abs=1e-6) and (dx, dy) == pytest.approx((12.0, -7.0), abs=1e-4) and pairs >= 85 and rms < 1e-6
    assert al.consensus(rng.uniform(0, 500, (60, 2)), rng.uniform(0, 500, (60, 2)), 1.25) is None
    assert al.vote(_turned(m, 0.0, [12.2, -6.1]), m) == (0.0, 12.0, -6.0)


def bead_field(points, side=128):
    y, x = np.mgrid[0:side, 0:side]
    return 100 + sum(900 * np.exp(-((x - a) ** 2 + (y - b) ** 2) / 8.0) for a, b in points)


def test_spots_and_coarse_shift():
    points = [(30.3, 40.7), (70.0, 35.2), (90.6, 88.1), (45.5, 95.9), (64.2, 64.8)]
    found = al.spots_of(bead_field(points))[:, :2]
    assert len(found) == 5
    for a, b in points:
        assert np.hypot(*(found - [a, b]).T).min() < 0.1
    dx, dy, score = al.coarse_shift(bead_field(points), bead_field([(a - 12, b + 8) for a, b in points]))
    assert (dx, dy) == (12, -8) and score > 0.9
    assert len(al.spots_of(np.zeros((8, 8)))) == 0


def test_deconvolution_sharpens_and_keeps_the_sum():
    image = np.zeros((9, 9, 9))
    image[4, 4, 4] = 1000.0
    psf = np.exp(-0.5 * sum(g**2 for g in np.mgrid[-1:2, -1:2, -1:2]))
    kernel = np.zeros_like(image)
    kernel[3:6, 3:6, 3:6] = 1000 * psf / psf.sum()
    out = kernels.richardson_lucy(kernel, psf, 30)
    assert out[4, 4, 4] > 3 * kernel[4, 4, 4] and out.sum() == pytest.approx(1000, rel=0.01)


def test_components_and_maxima():
    mask = np.array([[1, 1, 0, 1], [0, 1, 0, 1], [1, 0, 0, 0]], bool)
    assert len(np.unique(kernels.components_of(mask))) - 1 == 3
    image = np.array([[0, 0, 0, 0, 0], [0, 9, 5, 7, 0], [0, 0, 0, 0, 0]], float)
    assert kernels.prominent_maxima(image, 1.0) == [(1, 1), (1, 3)] and kernels.prominent_maxima(image, 4.0) == [(1, 1)]


def test_padded_psf():
    psf = np.full((3, 3, 3), 2.0, np.float32)
    assert beads.padded(psf, (5, 5, 5)).sum() == 54 and beads.padded(psf, (5, 5, 5), "mean")[0, 0, 0] == 2


def test_name_tokens(spark):
    paths = ["a_Time0001_Time0002.tif", "a_Time0003_Channel0002.tif", "a.tif", "a_Time99999999999.tif", "a_Frames_9_2.tif", "a_Frames_1_5.tif"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [(r.t.state, r.t.value, r.f.state, r.f.last) for r in df.select(nm.token(F.col("path"), "time").alias("t"), nm.frame_range(F.col("path")).alias("f")).collect()]
    assert got == [("invalid", None, "absent", None), ("valid", 3, "absent", None), ("absent", None, "absent", None), ("invalid", None, "absent", None), ("absent", None, "invalid", None), ("absent", None, "valid", 5)]


def test_incomplete_time_points_are_left_out(spark):
    rows = [(1, 1, 1, 1, 1), (1, 1, 2, 6, 2), (1, 2, 1, 6, 3), (1, 2, 2, 6, 4), (1, 3, 1, 9, 5)]
    files = spark.createDataFrame(rows, "position long, time_id long, channel long, s long, size long").withColumn("mtime", F.timestamp_seconds("s"))
    got = {r.time_id: (r["index"], r.elapsed) for r in cat.complete_points(files).collect()}
    assert got == {1: (1, 0), 2: (2, 5)}


def test_store_round_trip_and_recovery(spark, tmp_path):
    spark.dataSource.register(ome_zarr.OmeZarr)
    v = ramp(spark).withColumn("c", F.lit(0).cast("long"))
    root = f"{tmp_path}/s.zarr"
    ome_zarr.to_chunks(v, 4).write.format("ome_zarr").option("shape", "1,1,3,5,7").option("chunk", 4).mode("append").save(root)
    part = v.withColumn("t", F.lit(1).cast("long")).filter("z < 2")
    ome_zarr.to_chunks(part, 4).write.format("ome_zarr").option("shape", "2,1,3,5,7").option("chunk", 4).mode("append").save(root)
    assert ome_zarr.metadata(root)["committed"] == 1  # the half-written time point is not seen
    got = ome_zarr.to_voxels(spark.read.format("ome_zarr").option("box", "0:3,0:5,3:7").load(root))
    assert np.array_equal(cube(got, (3, 5, 7))[:, :, 3:], cube(v, (3, 5, 7))[:, :, 3:])
    ome_zarr.to_chunks(v.withColumn("t", F.lit(1).cast("long")), 4).write.format("ome_zarr").option("shape", "2,1,3,5,7").option("chunk", 4).mode("append").save(root)
    assert ome_zarr.metadata(root)["committed"] == 2
    with pytest.raises(Exception, match="cannot append"):
        ome_zarr.to_chunks(v, 4).write.format("ome_zarr").option("shape", "1,1,3,5,9").option("chunk", 4).mode("append").save(root)


def test_sparse_volumes_are_whole_and_attributes_stay(spark, tmp_path):
    """A volume filled in one corner commits; an append keeps alignment and labels; overwriting leaves no old chunk behind."""
    spark.dataSource.register(ome_zarr.OmeZarr)
    root = f"{tmp_path}/s.zarr"
    corner = spark.createDataFrame([(0, 0, 0, 0, x, 5) for x in range(3)], "t long, c long, z long, y long, x long, v long")
    ome_zarr.write_store(corner, root, (9, 9, 2), 1, 1, 4, labels='["one"]', windows="[[3, 70]]")
    assert ome_zarr.metadata(root)["committed"] == 1
    got = ome_zarr.to_voxels(spark.read.format("ome_zarr").load(root))
    assert got.count() == 9 * 9 * 2 and got.agg(F.sum("v")).first()[0] == 15
    ome_zarr.set_alignment(root, {"right": [1, 0, 2, 0, 1, 0]}, "file")
    ome_zarr.write_store(corner.withColumn("t", F.lit(1).cast("long")), root, (9, 9, 2), 2, 1, 4)
    attrs = ome_zarr._load(f"{root}/.zattrs")
    assert ome_zarr.metadata(root)["committed"] == 2 and attrs["opm_provenance"]["alignSource"] == "file" and attrs["omero"]["channels"][0]["window"]["end"] == 70
    other = corner.withColumn("v", F.lit(9))
    ome_zarr.to_chunks(other.filter("x < 1"), 4).write.format("ome_zarr").options(shape="2,1,2,9,9", chunk=4).mode("overwrite").save(root)
    assert ome_zarr.metadata(root)["committed"] == 0  # most chunks are missing, and the old ones do not count
    ome_zarr.write_store(other, root, (9, 9, 2), 1, 1, 4, mode="overwrite")
    got = ome_zarr.to_voxels(spark.read.format("ome_zarr").load(root))
    assert got.agg(F.sum("v")).first()[0] == 27 and ome_zarr.metadata(root)["committed"] == 1


def test_a_time_point_waits_for_its_projections(spark, tmp_path):
    spark.dataSource.register(ome_zarr.OmeZarr)
    root = f"{tmp_path}/p.zarr"
    v = ramp(spark).withColumn("c", F.lit(0).cast("long"))
    flat = pj.projection(v, "z", "max").select("t", "c", F.col("y").alias("h"), F.col("x").alias("w"), "v")
    ome_zarr.write_store(v, root, (7, 5, 3), 1, 1, 4, views={"maxZ": flat})
    got = ome_zarr.to_voxels(spark.read.format("ome_zarr").option("projection", "maxZ").load(root))
    assert np.array_equal(cube(got, (1, 5, 7))[0], cube(v, (3, 5, 7)).max(axis=0))
    ome_zarr.write_store(v.withColumn("t", F.lit(1).cast("long")), root, (7, 5, 3), 2, 1, 4)
    assert ome_zarr.metadata(root)["committed"] == 1  # its projection is not there


def test_exports_refuse_what_exists(spark, tmp_path):
    spark.dataSource.register(ome_zarr.OmeZarr)
    v = ramp(spark)
    target = pl.region_export(v, f"{tmp_path}/e.zarr", vx.clamp_box(1, 1, 3, 3, 0, 1, 7, 5, 3), [1], (0, 0))
    assert cube(ome_zarr.to_voxels(spark.read.format("ome_zarr").load(target)), (2, 3, 3))[1, 2, 2] == 3 + 7 * 3 + 35
    with pytest.raises(FileExistsError):
        pl.region_export(v, target, vx.clamp_box(0, 0, 2, 2, 0, 0, 7, 5, 3), [1], (0, 0))
    pl.region_export(v, target, vx.clamp_box(0, 0, 2, 2, 0, 0, 7, 5, 3), [1], (0, 0), overwrite=True)
    assert ome_zarr.metadata(target)["shape"] == [1, 1, 1, 2, 2]


def test_folder_looks_tell_older_and_removed_files(tmp_path):
    """A file copied in with an older time is new, a changed one is told again, a removed one has size -1; batches can be told again."""
    import os

    from lamella.streaming.sources import FolderReader

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "b.tif").write_text("bb")
    reader = FolderReader({"path": str(folder), "listings": str(tmp_path / "looks"), "suffixes": ".tif"})
    names = lambda rows: [(os.path.basename(p), n) for p, n, _ in rows]
    rows, one = reader.read(reader.initialOffset())
    assert names(rows) == [("b.tif", 2)]
    (folder / "a.tif").write_text("a")
    os.utime(folder / "a.tif", (1, 1))
    (folder / "c.txt").write_text("c")
    rows, two = reader.read(one)
    assert names(rows) == [("a.tif", 1)]
    (folder / "b.tif").unlink()
    (folder / "a.tif").write_text("aaa")
    rows, three = reader.read(two)
    assert names(rows) == [("a.tif", 3), ("b.tif", -1)]
    assert names(reader.readBetweenOffsets(one, two)) == [("a.tif", 1)] and names(reader.readBetweenOffsets(two, three)) == [("a.tif", 3), ("b.tif", -1)]
    rows, same = reader.read(three)
    assert list(rows) == [] and same == three


def test_announcements_over_a_socket(spark):
    """Paths of a line protocol, blank lines ignored."""
    import socket
    import threading
    import time

    from lamella.streaming.sources import announcements

    server = socket.socket()
    server.bind(("127.0.0.1", 0))
    server.listen(1)
    stop = threading.Event()

    def serve():
        connection, _ = server.accept()
        connection.sendall(b"/data/a.tif\n\n  /data/b.tif \n")
        stop.wait(60)
        connection.close()

    threading.Thread(target=serve, daemon=True).start()
    query = announcements(spark, "127.0.0.1", server.getsockname()[1]).writeStream.format("memory").queryName("announced").start()
    try:
        for _ in range(60):
            if spark.table("announced").count() == 2:
                break
            time.sleep(0.5)
        assert sorted(r.path for r in spark.table("announced").collect()) == ["/data/a.tif", "/data/b.tif"]
    finally:
        query.stop()
        stop.set()
        server.close()


def test_tiff_round_trip_and_half_written_files(tmp_path):
    planes = [np.arange(35, dtype="<u2").reshape(5, 7) * (k + 1) for k in range(4)]
    for deflate in (False, True):
        path = f"{tmp_path}/{deflate}.tif"
        raw = tiff.encode(planes, "ImageJ=1\nimages=4\nslices=4\n", deflate)
        with open(path, "wb") as f:
            f.write(raw)
        assert tiff.ready(path)
        assert all(np.array_equal(tiff.read_plane(path, t, o), p) for (t, o), p in zip(tiff.directories(path), planes))
        with open(path, "wb") as f:
            f.write(raw[: len(raw) - 40])
        assert not tiff.ready(path)


def test_tolerant_parameters(spark):
    lines = [("/a/p.txt", x) for x in ("Step size /um: 0.3", "um per galvo DU: NaN", "Tilt angle: 95", "Planes per volume: 12", "Pixel size /um: 6.5", "System magnification: 50")]
    r = text.tolerant_geometry(text.parameters(spark.createDataFrame([(p, n, x) for n, (p, x) in enumerate(lines)], "path string, n int, line string"))).first()
    assert (r.step, r.angle, r.planes) == (0.3, None, 12) and r.pixel == pytest.approx(0.13) and r.warnings == ["Invalid Tilt angle"]


def test_file_state_machine():
    seen, known = [], None
    looks = [(5, 1, 3, 4), (8, 2, 4, 4), (8, 2, 4, 4), (9, 3, 5, 4), (9, 3, 5, 4), (-1, 0, None, None), (9, 4, 4, 4)]
    for size, mtime, planes, expected in looks:
        now, _ = state.next_state(known, size, mtime, planes, expected)
        seen.append(now)
        known = (size, mtime, now)
    assert seen == ["PENDING", "PENDING", "COMPLETE", "CHANGED", "FAILED", "REMOVED", "PENDING"]


def test_layout_decisions():
    assert state.layout_of([(1, None)], False) == ("single", [1])
    assert state.layout_of([(1, 2), (2, 2)], False) == ("single", [2])
    assert state.layout_of([(1, 1), (1, 3), (2, 1)], False) == ("multi", [1, 2, 3])
    assert state.layout_of([(1, 1), (2, 2)], False) == ("ambiguous", [1])
    assert state.layout_of([(1, 1)], False) is None and state.layout_of([(1, 1)], True) == ("single", [1])


def test_retries_end_in_the_dead_letters(spark):
    work = spark.createDataFrame([(k, 0) for k in range(4)], "key int, tried int")
    done, dead = jobs.with_retries(work, lambda df: df.withColumn("tried", F.col("tried") + 1).withColumn("ok", (F.col("key") > 0) & (F.col("tried") >= F.col("key"))), delay=0.0)
    assert {r.key: r.attempt for r in done.collect()} == {1: 1, 2: 2, 3: 3} and [r.key for r in dead.collect()] == [0]


def test_capacity_levels(spark):
    rows = [("a", 0, 10**12), ("a", 60, 10**12 - 6 * 10**9), ("b", 0, 10**12), ("b", 10, 10**11), ("c", 0, 4 * 10**9), ("d", 0, 10**11), ("d", 100, 2 * 10**11)]
    df = spark.createDataFrame(rows, "volume string, s long, free long").withColumn("ts", F.timestamp_seconds("s"))
    assert {r.volume: r.level for r in state.capacity(df).collect()} == {"a": "WARNING", "b": "OK", "c": "CRITICAL", "d": "OK"}


def test_plane_count_is_tolerant(spark):
    r = spark.range(1).select(model.plane_count(F.lit(119.25), F.lit(0.265)).alias("n")).first()
    assert r.n == 451
