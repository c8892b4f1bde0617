"""Queries of file catalogues, names, orders and logs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamella.functions import names as nm
from lamella.operators import catalogue as cat
from lamella.plans import views
from lamella.plans.registry import query

FILES = f"WITH {views.FILES} "
# Paths of the acquisition; every 11th file has a second time token, every 13th a reversed plane range.
PATHS_SQL = f"""WITH {views.FILES}, paths AS (
  SELECT position, time_id, channel, size, mtime, printf('/data/run%d/Exp_Position%04d_Time%06d_Channel%04d%s_Frames_%d_%d.tif', CAST(position AS INTEGER), CAST(position AS INTEGER),
    CAST(time_id AS INTEGER), CAST(channel AS INTEGER), CASE WHEN size % 11 = 0 THEN '_Time000000' ELSE '' END,
    CAST(CASE WHEN size % 13 = 0 THEN 9 ELSE 1 END AS INTEGER), CAST(size % 7 + 1 AS INTEGER)) AS path FROM files) """


def _files(spark, sf_dir):
    return views.files(spark, sf_dir)


def _paths(spark, sf_dir):
    return _files(spark, sf_dir).withColumn(
        "path",
        F.format_string(
            "/data/run%d/Exp_Position%04d_Time%06d_Channel%04d%s_Frames_%d_%d.tif", "position", "position", "time_id", "channel",
            F.expr("CASE WHEN size % 11 = 0 THEN '_Time000000' ELSE '' END"), F.expr("CASE WHEN size % 13 = 0 THEN 9 ELSE 1 END"), F.expr("size % 7 + 1"),
        ),
    )


@query("s01_list_files", PATHS_SQL + "SELECT path, size FROM paths WHERE (contains(lower(path), 'time00000') OR contains(lower(path), 'channel0002')) AND NOT contains(lower(path), 'frames_9')")
def s01(spark, sf_dir):
    return cat.keep_files(_paths(spark, sf_dir), ["TIME00000", "channel0002"], ["frames_9"], ["tif"]).select("path", "size")


@query("s02_exclude_tree", PATHS_SQL + "SELECT path, size FROM paths WHERE position <> 2")
def s02(spark, sf_dir):
    return cat.keep_files(_paths(spark, sf_dir), outside="/data/run2").select("path", "size")


@query("s03_watch_filter", PATHS_SQL + "SELECT path FROM paths WHERE contains(path, 'Channel0001') AND contains(path, 'Position0003')")
def s03(spark, sf_dir):
    return cat.keep_files(_paths(spark, sf_dir), ["Channel0001", "Position0003"], extensions=["tif"], match="all", ignore_case=False).select("path")


TREE_SQL = """WITH p AS (SELECT CASE WHEN p_size % 3 = 0 THEN printf('/d/%d/a.zarr/%d.zarr', CAST(p_partkey // 10 AS INTEGER), CAST(p_partkey AS INTEGER))
   WHEN p_size % 3 = 1 THEN printf('/d/%d/a.zarr', CAST(p_partkey // 10 AS INTEGER)) ELSE printf('/d/%d/f%d-deskewed-maxZprojection_Time%06d.tif', CAST(p_partkey // 10 AS INTEGER), CAST(p_partkey % 4 AS INTEGER), CAST(p_partkey AS INTEGER)) END AS path FROM part),
  s AS (SELECT DISTINCT path FROM p WHERE path LIKE '%.zarr'),
  top AS (SELECT path FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE a.path <> b.path AND b.path = regexp_extract(a.path, '^(.*)/[^/]*$', 1))) """


def _tree(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    return part.select(F.expr(
        "CASE WHEN p_size % 3 = 0 THEN format_string('/d/%d/a.zarr/%d.zarr', p_partkey div 10, p_partkey) WHEN p_size % 3 = 1 THEN format_string('/d/%d/a.zarr', p_partkey div 10)"
        " ELSE format_string('/d/%d/f%d-deskewed-maxZprojection_Time%06d.tif', p_partkey div 10, p_partkey % 4, p_partkey) END"
    ).alias("path"))


@query("s13_topmost_stores", TREE_SQL + "SELECT path FROM top")
def s13(spark, sf_dir):
    return cat.topmost(_tree(spark, sf_dir), F.col("path").endswith(".zarr"))


@query(
    "s14_result_series",
    TREE_SQL + "SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS root, regexp_extract(path, '/(f[0-9])', 1) AS series, 'maxZ' AS view, CAST(regexp_extract(path, '_Time([0-9]+)', 1) AS BIGINT) AS time, path FROM p WHERE path LIKE '%.tif'",
)
def s14(spark, sf_dir):
    return cat.result_series(_tree(spark, sf_dir))


@query("s15_folder_scan", TREE_SQL + "SELECT path, 'store' AS kind FROM top UNION ALL SELECT DISTINCT path, 'series' FROM p WHERE path LIKE '%.tif'")
def s15(spark, sf_dir):
    return cat.folder_scan(_tree(spark, sf_dir), F.col("path").endswith(".zarr"))


@query("s16_canonical_views", "SELECT DISTINCT o_orderstatus AS k, CASE o_orderstatus WHEN 'F' THEN 'meanZ' WHEN 'O' THEN 'maxX' ELSE 'sumavg' END AS view FROM orders")
def s16(spark, sf_dir):
    raw = F.expr("CASE o_orderstatus WHEN 'F' THEN 'avgZ' WHEN 'O' THEN 'maxX' ELSE 'sumavg' END")
    return views.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("k"), nm.canonical_view(raw).alias("view")).distinct()


@query("w10_newest_frames", TREE_SQL + """, r AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS root, regexp_extract(path, '/(f[0-9])', 1) AS series, 'maxZ' AS view, CAST(regexp_extract(path, '_Time([0-9]+)', 1) AS BIGINT) AS time, path FROM p WHERE path LIKE '%.tif')
    SELECT root, series, view, time, path FROM r QUALIFY time = max(time) OVER (PARTITION BY root, series, view)""")
def w10(spark, sf_dir):
    return cat.newest_frames(cat.result_series(_tree(spark, sf_dir)))


@query(
    "h01_name_tokens",
    PATHS_SQL + """SELECT path, CASE WHEN size % 11 = 0 AND time_id <> 0 THEN 'invalid' ELSE 'valid' END AS time_state, CASE WHEN size % 11 = 0 AND time_id <> 0 THEN NULL ELSE time_id END AS time_value,
      channel AS channel_value, CASE WHEN size % 13 = 0 AND 9 > size % 7 + 1 THEN 'invalid' ELSE 'valid' END AS frames_state,
      CASE WHEN size % 13 <> 0 THEN size % 7 + 1 END AS frames_last FROM paths""",
)
def h01(spark, sf_dir):
    p = _paths(spark, sf_dir).select("path", nm.token(F.col("path"), "time").alias("t"), nm.token(F.col("path"), "channel").alias("c"), nm.frame_range(F.col("path")).alias("f"))
    return p.select(
        "path", F.col("t.state").alias("time_state"), F.col("t.value").alias("time_value"), F.col("c.value").alias("channel_value"),
        F.col("f.state").alias("frames_state"), F.col("f.last").alias("frames_last"),
    )


@query(
    "h02_names",
    PATHS_SQL + """SELECT path, regexp_extract(path, '[^/]*$') AS base, regexp_replace(path, '_Channel[0-9]+', '') AS group_key,
      regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '_Time[0-9]+', '', 'g'), '[.][^.]*$', '') AS movie, printf('Time%06d', CAST(time_id AS INTEGER)) AS label FROM paths""",
)
def h02(spark, sf_dir):
    path = F.col("path")
    return _paths(spark, sf_dir).select(
        "path", nm.base_name(path).alias("base"), nm.group_key(path).alias("group_key"), nm.movie_name(nm.base_name(path)).alias("movie"), nm.time_label(F.col("time_id")).alias("label")
    )


@query("h03_source_keys", FILES + """SELECT DISTINCT channel, CASE WHEN size % 3 = 0 THEN 'left' WHEN size % 3 = 1 THEN 'right' ELSE 'whole' END AS side,
    printf('_Channel%04d-%s', CAST(channel AS INTEGER), CASE WHEN size % 3 = 0 THEN 'left' WHEN size % 3 = 1 THEN 'right' ELSE 'whole' END) AS key, size % 3 = 2 AS is_whole FROM files""")
def h03(spark, sf_dir):
    side = F.expr("CASE WHEN size % 3 = 0 THEN 'left' WHEN size % 3 = 1 THEN 'right' ELSE 'whole' END")
    keyed = _files(spark, sf_dir).select(nm.source_key(F.col("channel"), side).alias("key")).distinct()
    p = nm.parse_source_key(F.col("key"))
    return keyed.select(p["channel"].cast("long").alias("channel"), p["side"].alias("side"), "key", p["is_whole"].alias("is_whole"))


@query("h04_mirrored_folders", PATHS_SQL + "SELECT path, printf('/out/run%d', CAST(position AS INTEGER)) AS target FROM paths")
def h04(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", nm.mirrored_folder(F.col("path"), "/data", "/out").alias("target"))


@query("h05_families", PATHS_SQL + "SELECT printf('/data/run%d/Exp_Position%04d.tif', CAST(position AS INTEGER), CAST(position AS INTEGER)) AS family, count(*) AS files FROM paths GROUP BY 1")
def h05(spark, sf_dir):
    return _paths(spark, sf_dir).groupBy(nm.family_key(F.col("path")).alias("family")).agg(F.count(F.lit(1)).alias("files"))


@query("h06_description_lookup", FILES + "SELECT size, 1 + size % 5 AS slices, CASE WHEN size % 4 = 0 THEN 0.5 ELSE 0.1 * (size % 4) END AS spacing FROM files")
def h06(spark, sf_dir):
    text = F.format_string("images=%d\nslices=%d\nspacing=%s\nloop=false", F.col("size"), F.expr("1 + size % 5"), F.expr("cast(0.1D * (size % 4) as string)"))
    d = F.str_to_map(text, F.lit("\n"), F.lit("="))
    spacing = F.try_element_at(d, F.lit("spacing")).try_cast("double")
    return _files(spark, sf_dir).select("size", F.try_element_at(d, F.lit("slices")).try_cast("long").alias("slices"), F.when(spacing > 0, spacing).otherwise(0.5).alias("spacing"))


@query("h07_units", FILES + "SELECT size, CASE size % 4 WHEN 0 THEN 2.5 WHEN 1 THEN 2.5 * 0.001 WHEN 2 THEN 2.5 * 1000 ELSE 0.0 END AS um FROM files")
def h07(spark, sf_dir):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("micron", "NM", "mm", "parsec")]), (F.col("size") % 4 + 1).cast("int"))
    return _files(spark, sf_dir).select("size", nm.to_micron(F.lit(2.5), unit).alias("um"))


@query("h08_intervals", FILES + "SELECT size, CASE size % 3 WHEN 0 THEN (size % 50) * 60.0 WHEN 1 THEN (size % 50) * 3600.0 ELSE (size % 50) * 1.0 END AS seconds FROM files")
def h08(spark, sf_dir):
    unit = F.element_at(F.array(F.lit("min"), F.lit("h"), F.lit("sec")), (F.col("size") % 3 + 1).cast("int"))
    return _files(spark, sf_dir).select("size", nm.interval_seconds(F.concat_ws(" ", (F.col("size") % 50).cast("string"), unit)).alias("seconds"))


@query("h12_stamps", "SELECT o_orderkey AS id, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%dT%H:%M:%SZ') AS stamp, CASE WHEN o_orderkey % 200 >= 48 THEN printf('%d days', CAST(o_orderkey % 200 // 24 AS INTEGER)) WHEN o_orderkey % 200 >= 1 THEN printf('%d h', CAST(o_orderkey % 200 AS INTEGER)) ELSE 'less than an hour' END AS remaining FROM orders")
def h12(spark, sf_dir):
    from lamella.functions.provenance import remaining_text, utc_stamp

    return views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), utc_stamp(F.col("o_orderdate").cast("timestamp")).alias("stamp"), remaining_text(F.col("o_orderkey") % 200).alias("remaining"))


@query("t01_natural_order", "WITH n AS (SELECT p_partkey AS id, 'File' || (p_partkey % 120) || '_part' || p_size AS name FROM part) SELECT id, name, row_number() OVER (ORDER BY id % 120, CAST(regexp_extract(name, '([0-9]+)$', 1) AS INTEGER), id) AS place FROM n")
def t01(spark, sf_dir):
    part = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("concat('File', p_partkey % 120, '_part', p_size)").alias("name"))
    return part.withColumn("place", F.row_number().over(Window.orderBy(nm.natural_key(F.col("name")), "id")))


@query("t02_digits_number", PATHS_SQL + "SELECT path, CAST(right(regexp_replace(path, '[^0-9]', '', 'g'), 18) AS BIGINT) AS number FROM paths")
def t02(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", nm.digits_number(F.col("path")).alias("number"))


@query("t03_channel_order", FILES + "SELECT position, time_id, string_agg(channel || ':' || size, ',' ORDER BY channel DESC, size) AS ordered FROM files GROUP BY ALL")
def t03(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct((-F.col("channel")).alias("k"), "size")))
    return _files(spark, sf_dir).groupBy("position", "time_id").agg(F.array_join(F.transform(rows, lambda r: F.concat((-r["k"]).cast("string"), F.lit(":"), r["size"].cast("string"))), ",").alias("ordered"))


POINTS_SQL = FILES + """, p AS (SELECT position, time_id, list(DISTINCT channel ORDER BY channel) AS channels, min(mtime) AS mtime, count(*) AS files FROM files GROUP BY ALL),
  e AS (SELECT position, channels AS expected FROM (SELECT position, channels, count(*) AS n FROM p GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY position ORDER BY len(channels) DESC, n DESC, channels) = 1) """


@query("a23_expected_channels", POINTS_SQL + "SELECT position, array_to_string(expected, ',') AS expected FROM e")
def a23(spark, sf_dir):
    e = cat.expected_channels(cat.signatures(_files(spark, sf_dir)))
    return e.select("position", F.array_join(F.transform("expected", lambda x: x.cast("string")), ",").alias("expected"))


@query("w03_complete_points", POINTS_SQL + """SELECT position, time_id, row_number() OVER (PARTITION BY position ORDER BY time_id) AS index,
    CAST(epoch(CAST(mtime AS TIMESTAMP)) - epoch(CAST(min(mtime) OVER (PARTITION BY position) AS TIMESTAMP)) AS BIGINT) AS elapsed, len(channels) AS n_channels
    FROM p JOIN e USING (position) WHERE channels = expected AND files = len(channels)""")
def w03(spark, sf_dir):
    return cat.complete_points(_files(spark, sf_dir))


@query("u02_exact_channels", FILES + "SELECT position, time_id FROM files GROUP BY ALL HAVING list(channel ORDER BY channel) = [1, 2, 3, 4]")
def u02(spark, sf_dir):
    grouped = _files(spark, sf_dir).groupBy("position", "time_id").agg(F.array_sort(F.collect_list("channel")).alias("c"))
    return grouped.filter("c = array(1L, 2L, 3L, 4L)").select("position", "time_id")


@query("a24_slot_conflicts", FILES + "SELECT position, time_id // 2 AS time_id, channel, string_agg(CAST(size AS VARCHAR), ',' ORDER BY size) AS claimants FROM files GROUP BY ALL HAVING count(*) > 1")
def a24(spark, sf_dir):
    return cat.slot_conflicts(_files(spark, sf_dir).withColumn("time_id", F.expr("time_id div 2")))


@query("a25_catalogue_summary", FILES + "SELECT position, count(DISTINCT channel) AS channels, count(*) AS files, count(DISTINCT time_id) AS points, max(time_id) AS last FROM files GROUP BY position")
def a25(spark, sf_dir):
    return _files(spark, sf_dir).groupBy("position").agg(
        F.countDistinct("channel").alias("channels"), F.count(F.lit(1)).alias("files"), F.countDistinct("time_id").alias("points"), F.max("time_id").alias("last")
    )


@query("a31_group_files", PATHS_SQL + "SELECT regexp_replace(path, '_Channel[0-9]+', '') AS key, string_agg(CAST(channel AS VARCHAR), ',' ORDER BY channel, path) AS channels FROM paths GROUP BY 1")
def a31(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("channel", "path")))
    return _paths(spark, sf_dir).groupBy(nm.group_key(F.col("path")).alias("key")).agg(F.array_join(F.transform(rows, lambda r: r["channel"].cast("string")), ",").alias("channels"))


@query("a22_majority_shape", "SELECT o_custkey AS dataset, CASE WHEN count(*) = 1 THEN min(shape) END AS shape, count(*) > 1 AS tie FROM (SELECT o_custkey, o_orderkey % 4 AS shape, rank() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC) AS r FROM orders GROUP BY 1, 2) WHERE r = 1 GROUP BY 1")
def a22(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dataset"), F.expr("o_orderkey % 4").alias("shape"))
    return cat.majority(orders, ["dataset"], "shape")


@query("w01_time_index", FILES + "SELECT position, time_id, row_number() OVER (PARTITION BY position ORDER BY time_id) AS index FROM (SELECT DISTINCT position, time_id FROM files)")
def w01(spark, sf_dir):
    points = _files(spark, sf_dir).select("position", "time_id").distinct()
    return points.withColumn("index", F.row_number().over(Window.partitionBy("position").orderBy("time_id")))


@query("w02_name_order", PATHS_SQL + "SELECT path, row_number() OVER (PARTITION BY position ORDER BY path) AS index FROM paths")
def w02(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", F.row_number().over(Window.partitionBy("position").orderBy("path")).alias("index"))


@query("w04_elapsed_by_number", FILES + "SELECT position, time_id, (time_id - first_value(time_id) OVER (PARTITION BY position ORDER BY time_id)) * 2.5 AS elapsed FROM (SELECT DISTINCT position, time_id FROM files)")
def w04(spark, sf_dir):
    line = Window.partitionBy("position").orderBy("time_id")
    points = _files(spark, sf_dir).select("position", "time_id").distinct()
    return points.withColumn("elapsed", (F.col("time_id") - F.first("time_id").over(line)) * 2.5)


@query("w05_gaps", FILES + """SELECT position, before + 1 AS "from", time_id - 1 AS "to" FROM (SELECT position, time_id, lag(time_id) OVER (PARTITION BY position ORDER BY time_id) AS before FROM (SELECT DISTINCT position, time_id FROM files WHERE channel = 4)) WHERE time_id <> before + 1""")
def w05(spark, sf_dir):
    return cat.gaps(_files(spark, sf_dir).filter("channel = 4").select("position", "time_id").distinct())


LOG_SQL = """WITH log AS (SELECT CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE 'F' || o_custkey END AS path, o_orderkey % 3 // 2 AS size, o_orderkey % 4 // 3 AS modified,
    CASE WHEN o_orderstatus = 'P' THEN 'FAILED' ELSE 'OK' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'tiff' ELSE 'zarr' END AS format, o_orderkey AS seq FROM orders),
  c AS (SELECT *, lower(path) AS key, CASE WHEN coalesce(lag(size) OVER w <> size OR lag(modified) OVER w <> modified, true) THEN 1 ELSE 0 END AS changed FROM log WHERE path IS NOT NULL WINDOW w AS (PARTITION BY lower(path) ORDER BY seq)),
  r AS (SELECT *, sum(changed) OVER (PARTITION BY key ORDER BY seq) AS run FROM c),
  m AS (SELECT key, max_by(size, seq) AS size, max_by(modified, seq) AS modified, max_by(status, seq) AS status,
    coalesce(string_agg(DISTINCT CASE WHEN status = 'OK' THEN format END, ',' ORDER BY CASE WHEN status = 'OK' THEN format END), '') AS formats FROM (SELECT * FROM r QUALIFY run = max(run) OVER (PARTITION BY key)) GROUP BY key) """


def _log(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").select(
        F.expr("CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE concat('F', o_custkey) END").alias("path"), F.expr("o_orderkey % 3 div 2").alias("size"),
        F.expr("o_orderkey % 4 div 3").alias("modified"), F.expr("CASE WHEN o_orderstatus = 'P' THEN 'FAILED' ELSE 'OK' END").alias("status"),
        F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'tiff' ELSE 'zarr' END").alias("format"), F.col("o_orderkey").alias("seq"),
    )


@query("w09_latest_manifest", LOG_SQL + "SELECT * FROM m")
def w09(spark, sf_dir):
    return cat.latest_manifest(_log(spark, sf_dir))


@query("j11_not_done", LOG_SQL + "SELECT 'f' || c_custkey AS path, c_custkey % 2 AS size FROM customer WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.key = 'f' || c_custkey AND m.size = c_custkey % 2 AND m.modified = 0 AND contains(m.formats, 'zarr'))")
def j11(spark, sf_dir):
    files = views.table(spark, sf_dir, "customer").select(F.expr("concat('f', c_custkey)").alias("path"), F.expr("c_custkey % 2").alias("size"), F.lit(0).cast("long").alias("modified"))
    return cat.not_done(files, cat.latest_manifest(_log(spark, sf_dir)), "zarr").select("path", "size")


@query("j13_missing_outputs", FILES + "SELECT f.position, f.time_id, f.channel FROM files f WHERE NOT EXISTS (SELECT 1 FROM files g WHERE g.position = f.position AND g.time_id = f.time_id AND g.channel = f.channel AND g.size % 5 <> 0)")
def j13(spark, sf_dir):
    f = _files(spark, sf_dir)
    return f.select("position", "time_id", "channel").join(f.filter("size % 5 <> 0").select("position", "time_id", "channel"), ["position", "time_id", "channel"], "left_anti")


@query("j14_listing_changes", """WITH a AS (SELECT o_orderkey AS path, o_custkey AS size FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey AS path, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS size FROM orders WHERE o_orderkey % 3 <> 0)
    SELECT 'f' || coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.size <> b.size""")
def j14(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").select(F.expr("concat('f', o_orderkey)").alias("path"), F.col("o_custkey").alias("size"), F.col("o_orderdate").alias("mtime"), "o_orderkey")
    new = o.filter("o_orderkey % 3 <> 0").withColumn("size", F.expr("CASE WHEN o_orderkey % 7 = 0 THEN size + 1 ELSE size END"))
    return cat.changes(o.filter("o_orderkey % 5 <> 0"), new)


@query("j01_pair_series", FILES + "SELECT position AS \"group\", time_id AS time, count(DISTINCT channel) AS n FROM files GROUP BY ALL HAVING count(DISTINCT channel) = 4")
def j01(spark, sf_dir):
    series = _files(spark, sf_dir).select(F.col("position").alias("group"), F.col("time_id").alias("time"), F.col("channel").alias("member"), F.col("size").alias("path"))
    return cat.paired_frames(series, 4).select("group", "time", "n")


# Matrices of two channels by name, the first one the reference, and a bare one; A is that of the reference's right half.
PLACED_SQL = FILES + """, s AS (SELECT DISTINCT channel, CASE size % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'whole' END AS side FROM files), n AS (SELECT printf('_Channel%04d-%s', CAST(channel AS INTEGER), side) AS source, side FROM s),
    k AS (SELECT * FROM (VALUES ('_Channel0002-right', 0.99875, -0.05, 1.5, 0.05, 0.99875, -2.5), ('_Channel0003-left', 1.0, 0.0, 4.0, 0.0, 1.0, 3.0), ('_Channel0004-whole', 1.0, 0.0, -6.0, 0.0, 1.0, 2.0)) v(source, a, b, e, c, d, f)),
    m AS (SELECT n.source, side, coalesce(a, CASE WHEN side = 'right' THEN 1.0 END) AS a, coalesce(b, CASE WHEN side = 'right' THEN 0.0 END) AS b, coalesce(e, CASE WHEN side = 'right' THEN 7.0 END) AS e, coalesce(c, CASE WHEN side = 'right' THEN 0.0 END) AS c,
      coalesce(d, CASE WHEN side = 'right' THEN 1.0 END) AS d, coalesce(f, CASE WHEN side = 'right' THEN 8.0 END) AS f FROM n LEFT JOIN k ON k.source = n.source)"""


def _placed(spark, sf_dir, flip_left):
    side = F.expr("CASE size % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'whole' END")
    sources = _files(spark, sf_dir).select(nm.source_key(F.col("channel"), side).alias("source"), "channel", side.alias("side")).distinct()
    rows = [("_Channel0002-right", 0.99875, -0.05, 1.5, 0.05, 0.99875, -2.5, True), ("_Channel0003-left", 1.0, 0.0, 4.0, 0.0, 1.0, 3.0, False), ("_Channel0004-whole", 1.0, 0.0, -6.0, 0.0, 1.0, 2.0, False), (None, 1.0, 0.0, 7.0, 0.0, 1.0, 8.0, False)]
    matrices = spark.createDataFrame(rows, "source string, m00 double, m01 double, m02 double, m10 double, m11 double, m12 double, is_reference boolean")
    out = cat.placements(sources, matrices, flip_left, half_width=100)
    return out.select("source", "mirror", *[F.round(k, 6).alias(k) for k in ("m00", "m01", "m02", "m10", "m11", "m12")])


@query("j02_placements", PLACED_SQL + " SELECT source, side = 'right' AS mirror, round(a, 6) AS m00, round(b, 6) AS m01, round(e, 6) AS m02, round(c, 6) AS m10, round(d, 6) AS m11, round(f, 6) AS m12 FROM m")
def j02(spark, sf_dir):
    return _placed(spark, sf_dir, False)


# Of a point: mirror, M, A^-1 (its determinant is not quite one), mirror; the columns of the product are the images of the axes and the origin.
@query("j02_reframed", PLACED_SQL + """, h AS (SELECT *, coalesce(a, 1) AS a_, coalesce(b, 0) AS b_, coalesce(e, 0) AS e_, coalesce(c, 0) AS c_, coalesce(d, 1) AS d_, coalesce(f, 0) AS f_, 0.99875 * 0.99875 + 0.05 * 0.05 AS det FROM m),
    p AS (SELECT *, unnest([0, 1, 0]) AS px, unnest([0, 0, 1]) AS py, unnest(['o', 'x', 'y']) AS name FROM h), q AS (SELECT *, a_ * (99 - px) + b_ * py + e_ AS qx, c_ * (99 - px) + d_ * py + f_ AS qy FROM p),
    r AS (SELECT *, 99 - (0.99875 * (qx - 1.5) + 0.05 * (qy + 2.5)) / det AS rx, (-0.05 * (qx - 1.5) + 0.99875 * (qy + 2.5)) / det AS ry FROM q),
    t AS (SELECT source, side, a, b, e, c, d, f, max(rx) FILTER (name = 'o') AS ox, max(ry) FILTER (name = 'o') AS oy, max(rx) FILTER (name = 'x') AS xx, max(ry) FILTER (name = 'x') AS xy, max(rx) FILTER (name = 'y') AS yx, max(ry) FILTER (name = 'y') AS yy FROM r GROUP BY ALL),
    u AS (SELECT source, side, CASE WHEN side = 'whole' THEN a ELSE xx - ox END AS m00, CASE WHEN side = 'whole' THEN b ELSE yx - ox END AS m01, CASE WHEN side = 'whole' THEN e ELSE ox END AS m02, CASE WHEN side = 'whole' THEN c ELSE xy - oy END AS m10, CASE WHEN side = 'whole' THEN d ELSE yy - oy END AS m11, CASE WHEN side = 'whole' THEN f ELSE oy END AS m12 FROM t)
    SELECT source, side = 'left' AS mirror, """ + ", ".join(f"CASE WHEN abs(m00 - 1) + abs(m01) + abs(m02) + abs(m10) + abs(m11 - 1) + abs(m12) >= 1e-9 THEN round({k}, 6) END AS {k}" for k in ("m00", "m01", "m02", "m10", "m11", "m12")) + " FROM u")
def j02b(spark, sf_dir):
    return _placed(spark, sf_dir, True)


@query("u04_prefix_snapshots", FILES + """, s AS (SELECT position, list(time_id ORDER BY time_id) FILTER (channel <= 3) AS one, list(time_id ORDER BY time_id) FILTER (channel <= 3 OR time_id > 5) AS two FROM files GROUP BY position)
    SELECT position, two[1:len(one)] = one AS extends FROM s""")
def u04(spark, sf_dir):
    early = F.array_sort(F.collect_list(F.when(F.col("channel") <= 3, F.col("time_id"))))
    late = F.array_sort(F.collect_list(F.when((F.col("channel") <= 3) | (F.col("time_id") > 5), F.col("time_id"))))
    return _files(spark, sf_dir).groupBy("position").agg(early.alias("one"), late.alias("two")).select("position", (F.slice("two", 1, F.greatest(F.size("one"), F.lit(1))) == F.col("one")).alias("extends"))


@query("u05_unplaced_names", PATHS_SQL + "SELECT path FROM paths WHERE (size % 11 = 0 AND time_id <> 0) OR (size % 13 = 0)")
def u05(spark, sf_dir):
    p = _paths(spark, sf_dir).select("path")
    usable = p.filter((nm.token(F.col("path"), "time")["state"] == "valid") & (nm.frame_range(F.col("path"))["state"] == "valid"))
    return p.exceptAll(usable)


@query("u06_output_clashes", "WITH o AS (SELECT o_orderkey AS dataset, CASE WHEN o_orderstatus <> 'F' THEN 'own' || o_orderkey ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'OUT' ELSE 'out' END || (o_orderkey // 3) END AS output FROM orders) SELECT dataset, output FROM o QUALIFY count(*) OVER (PARTITION BY lower(output)) > 1")
def u06(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    output = "CASE WHEN o_orderstatus <> 'F' THEN concat('own', o_orderkey) ELSE concat(CASE WHEN o_orderkey % 2 = 0 THEN 'OUT' ELSE 'out' END, o_orderkey div 3) END"
    return cat.output_clashes(o.select(F.col("o_orderkey").alias("dataset"), F.expr(output).alias("output")))


# Files with faults by their numbers; then the checks one after the other.
PLAN_SQL = """WITH s AS (SELECT o_custkey // 3 AS dataset, 'f' || o_orderkey AS path, CASE WHEN (o_custkey // 3) % 40 = 7 THEN 'Shared' WHEN (o_custkey // 3) % 40 = 8 THEN 'shared' ELSE 'out' || (o_custkey // 3) END AS output, o_orderkey % 25 AS time_no, o_orderkey % 2 + 1 AS channel,
    CASE WHEN o_orderkey % 11 = 0 THEN 64 WHEN (o_custkey // 3) % 9 = 4 THEN 33 ELSE 32 END AS width, 48 AS height, 10 + CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS slices, CASE WHEN o_orderkey % 3 = 0 THEN 10 END AS named, o_orderkey % 23 <> 0 AS readable,
    CASE WHEN (o_custkey // 3) % 13 = 5 AND o_orderkey % 7 = 0 THEN 0.2 ELSE 0.1 END AS pixel FROM orders),
  r AS (SELECT *, CASE WHEN NOT readable THEN 'unreadable' WHEN named <> slices THEN 'depth differs from its name' WHEN named IS NULL AND dataset % 2 = 0 AND slices <> 10 THEN 'depth differs from its folder''s' END AS own, width || 'x' || height || 'x' || slices || 'x1x1' AS shape FROM s),
  m AS (SELECT dataset, CASE WHEN count(*) = 1 THEN min(shape) END AS common, count(*) > 1 AS tie FROM (SELECT dataset, shape, rank() OVER (PARTITION BY dataset ORDER BY count(*) DESC) AS k FROM r WHERE own IS NULL GROUP BY 1, 2) WHERE k = 1 GROUP BY 1),
  t AS (SELECT r.*, common, tie, coalesce(own, CASE WHEN shape <> common THEN 'other shape' END) AS reason FROM r LEFT JOIN m USING (dataset)), g AS (SELECT * FROM t WHERE reason IS NULL AND common IS NOT NULL),
  w AS (SELECT dataset, count(DISTINCT channel) AS channels, max(width) AS width, min(pixel) AS pixel, max(pixel) > min(pixel) AS uneven FROM g GROUP BY 1),
  p AS (SELECT dataset, time_no, count(DISTINCT channel) AS have, count(*) AS files, channels FROM g JOIN w USING (dataset) GROUP BY ALL),
  k AS (SELECT dataset, count(*) FILTER (have = channels AND files = have) AS points, count(*) FILTER (have < channels) AS incomplete, count(*) FILTER (files > have) AS conflicts FROM p GROUP BY 1)"""


def _plan(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").withColumn("dataset", F.expr("o_custkey div 3"))
    sources = o.select(
        "dataset", F.concat(F.lit("f"), "o_orderkey").alias("path"), F.expr("CASE WHEN dataset % 40 = 7 THEN 'Shared' WHEN dataset % 40 = 8 THEN 'shared' ELSE concat('out', dataset) END").alias("output"), F.expr("o_orderkey % 25").alias("time_no"),
        F.expr("o_orderkey % 2 + 1").alias("channel"), F.expr("CASE WHEN o_orderkey % 11 = 0 THEN 64 WHEN dataset % 9 = 4 THEN 33 ELSE 32 END").alias("width"), F.lit(48).alias("height"), F.expr("10 + if(o_orderkey % 29 = 0, 1, 0)").alias("slices"),
        F.lit(1).alias("stored_channels"), F.lit(1).alias("frames"), F.expr("if(o_orderkey % 3 = 0, 10, NULL)").alias("named_depth"), F.expr("o_orderkey % 23 <> 0").alias("readable"),
        F.expr("if(dataset % 13 = 5 AND o_orderkey % 7 = 0, 0.2D, 0.1D)").alias("pixel"), F.lit(0.3).alias("dz"),
    )
    parameters = o.select("dataset").distinct().filter("dataset % 2 = 0").select("dataset", F.lit(10).alias("planes"), F.expr("if(dataset % 6 = 0, 2048, 32)").alias("roi_width"), F.lit(48).alias("roi_height"))
    return cat.conversion_plan(sources, parameters, split=True)


@query("x09_conversion_plan", PLAN_SQL + """, d AS (SELECT DISTINCT dataset, output FROM s), c AS (SELECT dataset FROM d QUALIFY count(*) OVER (PARTITION BY lower(output)) > 1), a AS (SELECT dataset, dataset % 2 = 1 OR width = CASE WHEN dataset % 6 = 0 THEN 2048 ELSE 32 END AS whole FROM w)
    SELECT d.dataset, common AS shape, CASE WHEN width IS NULL THEN NULL WHEN whole THEN 'halves' ELSE 'stored' END AS layout, channels, points, incomplete, conflicts, pixel, CASE WHEN pixel IS NOT NULL THEN 0.3 END AS dz,
      CASE WHEN tie THEN 'no majority shape' WHEN points IS NULL THEN 'no sound file' WHEN conflicts > 0 THEN 'conflicting files' WHEN points = 0 THEN 'no complete time point' WHEN uneven THEN 'sampling differs' WHEN NOT whole THEN 'halves need whole widths' WHEN width % 2 <> 0 THEN 'odd width'
        WHEN c.dataset IS NOT NULL THEN 'output clash' END AS refused FROM (SELECT DISTINCT dataset FROM d) d LEFT JOIN m USING (dataset) LEFT JOIN w USING (dataset) LEFT JOIN k USING (dataset) LEFT JOIN a USING (dataset) LEFT JOIN c ON c.dataset = d.dataset""")
def x09(spark, sf_dir):
    return _plan(spark, sf_dir)[0]


@query("x09_left_out", PLAN_SQL + """, h AS (SELECT dataset, time_no FROM p WHERE have < channels), l AS (SELECT t.dataset, path, coalesce(reason, CASE WHEN h.dataset IS NOT NULL THEN 'incomplete time point' END) AS reason FROM t LEFT JOIN h ON h.dataset = t.dataset AND h.time_no = t.time_no)
    SELECT * FROM l WHERE reason IS NOT NULL""")
def x09b(spark, sf_dir):
    return _plan(spark, sf_dir)[1]


@query("j12_unnamed_inputs", "WITH i AS (SELECT 'f' || o_orderkey AS name FROM orders), o AS (SELECT 'out_f' || o_orderkey || '-maxZ' AS name FROM orders WHERE o_orderstatus = 'P') SELECT name FROM i WHERE NOT EXISTS (SELECT 1 FROM o WHERE contains(o.name, i.name))")
def j12(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    inputs = orders.select(F.concat(F.lit("f"), "o_orderkey").alias("name"))
    return cat.unnamed_by_outputs(inputs, orders.filter("o_orderstatus = 'P'").select(F.concat(F.lit("out_f"), "o_orderkey", F.lit("-maxZ")).alias("name")))
