"""Queries that run streams to completion over the driver's tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamella.operators.catalogue import signatures
from lamella.plans import views
from lamella.plans.registry import query
from lamella.streaming import jobs, state
from lamella.streaming.sources import files_as_stream, replayed

FILES = f"WITH {views.FILES} "


def _files(spark, sf_dir):
    orders = files_as_stream(spark, f"{sf_dir}/orders.parquet")
    return orders.select(
        F.expr("1 + o_orderkey % 3 + CASE WHEN o_orderstatus = 'P' THEN 3 ELSE 0 END").alias("position"), F.expr("o_orderkey div 12").alias("time_id"), F.expr("1 + (o_orderkey div 3) % 4").alias("channel"),
        F.col("o_orderdate").alias("mtime"), F.col("o_orderkey").alias("size"),
    )


def _arriving(spark, sf_dir):
    """The files in order of arrival, in four batches."""
    return replayed(views.files(spark, sf_dir), "size", 4)


@query("r03_quiet_gate", """WITH e AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e)
  SELECT user_id, min(ts) AS first, max(ts) + INTERVAL 2 HOUR AS quiet_at, count(*) AS n FROM g GROUP BY user_id, s HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def r03(spark, sf_dir):
    events = replayed(views.table(spark, sf_dir, "events"), "ts", 4).withColumn("ts", F.col("ts").cast("timestamp"))
    out = jobs.drain(state.quiet_sessions(events, "user_id", "ts", "2 hours", "10 minutes"))
    return out.withColumns({"first": F.col("first").cast("timestamp_ntz"), "quiet_at": F.col("quiet_at").cast("timestamp_ntz")})


# Turns of a path, look by look: the first look beyond a turn's end closes it, then the look itself counts. Turns still open end with the last watermark.
QUIET, TURN, LATE = 6 * 3_600_000, 60 * 3_600_000 + 7, "10 minutes"
_LOOKS = "'f' || user_id AS path, epoch_us(ts) // 1000 AS seen_at, CASE WHEN event_id % 41 = 0 THEN -1 ELSE event_id // 600 % 4 END AS size, event_id % 4 > 0 AS structure, event_id // 600 % 4 + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS after_"


@query("r03_readiness_gate", f"""WITH RECURSIVE l AS (SELECT {_LOOKS}, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
  s AS (SELECT path, 0 AS rn, CAST(-1 AS BIGINT) AS size, CAST(0 AS BIGINT) AS since, CAST(0 AS BIGINT) AS first, true AS done, false AS held, CAST(NULL AS BIGINT) AS ended, CAST(NULL AS BIGINT) AS old, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS told_at FROM l WHERE rn = 1
    UNION ALL SELECT path, rn, CASE WHEN fresh THEN nsize WHEN checked THEN after_ WHEN NOT over AND nsize <> size THEN nsize ELSE size END, CASE WHEN fresh OR (NOT over AND nsize <> size) OR (checked AND after_ <> nsize) THEN nat ELSE since END,
      CASE WHEN fresh THEN nat ELSE first END, CASE WHEN nsize < 0 THEN true WHEN fresh THEN false ELSE over OR (checked AND after_ = nsize) END, nsize >= 0, CASE WHEN late THEN first + {TURN} END, CASE WHEN late OR nsize < 0 THEN size END,
      CASE WHEN nsize < 0 AND held THEN 'GONE' WHEN checked AND after_ = nsize THEN 'READY' END, nat
    FROM (SELECT *, over AND nsize >= 0 AND (NOT held OR nsize <> size) AS fresh, NOT over AND nsize >= 0 AND nsize = size AND nat - since >= {QUIET} AND structure AS checked FROM (
      SELECT s.path, l.rn, s.size, s.since, s.first, s.held, l.size AS nsize, l.seen_at AS nat, l.structure, l.after_, NOT s.done AND l.seen_at > s.first + {TURN} AS late, s.done OR l.seen_at > s.first + {TURN} AS over FROM s JOIN l ON l.path = s.path AND l.rn = s.rn + 1))),
  e AS (SELECT s.* FROM s JOIN (SELECT path, max(rn) AS rn FROM s GROUP BY path) USING (path, rn) WHERE NOT done AND first + {TURN} < (SELECT epoch_us(max(ts)) // 1000 - 600000 FROM events))
  SELECT path, ended AS "at", 'TIMEOUT' AS outcome, old AS size FROM s WHERE ended IS NOT NULL UNION ALL SELECT path, told_at, outcome, CASE WHEN outcome = 'GONE' THEN old ELSE size END FROM s WHERE outcome IS NOT NULL
  UNION ALL SELECT path, first + {TURN}, 'TIMEOUT', size FROM e""")
def r03b(spark, sf_dir):
    looks = replayed(views.table(spark, sf_dir, "events"), "ts", 5).select(
        F.concat(F.lit("f"), F.col("user_id")).alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.expr("CASE WHEN event_id % 41 = 0 THEN -1 ELSE event_id div 600 % 4 END").alias("size"), F.lit(0).cast("long").alias("mtime"),
        (F.col("event_id") % 4 > 0).alias("structure"), F.expr("event_id div 600 % 4 + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END").alias("size_after"), F.lit(0).cast("long").alias("mtime_after"),
    )
    return jobs.drain(state.readiness(looks, "ts", QUIET, TURN, LATE))


# Looks of a path one after the other: each state follows from the look before and its state.
@query("r04_file_states", """WITH RECURSIVE l AS (SELECT 'f' || user_id AS path, event_id AS seq, CASE WHEN event_id % 41 = 0 THEN -1 ELSE event_id % 5 // 2 END AS size, CASE WHEN event_id % 7 > 0 THEN 8 + event_id % 3 END AS planes, CASE WHEN user_id % 4 > 0 THEN 9 END AS expected,
    user_id % 3 = 0 AS folder, user_id % 17 = 0 AS bad, event_id % 19 = 0 AS odd, event_id % 13 = 0 AS moved, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
  d AS (SELECT *, CASE WHEN moved THEN 'INCOMPLETE' WHEN bad THEN 'FAILED' WHEN planes IS NULL THEN 'INCOMPLETE' WHEN odd THEN 'FAILED' WHEN expected IS NULL THEN 'DEPTH_UNVERIFIED' WHEN planes < expected THEN 'INCOMPLETE' WHEN planes > expected THEN CASE WHEN folder THEN 'DEPTH_UNVERIFIED' ELSE 'FAILED' END ELSE 'COMPLETE' END AS depth,
    CASE WHEN moved THEN 'changed while it was checked' WHEN bad THEN 'two times in its name' WHEN planes IS NULL THEN 'structure is incomplete' WHEN odd THEN 'unsupported layout: tiles' WHEN expected IS NULL THEN 'no plane count is known' WHEN planes < expected THEN planes || ' of ' || expected || ' planes'
      WHEN planes > expected THEN CASE WHEN folder THEN planes || ' planes, the folder says ' || expected ELSE planes || ' planes, ' || expected || ' named' END ELSE 'quiet and complete' END AS why FROM l),
  s AS (SELECT path, rn, seq, size, CASE WHEN size < 0 THEN 'REMOVED' ELSE 'PENDING' END AS state, CASE WHEN size < 0 THEN 'the file is gone' ELSE 'seen' END AS reason, true AS told FROM d WHERE rn = 1
    UNION ALL SELECT path, rn, seq, CASE WHEN state = 'INCOMPLETE' AND moved THEN size + 10 ELSE size END, state, reason, state <> was FROM (SELECT d.path, d.rn, d.seq, d.size, d.moved, s.state AS was,
      CASE WHEN d.size < 0 THEN 'REMOVED' WHEN s.state = 'REMOVED' THEN 'PENDING' WHEN d.size <> s.size THEN CASE WHEN s.state IN ('COMPLETE', 'DEPTH_UNVERIFIED', 'FAILED') THEN 'CHANGED' ELSE 'PENDING' END ELSE depth END AS state,
      CASE WHEN d.size < 0 THEN 'the file is gone' WHEN s.state = 'REMOVED' THEN 'seen' WHEN d.size <> s.size THEN CASE WHEN s.state IN ('COMPLETE', 'DEPTH_UNVERIFIED', 'FAILED') THEN 'size or time changed' ELSE 'still growing' END ELSE why END AS reason
      FROM s JOIN d ON d.path = s.path AND d.rn = s.rn + 1))
  SELECT path, seq, state, reason FROM s WHERE told""")
def r04(spark, sf_dir):
    events = replayed(views.table(spark, sf_dir, "events"), "event_id", 4)
    size = F.expr("CASE WHEN event_id % 41 = 0 THEN -1 ELSE event_id % 5 div 2 END")
    looks = events.select(
        F.concat(F.lit("f"), F.col("user_id")).alias("path"), F.col("event_id").alias("seq"), size.alias("size"),
        F.lit(0).cast("long").alias("mtime"), F.expr("CASE WHEN event_id % 7 > 0 THEN 8 + event_id % 3 END").alias("planes"), F.expr("CASE WHEN user_id % 4 > 0 THEN 9 END").alias("expected"),
        (F.col("user_id") % 3 == 0).alias("from_folder"), F.expr("CASE WHEN user_id % 17 = 0 THEN 'two times in its name' END").alias("problem"), F.expr("CASE WHEN event_id % 19 = 0 THEN 'tiles' END").alias("unsupported"),
        (size + F.expr("CASE WHEN event_id % 13 = 0 THEN 10 ELSE 0 END")).alias("size_after"), F.lit(0).cast("long").alias("mtime_after"),
    )
    return jobs.drain(state.file_states(looks), "update")


@query("r05_depth_check", "SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 'DEPTH_UNVERIFIED' WHEN 8 + event_id % 3 < 9 THEN 'INCOMPLETE' WHEN 8 + event_id % 3 > 9 THEN CASE WHEN user_id % 2 = 0 THEN 'DEPTH_UNVERIFIED' ELSE 'FAILED' END ELSE 'COMPLETE' END AS state FROM events")
def r05(spark, sf_dir):
    planes, expected, folder = F.expr("8 + event_id % 3"), F.expr("CASE WHEN event_id % 4 > 0 THEN 9 END"), F.col("user_id") % 2 == 0
    return jobs.drain(files_as_stream(spark, f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), state.depth_state(planes, expected, folder).alias("state")))


# The first file whose time differs from the first one's decides, by the channels before it.
@query("r06_layouts", FILES + """, f AS (SELECT time_id // 20 AS dataset, time_id, channel, row_number() OVER (PARTITION BY time_id // 20 ORDER BY size) AS rn FROM files), o AS (SELECT dataset, time_id AS t0, channel AS c0 FROM f WHERE rn = 1),
  k AS (SELECT dataset, min(rn) AS k FROM f JOIN o USING (dataset) WHERE time_id <> t0 GROUP BY dataset), a AS (SELECT dataset, count(DISTINCT channel) AS n, max(channel) AS most FROM f JOIN k USING (dataset) WHERE rn < k GROUP BY dataset),
  l AS (SELECT dataset, channel AS later FROM f JOIN k USING (dataset) WHERE rn = k)
  SELECT dataset, CASE WHEN n > 1 THEN 'multi' WHEN later = c0 THEN 'single' ELSE 'ambiguous' END AS kind, CASE WHEN n > 1 THEN array_to_string(range(1, most + 1), ',') ELSE CAST(c0 AS VARCHAR) END AS channels FROM o JOIN a USING (dataset) JOIN l USING (dataset)""")
def r06(spark, sf_dir):
    f = _arriving(spark, sf_dir)
    return jobs.drain(state.layouts(f.select(F.expr("time_id div 20").alias("dataset"), F.col("size").alias("seq"), "time_id", "channel")), "update")


@query("r07_complete_groups", FILES + "SELECT position, time_id, 'complete' AS status FROM files GROUP BY ALL HAVING list(channel ORDER BY channel) = [1, 2, 3, 4]")
def r07(spark, sf_dir):
    return jobs.drain(state.complete_groups(_arriving(spark, sf_dir), [1, 2, 3, 4]), "update")


@query("r08_metadata_gate", FILES + "SELECT size, 'run' || (time_id % 40) AS folder, 0.1 + (time_id % 40) * 0.01 AS pixel, 25.0 AS angle FROM files WHERE time_id % 40 % 3 > 0")
def r08(spark, sf_dir):
    f = _files(spark, sf_dir).select("size", F.expr("concat('run', time_id % 40)").alias("folder"))
    params = spark.range(40).filter("id % 3 > 0").select(F.expr("concat('run', id)").alias("folder"), F.expr("0.1D + id * 0.01D").alias("pixel"))
    known, _ = jobs.with_metadata(f, params, {"angle": 25.0})
    return jobs.drain(known)


@query("r09_retries", FILES + "SELECT size, CASE WHEN size % 5 = 0 THEN 'dead' WHEN size % 3 = 0 THEN 'second try' ELSE 'first try' END AS outcome FROM files")
def r09(spark, sf_dir):
    work = views.files(spark, sf_dir).select("size", F.lit(0).alias("tried"))

    def run(df):
        tried = df.withColumn("tried", F.col("tried") + 1)
        return tried.withColumn("ok", (F.col("size") % 5 != 0) & ((F.col("size") % 3 != 0) | (F.col("tried") > 1)))

    done, dead = jobs.with_retries(work, run, delay=0.0)
    label = F.when(F.col("attempt") == 1, "first try").otherwise("second try")
    return done.select("size", label.alias("outcome")).unionByName(dead.select("size", F.lit("dead").alias("outcome")))


@query("r10_exactly_once", FILES + "SELECT DISTINCT position AS path, size % 50 AS size, channel AS mtime FROM files WHERE NOT (position = 1 AND size % 50 < 25)")
def r10(spark, sf_dir):
    f = views.files(spark, sf_dir).select(F.col("position").alias("path"), (F.col("size") % 50).alias("size"), F.col("channel").alias("mtime"))
    manifest = f.filter("path = 1 AND size < 25").distinct().withColumn("status", F.lit("OK"))
    return jobs.once(f, manifest)


@query("r15_late_points", FILES + "SELECT position, time_id, row_number() OVER (PARTITION BY position ORDER BY time_id) AS index FROM (SELECT DISTINCT position, time_id FROM files)")
def r15(spark, sf_dir):
    points = jobs.drain(_files(spark, sf_dir).groupBy("position", "time_id").agg(F.count(F.lit(1)).alias("n")), "update")
    line = Window.partitionBy("position").orderBy("time_id")
    return points.select("position", "time_id").distinct().withColumn("index", F.row_number().over(line))


@query("r16_withheld_arrivals", FILES + "SELECT size, channel FROM files WHERE NOT (size % 4 = 0 AND channel > 2)")
def r16(spark, sf_dir):
    f = _files(spark, sf_dir).select("size", "channel", (F.col("channel") > 2).alias("arrived"), F.when(F.col("size") % 4 == 0, "DEPTH_UNVERIFIED").otherwise("COMPLETE").alias("state"))
    return jobs.drain(state.shown(f).select("size", "channel"))


@query("r18_capacity", """WITH s AS (SELECT user_id % 20 AS volume, ts, 4e11 - event_id * 1e7 - (user_id % 20) * 2e10 AS free FROM events),
  e AS (SELECT volume, arg_min(free, ts) AS f0, arg_max(free, ts) AS free, epoch(min(ts)) AS t0, epoch(max(ts)) AS t1 FROM s GROUP BY volume),
  r AS (SELECT volume, free, CASE WHEN floor(t1) - floor(t0) >= 30 THEN (f0 - free) / (floor(t1) - floor(t0)) END AS rate FROM e)
  SELECT volume, free, round(rate, 4) AS rate, round(CASE WHEN rate > 0 THEN free / rate / 3600 END, 4) AS hours, CASE WHEN free < 5e9 OR (rate > 0 AND free / rate / 3600 < 1) THEN 'CRITICAL' WHEN rate > 0 AND free / rate / 3600 < 4 THEN 'WARNING' ELSE 'OK' END AS level FROM r""")
def r18(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    out = state.capacity(e.select(F.expr("user_id % 20").alias("volume"), "ts", F.expr("4e11 - event_id * 1e7 - (user_id % 20) * 2e10").alias("free")))
    return out.select("volume", "free", F.round("rate", 4).alias("rate"), F.round("hours", 4).alias("hours"), "level")


@query("r19_whole_captures", FILES + "SELECT position, time_id FROM files GROUP BY ALL HAVING count(DISTINCT channel) = 4")
def r19(spark, sf_dir):
    return signatures(views.files(spark, sf_dir)).filter("size(channels) = 4").select("position", "time_id")
