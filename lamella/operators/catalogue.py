"""File catalogues: listings, time points, completeness, conflicts, plans and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions import matrix as mx

from lamella.functions import names


def keep_files(paths: DataFrame, include=(), exclude=(), extensions=(), match: str = "any", ignore_case: bool = True, outside: str | None = None) -> DataFrame:
    """Listing filter: extensions, any or all of the include fragments, none of the excluded, not below a tree."""
    name = names.base_name(F.col("path"))
    wanted = names.contains_any(name, list(include), ignore_case) if match == "any" else names.contains_all(name, list(include), ignore_case)
    keep = wanted
    if exclude:
        keep = keep & ~names.contains_any(name, list(exclude), ignore_case)
    if extensions:
        keep = keep & F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin([e.lower() for e in extensions])
    if outside:
        root = outside.rstrip("/") + "/"
        keep = keep & ~F.startswith(F.col("path"), F.lit(root))
    return paths.filter(keep)


def topmost(paths: DataFrame, is_store: Column) -> DataFrame:
    """Stores that lie inside no other store: each path's ancestors are looked up, so no pairs are compared."""
    stores = paths.filter(is_store).select("path").distinct()
    parts = F.split("path", "/")
    upper = F.expr("transform(sequence(1, greatest(size(split(path, '/')) - 1, 1)), i -> array_join(slice(split(path, '/'), 1, i), '/'))")
    nested = stores.withColumn("ancestor", F.explode(upper)).filter("ancestor <> path").join(stores.select(F.col("path").alias("ancestor")), "ancestor", "left_semi")
    return stores.join(nested.select("path").distinct(), "path", "left_anti")


SERIES = r"^(.*?)(?:-deskewed)?(?:-(max|mean|avg|min|sum|median|std)([XYZ])projection)?(?:_Time(\d+))?\.tiff?$"


def result_series(paths: DataFrame) -> DataFrame:
    """``root, series, view, time, path`` of result files: suffixes name the view and the time number."""
    name = names.base_name(F.col("path"))
    kind, axis = F.regexp_extract(name, SERIES, 2), F.regexp_extract(name, SERIES, 3)
    view = F.when(kind == "", "volume").otherwise(names.canonical_view(F.concat(kind, axis)))
    return paths.filter(name.rlike(SERIES)).select(
        names.folder(F.col("path")).alias("root"), F.regexp_extract(name, SERIES, 1).alias("series"), view.alias("view"),
        F.regexp_extract(name, SERIES, 4).try_cast("long").alias("time"), "path",
    )


def newest_frames(series: DataFrame) -> DataFrame:
    """The highest-numbered frame of every view: the ones that may still be half written."""
    view = Window.partitionBy("root", "series", "view")
    return series.withColumn("newest", F.max("time").over(view)).filter(F.col("time").eqNullSafe(F.col("newest"))).drop("newest")


def folder_scan(paths: DataFrame, is_store: Column) -> DataFrame:
    """Every path once, as a store, as part of a result series, or as a loose file."""
    stores = topmost(paths, is_store).select("path", F.lit("store").alias("kind"))
    left = paths.select("path").distinct().join(stores, "path", "left_anti").filter(~is_store)
    name = names.base_name(F.col("path"))
    return stores.unionByName(left.select("path", F.when(name.rlike(r"(projection|-deskewed).*\.tiff?$"), "series").otherwise("loose").alias("kind")))


def signatures(files: DataFrame) -> DataFrame:
    """Channel set of every (position, time)."""
    return files.groupBy("position", "time_id").agg(
        F.array_sort(F.collect_set("channel")).alias("channels"), F.min("mtime").alias("mtime"), F.count(F.lit(1)).alias("files")
    )


def expected_channels(points: DataFrame) -> DataFrame:
    """Per position the widest channel set, then the most frequent, then the smallest in order."""
    counted = points.groupBy("position", "channels").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("position").orderBy(F.desc(F.size("channels")), F.desc("n"), "channels")
    return counted.withColumn("k", F.row_number().over(best)).filter("k = 1").select("position", F.col("channels").alias("expected"))


def complete_points(files: DataFrame) -> DataFrame:
    """Time points with exactly the expected channels, indexed in order, with elapsed seconds from the first."""
    points = signatures(files)
    whole = points.join(expected_channels(points), "position").filter("channels = expected AND files = size(channels)")
    line = Window.partitionBy("position").orderBy("time_id")
    start = F.min("mtime").over(Window.partitionBy("position"))
    seconds = F.unix_timestamp(F.col("mtime").cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))
    return whole.select("position", "time_id", F.row_number().over(line).alias("index"), seconds.alias("elapsed"), F.size("channels").alias("n_channels"))


def slot_conflicts(files: DataFrame) -> DataFrame:
    """Slots claimed by several files: all claimants are withheld and named."""
    claimed = files.groupBy("position", "time_id", "channel").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("size")).alias("claimants"))
    return claimed.filter("n > 1").select("position", "time_id", "channel", F.array_join(F.transform("claimants", lambda x: x.cast("string")), ",").alias("claimants"))


def slot_problems(slots: DataFrame) -> DataFrame:
    """Channels an output order needs, and why it is refused (empty, or whole and half widths mixed)."""
    used = F.col("side") != "skip"
    problem = F.when(F.count_if(used) == 0, "empty").when(F.bool_or(F.col("side") == "whole") & F.bool_or(F.col("side").isin("left", "right")), "mixed widths")
    return slots.groupBy("selection").agg(F.count(F.lit(1)).alias("slots"), F.max(F.when(used, F.col("channel"))).alias("required"), problem.alias("problem"))


def majority(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most common value per key; a tie for the first place is refused (NULL, ``tie``)."""
    counted = values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = counted.withColumn("r", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("n")))).filter("r = 1")
    return ranked.groupBy(*keys).agg(F.when(F.count(F.lit(1)) == 1, F.min(value)).alias(value), (F.count(F.lit(1)) > 1).alias("tie"))


def gaps(points: DataFrame) -> DataFrame:
    """Missing runs in the time numbers of a position."""
    line = Window.partitionBy("position").orderBy("time_id")
    return points.withColumn("before", F.lag("time_id").over(line)).filter("time_id <> before + 1").select(
        "position", (F.col("before") + 1).alias("from"), (F.col("time_id") - 1).alias("to")
    )


def latest_manifest(log: DataFrame) -> DataFrame:
    """Latest state of every input from an append-only log.

    Rows: path, size, modified, status, format, seq. Formats written since the input last
    changed add up; corrupt rows (no path, size or status) are skipped.
    """
    rows = log.filter("path IS NOT NULL AND size IS NOT NULL AND status IS NOT NULL").withColumn("key", F.lower("path"))
    line = Window.partitionBy("key").orderBy("seq")
    changed = F.coalesce((F.lag("size").over(line) != F.col("size")) | (F.lag("modified").over(line) != F.col("modified")), F.lit(True))
    runs = rows.withColumn("changed", changed.cast("int")).withColumn("run", F.sum("changed").over(line))
    now = runs.withColumn("latest", F.max("run").over(Window.partitionBy("key"))).filter("run = latest")
    return now.groupBy("key").agg(
        F.max_by("size", "seq").alias("size"), F.max_by("modified", "seq").alias("modified"), F.max_by("status", "seq").alias("status"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") == "OK", F.col("format")))), ",").alias("formats"),
    )


def not_done(files: DataFrame, manifest: DataFrame, fmt: str) -> DataFrame:
    """Inputs without a successful entry in this format for their present size and time."""
    done = manifest.filter(F.array_contains(F.split("formats", ","), fmt)).select("key", F.col("size").alias("s"), F.col("modified").alias("m"))
    return files.join(done, (F.lower(files["path"]) == done["key"]) & (files["size"] == done["s"]) & (files["modified"] == done["m"]), "left_anti")


def unnamed_by_outputs(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Inputs (name) whose name occurs in no output's name.

    Names contain others by chance (``f1`` in ``f12-maxZ``), so ``not_done`` is the safe choice. Containment
    is an equi-join: outputs give all their parts of the lengths that inputs have, and a file name is at
    most 255 long, so both the lengths and the parts of a name are few.
    """
    lengths = inputs.select(F.length("name").alias("n")).distinct()
    parts = outputs.join(lengths, F.col("n") <= F.length("name")).withColumn("at", F.explode(F.sequence(F.lit(1), F.length("name") - F.col("n") + 1)))
    return inputs.join(parts.select(F.expr("substring(name, at, n)").alias("name")).distinct(), "name", "left_anti")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, changed and removed files between two listings (path, size, mtime)."""
    a = old.select("path", F.struct("size", "mtime").alias("was"))
    b = new.select("path", F.struct("size", "mtime").alias("now"))
    both = a.join(b, "path", "full_outer")
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return both.select("path", state.alias("change")).filter("change IS NOT NULL")


def paired_frames(series: DataFrame, members: int) -> DataFrame:
    """Time numbers present in every member of a group."""
    return series.groupBy("group", "time").agg(F.countDistinct("member").alias("n"), F.array_sort(F.collect_list(F.struct("member", "path"))).alias("files")).filter(F.col("n") == members)


def placements(sources: DataFrame, matrices: DataFrame, flip_left: bool, half_width: int) -> DataFrame:
    """``source, mirror, m00 ... m12``: whether a camera half is mirrored, and the matrix to apply after that (NULL: none).

    ``sources``: source key, channel, side (left, right, whole). ``matrices``: source (NULL for the bare
    matrix of a single-matrix file), m00 ... m12, is_reference. A source has its own matrix; a
    bare one goes for every right half. Whole-width sources are never mirrored and take only a
    matrix of their own name. With ``flip_left`` the left halves are mirrored instead, and a matrix M
    becomes F A^-1 M F, with A the matrix of the right half of the reference's channel (or the bare one)
    and F the mirror of a half: the same result seen from the other side. Identities are NULL.
    """
    six = list(mx.SIX)
    own = matrices.filter("source IS NOT NULL")
    bare = matrices.filter("source IS NULL").select(F.lit("right").alias("side"), *[F.col(k).alias(f"b_{k}") for k in six])
    joined = sources.join(own.select("source", *six), "source", "left").join(bare, "side", "left")
    stored = [F.coalesce(F.col(k), F.col(f"b_{k}")) for k in six]
    placed = joined.select("source", "channel", "side", *[c.alias(k) for k, c in zip(six, stored)])
    mirror = F.when(F.col("side") == "whole", False).otherwise(F.col("side") == ("left" if flip_left else "right"))
    one = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    if flip_left:
        # The frame is the right half of the reference's own channel; the bare matrix is a right half's, too.
        reference = own.filter("is_reference").select(F.regexp_extract("source", "^_Channel([0-9]+)", 1).cast("int").alias("channel"))
        anchor = own.join(reference.withColumn("key", F.concat(F.format_string("_Channel%04d", "channel"), F.lit("-right"))).select("key"), F.col("source") == F.col("key")).select(*six)
        # The named one goes before the bare one, wherever their rows lie.
        both = anchor.withColumn("bare", F.lit(1)).union(matrices.filter("source IS NULL").select(*six, F.lit(2)))
        frame = both.agg(F.min(F.struct("bare", *six)).alias("first")).filter("first IS NOT NULL").select(*[F.col(f"first.{k}").alias(f"a_{k}") for k in six])
        rows = placed.join(frame, F.lit(True), "left")  # one row at most
        f = mx.mirror_x(F.lit(float(half_width)))
        m = [F.coalesce(F.col(k), F.lit(d)) for k, d in zip(six, one)]
        a = [F.coalesce(F.col(f"a_{k}"), F.lit(d)) for k, d in zip(six, one)]
        framed = mx.product2(f, mx.product2(mx.inverse2(a), mx.product2(m, f)))
        moved = [F.when(F.col("side") == "whole", F.col(k)).otherwise(c) for k, c in zip(six, framed)]
        placed = rows.select("source", "channel", "side", *[c.alias(k) for k, c in zip(six, moved)])
    same = F.lit(True)
    for k, d in zip(six, one):
        same = same & (F.abs(F.col(k) - d) < 1e-12)
    return placed.select("source", mirror.alias("mirror"), *[F.when(~same, F.col(k)).alias(k) for k in six])


def output_clashes(outputs: DataFrame) -> DataFrame:
    """Datasets whose output another one also writes; all of them are refused."""
    return outputs.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.lower("output")))).filter("n > 1").select("dataset", "output")


def _file_reason():
    """Why a file is left out before it may decide what the others should be."""
    named, slices = F.col("named_depth"), F.col("slices")
    by_folder = named.isNull() & (F.col("planes") > 0) & (F.col("stored_channels") == 1) & (F.col("frames") == 1) & (slices != F.col("planes"))
    return F.when(~F.col("readable"), "unreadable").when(named != slices, "depth differs from its name").when(by_folder, "depth differs from its folder's")


FILES_PER_TASK = 250_000


def _dealt(files: DataFrame) -> DataFrame:
    """Files dealt by dataset, so that a task has some FILES_PER_TASK of them however many there are.

    Sorted, files are many times longer than in a shuffle, by whose bytes tasks would be merged. Fewer tasks
    than the session's shuffles have would be dealt anew by the joins.
    """
    number = files.count()
    if number <= FILES_PER_TASK:
        return files.repartition("dataset")
    return files.repartition(max(number // FILES_PER_TASK + 1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "dataset")


def conversion_plan(sources: DataFrame, parameters: DataFrame, split: bool = False) -> tuple[DataFrame, DataFrame]:
    """(plan, left out): a row per dataset with its shape, layout, sampling, counts and the reason to refuse it; and files with reasons.

    ``sources``: path, dataset, output, time_no, channel, width, height, slices, stored_channels, frames,
    named_depth, readable, pixel, dz. ``parameters``: dataset, planes, roi_width, roi_height. Each file
    is checked on its own first; then the shape that most sound files share holds, and others are left
    out; a tie is no answer. Slots must not be doubled, incomplete time points are left out, sampling must
    agree, halves need whole and even camera widths, and no two datasets may write one output.
    """
    group, point = Window.partitionBy("dataset"), Window.partitionBy("dataset", "time_no")
    known = _dealt(sources).join(parameters, "dataset", "left").withColumn("reason", _file_reason())
    shaped = known.withColumn("shape", F.concat_ws("x", "width", "height", "slices", "stored_channels", "frames"))
    sound = F.col("reason").isNull() & F.col("dataset").isNotNull()
    ranked = shaped.withColumn("n", F.count(F.when(sound, 1)).over(Window.partitionBy("dataset", "shape"))).withColumn("most", F.nullif(F.max("n").over(group), F.lit(0)))
    leading = F.when(F.col("n") == F.col("most"), F.col("shape"))
    voted = ranked.withColumns({"first": F.min(leading).over(group), "last": F.max(leading).over(group)})
    voted = voted.withColumns({"common": F.when(F.col("first") == F.col("last"), F.col("first")), "shape_tie": F.col("first") != F.col("last")})
    sorted_out = voted.withColumn("reason", F.coalesce("reason", F.when(F.col("common").isNotNull() & (F.col("shape") != F.col("common")), "other shape")))
    good = F.col("reason").isNull() & F.col("common").isNotNull()
    channels = F.collect_set(F.when(F.col("good"), F.col("channel")))
    checked = sorted_out.withColumn("good", good).withColumns({"channels": F.size(channels.over(group)).cast("long"), "have": F.size(channels.over(point)).cast("long"), "sound": F.max("good").over(point) & F.col("time_no").isNotNull()})

    # The sums of a time point, then those of its dataset: both lie in the task that has the dataset.
    own = lambda k: F.when(F.col("good"), F.col(k))
    most = {"channels": "channels", "width": "width", "height": "height", "stored": "stored_channels", "roi_width": "roi_width", "roi_height": "roi_height", "pixel_to": "pixel", "dz_to": "dz"}
    points = checked.groupBy("dataset", "time_no").agg(
        F.max("common").alias("common"), F.bool_or("shape_tie").alias("shape_tie"), *[F.max(own(k)).alias(n) for n, k in most.items()], F.min(own("pixel")).alias("pixel"), F.min(own("dz")).alias("dz"),
        F.max(own("have")).alias("have"), F.count_if("good").alias("files"),
    )
    told = lambda rule: F.when(F.count("have") > 0, F.count_if(F.expr(rule)))
    counted = points.groupBy("dataset").agg(
        F.max("common").alias("common"), F.bool_or("shape_tie").alias("shape_tie"), *[F.max(n).alias(n) for n in most], F.min("pixel").alias("pixel"), F.min("dz").alias("dz"),
        told("have = channels AND files = have").alias("points"), told("have < channels").alias("incomplete"), told("files > have").alias("conflicts"),
    ).withColumn("uneven", (F.col("pixel_to") > F.col("pixel")) | (F.col("dz_to") > F.col("dz")))
    clashes = output_clashes(sources.select("dataset", "output").distinct()).select("dataset", F.lit(True).alias("clash"))
    whole = (F.coalesce(F.col("stored"), F.lit(1)) == 1) & (F.col("roi_width").isNull() | ((F.col("width") == F.col("roi_width")) & (F.col("height") == F.col("roi_height"))))
    layout = F.when(F.col("width").isNull(), None).when(~whole, "stored").otherwise("halves" if split else "whole")
    reason = (
        F.when(F.col("shape_tie"), "no majority shape").when(F.col("points").isNull(), "no sound file").when(F.col("conflicts") > 0, "conflicting files").when(F.col("points") == 0, "no complete time point")
        .when(F.col("uneven"), "sampling differs").when(F.lit(split) & ~whole, "halves need whole widths").when(F.lit(split) & (F.col("width") % 2 != 0), "odd width").when(F.col("clash"), "output clash")
    )
    every = counted.join(clashes, "dataset", "left")
    plan = every.select("dataset", F.col("common").alias("shape"), layout.alias("layout"), "channels", "points", "incomplete", "conflicts", "pixel", "dz", reason.alias("refused"))
    left = checked.withColumn("reason", F.coalesce("reason", F.when(F.col("sound") & (F.col("have") < F.col("channels")), "incomplete time point")))
    return plan, left.filter("reason IS NOT NULL").select("dataset", "path", "reason")
