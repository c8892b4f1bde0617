"""Joins over detected spots: cell-bucketed range joins, mutual matches, votes, rigid fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.streaming.jobs import shared_folder


def cells(points: DataFrame, axes: dict[str, float], spread: bool) -> DataFrame:
    """Bucket key per axis (floor(position / radius)); ``spread`` also lists the neighbouring cells.

    Two points within the radius lie in the same or adjacent cells, so an equi-join of one
    plain side and one spread side finds every pair without comparing all of them.
    """
    out = points
    for axis, radius in axes.items():
        cell = F.floor(F.col(axis) / radius).cast("long")
        out = out.withColumn(f"_{axis}", F.explode(F.array(cell - 1, cell, cell + 1)) if spread else cell)
    return out


def close_pairs(left: DataFrame, right: DataFrame, axes: dict[str, float], inside: Column, same: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (columns of left as a_*, of right as b_*) that agree in the columns ``same`` and for which ``inside`` holds.

    The planner takes the spread side for as small as its source, so it is told not to send it to all tasks.
    """
    keys = [*(f"_same_{k}" for k in same), *(f"_{a}" for a in axes)]
    held = [F.col(k).alias(f"_same_{k}") for k in same] + [F.col(c) for c in axes]
    a = cells(left.select([F.col(c).alias(f"a_{c}") for c in left.columns] + held), axes, False).drop(*axes)
    b = cells(right.select([F.col(c).alias(f"b_{c}") for c in right.columns] + held), axes, True).drop(*axes)
    return a.hint("shuffle_hash").join(b, keys).drop(*keys).filter(inside)


def crowded(points: DataFrame, radii: dict[str, float], inside: Column) -> DataFrame:
    """``id`` of the points that have another one ``inside`` (of a_* and b_*), which holds for all points near enough to each other.

    Cells are a third smaller than the radii. Where the box around a cell's points is itself inside, all of them
    have another one; it takes no pairs. The other points, one to a crowded place, are compared with those of the cells around: the
    number of pairs grows with the points, whatever their density.
    """
    least = F.lit(True)
    for axis in radii:
        least = least & F.col(axis).isNotNull() & (F.abs(axis) < float("inf"))
    keyed = points.select("id", *radii).filter(least)
    cell = {f"_{k}": F.floor(F.col(k) / (r / 1.5)).cast("long") for k, r in radii.items()}
    keyed = keyed.withColumns(cell)
    ends = [e for k in radii for e in (F.min(k).alias(f"a_{k}"), F.max(k).alias(f"b_{k}"))]
    boxes = keyed.groupBy(*cell).agg((F.min("id") != F.max("id")).alias("several"), *ends)
    boxes = boxes.select(*cell, (F.col("several") & inside).alias("all"))
    known = keyed.join(boxes.hint("shuffle_hash"), list(cell))
    rest = known.filter("NOT all").select(F.col("id").alias("a_id"), *[F.col(k).alias(f"a_{k}") for k in radii], *cell)
    for k in cell:
        rest = rest.withColumn(k, F.explode(F.array(*[F.col(k) + d for d in (-2, -1, 0, 1, 2)])))
    others = keyed.select(F.col("id").alias("b_id"), *[F.col(k).alias(f"b_{k}") for k in radii], *cell)
    met = rest.hint("shuffle_hash").join(others, list(cell)).filter((F.col("a_id") != F.col("b_id")) & inside)
    return known.filter("all").select("id").union(met.select(F.col("a_id").alias("id")))


def _distance2(scale: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for axis, s in scale.items():
        d = (F.col(f"a_{axis}") - F.col(f"b_{axis}")) / s
        total = total + d * d
    return total


def credible(points: DataFrame, others: int, own: int) -> DataFrame:
    """The brightest of ``own`` points, three times as many as there are others but 100 at least: fainter ones are no match for them."""
    most = max(100, 3 * others)
    return points if most >= own else brightest_many(points, most)


def brightest_many(points: DataFrame, n: int) -> DataFrame:
    """As ``brightest``, for numbers that no single task should hold: the sorted table is kept, and its places up to the n-th are read."""
    spark = points.sparkSession
    folder = shared_folder(spark)
    sorted_ = points.orderBy(F.desc("response"), "y", "x", "id").withColumn("_place", F.monotonically_increasing_id())
    sorted_.write.parquet(folder)
    kept = spark.read.parquet(folder)
    # A place is the number of the part over the number in it; parts follow each other, and there are few of them.
    left, end = n, None
    for r in kept.groupBy(F.expr("shiftright(_place, 33)").alias("part")).count().orderBy("part").toLocalIterator():
        if left <= r["count"]:
            end = (r["part"] << 33) + left
            break
        left -= r["count"]
    return (kept if end is None else kept.filter(F.col("_place") < end)).drop("_place")


def _nearest(points: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """``id, other, d2``: the nearest other point within a radius, ties to the smaller id.

    Radii grow to the full one: a point that has one nearer than a smaller radius takes no part in the next, so that dense
    places are compared inside small cells only. The best is an aggregate; pairs are not shuffled.
    """
    spark, out, left = points.sparkSession, None, points
    d2 = _distance2({"x": 1.0, "y": 1.0})
    for r in (radius / 16, radius / 4, radius):
        pairs = close_pairs(left, others, {"x": r, "y": r}, d2 <= r * r)
        folder = shared_folder(spark)
        pairs.groupBy(F.col("a_id").alias("id")).agg(F.min(F.struct(d2.alias("d2"), F.col("b_id").alias("other"))).alias("best")).select("id", "best.other", "best.d2").write.parquet(folder)
        found = spark.read.parquet(folder)
        out = found if out is None else out.union(found)
        left = left.join(found.select("id").hint("shuffle_hash"), "id", "left_anti")
    return out


def mutual_matches(fixed: DataFrame, moving: DataFrame, coarse: tuple[float, ...], radius: float) -> DataFrame:
    """Pairs of credible points that are each other's nearest within a radius after a coarse map; ties go to the smaller id.

    ``coarse`` is a shift (x, y) or a 2x3 matrix from moving to fixed. Of points at one place only the one with the smallest id
    can be a nearest one, so the others take no part.
    """
    a, b, c, d, e, f = coarse if len(coarse) == 6 else (1.0, 0.0, coarse[0], 0.0, 1.0, coarse[1])
    counts = fixed.count(), moving.count()
    fixed, moving = credible(fixed, counts[1], counts[0]), credible(moving, counts[0], counts[1])
    spark, sides = fixed.sparkSession, []
    for side in (fixed, moving.select("id", (a * F.col("x") + b * F.col("y") + c).alias("x"), (d * F.col("x") + e * F.col("y") + f).alias("y"))):
        folder = shared_folder(spark)
        side.groupBy("x", "y").agg(F.min("id").alias("id")).select("id", "x", "y").write.parquet(folder)
        sides.append(spark.read.parquet(folder))
    of_fixed = _nearest(*sides, radius).select(F.col("id").alias("fixed_id"), F.col("other").alias("moving_id"), "d2")
    wanted = sides[1].join(of_fixed.select(F.col("moving_id").alias("id")).distinct().hint("shuffle_hash"), "id", "left_semi")
    of_moving = _nearest(wanted, sides[0], radius).select(F.col("other").alias("fixed_id"), F.col("id").alias("moving_id"))
    return of_fixed.join(of_moving.hint("shuffle_hash"), ["fixed_id", "moving_id"])


def brightest(points: DataFrame, n: int) -> DataFrame:
    return points.orderBy(F.desc("response"), "y", "x", "id").limit(n)


def shift_votes(fixed: DataFrame, moving: DataFrame, limit_x: float, limit_y: float, top: int = 300, bin_size: float = 2.0) -> DataFrame:
    """``dx, dy, votes`` of all pairs of the brightest spots for a bounded shift in bins of ``bin_size`` pixels.

    Differences are rounded to whole pixels before they are bounded, and these to bins, halves up.
    Both sides hold at most ``top`` rows by definition, so the pairing is bounded.
    """
    a = brightest(fixed, top).select(F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = brightest(moving, top).select(F.col("x").alias("bx"), F.col("y").alias("by"))
    moves = a.crossJoin(b).select(F.floor(F.col("ax") - F.col("bx") + 0.5).alias("dx"), F.floor(F.col("ay") - F.col("by") + 0.5).alias("dy"))
    near = moves.filter((F.abs("dx") <= limit_x) & (F.abs("dy") <= limit_y))
    binned = {k: (F.floor(F.col(k) / bin_size + 0.5) * bin_size).cast("long") for k in ("dx", "dy")}
    return near.groupBy(*[c.alias(k) for k, c in binned.items()]).agg(F.count(F.lit(1)).alias("votes"))


def isolated(points: DataFrame, radii: dict[str, float]) -> DataFrame:
    """Points whose ellipsoid holds no other point."""
    return points.join(crowded(points, radii, _distance2(radii) <= 1).distinct().hint("shuffle_hash"), "id", "left_anti")


def apart_from_others(points: DataFrame, distance: float, width: float, height: float, margin: float) -> DataFrame:
    """Drops both points of a pair closer than a distance (squared against squared), and border points."""
    inner = points.filter(F.col("x").between(margin, width - 1 - margin) & F.col("y").between(margin, height - 1 - margin))
    d2 = _distance2({"x": 1.0, "y": 1.0})
    return inner.join(crowded(points, {"x": distance, "y": distance}, d2 < distance * distance).distinct().hint("shuffle_hash"), "id", "left_anti")


def rigid_fit(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Closed-form rotation and shift of paired points (fx, fy) = R (mx, my) + t, with its RMS.

    One pass over sums; NULL under three pairs or without spread.
    """
    def s(e):
        return F.expr(f"sum({e})")

    sums = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("fx").alias("cfx"), F.avg("fy").alias("cfy"), F.avg("mx").alias("cmx"), F.avg("my").alias("cmy"),
        s("mx*fx + my*fy").alias("dot"), s("mx*fy - my*fx").alias("cross"), s("mx*mx + my*my").alias("mm"), s("fx*fx + fy*fy").alias("ff"),
    )
    centred = sums.withColumns({
        "_d": F.expr("dot - n * (cmx*cfx + cmy*cfy)"), "_k": F.expr("cross - n * (cmx*cfy - cmy*cfx)"),
        "sm": F.expr("mm - n * (cmx*cmx + cmy*cmy)"), "sf": F.expr("ff - n * (cfx*cfx + cfy*cfy)"),
    })
    angle = F.when((F.col("n") >= 3) & (F.col("sm") > 1e-9), F.atan2("_k", "_d"))
    turned = centred.withColumn("_a", angle)
    return turned.select(
        *keys, F.col("n").alias("pairs"), F.degrees("_a").alias("angle"),
        (F.col("cfx") - F.cos("_a") * F.col("cmx") + F.sin("_a") * F.col("cmy")).alias("dx"),
        (F.col("cfy") - F.sin("_a") * F.col("cmx") - F.cos("_a") * F.col("cmy")).alias("dy"),
        F.sqrt(F.greatest((F.col("sm") + F.col("sf") - 2 * F.hypot("_d", "_k")) / F.col("n"), F.lit(0.0))).alias("rms"),
    )


def local_maxima(planes: DataFrame) -> DataFrame:
    """Pixels strictly above their eight neighbours.

    Each pixel is offered to its neighbours and the offers are aggregated: one shuffle,
    however large the image.
    """
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    fed = planes.withColumn("o", F.explode(offsets))
    own = (F.col("o.dy") == 0) & (F.col("o.dx") == 0)
    around = fed.groupBy("t", "c", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).agg(
        F.max(F.when(own, F.col("v"))).alias("v"), F.max(F.when(~own, F.col("v"))).alias("around"), F.count_if(~own).alias("n")
    )
    return around.filter("v IS NOT NULL AND n = 8 AND v > around").select("t", "c", "y", "x", "v")


def parabola(minus: Column, centre: Column, plus: Column) -> Column:
    """Sub-pixel offset of a peak, at most half a pixel."""
    bend = minus - 2 * centre + plus
    return F.when(bend == 0, 0.0).otherwise(F.least(F.greatest((minus - plus) / (2.0 * bend), F.lit(-0.5)), F.lit(0.5)))


def first_maximum_z(voxels: DataFrame) -> DataFrame:
    """First plane of the maximum along z; NULL for a line without positive values."""
    best = voxels.groupBy("t", "c", "y", "x").agg(F.max_by("z", F.struct(F.col("v"), -F.col("z"))).alias("z"), F.max("v").alias("v"))
    return best.select("t", "c", "y", "x", F.when(F.col("v") > 0, F.col("z")).alias("z"))


def crops(voxels: DataFrame, beads: DataFrame, radius: dict[str, int]) -> DataFrame:
    """Voxels of a box around every bead, with offsets from its centre: an equi-join on plane and cell."""
    size = {k: 2 * r + 1 for k, r in radius.items()}
    b = beads
    for k, r in radius.items():
        b = b.withColumn(f"_{k}", F.explode(F.sequence(F.floor((F.col(f"b{k}") - r) / size[k]), F.floor((F.col(f"b{k}") + r) / size[k]))))
    v = voxels.withColumns({f"_{k}": F.floor(F.col(k) / size[k]) for k in radius})
    joined = v.join(b, ["t", "c", *[f"_{k}" for k in radius]])
    for k, r in radius.items():
        joined = joined.withColumn(f"d{k}", F.col(k) - F.col(f"b{k}")).filter(F.abs(f"d{k}") <= r)
    return joined.select("bead", *[f"d{k}" for k in radius], "v")
