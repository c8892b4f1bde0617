"""Axis projections, display ranges and robust statistics of voxel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.rounding import half_up, mean_uint16, saturate

OTHER = {"x": ("z", "y"), "y": ("z", "x"), "z": ("y", "x")}


def reducer(kind: str, v: str = "v") -> Column:
    """Integer projection of a line of voxels: max, min, mean, sum, median, std."""
    count = F.count(F.lit(1))
    match kind:
        case "max":
            return F.max(v)
        case "min":
            return F.min(v)
        case "sum":
            return saturate(F.sum(v))
        case "mean":
            return mean_uint16(F.sum(v), count)
        case "median":
            return half_up(F.median(v))
        case "std":
            return F.when(count < 2, F.lit(0).cast("long")).otherwise(saturate(half_up(F.stddev_samp(v))))
    raise ValueError(f"unknown projection {kind}")


def projection(voxels: DataFrame, axis: str, kind: str, keys=("t", "c")) -> DataFrame:
    """One projection: the two remaining axes are the image."""
    return voxels.groupBy(*keys, *OTHER[axis]).agg(reducer(kind).alias("v"))


def six_projections(voxels: DataFrame, keys=("t", "c")) -> DataFrame:
    """Max and mean along every axis in one traversal: ``keys, view, h, w, max_v, mean_v``.

    Grouping sets expand a voxel into three partial groups that are combined on the
    map side; the volume is read once.
    """
    names = ", ".join(keys)
    grouped = voxels.groupingSets(
        [[*keys, "y", "z"], [*keys, "x", "z"], [*keys, "x", "y"]], *keys, "z", "y", "x"
    ).agg(F.max("v").alias("max_v"), mean_uint16(F.sum("v"), F.count(F.lit(1))).alias("mean_v"), F.grouping_id().alias("g"))
    view = F.expr("CASE WHEN x IS NULL THEN 'X' WHEN y IS NULL THEN 'Y' ELSE 'Z' END")
    # X: (depth, height), Y: (width, depth), Z: (width, height)
    w = F.expr("CASE WHEN x IS NULL THEN z ELSE x END")
    h = F.expr("CASE WHEN x IS NULL THEN y WHEN y IS NULL THEN z ELSE y END")
    return grouped.select(*keys, view.alias("view"), h.alias("h"), w.alias("w"), "max_v", "mean_v")


def grouped_median_z(voxels: DataFrame, group: int) -> DataFrame:
    """Median of the means of consecutive groups of planes: the bounded form for very deep stacks."""
    means = voxels.groupBy("t", "c", "y", "x", F.floor(F.col("z") / group).alias("g")).agg(F.avg("v").alias("m"))
    return means.groupBy("t", "c", "y", "x").agg(half_up(F.median("m")).alias("v"))


def movie(voxels: DataFrame, axis: str, kind: str) -> DataFrame:
    """One projection per time point of every channel, frames numbered from 0."""
    frames = projection(voxels, axis, kind)
    order = voxels.select("c", "t").distinct().withColumn("frame", F.row_number().over(Window.partitionBy("c").orderBy("t")) - 1)
    return frames.join(order, ["c", "t"])


def histogram(voxels: DataFrame, keys: list[str]) -> DataFrame:
    return voxels.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))


def saturated_range(voxels: DataFrame, keys: list[str], saturated: float) -> DataFrame:
    """Display range that lets ``saturated`` percent of the voxels clip, half on each side.

    Works on the histogram: rows of a window are distinct values, not voxels.
    """
    hist = histogram(voxels, keys)
    up = Window.partitionBy(*keys).orderBy("v")
    down = Window.partitionBy(*keys).orderBy(F.desc("v"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    tails = hist.select(*keys, "v", F.sum("n").over(up).alias("below"), F.sum("n").over(down).alias("above"), (total * (saturated / 200.0)).alias("cut"))
    return tails.groupBy(*keys).agg(F.min(F.when(F.col("below") > F.col("cut"), F.col("v"))).alias("low"), F.max(F.when(F.col("above") > F.col("cut"), F.col("v"))).alias("high"))


def next_stage(previous: int) -> int:
    """Divisor of the next automatic range: half the last one; the cycle begins, and begins again after one under ten, at 5000."""
    return previous // 2 if previous >= 10 else 5000


def auto_range(voxels: DataFrame, keys: list[str], previous: int = 0, bins: int = 256) -> DataFrame:
    """Staged automatic range over ``bins`` equal bins: ``keys, low, high, stage``.

    A bin counts if it holds more than n/stage voxels and no more than n/10 (fuller ones are
    background). The range goes from the first to the last bin that counts. Where none does, the
    cycle ends (stage 0) with the full range; a single bin gives the full range, too. The full
    range of a constant volume is one unit wide. Values come from a histogram, in two aggregates.
    """
    stage = next_stage(previous)
    ends = voxels.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("total"))
    span = (F.col("hi") - F.col("lo")).cast("double")
    place = F.when(span == 0, 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) * (F.lit(float(bins)) / span)), F.lit(bins - 1)))
    counts = histogram(voxels, keys).join(ends, keys).groupBy(*keys, "lo", "hi", "total", place.alias("bin")).agg(F.sum("n").alias("n"))
    fit = (F.col("n") > F.floor(F.col("total") / stage)) & (F.col("n") <= F.floor(F.col("total") / 10))
    ranged = counts.groupBy(*keys, "lo", "hi").agg(
        F.coalesce(F.min(F.when(fit & (F.col("bin") < bins - 1), F.col("bin"))), F.lit(bins - 1)).alias("first"),
        F.coalesce(F.max(F.when(fit & (F.col("bin") > 0), F.col("bin"))), F.lit(0)).alias("last"),
    )
    full = F.when(span == 0, F.col("lo") + 1).otherwise(F.col("hi"))
    whole = (F.col("last") <= F.col("first")) | (span == 0)
    low = F.when(whole, F.col("lo")).otherwise(F.col("lo") + F.col("first") * (span / bins))
    high = F.when(whole, full).otherwise(F.col("lo") + F.col("last") * (span / bins))
    return ranged.select(*keys, low.cast("double").alias("low"), high.cast("double").alias("high"), F.when(F.col("last") < F.col("first"), 0).otherwise(stage).alias("stage"))


def trimmed_range(voxels: DataFrame, keys: list[str], partner: Column, share: float = 0.00005) -> DataFrame:
    """Tail-trimmed range per channel; a blank channel (no spread) takes its partner's."""
    ranges = saturated_range(voxels, keys, share * 200)
    other = ranges.withColumnsRenamed({"low": "plow", "high": "phigh", "c": "pc", "t": "pt"})
    joined = ranges.withColumn("_p", partner).join(other, [F.col("t") == F.col("pt"), F.col("_p") == F.col("pc")], "left")
    blank = F.col("low") >= F.col("high")
    return joined.select(*keys, F.when(blank, F.coalesce("plow", "low")).otherwise(F.col("low")).alias("low"), F.when(blank, F.coalesce("phigh", "high")).otherwise(F.col("high")).alias("high"))


def median_mad(voxels: DataFrame, keys: list[str]) -> DataFrame:
    """Median and 1.4826 * MAD, exactly, in two passes."""
    middle = voxels.groupBy(*keys).agg(F.median("v").alias("median"))
    spread = voxels.join(middle, keys).groupBy(*keys, "median").agg(F.median(F.abs(F.col("v") - F.col("median"))).alias("mad"))
    return spread.select(*keys, "median", (F.col("mad") * 1.4826).alias("sigma"))


def _upper_median(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, median``: the order statistic n // 2 (from 0) of a histogram (keys, value, n)."""
    up_to = F.sum("n").over(Window.partitionBy(*keys).orderBy(value))
    placed = counts.select(*keys, value, up_to.alias("_up"), F.sum("n").over(Window.partitionBy(*keys)).alias("_n"))
    return placed.filter(F.col("_up") > F.floor(F.col("_n") / 2)).groupBy(*keys).agg(F.min(value).alias("median"))


def order_median_mad(voxels: DataFrame, keys: list[str], scale: float = 1 / 0.6744897501960817) -> DataFrame:
    """``keys, median, sigma`` by order statistics: of n values the one at n // 2, no mean of two; sigma is scale * that of the distances from it.

    Both come from histograms, so windows sort distinct values and not voxels.
    """
    counts = histogram(voxels, keys)
    middle = _upper_median(counts, keys, "v")
    apart = counts.join(middle, keys).groupBy(*keys, "median", F.abs(F.col("v") - F.col("median")).alias("d")).agg(F.sum("n").alias("n"))
    spread = _upper_median(apart.select(*keys, "d", "n"), keys, "d").withColumnRenamed("median", "mad")
    return middle.join(spread, keys).select(*keys, "median", (F.col("mad") * scale).alias("sigma"))


LEAST_ROI = 64


def roi_background(voxels: DataFrame, keys: list[str], box: tuple[int, int, int, int], width: int, height: int) -> DataFrame:
    """``keys, median, sigma`` of the region (x, y, w, h) of planes, by order statistics.

    A region of fewer than 64 pixels or outside the image is refused; a plane with a value in it that
    is not finite has no estimate.
    """
    x, y, w, h = box
    if w * h < LEAST_ROI:
        raise ValueError(f"a background region has {LEAST_ROI} pixels at least")
    if min(x, y) < 0 or x + w > width or y + h > height:
        raise ValueError("the background region lies outside the image")
    inner = voxels.filter(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)).withColumn("v", F.col("v").cast("double"))
    spoiled = inner.filter(F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf"))).select(*keys).distinct()
    return order_median_mad(inner.join(spoiled, keys, "left_anti"), keys)


def plane_digests(voxels: DataFrame, top: int) -> DataFrame:
    """Content hash of a volume as a hash of its planes' hashes, and its saturated voxels."""
    pixels = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda p: p["v"].cast("string")), ",")
    planes = voxels.groupBy("t", "c", "z").agg(F.sha2(pixels, 256).alias("h"), F.count_if(F.col("v") >= top).alias("s"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("z", "h"))), lambda p: p["h"]), "")
    return planes.groupBy("t", "c").agg(F.sha2(ordered, 256).alias("digest"), F.sum("s").alias("saturated"))


def saturating_product(*factors: Column) -> Column:
    """Product of sizes, capped at the largest long instead of overflowing."""
    out = factors[0].cast("long")
    for f in factors[1:]:
        out = F.coalesce(F.try_multiply(out, f.cast("long")), F.lit(2**63 - 1))
    return out
