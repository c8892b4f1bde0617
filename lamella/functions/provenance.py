"""Provenance records: stamps, JSON settings and their versions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SCHEMA = "version int, pixel double, step double, angle double, voxel array<double>, sources array<array<string>>, matrices map<string,array<array<double>>>"
VERSIONS = (1, 2)


def utc_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def remaining_text(hours: Column) -> Column:
    return (
        F.when(hours >= 48, F.concat(F.floor(hours / 24).cast("string"), F.lit(" days"))).when(hours >= 1, F.concat(hours.cast("long").cast("string"), F.lit(" h")))
        .otherwise("less than an hour")
    )


def parse(text: Column) -> Column:
    """Record of a JSON text; NULL for a version that is not known."""
    record = F.from_json(text, SCHEMA)
    return F.when(record["version"].isin(*VERSIONS), record)


def _near(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))


def legacy_voxels(record: Column) -> Column:
    """Whether a record has the voxel pitches (x, y, z) that old writers gave a deskewed volume: pixel, pixel cos, step sin of the angle."""
    (x, y, z), a = [F.get(record["voxel"], F.lit(k)) for k in range(3)], F.radians(record["angle"])
    old = _near(x, record["pixel"]) & _near(y, record["pixel"] * F.cos(a)) & _near(z, record["step"] * F.sin(a))
    return F.coalesce((F.size(record["voxel"]) >= 3) & (record["pixel"] > 0) & old, F.lit(False))


def voxel_size(record: Column) -> Column:
    """Pitches (x, y, z) of a deskewed volume: its grid has the pixel's pitch on all axes, so legacy ones are replaced; NULL where none are recorded."""
    held = F.when(F.size(record["voxel"]) >= 3, record["voxel"])
    return F.when(legacy_voxels(record), F.array(*[record["pixel"]] * 3)).otherwise(held)


SKIP = "skip"
# What a deskew run may do with the camera halves of a single file, and the view that shows the same.
SINGLE_FILE = {
    "whole image": ("side_by_side", "all"), "fold by midline": ("flip", "all"), "align with SIFT": ("flip_align_right", "all"), "align with SIFT matrix": ("flip_align_right", "all"),
    "only left": ("stored", "left"), "only right": ("stored", "right"), "left & right separately": ("stored", "all"),
}


def view_of_settings(option: Column, combine: Column, order: Column, flip_half: Column, interpolate: Column, raw: Column | None = None) -> Column:
    """The view that shows a result as the run that wrote it asked for: ``operation, selection, sources, flip_half, interpolate``.

    A run that combined files takes its channels from the slots of ``order``, in their order and without the skipped
    ones: whole widths side by side, halves mirrored on the ``flip_half`` side and aligned. A run of single files
    always mirrors the right half. NULL for a raw dataset, for one of which nothing is recorded, and for
    an option that is not known.
    """
    sources = F.filter(F.coalesce(order, F.array().cast("array<string>")), lambda s: s.isNotNull() & (s != SKIP))
    combined = F.coalesce(combine, F.lit(False)) & (F.size(sources) > 0)
    whole = F.exists(sources, lambda s: ~s.rlike("-(left|right)$"))
    left = F.coalesce(flip_half == "left", F.lit(False))
    nothing = F.array().cast("array<string>")

    def view(operation, selection, chosen, side):
        return F.struct(operation.alias("operation"), selection.alias("selection"), chosen.alias("sources"), side.alias("flip_half"), interpolate.alias("interpolate"))

    together = F.when(whole, "side_by_side").when(left, "flip_align_left").otherwise("flip_align_right")
    single = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for k, v in SINGLE_FILE.items() for x in (k, v[i])]), option)
    out = F.when(combined, view(together, F.lit("configured"), sources, F.when(left & ~whole, "left").otherwise("right")))
    out = out.when(single(0).isNotNull(), view(single(0), single(1), nothing, F.lit("right")))
    return out if raw is None else F.when(~F.coalesce(raw, F.lit(False)), out)


def environment(spark: SparkSession) -> dict[str, Column]:
    """Literals that stamp a run."""
    return {"spark_version": F.lit(spark.version), "time_zone": F.lit(spark.conf.get("spark.sql.session.timeZone")), "written": utc_stamp(F.current_timestamp())}
