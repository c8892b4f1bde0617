"""Array-shaped views over the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOXELS = """voxels AS (
  SELECT event_id // 2000 AS t, (event_id // 1000) % 2 + 1 AS c, (event_id // 100) % 10 AS z,
         (event_id // 10) % 10 AS y, event_id % 10 AS x, CAST(floor(value * 100) AS INTEGER) AS v
  FROM events)"""

FILES = """files AS (
  SELECT 1 + o_orderkey % 3 + CASE WHEN o_orderstatus = 'P' THEN 3 ELSE 0 END AS position, o_orderkey // 12 AS time_id, 1 + (o_orderkey // 3) % 4 AS channel,
         o_orderdate AS mtime, o_orderkey AS size
  FROM orders)"""

POINTS = """points AS (
  SELECT p_partkey AS id, (p_partkey * 37) % 512 + p_size / 100.0 AS x,
         (p_partkey * 101) % 512 + (p_retailprice - floor(p_retailprice)) / 10 AS y, p_size AS response
  FROM part)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per voxel: 10x10x10 stacks, two channels, one time point per 2000 events."""
    return table(spark, sf_dir, "events").select(
        F.expr("event_id div 2000").alias("t"),
        F.expr("(event_id div 1000) % 2 + 1").alias("c"),
        F.expr("(event_id div 100) % 10").alias("z"),
        F.expr("(event_id div 10) % 10").alias("y"),
        F.expr("event_id % 10").alias("x"),
        F.expr("cast(floor(value * 100) as int)").alias("v"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per arriving file of a multi-position, multi-channel acquisition; what pending orders take from positions 1 to 3 is at 4 to 6."""
    return (
        table(spark, sf_dir, "orders")
        .select(
            F.expr("1 + o_orderkey % 3 + CASE WHEN o_orderstatus = 'P' THEN 3 ELSE 0 END").alias("position"),
            F.expr("o_orderkey div 12").alias("time_id"),
            F.expr("1 + (o_orderkey div 3) % 4").alias("channel"),
            F.col("o_orderdate").alias("mtime"),
            F.col("o_orderkey").alias("size"),
        )
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected spots: position inside 0..512 and a response."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.expr("(p_partkey * 37) % 512 + p_size / 100.0").cast("double").alias("x"),
        F.expr("(p_partkey * 101) % 512 + (p_retailprice - floor(p_retailprice)) / 10").cast("double").alias("y"),
        F.col("p_size").alias("response"),
    )


BEAD_SIDE, BEADS = 256, 200  # pixels a side, beads an image
DRAWN = 16  # images that one task draws

# Whole pixels of a part's bead. Keys are reduced before they are multiplied: the cube of a key from 2,097,152 on is no long.
BEAD_X = "(CAST(p_partkey AS BIGINT) % 196 * (p_partkey % 196) * 37 + 11 * (p_partkey % 196)) % 196"
BEAD_Y = "(CAST(p_partkey AS BIGINT) % 1009 * (p_partkey % 1009) * (p_partkey % 1009) % 1009 * 53 + 17 * p_partkey) % 196"


def bead_images(spark: SparkSession, sf_dir: str, wanted: DataFrame | None = None, channel: int | None = None) -> DataFrame:
    """``image, c, width, height, px``: pairs of images of the parts' positions as bright beads, BEADS to an image.

    ``wanted`` (image) and ``channel`` choose before anything is drawn: beads are joined and images are not.

    Channel 2 shows the beads of channel 1 turned by 0.05 degrees for each (image % 7) and shifted by
    (image % 11 - 20, 5 - image % 9) pixels, each channel without every ninth bead of its own.

    An image is over a hundred times longer than its beads, so the number of tasks follows the number of images
    and not the bytes of the beads, by which they would be merged into a few.
    """
    image = F.expr(f"p_partkey div {BEADS}")
    part = table(spark, sf_dir, "part")
    tasks = part.count() // (BEADS * DRAWN) + 1
    spots = part.select(
        image.alias("image"), F.col("p_partkey").alias("id"), (30 + F.expr(BEAD_X) + F.col("p_size") / 100.0).alias("x"), (30 + F.expr(BEAD_Y) + F.expr("p_partkey % 83") / 100.0).alias("y")
    )
    if wanted is not None:
        spots = spots.join(wanted.hint("shuffle_hash"), "image", "left_semi")
    both = spots.withColumn("c", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long")))).filter("(id + c * 4) % 9 <> 0")

    if channel is not None:
        both = both.filter(F.col("c") == channel)

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, c = key
        x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        if c == 2:
            a = np.radians(0.05 * (n % 7))
            x, y = x - (n % 11 - 20), y - (5 - n % 9)
            x, y = np.cos(a) * x + np.sin(a) * y, -np.sin(a) * x + np.cos(a) * y
        out = np.full((BEAD_SIDE, BEAD_SIDE), 100.0)
        gy, gx = np.mgrid[-8:9, -8:9]
        for px, py in zip(x, y):
            cx, cy = int(round(px)), int(round(py))
            if 8 <= cx < BEAD_SIDE - 8 and 8 <= cy < BEAD_SIDE - 8:
                out[cy - 8 : cy + 9, cx - 8 : cx + 9] += 900 * np.exp(-((gx + cx - px) ** 2 + (gy + cy - py) ** 2) / 8.0)
        return pd.DataFrame([(n, c, BEAD_SIDE, BEAD_SIDE, out.ravel())], columns=["image", "c", "width", "height", "px"])

    return both.repartition(tasks, "image", "c").groupBy("image", "c").applyInPandas(draw, "image long, c long, width int, height int, px array<double>")
