"""Looks at a folder by tasks: a listing is a table, a change is the difference of two of them.

A folder that grows over months has more files than a driver should walk or hold. A look lists one level of
folders after the other, the folders of a level dealt to tasks, and is kept as Parquet; what is
new, changed or gone since the last look is a join of two tables. Taken again after a failure, a look overwrites itself.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTING = "path string, size long, mtime long"
FOLDERS_PER_TASK = 64


def _scan(suffixes: tuple[str, ...]):
    """Entries of folders: files as (path, size, mtime), folders with size -2; what goes meanwhile is left to the next look."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for folder in pdf["path"]:
                try:
                    with os.scandir(folder) as entries:
                        for e in entries:
                            if e.is_dir(follow_symlinks=False):
                                rows.append((e.path, -2, 0))
                            elif not suffixes or e.name.endswith(suffixes):
                                st = e.stat()
                                rows.append((e.path, st.st_size, st.st_mtime_ns))
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "size", "mtime"])

    return run


def take_look(spark: SparkSession, root: str, looks: str, number: int, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """List ``root`` into ``looks`` as the look ``number``; (path, size, mtime) of its files.

    Each level of folders is one job; folders are dealt to tasks, FOLDERS_PER_TASK at a time.
    """
    level = 0
    folders = spark.createDataFrame([(root,)], "path string")
    while True:
        found = folders.mapInPandas(_scan(tuple(suffixes)), LISTING)
        found.write.mode("overwrite").parquet(_level(looks, number, level))
        below = spark.read.schema(LISTING).parquet(_level(looks, number, level)).filter("size = -2").select("path")
        n = below.count()
        if not n:
            return look(spark, looks, number)
        folders, level = below.repartition(max(1, n // FOLDERS_PER_TASK)), level + 1


def _level(looks: str, number: int, level: int) -> str:
    return f"{looks}/look={number}/level={level}"


def look(spark: SparkSession, looks: str, number: int) -> DataFrame:
    """A look taken before; the look 0 is empty. It ends with the first level that has no folders: deeper ones are left from a broken try."""
    if number == 0:
        return spark.createDataFrame([], LISTING)
    levels = [_level(looks, number, 0)]
    while not spark.read.schema(LISTING).parquet(levels[-1]).filter("size = -2").isEmpty():
        levels.append(_level(looks, number, len(levels)))
    return spark.read.schema(LISTING).parquet(*levels).filter("size <> -2")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, size, mtime`` of files that are new or differ, and of those that are gone with size -1."""
    old = before.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    both = after.join(old, "path", "full_outer")
    gone = F.col("size").isNull()
    same = F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime").eqNullSafe(F.col("_mtime"))
    told = both.filter(~same)
    return told.select("path", F.when(gone, F.lit(-1)).otherwise(F.col("size")).cast("long").alias("size"), F.when(gone, F.col("_mtime")).otherwise(F.col("mtime")).alias("mtime"))
