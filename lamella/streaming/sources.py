"""Streaming sources: a folder listing that reports changed files again, a growing store."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from lamella.sources.ome_zarr import _load, _save, metadata
from lamella.streaming.jobs import shared_folder


class FolderReader(SimpleDataSourceStreamReader):
    """Each trigger lists the folder and reports what was added, changed or removed since the last look.

    A look is kept as a file in ``listings``, a shared folder, and the offset is its number: a
    batch is the difference of two looks, so it can be told again after a failure. A file copied
    in with an older time is new all the same; a file that is gone is reported with size -1.
    """

    def __init__(self, options):
        if "listings" not in options:
            raise ValueError("folder_listing needs the option listings: a folder for its looks")
        self.root, self.listings = options["path"], options["listings"]
        self.suffixes = tuple(s for s in options.get("suffixes", "").split(",") if s)

    def initialOffset(self):
        return {"look": 0}

    def _look(self) -> dict:
        out = {}
        for folder, _, names in os.walk(self.root):
            for name in names:
                if not self.suffixes or name.endswith(self.suffixes):
                    path = os.path.join(folder, name)
                    try:
                        st = os.stat(path)
                    except OSError:
                        continue  # gone meanwhile; the next look repairs it
                    out[path] = [st.st_size, st.st_mtime_ns]
        return out

    def _known(self, number: int) -> dict:
        return _load(os.path.join(self.listings, f"{number}.json")) if number else {}

    @staticmethod
    def _difference(before: dict, after: dict):
        fresh = [(p, *x) for p, x in sorted(after.items()) if before.get(p) != x]
        return fresh + [(p, -1, x[1]) for p, x in sorted(before.items()) if p not in after]

    def read(self, start):
        number = int(start["look"])
        before, now = self._known(number), self._look()
        rows = self._difference(before, now)
        if rows:
            number += 1
            os.makedirs(self.listings, exist_ok=True)
            _save(os.path.join(self.listings, f"{number}.json"), now)
        return iter(rows), {"look": number}

    def readBetweenOffsets(self, start, end):
        return iter(self._difference(self._known(int(start["look"])), self._known(int(end["look"]))))

    def commit(self, end):
        pass


class FolderListing(DataSource):
    @classmethod
    def name(cls):
        return "folder_listing"

    def schema(self):
        return "path string, size long, mtime long"

    def simpleStreamReader(self, schema):
        return FolderReader(self.options)


class GrowingStoreReader(SimpleDataSourceStreamReader):
    """Committed time points of a store; known ones are not repeated."""

    def __init__(self, options):
        self.root = options["path"]

    def initialOffset(self):
        return {"committed": 0}

    def read(self, start):
        m = metadata(self.root)
        first, last = int(start["committed"]), m["committed"]
        labels = m["time_labels"]
        return iter([(self.root, t, labels[t] if t < len(labels) else None) for t in range(first, last)]), {"committed": max(first, last)}

    def readBetweenOffsets(self, start, end):
        labels = metadata(self.root)["time_labels"]
        return iter([(self.root, t, labels[t] if t < len(labels) else None) for t in range(int(start["committed"]), int(end["committed"]))])

    def commit(self, end):
        pass


class GrowingStore(DataSource):
    @classmethod
    def name(cls):
        return "growing_store"

    def schema(self):
        return "root string, t int, label string"

    def simpleStreamReader(self, schema):
        return GrowingStoreReader(self.options)


def announcements(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Announced paths of a line protocol: one path a line, blank lines ignored."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return lines.select(F.trim("value").alias("path")).filter("path <> ''")


def files_as_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table (a file or a folder) as a stream, with the table's own schema.

    The path is given as a pattern that only it matches, since a plain path must be a folder.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


ROWS_PER_FILE = 1_000_000


def replayed(rows: DataFrame, order: str, batches: int) -> DataFrame:
    """A table as a stream of several batches, in the order of a column: its ranges are written one after the other, each by the same number of tasks."""
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession)
    value = F.col(order).cast("timestamp").cast("double") if dict(rows.dtypes)[order].startswith("timestamp") else F.col(order).cast("double")
    ends = rows.select(value.alias("at")).approxQuantile("at", [k / batches for k in range(1, batches)], 0.001) if batches > 1 else []
    part = F.lit(0)
    for e in ends:
        part = part + (value > e).cast("int")
    files = rows.count() // (batches * ROWS_PER_FILE) + 1
    for k in range(batches):
        own = rows.filter(part == k)
        (own.repartition(files) if files > 1 else own.coalesce(1)).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)
